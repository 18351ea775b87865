"""Fingerprints from prefix polynomial hashes.

Two moduli, 2^31 - 1 each with a base of its own, give every span of a text a
62-bit hash in constant time from prefix arrays.  The fingerprint of a text is
its length, its whole hash and, for each of 64 classes of its spans of 16 code
points, a byte of the least span hash; the share of equal bytes estimates the
Jaccard similarity of the texts' spans.  Texts of n < 256 code points, which have
few spans, add the first 256 - n spans of 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.words import slices

P = (1 << 31) - 1
#: Bases of the two moduli.
BASES = (911382323, 972663749)
SPAN = 16
#: Texts of under SOME code points add spans of SHORT.
SHORT, SOME = 4, 256
SLOTS = 64


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for 0 <= x < 2^62."""
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


#: Powers that a worker keeps; 32 bytes each.
MOST_POWERS = 1 << 20


class _Powers:
    """Powers of both bases and of their inverses, grown on demand."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, np.int64) for _ in range(4)]
        self.roots = [*BASES, *(pow(b, P - 2, P) for b in BASES)]

    def upto(self, n: int) -> list[np.ndarray]:
        kept = self.tables
        while len(self.tables[0]) <= n:
            size = len(self.tables[0])
            self.tables = [np.concatenate((t, _mod(t * pow(r, size, P)))) for t, r in zip(self.tables, self.roots)]
        grown = self.tables
        if len(grown[0]) > MOST_POWERS and len(kept[0]) <= MOST_POWERS:
            self.tables = kept  # those of a very long text go with it
        return grown


_POWERS = _Powers()


class PrefixHash:
    """Prefix arrays of one text: equality of any two spans, and longest common extensions."""

    def __init__(self, points: np.ndarray):
        """``points``: code points, as int64."""
        self.points, n = points, len(points)
        self.powers = _POWERS.upto(n)
        self.prefix = []
        for power in self.powers[:2]:
            sums = np.cumsum(_mod((points + 1) * power[:n])) % P
            self.prefix.append(np.concatenate((np.zeros(1, np.int64), sums)))

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(code_points(text))

    def replaced(self, kept: int, tail: np.ndarray) -> PrefixHash:
        """The hash of the first ``kept`` code points and ``tail``; the kept prefix is not hashed anew."""
        out = object.__new__(PrefixHash)
        out.points = np.concatenate((self.points[:kept], tail))
        n = len(out.points)
        out.powers, out.prefix = _POWERS.upto(n), []
        for power, own in zip(out.powers[:2], self.prefix):
            more = (np.cumsum(_mod((tail + 1) * power[kept:n])) + own[kept]) % P
            out.prefix.append(np.concatenate((own[: kept + 1], more)))
        return out

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` from each start."""
        # A negative difference is lifted by P, so that every product is below 2^62, as _mod needs.
        sums = (h[starts + length] - h[starts] for h in self.prefix)
        high, low = (_mod((d + (P & (d >> 63))) * inverse[starts]) for d, inverse in zip(sums, self.powers[2:]))
        return (high << 31) | low

    def span(self, start: int, stop: int) -> int:
        high, low = ((int(h[stop]) - int(h[start])) * int(inverse[start]) % P for h, inverse in zip(self.prefix, self.powers[2:]))
        return (high << 31) | low

    def common_extension(self, other: PrefixHash, i: int = 0, j: int = 0) -> int:
        """Length of the longest common prefix of the texts from ``i`` and ``j`` on, by binary search."""
        low, high = 0, min(len(self.points) - i, len(other.points) - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        n = len(self.points)
        slots = np.full(SLOTS, np.iinfo(np.int64).max)
        if n:
            span, short = min(SPAN, n), min(SHORT, n)
            found = [self.spans(np.arange(n - span + 1), span), self.spans(np.arange(max(0, min(n - short + 1, SOME - n))), short)]
            with np.errstate(over="ignore"):
                mixed = np.concatenate(found).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) & np.uint64((1 << 62) - 1)
            value = mixed.view(np.int64)
            np.minimum.at(slots, value & (SLOTS - 1), value >> 6)
        # The byte 0 marks a class without spans.
        used = slots != np.iinfo(np.int64).max
        marks = np.where(used, slots % 255 + 1, 0).astype(np.uint8)
        return f"{n:x}-{self.span(0, n) if n else 0:016x}-{marks.tobytes().hex()}"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def likeness(a: str, b: str) -> float:
    """Estimated similarity of two fingerprints, 0 to 1; equal ones are 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), np.uint8) for f in (a, b))
    some = (x > 0) | (y > 0)
    if not some.any():
        return 0.0
    share = float(((x == y) & some).sum() / some.sum())
    return max(0.0, (share - 1 / 255) / (1 - 1 / 255))  # less the chance of equal bytes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix, common_with_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many, or all, of the next document's: the one with the next
    smaller doc_id, for the smallest that with the greatest.  Where a doc_id
    stands on several rows, the one of least text hash is the next document of
    others; all of them have the same next one.  Nulls: a null text is empty,
    rows of null doc_id come behind the smallest id and have the same next one
    as that.  A lone doc_id is its own next document; without any doc_id each
    row is its own.  Other columns are ignored, an empty table gives an empty
    result, and very long texts are hashed whole.

    The table is dealt by ranges of doc_id; an id that fills several ranges, and
    the rows without one, are dealt to more parts by text hash.  Each part gets
    the document below its least id; bounds and edges, ``parts`` numbers each,
    are all that reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = max(1, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array(sorted(rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []) if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Range k holds ids above cut k - 1 up to cut k; an id that is several cuts has as many ranges."""
        none = ids.isna().to_numpy()
        known = ids.fillna(0).to_numpy(np.int64)
        low, high = np.searchsorted(cuts, known, side="left"), np.searchsorted(cuts, known, side="right")
        low, wide = np.where(none, 0, low), np.where(none, parts, np.maximum(high - low, 1))
        return pd.Series((low + hashes.to_numpy(np.int64).view(np.uint64) % wide.astype(np.uint64)).astype(np.int32))

    @F.pandas_udf("boolean")
    def is_cut(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.to_numpy(np.int64), cuts))

    placed = rows.withColumn("p", place("doc_id", "h"))
    ids = placed.where("doc_id is not null").select("p", "doc_id").withColumn("below", F.when(~is_cut("doc_id"), F.col("doc_id")))
    ends = ids.groupBy("p").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("below").alias("below")).collect()
    known = np.array(sorted({x for r in ends for x in (r.high, r.below) if x is not None}), np.int64)
    needs = []  # (part, id whose document it needs, whether its rows without id do)
    if len(known):
        greatest = int(known[-1])
        for r in ends:
            at = int(np.searchsorted(known, r.low))
            needs.append((r.p, int(known[at - 1]) if at else greatest, False))
        needs += [(p, greatest, True) for p in range(parts)]
    needed = spark.createDataFrame(needs, "p int, doc_id bigint, lone boolean")
    heads = rows.where(F.col("doc_id").isin(sorted({n[1] for n in needs}))).groupBy("doc_id").agg(F.min_by("text", "h").alias("text"))
    # Only rows without id need the greatest one everywhere.
    lone = placed.where("doc_id is null").select("p").distinct()
    needed = needed.where("not lone").unionByName(needed.where("lone").join(lone, "p", "left_semi"))
    edges = heads.join(needed, "doc_id").select("p", F.when(F.col("lone"), 0).otherwise(1).alias("kind"), "doc_id", "text", F.lit(0).cast("bigint").alias("h"))
    dealt = placed.select("p", F.when(F.col("doc_id").isNull(), 2).otherwise(3).alias("kind"), "doc_id", "text", "h").unionByName(edges)
    dealt = dealt.repartition(parts, "p").sortWithinPartitions("p", "kind", "doc_id", "h").drop("h")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = first = before = head = None  # part; document of the greatest id; last smaller one; first row of the id in hand
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for p, kind, doc, text in zip(*(part.column(c).to_pylist() for c in ("p", "kind", "doc_id", "text"))):
                    if p != current:
                        current, first, before, head = p, None, None, None
                    own = _Document(doc, text)
                    if kind == 0:
                        first = own
                    elif kind == 1:
                        before = own
                    elif kind == 2:
                        out.append(own.against(first or own))
                    else:
                        if head is None or head.doc != doc:
                            before, head = head or before, own
                        out.append(own.against(before or own))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * len(_TYPES), _TYPES.types)], schema=_TYPES)

    return dealt.mapInArrow(walk, _SCHEMA)


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint, common_with_next bigint"
_TYPES = pa.schema([(f.split()[0], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in _SCHEMA.split(", ")])


class _Document:
    def __init__(self, doc: int | None, text: str):
        self.doc, self.text = doc, text

    @cached_property
    def hash(self) -> PrefixHash:
        return PrefixHash.of(self.text)

    @cached_property
    def print(self) -> str:
        return self.hash.fingerprint()

    def against(self, following: _Document) -> tuple:
        """The result row, given the next document."""
        n = len(self.text)
        cut = n // 3
        head = following.text[:cut]
        edited = self.hash.replaced(n - cut, code_points(head))
        sha = hashlib.sha256((self.text[: n - cut] + head).encode()).hexdigest()
        changed = edited.fingerprint()
        return (
            self.doc, n, sha, self.print, changed, likeness(self.print, changed), likeness(self.print, following.print),
            self.hash.common_extension(edited), self.hash.common_extension(following.hash),
        )
