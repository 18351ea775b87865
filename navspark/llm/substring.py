"""Exact removal of repeated word windows behind a count-min sketch.

Every window of 35 words is filed under its anchor: the least hashed of its
18-word grams, the leftmost on ties.  Equal windows have equal anchors at equal
offsets, so a window occurs no more often than its anchor is chosen, and about
two of 19 positions are anchors.  Pass one adds the anchors of each partition to
a count-min sketch; merged, it overestimates each anchor's and so each window's
count.  Pass two groups exactly the windows whose estimate is two or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navspark.llm.shared import staged
from navspark.llm.words import Words, grams, mix, slices

WINDOW = 35
GRAM = 18
#: Counters of a sketch row per expected anchor, and the most of them: two rows of 2^29 bits are 128 MB.
SPARSE = 8
MOST_BITS = 29
#: Bits of a sketch that one row of the merge holds.
SHARD = 1 << 19
ROWS = 2


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of window, position of its anchor, hash of each gram) over all texts of ``words``."""
    hashed = grams(words.hashes, gram, seed=3)
    starts = np.flatnonzero(words.inside(window))
    if not len(starts):
        return starts, starts, hashed
    # 40 bits of the gram's hash over 24 of its place: a minimum is leftmost on ties.
    place = np.arange(len(hashed), dtype=np.uint64)
    if len(hashed) >= 1 << 24:
        raise ValueError("a slice holds at most 2^24 words; see pieces")
    packed = (mix(hashed) & ~np.uint64((1 << 24) - 1)) | place
    span = window - gram + 1
    low, have = packed, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(packed) - span + 1], low[span - have : len(packed) - have + 1])
    return starts, (low[starts] & np.uint64((1 << 24) - 1)).astype(np.int64), hashed


def pieces(words: Words, window: int, limit: int = 1 << 24) -> Iterator[tuple[Words, int]]:
    """(words, base) of pieces of under ``limit`` words, 2^24, of a slice of texts.

    A text of more words is one slice; it comes in pieces that overlap by
    ``window - 1`` words, so each window is in exactly one.  ``base`` is the
    place of the piece's first word in the text.
    """
    most = limit - window  # a piece has window - 1 more
    if len(words.codes) < limit:
        yield words, 0
        return
    for text in range(len(words.lengths)):
        at, end = words.starts[text], words.starts[text] + words.lengths[text]
        for base in range(0, max(1, int(words.lengths[text]) - window + 1), most):
            piece = object.__new__(Words)
            stop = min(end, at + base + most + window - 1)
            piece.codes, piece.hashes = words.codes[at + base : stop], words.hashes[at + base : stop]
            piece.lengths, piece.starts = np.array([stop - at - base]), np.array([0])
            piece.text = text
            yield piece, base


def cells(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch."""
    a = mix(hashed + np.uint64(1))
    return [(a >> np.uint64(64 - bits)).astype(np.int64), (a & np.uint64((1 << bits) - 1)).astype(np.int64)]


def anchor_places(place: np.ndarray) -> np.ndarray:
    """Where a new anchor begins; the anchors of successive windows never step back."""
    return np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)


def sketch(docs: DataFrame, bits: int, window: int, gram: int) -> dict[tuple[int, int], bytes]:
    """The counters that are two or more, as bits by (row, shard).

    A counter stops at two, so it is a bit "seen" and a bit "again".  A task
    holds the counters that it has touched, not the whole sketch, and sends a
    shard as sorted numbers where that is shorter than its bits.
    """
    shard = min(SHARD, 1 << bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.uint32) for _ in range(ROWS)]
        again = [np.zeros(0, np.uint32) for _ in range(ROWS)]
        fresh: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        held = 0

        def settle() -> None:
            for row in range(ROWS):
                new, n = np.unique(np.concatenate([*fresh[row], np.zeros(0, np.uint32)]), return_counts=True)
                old = np.intersect1d(seen[row], new, assume_unique=True)
                again[row] = np.union1d(np.union1d(again[row], new[n > 1]), old)
                seen[row] = np.union1d(seen[row], new)
                fresh[row].clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for words, _ in pieces(Words(part.column("text")), window):
                    _, place, hashed = anchors(words, window, gram)
                    chosen = hashed[place[anchor_places(place)]]
                    for row, at in enumerate(cells(chosen, bits)):
                        fresh[row].append(at.astype(np.uint32))
                    held += len(chosen)
                    if held > 4_000_000:
                        settle()
                        held = 0
        settle()
        for row in range(ROWS):
            edges = np.arange(0, (1 << bits) + 1, shard)
            a, b = np.searchsorted(seen[row], edges), np.searchsorted(again[row], edges)
            for k in range(len(edges) - 1):
                if a[k] < a[k + 1]:
                    base = np.uint32(edges[k])
                    packed = [_pack(x - base, shard) for x in (seen[row][a[k] : a[k + 1]], again[row][b[k] : b[k + 1]])]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), *(pa.array([x]) for x in packed)], names=["row", "shard", "seen", "again"])

    def merge(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(shard, bool), np.zeros(shard, bool)
        for batch in tables:
            for s, a in zip(batch.column("seen"), batch.column("again")):
                more = _unpack(s.as_py(), shard)
                again |= _unpack(a.as_py(), shard) | (seen & more)
                seen |= more
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([_pack(np.flatnonzero(again).astype(np.uint32), shard)])], names=["row", "shard", "again"])

    parts = docs.select("text").mapInArrow(partial, "row bigint, shard bigint, seen binary, again binary")
    merged = parts.groupBy("row", "shard").applyInArrow(merge, "row bigint, shard bigint, again binary")
    return {(r.row, r.shard): bytes(r.again) for r in merged.toLocalIterator()}


def _pack(at: np.ndarray, n: int) -> bytes:
    if at.nbytes < n // 8:
        return b"s" + at.tobytes()
    bits = np.zeros(n, bool)
    bits[at] = True
    return b"b" + np.packbits(bits).tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    if packed[:1] == b"s":
        out = np.zeros(n, bool)
        out[np.frombuffer(packed, np.uint32, offset=1)] = True
        return out
    return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), count=n).astype(bool)


class Estimate:
    """Whether an anchor's estimated count is two or more; bits are unpacked once in a worker."""

    def __init__(self, found: dict[tuple[int, int], bytes], bits: int):
        self.found, self.bits, self.rows = found, bits, None

    def __getstate__(self):
        return {"found": self.found, "bits": self.bits, "rows": None}

    def __call__(self, hashed: np.ndarray) -> np.ndarray:
        if self.rows is None:
            shard = min(SHARD, 1 << self.bits)
            self.rows = np.zeros((ROWS, max(1, (1 << self.bits) >> 3)), np.uint8)
            for (row, k), packed in self.found.items():
                self.rows[row, k * shard // 8 : (k + 1) * shard // 8] = np.packbits(_unpack(packed, shard))
        out = np.ones(len(hashed), bool)
        for row, at in zip(self.rows, cells(hashed, self.bits)):
            out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


def candidates(words: Words, repeated: Estimate, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, h1, h2) of the windows whose anchor is estimated repeated."""
    starts, place, hashed = anchors(words, window, gram)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    new = anchor_places(place)
    starts = starts[repeated(hashed[place[new]])[np.cumsum(new) - 1]]
    return starts, grams(words.hashes, window, seed=5)[starts], grams(words.hashes, window, seed=6)[starts]


def sketch_bits(docs: DataFrame, window: int, gram: int) -> int:
    """Counters of a row as a power of two, from the corpus's bytes; a wrong guess costs time only."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, size // 6 * 2 // (window - gram + 2))
    return int(min(MOST_BITS, max(16, np.ceil(np.log2(expected * SPARSE)))))


def repeated_windows(docs: DataFrame, carry: list[str], text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: its words' number and the words that repeated windows cover.

    Words are runs of other than ASCII white space, unchanged.  A word goes if
    it is in a window of ``window`` consecutive words of its text whose word
    sequence also starts elsewhere, in another row or at another place of the
    same.  Windows are judged on the input.  Returns row (a struct of the columns
    ``carry``), n_words, n_removed, removed (array of [start, end) word ranges)
    and kept (the remaining words, joined by one space).

    A null text has no words; repeated rows repeat each other's windows; ids
    play no part and may repeat or be null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    bits = sketch_bits(docs, window, gram)
    estimate = spark.sparkContext.broadcast(Estimate(sketch(docs, bits, window, gram), bits))
    key = F.xxhash64("text").alias("key")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column("key").to_numpy(zero_copy_only=False)
                for words, base in pieces(Words(part.column("text")), window):
                    start, h1, h2 = candidates(words, estimate.value, window, gram)
                    text = words.owners()[start]
                    own = start - words.starts[text] + base
                    text = text + getattr(words, "text", 0)
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(keys[text]), pa.array(own)], names=["h1", "h2", "key", "start"])

    each = docs.where("text is not null").select("text", key).mapInArrow(windows, "h1 bigint, h2 bigint, key bigint, start bigint")
    # Most candidates do repeat, so what comes back to the texts are the others, each on one place.
    lone = each.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("start").alias("start")).where("n = 1")
    lone = staged(lone.groupBy("key").agg(F.collect_list(F.struct("start", "h1")).alias("lone")), "lone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part, estimate.value, window, gram)

    joined = docs.withColumn("key", key).join(lone, "key", "left").select("row", "text", "lone")
    added = T.StructType.fromDDL("n_words bigint, n_removed bigint, removed array<array<bigint>>, kept string")
    return joined.mapInArrow(cut, T.StructType([joined.schema["row"], *added.fields]))


def _cut(part: pa.RecordBatch, estimate: Estimate, window: int, gram: int) -> pa.RecordBatch:
    n = part.num_rows
    whole = Words(part.column("text"))
    delta = np.zeros(len(whole.codes) + 1, np.int64)
    lone: dict[int, set] = {}
    for text, items in enumerate(part.column("lone").to_pylist()):
        if items:
            lone[text] = {(x["start"], x["h1"]) for x in items}
    for words, base in pieces(whole, window):
        start, h1, _ = candidates(words, estimate, window, gram)
        text = words.owners()[start]
        own = start - words.starts[text] + base
        text = text + getattr(words, "text", 0)
        if lone:
            some = np.isin(text, np.fromiter(lone, np.int64, len(lone)))
            bad = np.fromiter(((s, h) in lone[t] for t, s, h in zip(text[some].tolist(), own[some].tolist(), h1[some].view(np.int64).tolist())), bool, int(some.sum()))
            good = np.ones(len(text), bool)
            good[np.flatnonzero(some)[bad]] = False
            text, own = text[good], own[good]
        at = whole.starts[text] + own
        delta[at] += 1
        np.subtract.at(delta, at + window, 1)
    gone = np.cumsum(delta)[:-1] > 0
    owner = whole.owners()
    removed = np.bincount(owner[gone], minlength=n)
    spans, kept = [], []
    dictionary = whole.dictionary
    raw = part.column("text").cast(pa.large_binary())
    for text in range(n):
        a, b = whole.starts[text], whole.starts[text] + whole.lengths[text]
        if not removed[text]:
            spans.append([])
            kept.append(b" ".join((raw[text].as_py() or b"").split()).decode())
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:b].view(np.int8), [0]))))
        spans.append(edge.reshape(-1, 2).tolist())
        kept.append(" ".join(dictionary.take(pa.array(whole.codes[a:b][~gone[a:b]])).to_pylist()))
    return pa.RecordBatch.from_arrays(
        [part.column("row"), pa.array(whole.lengths), pa.array(removed.astype(np.int64)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())],
        names=["row", "n_words", "n_removed", "removed", "kept"],
    )


def without_repeats(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated windows cut from the texts; untouched texts stay as they are.

    A text that loses words becomes its remaining words joined by one space, and
    ``size_col`` (if there) its new number of characters.  No row goes.
    """
    found = repeated_windows(docs, docs.columns, text_col)
    cut = F.col("n_removed") > 0

    def column(name: str):
        old = F.col("row").getField(name)
        if name == text_col:
            return F.when(cut, F.col("kept")).otherwise(old).alias(name)
        if name == size_col:
            return F.when(cut, F.length("kept")).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        return old.alias(name)

    return found.select(*(column(c) for c in docs.columns))
