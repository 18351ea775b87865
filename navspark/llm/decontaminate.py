"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact verification.

For every benchmark item of L words, windows of L words are hashed to 128 bits.
Cut into BLOCKS blocks, two fingerprints within RADIUS bits differ in at most
RADIUS // BLOCKS bits of some block.  So the index holds every item under all
values within so many bits of its blocks, and an equality join on blocks finds
every pair within the radius.  Each is then verified by the weighted Jaccard
similarity of its five-word shingles.  Windows without any shingle of an item
have similarity 0 and are not hashed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.shared import staged
from navspark.llm.words import Words, grams, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 two fingerprints differ in 19.4 of 128 bits on average, with a deviation of 4.1: 7 in 1,000 such pairs are beyond the radius, at 0.85 fewer than 1.
RADIUS = 29
#: Blocks of the two 64-bit halves together.
BLOCKS = 10
#: Items and words of one pass; the passes over the documents grow with the benchmark, a pass's index does not.
ITEMS, WORDS = 20_000, 4_000_000

_DROPPED = re.compile(r"[^\w]+|_+")


def normal(word: str) -> str:
    """A word in lower case without punctuation."""
    return _DROPPED.sub("", word.lower())


def _width(length: int, shingle: int) -> int:
    return min(length, shingle)


class Items:
    """The index of one block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int = SHINGLE, seen: dict[int, int] | None = None, total: int | None = None):
        """``seen`` counts the items of the whole benchmark that have a shingle, for shingles of several, ``total`` its items; by default these rows are all."""
        words = Words(pa.array([t for _, t in rows], pa.string()), normal, unicode=True)
        self.shingle, self.items = shingle, []
        for (item, _), at, n in zip(rows, words.starts, words.lengths):
            if n:
                width = _width(int(n), shingle)
                self.items.append((item, int(n), width, grams(words.hashes[at : at + n], width, seed=20 + width)))
        own = Counter(h for *_, hashes in self.items for h in set(hashes.tolist()))
        seen, total = (own, len(self.items)) if seen is None else (seen, total)
        #: An item's shingle weighs the less, the more items have it; all others weigh as one item's.
        self.rare = float(np.log1p(total))
        self.weight = {h: float(np.log1p(total / n)) for h, n in seen.items()}
        self.vocabulary_of(own)

    def vocabulary_of(self, own: Counter) -> None:
        """The shingles that documents are scanned for, and the lengths of the items that have them."""
        self.vocabulary, self.lengths = {}, {}
        for width in {w for _, _, w, _ in self.items}:
            of: dict[int, set] = {}
            for _, n, w, hashes in self.items:
                if w == width:
                    for h in hashes.tolist():
                        of.setdefault(h, set()).add(n)
            keys = np.array(sorted(of), np.uint64)
            self.vocabulary[width] = keys
            self.lengths[width] = [sorted(of[int(h)]) for h in keys]
        self.filter = {}
        for width, keys in self.vocabulary.items():
            self.filter[width] = np.zeros(1 << 20, bool)
            self.filter[width][(keys >> np.uint64(44)).astype(np.int64)] = True

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        return np.fromiter((self.weight.get(h, self.rare) for h in hashes.tolist()), float, len(hashes))

    def hits(self, hashed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, entry of the vocabulary) of the shingles that some item has."""
        at = np.flatnonzero(self.filter[width][(hashed >> np.uint64(44)).astype(np.int64)])
        keys = self.vocabulary[width]
        entry = np.minimum(np.searchsorted(keys, hashed[at]), len(keys) - 1)
        same = keys[entry] == hashed[at]
        return at[same], entry[same]

    def simhashes(self, hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """(starts, 2) SimHashes of ``n`` shingles from each start on, two times 64 bits."""
        weights, halves = self.weights(hashes)[:, None], []
        for seed in (0, 1):
            bits = ((mix(hashes ^ np.uint64(seed * 0x5DEECE66D))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1
            sums = np.concatenate((np.zeros((1, 64)), np.cumsum(bits * weights, axis=0)))
            total = sums[starts + n] - sums[starts]
            halves.append(((total > 1e-9).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
        return np.stack(halves, axis=1)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        x, y = Counter(a.tolist()), Counter(b.tolist())
        low = high = 0.0
        for h in x.keys() | y.keys():
            w = self.weight.get(h, self.rare)
            low += w * min(x[h], y[h])
            high += w * max(x[h], y[h])
        return low / high if high else 0.0


def _regions(words: Words, items: Items) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, length of item, width, first word, shingles, starts within, SimHashes) of runs of windows."""
    for width in items.vocabulary:
        hashed = grams(words.hashes, width, seed=20 + width)
        at, entry = items.hits(hashed, width)
        if not len(at):
            continue
        text = np.searchsorted(words.starts, at, side="right") - 1
        inside = at + width <= words.starts[text] + words.lengths[text]
        runs: dict[tuple[int, int], list[int]] = {}
        for p, e, t in zip(at[inside].tolist(), entry[inside].tolist(), text[inside].tolist()):
            for length in items.lengths[width][e]:
                runs.setdefault((t, length), []).append(p)
        for (t, length), places in runs.items():
            begin, size = int(words.starts[t]), int(words.lengths[t])
            span = min(length, size)  # a shorter text is one window
            p = np.array(places) - begin
            low, high = np.maximum(p - (span - width), 0), np.minimum(p, size - span)
            delta = np.zeros(size - span + 2, np.int64)
            np.add.at(delta, low, 1)
            np.subtract.at(delta, high + 1, 1)
            starts = np.flatnonzero(np.cumsum(delta)[:-1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                first, last = int(run[0]), int(run[-1]) + span - width + 1
                shingles = hashed[begin + first : begin + last]
                yield t, length, span - width + 1, first, shingles, run - first, items.simhashes(shingles, run - first, span - width + 1)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, most_items: int = ITEMS,
) -> DataFrame:
    """One row per (document, item) that match: doc_id, key1, key2, item_id, start_word, n_words, distance, similarity.

    ``key1, key2`` hash the document's text.  Words are compared in lower case
    without punctuation.  Of several windows the most similar counts, the first
    on ties.  An item of under five words is one shingle; a document shorter
    than an item is one window.  Null and wordless texts and items match
    nothing; repeated rows match alike and give one row; repeated items each
    give their own.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    n, size = bench.agg(F.count("*"), F.sum(F.length("text"))).first()
    passes = max(1, -(-n // most_items), -(-(size or 0) // (6 * WORDS)))
    if passes == 1:
        return _one_pass(docs, Items([(r.item_id, r.text) for r in bench.collect()], shingle), spark, similarity, radius)
    shingles = staged(_shingles(bench.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).cast("int")), shingle), "benchmark")
    total = shingles.count()
    counts = staged(shingles.select(F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")), "counts")
    # A shingle of one item weighs as one of none, so every pass needs only those that several items share.
    several = {r.shingle & ((1 << 64) - 1): r.n for r in counts.where("n > 1").collect()}
    out = None
    for k in range(passes):
        # A pass's rows are bounded by most_items, give or take the hash's unevenness.
        mine = shingles.where(F.col("pass") == k)
        rows = mine.select("item_id", "text").collect()
        items = Items([(r.item_id, r.text) for r in rows], shingle, several, total)
        found = _one_pass(docs, items, spark, similarity, radius)
        out = found if out is None else out.unionByName(found)
    return out


def _shingles(bench: DataFrame, shingle: int) -> DataFrame:
    """``bench`` (item_id, text, pass) with the shingles of the items that have words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), normal, unicode=True)
                lists = [grams(words.hashes[at : at + n], _width(int(n), shingle), seed=20 + _width(int(n), shingle)).view(np.int64) if n else None for at, n in zip(words.starts, words.lengths)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*part.schema.names, "shingles"])

    return bench.mapInArrow(rows, "item_id bigint, text string, pass int, shingles array<bigint>").where("shingles is not null")


#: First bits of the blocks of one half, and its end.
_EDGES = np.linspace(0, 64, BLOCKS // 2 + 1).astype(int).tolist()


def _blocks(low: str, high: str) -> Column:
    """The blocks of a fingerprint as numbers."""
    cut = lambda c, a, b: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*(cut(half, a, b) for half in (low, high) for a, b in zip(_EDGES, _EDGES[1:])))


def _masks(flips: int) -> list[int]:
    """All numbers of the widest block's length with at most so many bits; those beyond a narrower block meet no value."""
    width = max(b - a for a, b in zip(_EDGES, _EDGES[1:]))
    return [sum(1 << i for i in bits) for k in range(flips + 1) for bits in combinations(range(width), k)]


def _one_pass(docs: DataFrame, items: Items, spark, similarity: float, radius: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(_regions(Words(part.column("text"), normal, unicode=True), shared.value))
                if rows:
                    text = pa.array([r[0] for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(c).take(text) for c in ("doc_id", "key1", "key2")),
                            *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)),
                            pa.array([r[4].view(np.int64) for r in rows], pa.list_(pa.int64())),
                            pa.array([r[5] for r in rows], pa.list_(pa.int64())),
                            *(pa.array([r[6][:, i].copy().view(np.int64) for r in rows], pa.list_(pa.int64())) for i in (0, 1)),
                        ],
                        names=["doc_id", "key1", "key2", "n_words", "n_shingles", "first", "shingles", "starts", "low", "high"],
                    )

    schema = "doc_id bigint, key1 bigint, key2 bigint, n_words bigint, n_shingles bigint, first bigint, shingles array<bigint>, starts array<bigint>, low array<bigint>, high array<bigint>"
    keyed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("key1"), F.xxhash64("text", F.lit(1)).alias("key2"), "text")
    regions = staged(keyed.mapInArrow(scan, schema).withColumn("region", F.monotonically_increasing_id()), "regions")

    local = []
    for item, n, width, hashes in items.items:
        low, high = items.simhashes(hashes, np.array([0]), len(hashes))[0].view(np.int64).tolist()
        local.append((item, n, low, high, hashes.view(np.int64).tolist()))
    index = spark.createDataFrame(local, "item_id bigint, n_words bigint, item_low bigint, item_high bigint, item array<bigint>")

    windows = regions.select("region", "n_words", F.explode(F.arrays_zip("starts", "low", "high")).alias("w"))
    windows = windows.select("region", "n_words", F.col("w.starts").alias("start"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    windows = windows.select("*", F.posexplode(_blocks("low", "high")).alias("block", "value"))
    keys = index.select("item_id", "n_words", "item_low", "item_high", F.posexplode(_blocks("item_low", "item_high")).alias("block", "own"))
    probes = F.array(*(F.lit(m) for m in _masks(radius // BLOCKS)))
    keys = keys.withColumn("mask", F.explode(probes)).select("item_id", "n_words", "item_low", "item_high", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    distance = F.bit_count(F.col("low").bitwiseXOR(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("item_high")))
    near = windows.join(keys, ["n_words", "block", "value"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    near = near.select("region", "start", "item_id", "n_words", "distance").distinct()
    pairs = near.join(regions.drop("starts", "low", "high", "n_words"), "region").join(index.select("item_id", "item"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            score = [shared.value.similarity(_slice(r["shingles"], r["start"], r["n_shingles"]), np.array(r["item"], np.int64).view(np.uint64)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key1", "key2", "item_id")), pa.array([r["first"] + r["start"] for r in rows], pa.int64()), batch.column("n_words"), batch.column("distance").cast(pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "key1", "key2", "item_id", "start_word", "n_words", "distance", "similarity"],
            )

    result = "doc_id bigint, key1 bigint, key2 bigint, item_id bigint, start_word bigint, n_words bigint, distance bigint, similarity double"
    scored = pairs.mapInArrow(verify, result).where(F.col("similarity") >= similarity)
    best = F.struct("similarity", (-F.col("start_word")).alias("before"), "n_words", "distance")
    found = scored.groupBy("doc_id", "key1", "key2", "item_id").agg(F.max(best).alias("b"))
    return found.select("doc_id", "key1", "key2", "item_id", (-F.col("b.before")).alias("start_word"), "b.n_words", "b.distance", "b.similarity")


def _slice(values: list[int], start: int, n: int) -> np.ndarray:
    return np.array(values[start : start + n], np.int64).view(np.uint64)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they were."""
    bad = staged(contaminated(docs, benchmark, id_col, text_col).select("key1", "key2").distinct(), "bad")
    same = (F.xxhash64(docs[text_col]) == bad["key1"]) & (F.xxhash64(docs[text_col], F.lit(1)) == bad["key2"])
    return docs.join(bad, same & docs[text_col].isNotNull(), "left_anti")
