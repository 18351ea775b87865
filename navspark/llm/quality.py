"""Positive-unlabelled quality classifier with non-negative risk (Kiryo et al., 2017)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navspark.llm.shared import Scratch
from navspark.llm.words import Words, mix, release, slices

#: Most rows of trusted positives that the model is fitted on, and of unlabelled ones that its first fit and its curvature come from.
SAMPLE = 4000
#: Passes over all unlabelled rows that carry the fit on from the sample.
PASSES = 4
#: One-sided bound of the shares that the class prior is read from, in standard errors (99 %), and the splits that it is the median of.
BOUND, SPLITS = 2.33, 4

#: Classes of bytes whose successions are counted.
CLASSES = 13


def _class_table() -> np.ndarray:
    table = np.full(256, 11, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for name, group in enumerate((" ", "\n\t\r", ".", ",;:", "!?", "|", "'\"()-", "<>/&"), start=3):
        for c in group:
            table[ord(c)] = name
    table[128:192] = 12  # a character's later bytes
    table[192:] = 12
    return table


_TABLE = _class_table()
#: Weight of the squared weights in the risk.
DECAY = 1e-3
N_SHAPE = CLASSES * CLASSES + 6
#: Cells of hashed words, and what their standardised shares are shrunk by beside the other features.
WORD_CELLS, WORD_WEIGHT = 128, 0.3
N_FEATURES = N_SHAPE + WORD_CELLS


def features(texts: pa.Array) -> np.ndarray:
    """(rows, N_FEATURES): shares of byte-class successions, repetition and length of words, shares of hashed words."""
    n = len(texts)
    out = np.zeros((n, N_FEATURES))
    if not n:
        return out
    words = Words(texts, str.lower)
    raw = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = raw.buffers()[2]
    codes = _TABLE[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    if len(codes) > 1:
        same = owner[1:] == owner[:-1]
        pair = codes[:-1].astype(np.int64) * CLASSES + codes[1:]
        square = CLASSES * CLASSES
        counts = np.bincount((owner[1:] * square + pair)[same], minlength=n * square).reshape(n, square)
        out[:, :square] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    at = CLASSES * CLASSES
    length = words.lengths
    some = np.maximum(length, 1)
    text = words.owners()
    if len(text):
        twin = (words.codes[1:] == words.codes[:-1]) & (text[1:] == text[:-1])
        out[:, at] = np.bincount(text[1:][twin], minlength=n) / some
        key = np.sort((text.astype(np.int64) << 32) | words.codes.astype(np.int64))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        distinct = np.bincount(key[fresh] >> 32, minlength=n)
        out[:, at + 1] = np.sqrt(distinct / some)
    out[:, at + 2] = np.log1p(length)
    out[:, at + 3] = np.log1p(sizes / some)
    out[:, at + 4] = length == 0
    out[:, at + 5] = 1.0
    cell = text.astype(np.int64) * WORD_CELLS + (mix(words.hashes) % np.uint64(WORD_CELLS)).astype(np.int64)
    out[:, N_SHAPE:] = np.sqrt(np.bincount(cell, minlength=n * WORD_CELLS).reshape(n, WORD_CELLS) / some[:, None])
    return out


@dataclass
class Model:
    """A linear model over standardised features; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _adam(gradient, size: int, steps: int, rate: float = 0.03) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray, above: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, int]] | None = None) -> float:
    """Share of positives among the unlabelled rows.

    A region of the feature space that holds positives only has in the
    unlabelled rows ``prior`` times its share of the positives, any other region
    more.  So the prior is the least ratio of the two shares over regions above
    a threshold of a positive-against-unlabelled score; the score is fitted on
    one half of the rows, the shares are taken on the other; to those of the
    unlabelled rows ``above(scores' weights, thresholds)`` adds the shares among
    rows that no score was fitted on, one split a row, and their number.
    The least of noisy ratios is no estimate on few rows, and a prior too high
    leaves too few negatives, so the upper bound of one share and the lower of
    the other are compared; on many rows they are the shares.  The median of a
    few splits is taken.
    """
    shares = np.linspace(0.90, 0.99, 10)
    weights, cuts, caught, others = [], [], [], []
    for k in range(SPLITS):
        rng = np.random.default_rng(k)
        i, j = rng.permutation(len(p)), rng.permutation(len(u))
        a, b, c, d = p[i[::2]], p[i[1::2]], u[j[::2]], u[j[1::2]]

        def gradient(w: np.ndarray) -> np.ndarray:
            return -a.T @ _sigmoid(-a @ w) / len(a) + c.T @ _sigmoid(c @ w) / len(c) + 1e-2 * w

        w = _adam(gradient, p.shape[1], 300)
        top = np.sort(b @ w)
        weights.append(w)
        cuts.append([top[int((1 - s) * (len(top) - 1))] for s in shares])
        others.append(((d @ w)[:, None] >= cuts[-1]).mean(axis=0))
    found, n = np.array(others), len(u) // 2
    if above:
        more, m = above(np.array(weights), np.array(cuts))
        found, n = (found * n + more * m) / (n + m), n + m
    low = found - BOUND * np.sqrt(found * (1 - found) / n)
    high = np.minimum(1, shares + BOUND * np.sqrt(shares * (1 - shares) / (len(p) // 2)))
    return float(np.clip(np.median((low / high).min(axis=1)), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, every: _Rows | None = None) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss; without rows the model answers one half.

    ``every`` stands for more unlabelled rows than are given: the features' mean
    and scale and the prior's shares are theirs, and the fit is carried on with
    their part of the risk, by Newton steps with the given rows' curvature.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.5)
    if every:
        mean, scale = every.moments()
    else:
        both = np.concatenate((positive, unlabelled))
        mean, scale = both.mean(axis=0), both.std(axis=0)
    constant = scale < 1e-6
    mean[constant], scale[constant] = 0.0, 1.0
    scale = np.maximum(scale, 1e-3)
    scale[N_SHAPE:] /= WORD_WEIGHT
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    prior = class_prior(p, u, every and every.above(mean, scale))

    def turned(w: np.ndarray, rows_risk: float, rows_gradient: np.ndarray) -> np.ndarray:
        """The gradient, given the mean of log(1 + exp(f)) over unlabelled rows and its gradient."""
        fp = p @ w
        right = -prior * (p.T @ _sigmoid(-fp)) / len(p)
        wrong = rows_gradient - prior * (p.T @ _sigmoid(fp)) / len(p)
        risk = rows_risk - prior * np.logaddexp(0, fp).mean()
        # Below zero the negative part is overfitted: step back on it alone.
        return (right + wrong if risk >= 0 else -wrong) + DECAY * w

    def carried_on(w: np.ndarray) -> np.ndarray:
        """The weights of least non-negative risk over all rows among ``w`` and those of a few Newton steps from it."""
        best, least = w, np.inf
        for _ in range(PASSES):
            risk, slope = every.risk(mean, scale, w)
            negative = risk - prior * np.logaddexp(0, p @ w).mean()
            total = prior * np.logaddexp(0, -(p @ w)).mean() + max(0.0, negative) + DECAY / 2 * w @ w
            if total > least:
                w = (best + w) / 2
                continue
            best, least = w, total
            share = _sigmoid(u @ w)
            curve = (u * (share * (1 - share))[:, None]).T @ u / len(u) + 10 * DECAY * np.eye(len(w))
            w = w - 0.5 * np.linalg.solve(curve, turned(w, risk, slope))
        return best

    def gradient(w: np.ndarray) -> np.ndarray:
        fu = u @ w
        return turned(w, np.logaddexp(0, fu).mean(), u.T @ _sigmoid(fu) / len(u))

    w = _adam(gradient, p.shape[1], steps)
    return Model(mean, scale, carried_on(w) if every else w, prior)


_SUM = "part int, n double, a array<double>, b array<double>"
#: Tasks in which the sums of all tasks are merged.
MERGES = 16


def _row(part: int, total: tuple) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.array(np.asarray(t, float))) for t in total[1:]]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(total[0])]), *lists], names=["part", "n", "a", "b"])


def _merged(batches: Iterable[pa.RecordBatch], merge: Callable[[tuple, tuple], tuple]) -> tuple | None:
    """Rows of sums as one, in the order they come."""
    total = None
    for batch in batches:
        for i in range(batch.num_rows):
            one = (batch.column("n")[i].as_py(), *(batch.column(c)[i].values.to_numpy(zero_copy_only=False).copy() for c in ("a", "b")))
            total = one if total is None else merge(total, one)
    return total


class _Rows:
    """Features of all unlabelled rows as a written table (key, x); sums over it are made in the tasks."""

    def __init__(self, table: DataFrame, fitted_on: np.ndarray):
        self.table, self.fitted_on = table, fitted_on

    def _sums(self, of: Callable[[np.ndarray, np.ndarray], tuple], merge: Callable[[tuple, tuple], tuple]) -> tuple:
        """``of(features, keys)`` of all rows, a tuple of a count and two arrays, merged in each task and then over the tasks."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    one = of(_matrix(part.column("x")), part.column("key").to_numpy())
                    total = one if total is None else merge(total, one)
            if total is not None:
                yield _row(TaskContext.get().partitionId(), total)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _merged(batches, merge)
            if total is not None:
                yield _row(0, total)

        # Sums meet in a few tasks, in one order, before they come to the driver: it gets MERGES rows, however many tasks there were.
        sums = self.table.mapInArrow(rows, _SUM)
        found = sums.repartition(MERGES, "part").sortWithinPartitions("part").mapInArrow(merged, _SUM).toArrow()
        return _merged(sorted(found.to_batches(), key=lambda b: repr(b.column("n").to_pylist())), merge)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        def of(x: np.ndarray, keys: np.ndarray) -> tuple:
            return len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)

        def merge(one: tuple, two: tuple) -> tuple:
            n, step = one[0] + two[0], two[1] - one[1]
            return n, one[1] + step * (two[0] / n), one[2] + two[2] + step**2 * (one[0] * two[0] / n)

        n, mean, squares = self._sums(of, merge)
        return mean, np.sqrt(squares / n)

    def above(self, mean: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, int]]:
        """Shares of the rows above thresholds of scores, but for those that the scores were fitted on, and how many they are."""

        fitted_on = self.fitted_on

        def shares(weights: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, int]:
            def count(x: np.ndarray, keys: np.ndarray) -> tuple:
                over = (((x - mean) / scale) @ weights.T)[:, :, None] >= cuts[None]
                fresh = ~np.isin(keys, fitted_on)
                return fresh.sum(), over[fresh].sum(axis=0, dtype=float).ravel(), np.zeros(1)

            n, found, _ = self._sums(count, _added)
            return (found / max(n, 1)).reshape(cuts.shape), int(n)

        return shares

    def risk(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean of log(1 + exp(f)) over the rows, and its gradient."""

        def of(x: np.ndarray, keys: np.ndarray) -> tuple:
            z = (x - mean) / scale
            f = z @ w
            return len(x), z.T @ _sigmoid(f), np.array([np.logaddexp(0, f).sum()])

        n, gradient, total = self._sums(of, _added)
        return float(total[0]) / n, gradient / n


def _added(one: tuple, two: tuple) -> tuple:
    return tuple(a + b for a, b in zip(one, two))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def _featured(rows: DataFrame) -> DataFrame:
    """(key, x) of rows (key, text)."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text")).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, x.ravel())
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "x"])

    return rows.select("key", "text").mapInArrow(featured, "key bigint, x array<float>")


def _least(keys: DataFrame, most: int) -> list[int]:
    """The ``most`` least keys, repeated ones once."""
    return sorted(r.key for r in keys.select("key").distinct().orderBy("key").limit(most).collect())


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on documents outside the held-out third: trusted positives by ``labels.quality``, all others as unlabelled.

    The features of all these documents are written once; their mean and scale,
    the class prior's shares and the unlabelled part of the risk are sums over
    all of them.  At most ``most`` trusted positives are fitted on, those of
    least hash of id and text; as many unlabelled rows give the first fit and
    the curvature of the later steps.  Only these reach the driver, as feature
    vectors.  Repeated rows count once among the positives.  Null texts and
    an empty table are fitted on nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(~held_out("doc_id") & F.col("text").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    trusted = labels.where("quality = 1").select("doc_id").where("doc_id is not null").distinct()
    keys = rows.select("doc_id", "key")
    with Scratch() as scratch:
        table = scratch.staged(_featured(rows), "features")
        sides = []
        for found in (_least(keys.join(trusted, "doc_id", "left_semi"), most), _least(keys, most)):
            if not found:
                sides.append(np.zeros((0, N_FEATURES)))
                continue
            # As Arrow, which is a tenth of rows of Python numbers.
            chosen = docs.sparkSession.createDataFrame(pa.table({"key": pa.array(found, pa.int64())}))  # ``most`` keys at most
            rows = table.join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"]).toArrow().combine_chunks()
            order = np.argsort(rows.column("key").to_numpy())
            sides.append(_matrix(rows.column("x").combine_chunks())[order])
        positive, unlabelled = sides
        if min(len(positive), len(unlabelled)) < 4:
            return fit(positive, unlabelled)
        model = fit(positive, unlabelled, every=_Rows(table, np.array(found)))
    del sides, positive, unlabelled, rows
    release()  # the driver has other work to do
    return model


def held_out(id_col: str):
    """Whether the row's crc32 remainder by three is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the column "quality score", 0 to 1; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                text = part.column(text_col)
                score = shared.value.score(features(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "quality score"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("quality score", T.DoubleType())]))
