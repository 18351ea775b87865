"""Efficient frontiers: candidate weights as rows, figures as aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.functions.clean import round_even
from navspark.operators.solvers import Frontier, Region
from navspark.operators.stats import DAYS


def lattice(spark: SparkSession, assets: Sequence[str], steps: int = 10) -> DataFrame:
    """(candidate, w): every weight vector in multiples of 1 / steps, as an array in the assets' order."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("k"))
    for _ in assets[:-1]:
        left = F.lit(steps) - F.aggregate("k", F.lit(0), lambda a, x: a + x)
        rows = rows.select(F.explode(F.transform(F.sequence(F.lit(0), left), lambda i: F.concat("k", F.array(i)))).alias("k"))
    left = F.lit(steps) - F.aggregate("k", F.lit(0), lambda a, x: a + x)
    rows = rows.select(F.concat("k", F.array(left)).alias("k"))
    return rows.select(F.concat_ws("-", F.col("k").cast("array<string>")).alias("candidate"), F.transform("k", lambda i: i / steps).alias("w"))


def random_weights(spark: SparkSession, n_assets: int, size: int, seed: int = 42, parts: int = 8) -> DataFrame:
    """(candidate, w): uniform on the simplex; each number is a hash of candidate, asset and seed, so reruns agree."""
    def u(i: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64("id", F.lit(i), F.lit(seed)), 11).cast("double")
        return -F.ln((bits + 0.5) / float(1 << 53))

    raw = F.array(*(u(i) for i in range(n_assets)))
    rows = spark.range(0, size, 1, parts).withColumn("raw", raw)
    return rows.select(F.col("id").cast("string").alias("candidate"), _normed(F.col("raw")).alias("w"))


def walk(candidates: DataFrame, size: float = 0.1, tries: int = 4, seed: int = 42) -> DataFrame:
    """Each candidate's ``tries`` steps: a little of another simplex point mixed in."""
    rows = candidates.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    other = F.transform("w", lambda x, i: -F.ln((F.shiftrightunsigned(F.xxhash64("candidate", "turn", i, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)))
    rows = rows.withColumn("o", _normed(other))
    return rows.select(F.concat_ws("/", "candidate", F.col("turn").cast("string")).alias("candidate"), F.zip_with("w", "o", lambda a, b: (1 - size) * a + size * b).alias("w"))


def _normed(w: Column) -> Column:
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.transform(w, lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.size(w)))


def quantised(w: Column, step: float) -> Column:
    """Weights on multiples of the step, normed; all zero gives equal ones."""
    return _normed(F.transform(w, lambda x: F.bround(x / step) * step))


def repaired(w: Column, low: Sequence[float], high: Sequence[float], passes: int = 10) -> Column:
    """Weights moved into their bounds, what is over or missing spread over the room that is left; null if the bounds allow none."""
    if sum(low) > 1 + 1e-9 or sum(high) < 1 - 1e-9:
        return F.lit(None).cast("array<double>")
    lo, hi = F.array(*map(F.lit, map(float, low))), F.array(*map(F.lit, map(float, high)))

    def clipped(v: Column) -> Column:
        return F.zip_with(F.zip_with(v, lo, lambda x, b: F.greatest(x, b)), hi, lambda x, b: F.least(x, b))

    def once(v: Column, _: Column) -> Column:
        c = clipped(v)
        gap = F.lit(1.0) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        room = F.when(gap > 0, F.zip_with(hi, c, lambda h, x: h - x)).otherwise(F.zip_with(c, lo, lambda x, b: x - b))
        total = F.aggregate(room, F.lit(0.0), lambda a, x: a + x)
        return F.when((F.abs(gap) < 1e-12) | (total <= 0), c).otherwise(F.zip_with(c, room, lambda x, r: x + gap * r / total))

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), w, once)


def within(w: Column, assets: Sequence[str], groups: Sequence[tuple[Sequence[str], float, float]]) -> Column:
    """Whether every group's weight is within its limits."""
    out = F.lit(True)
    for names, low, high in groups:
        total = sum((w[i] for i, a in enumerate(assets) if a in names), F.lit(0.0))
        out = out & total.between(low - 1e-9, high + 1e-9)
    return out


def _one_row(moments: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(m): the means and covariances (a, b, mean_a, cov) as one array, asset by asset; small by the number of assets."""
    index = F.create_map(*(F.lit(x) for i, a in enumerate(assets) for x in (a, i)))
    cells = moments.select(F.element_at(index, F.col("a")).alias("i"), F.element_at(index, F.col("b")).alias("j"), "mean_a", "cov")
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "mean_a", "cov"))), lambda c: F.struct(c["mean_a"].alias("mean"), c["cov"].alias("cov"))).alias("m"))


def _solved(asked: DataFrame, moments: DataFrame, assets: Sequence[str], region: Region, days: int, exact: bool = False) -> DataFrame:
    """(candidate, w, ret, risk) of least risk for each (candidate, least) of a least, or ``exact``, annual return; nothing where that is out of reach."""
    n = len(assets)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                mean = np.array([r.m[i * n]["mean"] for i in range(n)], float) * days
                cov = np.array([c["cov"] for c in r.m], float).reshape(n, n) * days
                line = Frontier(region, cov, mean, region.low)
                w = line.exactly(r.least) if exact else line.above(r.least)
                if w is not None:
                    w = region.clean(w)
                    out.append((r.candidate, w.tolist(), float(mean @ w), float(np.sqrt(max(w @ cov @ w, 0.0)))))
            yield pd.DataFrame(out, columns=["candidate", "w", "ret", "risk"])

    return asked.crossJoin(F.broadcast(_one_row(moments, assets))).select("candidate", "least", "m").mapInPandas(rows, "candidate string, w array<double>, ret double, risk double")


def _region(assets: Sequence[str], low: Sequence[float] | None, high: Sequence[float] | None, groups: Sequence[tuple[Sequence[str], float, float]]) -> Region:
    n = len(assets)
    masks = tuple((np.array([a in names for a in assets]), float(lo), float(hi)) for names, lo, hi in groups)
    return Region(np.array(low or [0.0] * n, float), np.array(high or [1.0] * n, float), masks)


def refined(
    points: DataFrame, moments: DataFrame, assets: Sequence[str], low: Sequence[float] | None = None, high: Sequence[float] | None = None, groups: Sequence[tuple[Sequence[str], float, float]] = (),
    buckets: int = 20, days: int = DAYS,
) -> DataFrame:
    """``points`` and, for the least risky of each of ``buckets`` return ranges, the point of least risk that returns as much.

    Solved exactly within the bounds and limits, one row a bucket; names of the
    new candidates end on ``+``.
    """
    best = best_of_buckets(points, buckets).select(F.concat("candidate", F.lit("+")).alias("candidate"), F.col("ret").alias("least"))
    return points.select("candidate", "w", "ret", "risk").unionByName(_solved(best.repartition("candidate"), moments, assets, _region(assets, low, high, groups), days))


def target_frontier(
    moments: DataFrame, assets: Sequence[str], n: int = 100, low: Sequence[float] | None = None, high: Sequence[float] | None = None, groups: Sequence[tuple[Sequence[str], float, float]] = (), days: int = DAYS,
) -> DataFrame:
    """(candidate, w, ret, risk): least risk for ``n`` target returns from the least to the greatest mean of an asset.

    Targets are rows, solved in as many tasks as there are partitions, and are
    met exactly, also below the return of the least risky portfolio; a target
    that the bounds rule out gives no row.
    """
    ends = moments.agg((F.min("mean_a") * days).alias("lo"), (F.max("mean_a") * days).alias("hi"))
    share = F.col("id") / max(n - 1, 1)
    asked = moments.sparkSession.range(n).crossJoin(F.broadcast(ends)).select(F.col("id").cast("string").alias("candidate"), (F.col("lo") + share * (F.col("hi") - F.col("lo"))).alias("least"))
    return _solved(asked, moments, assets, _region(assets, low, high, groups), days, exact=True)


def evaluated(candidates: DataFrame, moments: DataFrame, assets: Sequence[str], days: int = DAYS) -> DataFrame:
    """Candidates with annual ret and risk from the assets' means and covariances (a, b, mean_a, cov).

    The matrix of moments is one row, small by the number of assets, so each
    candidate is a row expression and no path of returns is built.
    """
    n = len(assets)
    joined = candidates.crossJoin(F.broadcast(_one_row(moments, assets)))
    ret = sum((F.col("w")[i] * F.col("m")[i * n]["mean"] for i in range(n)), F.lit(0.0)) * days
    var = sum((F.col("w")[i] * F.col("w")[j] * F.col("m")[i * n + j]["cov"] for i in range(n) for j in range(n)), F.lit(0.0))
    return joined.select("candidate", "w", ret.alias("ret"), (F.sqrt(F.greatest(var, F.lit(0.0))) * F.sqrt(F.lit(days))).alias("risk"))


def path_returns(candidates: DataFrame, returns: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(asset, date, ret) with the candidate as asset, for risks that need whole paths; feed to ``stats.risk_metrics``."""
    long = candidates.select("candidate", F.posexplode("w").alias("i", "x"))
    names = F.element_at(F.array(*map(F.lit, assets)), F.col("i") + 1)
    joined = long.withColumn("asset", names).join(returns, "asset")
    return joined.groupBy(F.col("candidate").alias("asset"), "date").agg(F.sum(F.col("x") * F.col("ret")).alias("ret"))


def best_of_buckets(points: DataFrame, buckets: int) -> DataFrame:
    """The least risky candidate of each of equal return ranges; the greatest return is in the last one."""
    ends = points.agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("ret") - F.col("lo"), F.col("hi") - F.col("lo")) * buckets), F.lit(0)), F.lit(buckets - 1))
    return points.crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket")).agg(F.min_by(F.struct("candidate", "w", "ret", "risk"), F.struct("risk", "candidate")).alias("p")).select("bucket", "p.*")


def explored(
    seeds: DataFrame, moments: DataFrame, assets: Sequence[str], low: Sequence[float] | None = None, high: Sequence[float] | None = None, groups: Sequence[tuple[Sequence[str], float, float]] = (),
    rounds: int = 3, buckets: int = 20, size: float = 0.1, tries: int = 8, step: float | None = None, days: int = DAYS,
) -> DataFrame:
    """(candidate, w, ret, risk): all feasible points of an exploration.

    Seeds are moved into their bounds and dropped where a group's limits do not
    hold.  Each round takes the least risky point of each of ``buckets`` return
    ranges and walks from it, ``tries`` steps of a size that halves with the
    rounds; with ``step``, weights end on its multiples where these satisfy all
    limits.  The rounds' points are a union, so a round walks from a bounded
    number of rows, whatever the number of seeds.
    """
    n = len(assets)
    low, high = list(low or [0.0] * n), list(high or [1.0] * n)
    inside = lambda w: F.forall(F.arrays_zip(w.alias("x"), F.array(*map(F.lit, low)).alias("l"), F.array(*map(F.lit, high)).alias("h")), lambda z: (z["x"] >= z["l"] - 1e-9) & (z["x"] <= z["h"] + 1e-9))

    def feasible(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("w", repaired(F.col("w"), low, high)).where("w is not null")
        if step:
            rows = rows.withColumn("q", quantised(F.col("w"), step)).withColumn("w", F.when(inside(F.col("q")) & within(F.col("q"), assets, groups), F.col("q")).otherwise(F.col("w"))).drop("q")
        return evaluated(rows.where(inside(F.col("w")) & within(F.col("w"), assets, groups)), moments, assets, days)

    points = feasible(seeds)
    for k in range(rounds):
        best = best_of_buckets(points, buckets).select("candidate", "w")
        points = points.unionByName(feasible(walk(best, size / 2**k, tries, seed=42 + k)))
    return points


def envelope(points: DataFrame) -> DataFrame:
    """The frontier: of each risk, at four decimals, the greatest return, and of these only those above all of lower risk."""
    best = points.groupBy(round_even(F.col("risk"), 4).alias("risk")).agg(F.max("ret").alias("ret"))
    # One row per distinct rounded risk is left, whatever the number of candidates.
    before = Window.orderBy("risk").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("top", F.max("ret").over(before)).where(F.col("top").isNull() | (F.col("ret") > F.col("top"))).drop("top")


def special(points: DataFrame, free: float = 0.015) -> DataFrame:
    """The points of greatest Sharpe ratio, least risk and greatest return; ties by candidate."""
    p = F.struct("candidate", "ret", "risk")
    sharpe = F.try_divide(F.col("ret") - free, F.col("risk"))
    found = points.agg(
        F.min_by(p, F.struct((-sharpe).alias("s"), "candidate")).alias("max_sharpe"), F.min_by(p, F.struct("risk", "candidate")).alias("min_risk"), F.min_by(p, F.struct((-F.col("ret")).alias("r"), "candidate")).alias("max_return"),
    )
    return found.select(F.explode(F.array(*(F.struct(F.lit(k).alias("point"), F.col(k).alias("p")) for k in ("max_sharpe", "min_risk", "max_return")))).alias("e")).select("e.point", "e.p.*")


def finite_points(points: DataFrame) -> DataFrame:
    ok = [~F.isnan(c) & (F.abs(c) != float("inf")) & F.col(c).isNotNull() for c in ("ret", "risk")]
    return points.where(ok[0] & ok[1])
