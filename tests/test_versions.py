"""Kept tables, frontiers from solvers, streaming recursions and pairwise moments."""

import datetime as dt
import itertools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark.operators import frontier, stats, technical, weights
from navspark.sources import versions


def test_cleaned_scan_reads_changed_files_only(spark, tmp_path):
    data, store = f"{tmp_path}/data", f"{tmp_path}/store"
    for i in range(3):
        spark.createDataFrame([(i, f" {i} ")], "id int, x string").coalesce(1).write.mode("append").parquet(data)
    read = spark.sparkContext.accumulator(0)

    def clean(df):
        def count(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return df.withColumn("x", F.trim("x").cast("int")).mapInArrow(count, "id int, x int, _file string, _version string")

    get = lambda: sorted(map(tuple, versions.cleaned_scan(spark, data, clean, store).collect()))
    assert get() == [(0, 0), (1, 1), (2, 2)] and read.value == 3
    assert get() == [(0, 0), (1, 1), (2, 2)] and read.value == 3  # nothing is read again
    one = sorted(f for f in os.listdir(data) if f.endswith(".parquet"))[0]
    os.utime(f"{data}/{one}", (time.time() + 60, time.time() + 60))
    assert get() == [(0, 0), (1, 1), (2, 2)] and read.value == 4  # the touched file alone
    os.remove(f"{data}/{one}")
    assert len(get()) == 2 and read.value == 4


def test_stored_schedule(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    nav = np.cumprod(1 + rng.normal(0.001, 0.02, (30, 3)), axis=0)
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(d)
    panel = spark.createDataFrame([(a, day(d), float(nav[d, i])) for d in range(30) for i, a in enumerate("xyz")], "asset string, date date, nav double")
    models = [weights.Strategy("p", "min_risk"), weights.Strategy("q", "min_risk"), weights.Strategy("r", "max_return")]
    ask = lambda days, some=models: spark.createDataFrame([(m.name, day(d)) for m in some for d in days], "strategy string, date date")
    asked = []

    def counted(panel, strategies, dates):
        asked.append(dates.count())
        return weights.schedule(panel, strategies, dates)

    monkeypatch.setattr(versions, "schedule", counted)
    store = f"{tmp_path}/schedules"
    rows = lambda df: sorted((r.strategy, r.date, r.asset, round(r.weight, 9)) for r in df.collect())
    first = rows(versions.stored_schedule(panel, models, ask([10, 20]), store, 1))
    assert first == rows(weights.schedule(panel, models, ask([10, 20]))) and asked == [4]  # p and q are one request
    assert rows(versions.stored_schedule(panel, models, ask([10, 20]), store, 2)) == first and asked == [4, 0]
    versions.stored_schedule(panel, models, ask([10, 20, 25]), store, 3)
    assert asked == [4, 0, 2]
    versions.stored_schedule(panel, models, ask([10]), store, 4, data="another panel")
    assert asked[-1] == 2
    other = [weights.Strategy("s", "max_sharpe")]
    versions.stored_schedule(panel, other, ask([10], other), store, 5, most=2)
    assert len([f for f in os.listdir(f"{store}/solved") if f.startswith("key=")]) == 2


def moments_of(spark, mean, cov, names):
    return spark.createDataFrame([(a, b, float(mean[i]), float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, mean_a double, cov double")


def test_target_frontier_is_the_analytic_line(spark):
    mean = np.array([0.001, 0.0005, 0.0002])
    cov = np.array([[4e-4, 1e-5, 0], [1e-5, 1e-4, 2e-6], [0, 2e-6, 9e-6]])
    found = frontier.target_frontier(moments_of(spark, mean, cov, "xyz"), "xyz", 11, low=[-9.0] * 3, high=[9.0] * 3).collect()
    c, v, one = mean * 252, cov * 252, np.ones(3)
    inverse = np.linalg.inv(v)
    a, b, d = one @ inverse @ one, one @ inverse @ c, c @ inverse @ c
    assert len(found) == 11
    for r in found:
        aim = c.min() + int(r.candidate) / 10 * (c.max() - c.min())
        assert r.ret == pytest.approx(aim, abs=1e-8) and r.risk == pytest.approx(np.sqrt((a * aim**2 - 2 * b * aim + d) / (a * d - b * b)), rel=1e-6)
    bounded = frontier.target_frontier(moments_of(spark, mean, cov, "xyz"), "xyz", 5, high=[0.5, 1.0, 1.0]).collect()
    assert len(bounded) == 3 and all(max(r.w) <= 1 and r.w[0] <= 0.5 for r in bounded)  # the two highest targets are out of reach


def test_refined_dominates_the_lattice(spark):
    mean, cov = np.array([0.001, 0.0005, 0.0002]), np.array([[4e-4, 1e-5, 0], [1e-5, 1e-4, 2e-6], [0, 2e-6, 9e-6]])
    moments = moments_of(spark, mean, cov, "xyz")
    groups = [(("x", "y"), 0.2, 0.9)]
    points = frontier.evaluated(frontier.lattice(spark, "xyz").where(frontier.within(F.col("w"), "xyz", groups)), moments, "xyz")
    every = frontier.refined(points, moments, "xyz", groups=groups, buckets=12)
    old, new = ({r.candidate: r for r in df.collect()} for df in (points, every))
    assert set(old) < set(new) and len(new) > len(old)
    best = {r.candidate: r for r in frontier.best_of_buckets(points, 12).collect()}
    for name, r in best.items():
        assert new[name + "+"].risk <= r.risk + 1e-9 and new[name + "+"].ret >= r.ret - 1e-9
        assert 0.2 - 1e-9 <= sum(new[name + "+"].w[:2]) <= 0.9 + 1e-9
    curve = [(r.risk, r.ret) for r in frontier.envelope(every).orderBy("risk").collect()]
    for r in frontier.envelope(points).collect():
        assert max(ret for risk, ret in curve if risk <= r.risk + 1e-9) >= r.ret - 1e-9


def test_pairs_are_a_self_join_without_one(spark):
    rng = np.random.default_rng(5)
    rows = [(a, dt.date(2024, 1, 1 + d), float(rng.normal())) for a in "wxyz" for d in range(20) if (a, d) not in (("x", 3), ("z", 7))]
    series = spark.createDataFrame(rows, "asset string, date date, ret double")
    found = sorted(map(tuple, stats.pairs(series).collect()))
    value = {(a, d): x for a, d, x in rows}
    days = sorted({d for _, d, _ in rows})
    assert found == sorted((d, a, b, value[a, d], value[b, d]) for d in days for a, b in itertools.product("wxyz", repeat=2) if (a, d) in value and (b, d) in value)
    assert sorted(map(tuple, stats.pairs(series, upper=True).collect())) == [r for r in found if r[1] < r[2]]
    plan = stats.matrix(series)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 2


def test_kdj_streams_long_series(spark):
    days = 30_000
    rows = spark.range(days).select(F.lit("a").alias("asset"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.sin("id") * 5 + 10).alias("close"))
    rows = rows.select("asset", "date", "close", (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"))
    data = [(r.high, r.low, r.close) for r in rows.orderBy("date").collect()]
    found = [(r.k, r.d, r.j) for r in technical.kdj(rows).orderBy("date").collect()]
    k = d = 50.0
    assert len(found) == days
    for i in range(2000):
        high, low = max(x[0] for x in data[max(0, i - 8) : i + 1]), min(x[1] for x in data[max(0, i - 8) : i + 1])
        k = (2 * k + (data[i][2] - low) / (high - low) * 100) / 3
        d = (2 * d + k) / 3
        assert found[i] == pytest.approx((k, d, 3 * k - 2 * d), abs=0.0051)
        k, d = found[i][:2]
