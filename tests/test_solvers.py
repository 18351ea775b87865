"""Solvers against lattices and closed forms, schedules against one solve a date, resolution against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navspark.functions import kernels
from navspark.operators import solvers, stats, universe, weights


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 100_000), n=st.integers(3, 7))
def test_quadratic_is_optimal(seed, n):
    """The conditions of an optimum, by a small move towards any other feasible point."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, n))
    q, p = m @ m.T + 0.1 * np.eye(n), rng.normal(size=n)
    region = solvers.Region(np.full(n, 0.02), np.full(n, 0.8), ((np.arange(n) < 2, 0.1, 0.6),))
    x = solvers.quadratic(q, p, *region.rows(), 1)
    assert region.contains(x)
    for _ in range(30):
        y = region.nearest(rng.normal(size=n))
        assert region.contains(y) and (q @ x + p) @ (y - x) >= -1e-8


def test_empty_region():
    assert solvers.Region(np.array([0.6, 0.6]), np.ones(2)).nearest(np.ones(2)) is None
    both = solvers.Region(np.zeros(3), np.ones(3), ((np.array([True, True, False]), 0.7, 1.0), (np.array([False, False, True]), 0.5, 1.0)))
    assert both.nearest(np.ones(3) / 3) is None
    s = weights.Strategy("s", "min_risk", groups=((("a", "b"), 0.7, 1.0), (("c",), 0.5, 1.0)))
    assert weights.solve(np.random.default_rng(0).normal(size=(9, 3)), ["a", "b", "c"], s).tolist() == [1 / 3] * 3


def test_frontier_is_the_two_fund_line():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(4, 4))
    v, c = m @ m.T + np.eye(4), np.array([0.02, 0.05, 0.03, 0.04])
    region = solvers.Region(np.full(4, -50.0), np.full(4, 50.0))
    line = solvers.Frontier(region, v, c, np.full(4, 0.25))
    inverse, one = np.linalg.inv(v), np.ones(4)
    a, b, d = one @ inverse @ one, one @ inverse @ c, c @ inverse @ c
    for aim in (0.04, 0.05, 0.06):
        w = line.above(aim)
        g, h = (d - aim * b) / (a * d - b * b), (aim * a - b) / (a * d - b * b)
        assert w == pytest.approx(inverse @ (g * one + h * c), abs=1e-6)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 100_000), kind=st.sampled_from(weights.TARGETS), risk=st.sampled_from(["vol", "es"]))
def test_targets_with_groups(seed, kind, risk):
    """No feasible point of a random cloud is better, and limits hold to 1e-9."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 7))
    names = [f"a{i}" for i in range(n)]
    x = rng.normal(0.003, 0.03, size=(50, n))
    s = weights.Strategy("s", kind, return_metric="mean", risk_metric=risk, target=0.03 if kind == "return_max_given_risk" else 0.004, bounds={a: (0.02, 0.6) for a in names}, groups=((tuple(names[:2]), 0.2, 0.5),))
    w, region, goal = weights.solve(x, names, s), weights._region(names, s), weights._goal(x, s)
    assert region.contains(w, 1e-9)
    for _ in range(60):
        y = region.nearest(rng.dirichlet(np.full(n, rng.choice([0.3, 1.0, 5.0]))))
        assert goal(w) <= goal(y) + 1e-7 * (1 + abs(goal(y)))


def test_traps_of_pairwise_exchange():
    """Seeds on which moving weight between pairs stops short of the best point."""
    grid = [np.array([a, b, 20 - a - b]) / 20 for a in range(2, 13) for b in range(0, 15) if 2 <= 20 - a - b <= 20]
    for seed in (52, 245, 333, 369):
        x = np.random.default_rng(seed).normal(0.01, 0.05, size=(40, 3))
        for kind in weights.TARGETS:
            s = weights.Strategy("s", kind, target=0.04 if kind == "return_max_given_risk" else 1.0, bounds={"a": (0.1, 0.6), "b": (0.0, 0.7), "c": (0.1, 1.0)})
            goal = weights._goal(x, s)
            assert goal(weights.solve(x, ["a", "b", "c"], s)) <= min(map(goal, grid)) + 1e-6


def panel_of(spark, days=40, names="xyz", seed=3):
    rng = np.random.default_rng(seed)
    nav = np.cumprod(1 + rng.normal(0.001, 0.02, (days, len(names))), axis=0)
    nav[7, 1] = 0.0  # the return after it has no value: that date counts for nobody
    rows = [(a, dt.date(2024, 1, 1) + dt.timedelta(d), float(nav[d, i])) for d in range(days) for i, a in enumerate(names)]
    return nav, spark.createDataFrame(rows, "asset string, date date, nav double")


def test_schedule_equals_one_solve_a_date(spark):
    nav, panel = panel_of(spark)
    kinds = [(k, r, mode) for k in (*weights.TARGETS, "risk_budget", "fixed", "other") for r, mode in (("vol", "all"), ("vol", "rollingN"))] + [("min_risk", "es", "rollingN"), ("min_risk", "es", "all"), ("max_sharpe", "max_drawdown", "all")]
    models = [weights.Strategy(f"{i}", k, weights={"x": 1, "y": 2}, budgets={"x": 0.5, "y": 0.2, "z": 0.3}, return_metric="mean", risk_metric=r, target=0.02 if k == "return_max_given_risk" else 0.0005, window_mode=mode, length=9) for i, (k, r, mode) in enumerate(kinds)]
    at = [1, 2, 12, 25, 39]
    dates = spark.createDataFrame([(m.name, dt.date(2024, 1, 1) + dt.timedelta(d)) for m in models for d in at], "strategy string, date date")
    found = {(r.strategy, (r.date - dt.date(2024, 1, 1)).days, r.asset): r.weight for r in weights.schedule(panel, models, dates).collect()}
    assert len(found) == len(models) * len(at) * 3
    for m in models:
        for d in at:
            rows = nav[: d + 1] if m.window_mode == "all" else nav[: d + 1][-9:]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = rows[1:] / rows[:-1] - 1
            w = weights.solve(x[np.isfinite(x).all(axis=1)], list("xyz"), m)
            assert [found[m.name, d, a] for a in "xyz"] == pytest.approx(w, abs=1e-7), (m, d)


def test_running_moments_move_rows_in_proportion(spark):
    """A row for each date, each asset and each two assets; no date meets its history."""
    _, panel = panel_of(spark, days=30)
    sums = weights.running_moments(panel)
    assert sums.count() == 30 and {len(r.firsts) for r in sums.collect()} == {3} and {len(r.seconds) for r in sums.collect()} == {6}
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_risk_budget_starts_at_the_budgets():
    assert weights.DAMP == 0.7
    cov = np.diag([0.04, 0.01])
    assert weights.risk_budget(cov, np.array([0.5, 0.5])) == pytest.approx([1 / 3, 2 / 3], abs=1e-7)


def test_resolution_equals_brute_force(spark):
    rng = random.Random(6)
    products = [(i, "".join(rng.choice("01ab") for _ in range(rng.randint(1, 12))) + rng.choice([".SH", ".SZ", ""]), f"n{rng.randrange(40)}") for i in range(150)]
    products += [(900, None, "n1"), (901, "", None)]
    requests = [("".join(rng.choice("01ab") for _ in range(rng.randint(0, 10))) + rng.choice([".OF", ""]), f"n{rng.randrange(80)}") for _ in range(200)] + [(p[1][1:9] + ".X", None) for p in products[:60]] + [(None, "n3"), (None, None), ("", "n5")]
    bare = lambda c: None if c is None else c.strip().split(".")[0]
    expected = {}
    for code, name in set(requests):
        ns, best = bare(code), None
        for pos, ts, n in products:
            rank = 0 if code is not None and code == ts else 1 if ns is not None and ns == bare(ts) else 2 if name is not None and name == n else 3 if ns and ts is not None and ns in ts else None
            if rank is not None and (best is None or (rank, pos) < best[:2]):
                best = (rank, pos, ts, n)
        expected[code, name] = (None, None, None) if best is None else (best[0], *best[2:])
    frame = spark.createDataFrame(requests, "req_code string, req_name string")
    found = universe.resolve(frame, spark.createDataFrame(products, "pos int, ts_code string, name string")).collect()
    got = {(r.req_code, r.req_name): (r.match_rank, r.ts_code, r.name) for r in found}
    assert len(found) == len(expected) and got == expected


def test_resolution_meets_a_common_name_once(spark):
    """Joins and generators make rows in proportion to requests and products, however many share a name."""
    n = 3000
    products = spark.range(n).selectExpr("id as pos", "concat(id, '.SH') as ts_code", "'common' as name")
    requests = spark.range(n).selectExpr("concat('none', id) as req_code", "'common' as req_name")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = universe.resolve(requests, products).collect()
    assert len(found) == n and {(r.match_rank, r.ts_code) for r in found} == {(2, "0.SH")}
    made, runs = 0, store.executionsList()
    for run in (runs.apply(i) for i in range(before, runs.size())):
        metrics, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and metrics.contains(metric.accumulatorId()):
                    made = max(made, int(metrics.apply(metric.accumulatorId()).replace(",", "")))
    assert n <= made <= 2 * n


@pytest.mark.parametrize("path,rate,steps", [([1, 1.2, 1.2, 0.8, 1.3], 0.4 / 1.2, 3), ([2, 1, 2, 1, 2], 0.5, 2), ([1, 1, 1], 0.0, 0), ([1, 0.5], 0.5, None)])
def test_recovery_counts_from_the_first_of_equal_peaks(spark, path, rate, steps):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1 + i), float(x)) for i, x in enumerate(path)], "asset string, date date, nav double")
    r = stats.recovery(rows).first()
    assert r.max_drawdown == pytest.approx(rate) and r.recovery == steps
    k = spark.range(1).select(kernels.max_drawdown_rate_and_recovery_days(F.array(*(F.lit(float(x)) for x in path))).alias("k")).first().k
    assert k.rate == pytest.approx(rate) and k.steps == steps


def test_search_sorts_missing_as_empty_text_and_keeps_the_total(spark):
    rows = spark.createDataFrame([(i, f"c{i}", f"n{i}", None if i % 3 == 0 else f"m{i % 2}") for i in range(12)], "pos int, code string, name string, management string")
    key = lambda i: "" if i % 3 == 0 else f"m{i % 2}"
    up = [r.pos for r in universe.search_page(rows, "C", "management", size=50).collect()]
    assert up == sorted(range(12), key=lambda i: (key(i), i))
    down = [r.pos for r in universe.search_page(rows, "c", "management", descending=True, size=50).collect()]
    assert down == sorted(range(12), key=key, reverse=True)
    beyond = universe.search_page(rows, "c1", "no such", number=9).collect()
    assert [(r.pos, r.total) for r in beyond] == [(None, 3)]
    assert [r.pos for r in universe.page(rows, "found_date").collect()] == list(range(12))
