"""Edge values of kernels, windows, calendars, weights, language, storage and streaming."""

import datetime as dt
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navspark.functions import clean
from navspark.functions import kernels as k
from navspark.operators import dsl, frontier, panel, rebalance, stats, technical, universe, weights
from navspark.sources import ingest
from navspark.streaming import panel as streaming


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(*xs):
    return F.array(*(F.lit(float(x)) for x in xs)) if xs else F.array().cast("array<double>")


def cases():
    return [
        (k.sequence_prod(array()), 1.0), (k.sequence_sum(array()), 0.0), (k.sequence_mean(array(1, 2, 3, 4)), 2.5), (k.sequence_variance(array(1, 2, 3, 4)), 5 / 3), (k.sequence_variance(array(1, 2, 3, 4), 0), 1.25),
        (k.sequence_min(array()), None), (k.sequence_mean(array()), None), (k.sequence_variance(array(1)), None), (k.divide(F.lit(3.0), F.lit(0.0)), None), (k.reciprocal(F.lit(1e-13)), None),
        (k.sequence_divide(array(1, 2, 3), array(1, 0.5, 0)), [1.0, 4.0, None]), (k.cumulative_simple_returns(array(0.1, -0.05, 0.2)), [0.1, 0.045, 0.254]), (k.cumulative_net_value(array(0.1, -0.05, 0.2), 100), [100.0, 110.0, 104.5, 125.4]),
        (k.sequence_geometric_mean(array(1.1, 1.2, 1.3)), (1.1 * 1.2 * 1.3) ** (1 / 3)), (k.sequence_geometric_mean(array(1, -1)), None), (k.sequence_geometric_mean(array()), None),
        (k.sequence_compound_annual_growth_rate(array(0.1, 0.1, 0.1, 0.1), 4), 1.1**4 - 1), (k.sequence_compound_annual_growth_rate(array(), 4), None),
        (k.sequence_drawdown(array(100, 110, 105, 120, 115)), [0.0, 0.0, -5 / 110, 0.0, -5 / 120]), (k.sequence_drawdown(array(0, 0.1)), [None, 0.0]), (k.power(F.lit(-1.0), F.lit(0.5)), None),
        (k.max_drawdown_rate_and_recovery_days(array(1, 1.1, 1.2, 1.3)), (0.0, 0.0)), (k.max_drawdown_rate_and_recovery_days(array(1, 1.2, 0.8, 1.05, 1.2)), (0.4 / 1.2, 3.0)), (k.max_drawdown_rate_and_recovery_days(array(1, 1.3, 0.9, 1, 1.1)), (0.4 / 1.3, None)),
        (k.maximum(F.lit(2.0), F.lit(3.0)), 3.0), (k.minimum(F.lit(2.0), F.lit(3.0)), 2.0), (k.sharpe_ratio(F.lit(1.0), F.lit(0.0)), None), (k.calmar_ratio(F.lit(1.0), F.lit(0.0)), None), (k.annualized_return(F.lit(-1.5), F.lit(2.0)), None),
        (k.volatility_from_variance(F.lit(-1.0)), None), (k.annualized_volatility(F.lit(1.0), F.lit(-1.0)), None), (k.win_rate(array(0.1, -0.1)), 0.5), (k.loss_rate(array(0.1, -0.1)), 0.5),
        (clean.round_even(F.lit(0.12345)), 0.1234), (clean.finite_or_zero(F.lit(float("nan"))), 0.0), (clean.finite(F.lit(float("inf"))), None), (clean.number(F.lit("3.5亿"), amount=True), 35000.0), (clean.number(F.lit("abc")), None),
        (clean.strip_suffix(F.lit(" 510050.SH ")), "510050"), (clean.issue_text(F.lit(None).cast("double")), "--"), (clean.issue_text(F.lit(12345.0)), "1.23亿"),
    ]


def test_kernel_values(spark):
    for column, want in cases():
        check(spark, column, want)


def check(spark, column, want):
    got = value(spark, column)
    if want is None or isinstance(want, str):
        assert got == want
    elif isinstance(want, (list, tuple)):
        assert [None if w is None else pytest.approx(w) for w in want] == list(got)
    else:
        assert got == pytest.approx(want)


def test_kernel_errors(spark):
    with pytest.raises(ValueError):
        k.clip(F.lit(1.0), 5, 0)
    with pytest.raises(Exception, match="length"):
        value(spark, k.sequence_add(array(1), array(1, 2)))


@pytest.fixture(scope="module")
def ten(spark):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(a, start + dt.timedelta(d), float(d + x)) for a, x in (("A", 0), ("B", 10)) for d in range(10)], "asset string, date date, nav double")


@pytest.mark.parametrize("mode,length,upto,want", [("all", None, 6, range(7)), ("rollingN", 4, 9, range(6, 10)), ("rollingN", 1, 1, (0, 1)), (None, 5, 4, range(5)), ("ROLLINGn", 3, 8, (6, 7, 8)), ("rollingN", None, 5, (4, 5))])
def test_window_slice(ten, mode, length, upto, want):
    day = F.lit(dt.date(2024, 1, 1) + dt.timedelta(upto))
    rows = panel.tail_window(ten, day, mode, length).where("asset = 'A'").collect()
    assert sorted(int(r.nav) for r in rows) == list(want)


def test_gate(spark, ten):
    weekly = rebalance.rebalance_dates(ten, "weekly", "nth", n=1)
    assert rebalance.gated(ten, weekly, "all").orderBy("date").first().date == dt.date(2024, 1, 8)
    with pytest.raises(ValueError):
        rebalance.gated(ten, weekly, "rollingN", 50)
    assert rebalance.rebalance_dates(ten, "no such mode").count() == 0


def test_static_path_and_markers(spark, ten):
    w = spark.createDataFrame([("s", "A", 1.0), ("s", "B", 1.0)], "strategy string, asset string, weight double")
    path, markers = rebalance.paths(ten, w)
    rows = {r.date.day: r.value for r in path.collect()}
    # A starts at 0, so only B is held.
    assert rows[1] == pytest.approx(1) and rows[10] == pytest.approx(1.9)
    assert {m.asset: m.weight for m in markers.collect()} == {"A": 0.0, "B": 1.0}


def test_rebalanced_equals_static_for_equal_returns(spark):
    rows = [(a, dt.date(2024, 1, 1) + dt.timedelta(d), x * 1.01**d) for a, x in (("A", 1.0), ("B", 5.0)) for d in range(40)]
    p = spark.createDataFrame(rows, "asset string, date date, nav double")
    w = spark.createDataFrame([("s", "A", 0.3), ("s", "B", 0.7)], "strategy string, asset string, weight double")
    dates = rebalance.rebalance_dates(p, "fixed", interval=7)
    moved, markers = rebalance.paths(p, w, dates.withColumn("strategy", F.lit("s")))
    held = {r.date: r.value for r in rebalance.paths(p, w)[0].collect()}
    got = {r.date: r.value for r in moved.collect()}
    assert got.keys() == held.keys() and all(got[d] == pytest.approx(held[d]) for d in held)
    assert all(got[m.date] == pytest.approx(m.value) for m in markers.collect())


def test_constant_series(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), 1.0) for i in range(5)] + [("B", dt.date(2024, 1, 1 + i), float(i)) for i in range(5)], "asset string, date date, ret double")
    found = {(r.a, r.b): r.corr for r in stats.matrix(rows).collect()}
    assert found["A", "A"] == 0 and found["A", "B"] == 0 and found["B", "B"] == pytest.approx(1)
    assert all(r.corr == 0 for r in technical.rolling_correlation(rows, "A", 3).collect())


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 5), st.integers(0, 10_000))
def test_risk_budget_shares(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, n))
    cov = np.cov(x, rowvar=False) + np.eye(n) * 0.1
    b = rng.uniform(0.2, 1, n)
    w = weights.risk_budget(cov, b)
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    share = w * (cov @ w)
    assert share / share.sum() == pytest.approx(b / b.sum(), abs=1e-3)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["min_risk", "max_return", "max_sharpe", "max_sharpe_traditional", "risk_min_given_return", "return_max_given_risk"]))
def test_targets_beat_a_lattice(seed, kind):
    x = np.random.default_rng(seed).normal(0.01, 0.05, size=(40, 3))
    s = weights.Strategy("s", kind, target=0.04 if kind == "return_max_given_risk" else 1.0, bounds={"a": (0.1, 0.6), "b": (0.0, 0.7), "c": (0.1, 1.0)})
    w = weights.solve(x, ["a", "b", "c"], s)
    assert w.sum() == pytest.approx(1) and 0.1 - 1e-9 <= w[0] <= 0.6 + 1e-9 and w[1] <= 0.7 + 1e-9 and w[2] >= 0.1 - 1e-9
    goal = weights._goal(x, s)
    grid = [np.array([a, b, 20 - a - b]) / 20 for a in range(2, 13) for b in range(0, 15) if 2 <= 20 - a - b <= 20]
    assert goal(w) <= min(goal(g) for g in grid) + 1e-6


def test_weights_fall_back_to_equal():
    s = weights.Strategy("s", "min_risk")
    assert weights.solve(np.zeros((2, 2)), ["a", "b"], s).tolist() == [0.5, 0.5]
    assert weights.solve(np.zeros((9, 2)), ["a", "b"], weights.Strategy("s", "no such")).tolist() == [0.5, 0.5]
    assert weights.risk_budget(np.eye(1), np.ones(1)).tolist() == [1.0]


def test_infeasible_bounds(spark):
    assert value(spark, frontier.repaired(array(0.5, 0.5), (0.7, 0.7), (1, 1))) is None


def test_frontier_keeps_finite_points(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("b", float("nan"), 1.0), ("c", 1.0, float("inf")), ("d", None, 1.0)], "candidate string, ret double, risk double")
    assert [r.candidate for r in frontier.finite_points(rows).collect()] == ["a"]


def test_language():
    a = dsl.parse(r"\frac{\left(\prod\left(\mathbf{r} + 1\right)\right) - 1}{\operatorname{std}\left(\mathbf{r}, 1\right)}")
    kinds = [n.kind for n in dsl.nodes(a)]
    assert kinds.count("variable") == 1 and kinds[-1] == "binary"
    assert dsl.to_dot(a).startswith("digraph")
    assert dsl.years("3M") == dsl.years("M3") == pytest.approx(0.25)
    for bad in (r"\operatorname{nothing}(1)", "1 +", "(1", "$"):
        with pytest.raises(dsl.ExpressionError):
            dsl.parse(bad)
    found = dsl.profiles('{"x": {"metadata": {"annual_risk_free_rate_percent": 1.5}, "indicators": [{"name": "n", "dsl_expression": "1", "periods": ["1W"]}]}}')
    assert dsl.profile(found).free == pytest.approx(1.015 ** (1 / 252) - 1)
    with pytest.raises(ValueError):
        dsl.profile(found, "y")


def test_spec_key():
    assert clean.spec_key({"b": 1, "a": None}) == clean.spec_key({"b": 1})
    assert clean.spec_key({"a": 1, "b": 2}) == clean.spec_key({"b": 2, "a": 1})
    assert universe.terms(["a, b", "c", " "]) == ["a", "b", "c"]


def test_allocations(spark, tmp_path):
    nav = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0)], "asset_name string, date date, nv double")
    classes = spark.createDataFrame([("A", "510050", "x", 50.0)], "asset_name string, etf_code string, etf_name string, etf_weight double")
    at = f"file://{tmp_path}"
    assert ingest.allocations(spark, at).count() == 0
    ingest.save_allocation(classes, nav, at, "demo")
    assert [r[0] for r in ingest.allocations(spark, at).collect()] == ["demo"]
    with pytest.raises(ValueError):
        ingest.save_allocation(classes, nav, at, "demo")


def test_files(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"ts_code": "1.SH", "fund_name": "a", "manager": "m"}, {"ts_code": "1.SH", "fund_name": "a", "manager": "m"}, {"fund_name": "b"}]')
    assert [r.code for r in ingest.universe_file(spark, f"file://{tmp_path}/u.json").collect()] == ["1.SH"]
    rows = spark.createDataFrame([("1", "a", dt.date(2024, 1, 1), 1.0), ("2", "b", dt.date(2024, 1, 1), None)], "ts_code string, name string, date date, adj_nav double")
    rows.write.parquet(f"file://{tmp_path}/nav")
    assert ingest.nav_of(spark, f"file://{tmp_path}/nav", ["1"], ["b"]).count() == 1
    ingest.export_csv(rows, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2
    assert ingest.exchange_traded(spark.createDataFrame([("SH",), ("us",)], "exchange string")).count() == 1


def test_streamed_panel_equals_batch(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/events.parquet").repartitionByRange(4, "ts").write.parquet(f"file://{tmp_path}/in")
    for k, name in enumerate(sorted(tmp_path.glob("in/part-*"))):  # files come in the order of their times, which may be one for all here
        os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))
    rows = streaming.daily(streaming.event_stream(spark, f"file://{tmp_path}/in"))
    query = streaming.write_panel(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    got = {(r.asset, r.date): round(r.nav, 6) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    want = {(r.event_type, r.d): round(r.v, 6) for r in batch.collect()}
    # The days within the watermark are still open.
    assert got and all(want[key] == v for key, v in got.items())
    assert max(d for _, d in want) - max(d for _, d in got) <= dt.timedelta(4)


def test_exploration_stays_feasible_and_gains(spark):
    moments = spark.createDataFrame([(a, b, m, c) for (a, m), row in zip((("x", 0.001), ("y", 0.0005), ("z", 0.0002)), ((4e-4, 1e-5, 0.0), (1e-5, 1e-4, 2e-6), (0.0, 2e-6, 9e-6))) for b, c in zip("xyz", row)], "a string, b string, mean_a double, cov double")
    low, high, groups = (0.0, 0.1, 0.0), (0.5, 0.8, 0.6), [(("x", "y"), 0.4, 0.9)]
    seeds = frontier.random_weights(spark, 3, 300)
    first = frontier.explored(seeds, moments, "xyz", low, high, groups, rounds=0)
    points = frontier.explored(seeds, moments, "xyz", low, high, groups, rounds=2, buckets=8)
    rows = points.collect()
    assert len(rows) > first.count() > 0
    for r in rows:
        assert abs(sum(r.w) - 1) < 1e-9 and all(lo - 1e-9 <= x <= hi + 1e-9 for x, lo, hi in zip(r.w, low, high)) and 0.4 - 1e-9 <= r.w[0] + r.w[1] <= 0.9 + 1e-9
        w = np.array(r.w)
        assert r.ret == pytest.approx(w @ [0.001, 0.0005, 0.0002] * 252) and r.risk == pytest.approx((w @ [[4e-4, 1e-5, 0], [1e-5, 1e-4, 2e-6], [0, 2e-6, 9e-6]] @ w * 252) ** 0.5)
    assert min(r.risk for r in rows) <= min(r.risk for r in first.collect())
    stepped = frontier.explored(frontier.lattice(spark, "xyz"), moments, "xyz", low, high, groups, rounds=1, step=0.05).where(F.expr("exists(w, x -> abs(x * 20 - round(x * 20)) < 1e-6)"))
    assert stepped.count() > 0


def test_point_weights(spark):
    rng = np.random.default_rng(2)
    nav = np.cumprod(1 + rng.normal(0.001, [0.01, 0.02, 0.04], (200, 3)), axis=0)
    rows = [(a, dt.date(2024, 1, 1) + dt.timedelta(d), float(nav[d, i])) for d in range(200) for i, a in enumerate("xyz")]
    panel_rows = spark.createDataFrame(rows, "asset string, date date, nav double")
    s = weights.Strategy("rp", "risk_budget", budgets={"x": 0.5, "y": 0.3, "z": 0.2})
    found = {r.asset: r.percent for r in weights.point_weights(panel_rows, s, leverage=2.0).collect()}
    w = np.array([found[a] for a in "xyz"]) / 200
    cov = np.cov((nav[1:] / nav[:-1] - 1).T)
    share = w * (cov @ w) / (w @ cov @ w)
    assert sum(found.values()) == pytest.approx(200, abs=0.02) and np.allclose(share, [0.5, 0.3, 0.2], atol=2e-3)
    short = weights.point_weights(panel_rows.where("date <= date'2024-01-03'"), s)
    assert {r.asset: r.percent for r in short.collect()} == {"x": 50.0, "y": 30.0, "z": 20.0}
    assert weights.point_weights(panel_rows.limit(0), s).count() == 0


def test_leading_share_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (150, 4)) @ rng.normal(0, 1, (4, 4))
    rows = spark.createDataFrame([(f"a{i}", dt.date(2024, 1, 1) + dt.timedelta(d), float(x[d, i])) for d in range(150) for i in range(4)], "asset string, date date, ret double")
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert weights.leading_share(rows).first().share == pytest.approx(values[-1] / values.sum())


def test_search_page(spark):
    rows = spark.createDataFrame([(i, f"code{i}", f"name {i % 3}", f"m{i % 5}") for i in range(30)], "pos int, code string, name string, management string")
    found = universe.search_page(rows, "name 1", "management", descending=True, top=7, number=2, size=5).collect()
    best = sorted((i for i in range(30) if i % 3 == 1), key=lambda i: (-(i % 5), i))[:7][5:]
    assert [r.pos for r in found] == best and {r.total for r in found} == {10}
