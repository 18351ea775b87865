"""Running figures by ranges, held paths, payloads, and the smaller operators of the round."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark.functions import clean
from navspark.operators import compare, panel, stats, universe, weights
from navspark.operators import rebalance as r
from navspark.operators import running as g
from navspark.sources import ingest, payload

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def long_panel(spark):
    rng = np.random.default_rng(3)
    rows = [(a, DAY + dt.timedelta(int(i)), None if i % 13 == 5 else float(x)) for a in ("a", "b") for i, x in enumerate(np.exp(rng.normal(0, 0.02, 400).cumsum()))]
    return spark.createDataFrame(rows + [("empty", DAY, None)], "asset string, date date, nav double")


@pytest.mark.parametrize("span", [1, 7, 5000])
@pytest.mark.parametrize("start", [None, 1.05])
def test_ranges_equal_one_window(long_panel, span, start):
    want = {(x.asset, x.date): x.d for x in long_panel.select("asset", "date", panel.drawdown(F.col("nav"), start).alias("d")).collect()}
    found = {(x.asset, x.date): x.drawdown for x in g.long_drawdown(long_panel, start, span=span).collect()}
    assert set(found) == set(want)
    for key, value in want.items():
        assert found[key] == (None if value is None else pytest.approx(value, abs=1e-12))
    returns = panel.returns(long_panel).drop("nav")
    want = {(x.asset, x.date): x.v for x in returns.select("asset", "date", panel.net_value(F.col("ret")).alias("v")).collect()}
    found = {(x.asset, x.date): x.nav for x in g.long_net_value(returns, span=span).collect()}
    assert found == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}


def test_ranges_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, 1, 2.0), (None, DAY, 1, 3.0), ("x", DAY, 1, None), ("x", DAY, 2, 4.0), ("x", DAY, 3, 4.0)], "asset string, date date, n int, nav double")
    found = g.running(rows, {"top": ("max", F.col("nav")), "all": ("sum", F.col("nav"))}, ("date", "n"), 1).orderBy("asset", "date", "n").collect()
    assert [(x.top, x["all"]) for x in found] == [(2.0, 2.0), (3.0, 5.0), (None, 0.0), (4.0, 4.0), (4.0, 8.0)]
    assert g.running(rows.where("false"), {"top": ("max", F.col("nav"))}).count() == 0
    with pytest.raises(ValueError):
        g.running(rows, {"nav": ("max", F.col("nav"))})


def test_one_long_series_is_many_tasks(spark):
    rows = spark.range(0, 300_000, 1, 4).select(F.lit("a").alias("asset"), F.timestamp_seconds(F.col("id") * 600).alias("date"), (F.col("id") % 1000).cast("double").alias("nav"))
    out = g.running(rows, {"top": ("max", F.col("nav")), "n": ("sum", F.lit(1.0))}, span=16)
    last = out.agg(F.max("n"), F.min("top"), F.sum("top")).first()
    assert last[0] == 300_000 and last[1] == 0 and last[2] == sum(range(1000)) + 999.0 * 299_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The rows' window is dealt by ranges, as the only asset is constant here.
    assert plan.count("Window [") == 2 and "hashpartitioning(running block#" in plan


def test_held_path(spark):
    rows = [("a", DAY, 2.0), ("a", DAY + dt.timedelta(1), 3.0), ("b", DAY, 0.0), ("b", DAY + dt.timedelta(1), 9.0), ("c", DAY, None), ("c", DAY + dt.timedelta(1), 1.0)]
    p = spark.createDataFrame(rows, "asset string, date date, nav double")
    w = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("none", "b", 1.0), ("none", "c", None)], "strategy string, asset string, weight double")
    found = {(x.strategy, x.date.day): x.value for x in g.held_path(p, w).collect()}
    assert found == {("s", 1): 1.0, ("s", 2): 1.5, ("none", 1): 0.0, ("none", 2): 0.0}
    assert {(x.strategy, x.date.day): x.value for x in r.paths(p, w)[0].collect()} == found


def test_model_settings():
    own = {"type": "risk_budget", "risk_metric": "es", "confidence": 97.5, "days": 200, "window": 40, "classes": [{"name": "a", "budget": 0.6}]}
    assert payload.model_of(own) == {"risk_metric": "es", "confidence": 97.5, "window_mode": "rollingN"}
    assert payload.model_of({**own, "risk_metric": "ewm_vol"}) == {"risk_metric": "ewm_vol", "days": 200, "window": 40, "window_mode": "rollingN"}
    assert payload.model_of({**own, "model": {"risk_metric": "vol", "window_mode": "all", "data_len": 9}}) == {"risk_metric": "vol", "window_mode": "all", "data_len": 9}
    target = payload.model_of({"type": "target", "target_return": 0.1, "risk_free_rate": 0.0, "model": {"target": "max_sharpe", "target_return": 0.2}})
    assert target == {"target": "max_sharpe", "target_return": 0.2, "return_metric": "annual", "return_type": "simple", "risk_metric": "vol", "risk_free_rate": 0.0, "window_mode": "rollingN"}
    assert payload.model_of({"type": "fixed", "days": 5}) == {"window_mode": "rollingN"}
    asked = payload.request_of("demo", None, own)
    assert asked["classes"] == [{"name": "a", "budget": 0.6}] and asked["rebalance"] == {} and asked["model"]["confidence"] == 97.5
    assert clean.spec_key(asked) == clean.spec_key(dict(reversed(asked.items())))
    limits = {"single_limits": {"a": {"lo": 0.1}, "b": 3}, "group_limits": [{"assets": ["a", "b"], "hi": 0.7}]}
    s = payload.strategy_of({"type": "target", "name": "t", "classes": [{"name": "a"}]}, {"target": "return_max_given_risk", "target_risk": 0.2, "constraints": limits})
    assert (s.kind, s.target, s.bounds, s.groups) == ("return_max_given_risk", 0.2, {"a": (0.1, 1.0)}, ((("a", "b"), 0.0, 0.7),))


def test_payload_run(spark, tmp_path):
    at, rng = f"file://{tmp_path}", np.random.default_rng(1)
    navs = {a: np.exp(rng.normal(0.001, s, 90).cumsum()) for a, s in (("A", 0.01), ("B", 0.02))}
    rows = [(a, DAY + dt.timedelta(i), float(x)) for a, xs in navs.items() for i, x in enumerate(xs)]
    nav = spark.createDataFrame(rows, "asset_name string, date date, nv double")
    ingest.save_allocation(spark.createDataFrame([("A", "1")], "asset_name string, etf_code string"), nav, at, "demo")
    ingest.save_allocation(spark.createDataFrame([("A", "1")], "asset_name string, etf_code string"), nav.withColumn("nv", F.col("nv") * 7), at, "other")
    asked = {"alloc_name": "demo", "start_date": "2024-01-11", "strategies": [
        {"name": "held", "type": "fixed", "classes": [{"name": "A", "weight": 3}, {"name": "B", "weight": 1}]},
        {"name": "monthly", "type": "fixed", "classes": [{"name": "A", "weight": 3}, {"name": "B", "weight": 1}], "rebalance": {"enabled": True, "mode": "monthly", "which": "first"}},
        {"name": "budget", "type": "risk_budget", "classes": [{"name": "A", "budget": 0.5}, {"name": "B", "budget": 0.5}], "rebalance": {"enabled": True, "recalc": True, "mode": "fixed", "fixedInterval": 30}},
        {"type": "equal"},
    ]}
    payload.run(spark, at, json.dumps(asked), f"{at}/out")
    series = {(x.strategy, x.date): x.value for x in spark.read.json(f"{at}/out/series").collect()}
    a, b = navs["A"][10:], navs["B"][10:]
    for i in (0, 30, 79):
        day = str(DAY + dt.timedelta(10 + i))
        assert series["held", day] == pytest.approx(0.75 * a[i] / a[0] + 0.25 * b[i] / b[0])
        assert series["equal", day] == pytest.approx(0.5 * a[i] / a[0] + 0.5 * b[i] / b[0])
    # A first date without history is no rebalancing date, so the path begins in February, on row 21, and March begins on row 50.
    assert ("monthly", "2024-01-31") not in series and series["monthly", "2024-02-01"] == 1
    one = 0.75 * a[50] / a[21] + 0.25 * b[50] / b[21]
    assert series["monthly", "2024-03-02"] == pytest.approx(one * (0.75 * a[51] / a[50] + 0.25 * b[51] / b[50]))
    markers = [x for x in spark.read.json(f"{at}/out/markers").collect() if x.strategy == "budget"]
    assert {x.date for x in markers} == {"2024-02-10", "2024-03-11"}
    last = {x.asset: x.weight for x in markers if x.date == "2024-03-11"}
    cov = np.cov([np.diff(navs[n][:71]) / navs[n][:70] for n in "AB"])
    w = np.array([last["A"], last["B"]])
    assert w.sum() == pytest.approx(1) and (w * (cov @ w) / (w @ cov @ w))[0] == pytest.approx(0.5, abs=1e-3)
    assert {x.strategy for x in spark.read.json(f"{at}/out/metrics").collect()} == {"held", "monthly", "budget", "equal"}
    with pytest.raises(ValueError):
        payload.backtest(payload.stored_nav(spark, at, "demo"), [{"type": "x"}, {"type": "x"}])
    never = payload.backtest(payload.stored_nav(spark, at, "demo"), [{"type": "x", "rebalance": {"enabled": True, "mode": "never"}}])
    assert never[0].count() == 90 and never[1].count() == 0
    with pytest.raises(ValueError):
        model = {"window_mode": "rollingN", "data_len": 91}
        payload.backtest(payload.stored_nav(spark, at, "demo"), [{"type": "x", "rebalance": {"enabled": True}, "model": model}])


def test_table_or_seed(spark, tmp_path):
    seed = spark.createDataFrame([(1, "a")], "id int, name string")
    a, b = (f"file://{tmp_path}/{x}" for x in "ab")
    assert ingest.table_or_seed(spark, [a, b], seed).count() == 1
    spark.createDataFrame([(2, 5)], "id int, fee int").write.parquet(b)
    found = ingest.table_or_seed(spark, [a, b], seed.limit(0))
    assert sorted(tuple(x) for x in found.select("id", "fee").collect()) == [(1, None), (2, 5)]


def test_axis_range(spark):
    rows = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(1), 3.0), (DAY + dt.timedelta(2), None), (DAY + dt.timedelta(3), float("nan"))], "date date, value double")
    marks = spark.createDataFrame([(DAY, 5.0), (DAY + dt.timedelta(9), 99.0)], "date date, value double")
    assert tuple(stats.axis_range(rows).first()) == pytest.approx((0.9, 3.1))
    assert tuple(stats.axis_range(rows, marks).first()) == pytest.approx((0.8, 5.2))
    assert tuple(stats.axis_range(rows, None, "2024-01-02").first()) == pytest.approx((2.85, 3.15))
    assert tuple(stats.axis_range(rows.withColumn("value", F.lit(0.0))).first()) == (-1.0, 1.0)
    assert stats.axis_range(rows.where("false")).count() == 0


def test_small_operators(spark):
    p = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY + dt.timedelta(1), 2.0), ("c", DAY, 3.0)], "asset string, date date, nav double")
    assert {(x.a, x.b) for x in compare.aligned_all(p, ["a", "b"]).collect()} == {(1.0, None), (None, 2.0)}
    out = spark.createDataFrame([("a", DAY, float(x)) for x in (1, 2, 3, 4, 100)] + [("b", DAY, 9.0)], "asset string, date date, ret double")
    assert [x.value for x in stats.outliers(out).collect()] == [100.0]
    percents = weights.equal_percents_first(spark.createDataFrame([("g", i) for i in range(3)], "g string, i int"), "g", "i")
    assert [x.percent for x in percents.orderBy("i").collect()] == [33.34, 33.33, 33.33]
    labels = spark.createDataFrame([("Ab",), ("b",), (None,), ("c",)], "x string")
    assert {x.label for x in universe.options(labels, "x", " B ").collect()} == {"Ab", "b"} and universe.options(labels, "x", " ").count() == 3
    amounts = spark.createDataFrame([(12345678.0,), (-20000.0,), (1234.5,), (float("nan"),), (None,)], "x double")
    assert [x[0] for x in amounts.select(clean.amount_text(F.col("x"))).collect()] == ["1,234.57 亿", "-2 亿", "1,234.5 万", "--", "--"]
    assert [x[0] for x in amounts.select(clean.percent_text(F.col("x"))).collect()] == ["+12,345,678.00%", "-20,000.00%", "+1,234.50%", "--", "--"]
