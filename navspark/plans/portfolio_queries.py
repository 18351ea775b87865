"""Queries of weights, frontiers, scores, allocations and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from navspark.operators import frontier as f
from navspark.operators import rebalance as r
from navspark.operators import scoring, weights
from navspark.operators import stats as s
from navspark.plans import views as v
from navspark.plans.registry import query
from navspark.plans.universe_queries import UNIVERSE, universe
from navspark.sources import ingest
from navspark.sources.shared import once
from navspark.sources.tables import table

ASSETS = ("click", "purchase", "view")


def _moments(spark, folder):
    rows = v.event_returns(spark, folder).where(F.col("asset").isin(*ASSETS) & F.col("ret").isNotNull())
    return s.pairs(rows).groupBy("a", "b").agg(F.avg("x").alias("mean_a"), F.covar_samp("x", "y").alias("cov"))


def _points(spark, folder):
    return f.evaluated(f.lattice(spark, ASSETS), _moments(spark, folder), ASSETS)


_LATTICE = f"""{v.EVENT_RETURNS}, fr AS (SELECT asset, date, ret FROM er WHERE ret IS NOT NULL AND asset IN ('click', 'purchase', 'view')),
k AS (SELECT a, b, 10 - a - b AS c FROM range(0, 11) x(a), range(0, 11) y(b) WHERE a + b <= 10), wd AS (SELECT x.date, x.ret AS r1, y.ret AS r2, z.ret AS r3 FROM fr x JOIN fr y ON x.date = y.date JOIN fr z ON x.date = z.date WHERE x.asset = 'click' AND y.asset = 'purchase' AND z.asset = 'view'),
pts AS (SELECT a || '-' || b || '-' || c AS candidate, a / 10.0 AS w1, b / 10.0 AS w2, c / 10.0 AS w3, avg(a / 10.0 * r1 + b / 10.0 * r2 + c / 10.0 * r3) * 252 AS ret, stddev_samp(a / 10.0 * r1 + b / 10.0 * r2 + c / 10.0 * r3) * sqrt(252) AS risk FROM k CROSS JOIN wd GROUP BY a, b, c)"""


@query(f"WITH {_LATTICE} SELECT candidate, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(ret, 5) AS ret, round(risk, 5) AS risk FROM pts")
def frontier_lattice(spark, folder):
    rows = _points(spark, folder)
    return rows.select("candidate", *(F.round(F.col("w")[i], 6).alias(f"w{i + 1}") for i in range(3)), F.round("ret", 5).alias("ret"), F.round("risk", 5).alias("risk"))


@query(f"WITH {_LATTICE}, e AS (SELECT round_even(risk, 4) AS risk, max(ret) AS ret FROM pts GROUP BY 1), t AS (SELECT *, max(ret) OVER (ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT round(risk, 4) AS risk, round(ret, 5) AS ret FROM t WHERE top IS NULL OR ret > top")
def frontier_envelope(spark, folder):
    return f.envelope(_points(spark, folder)).select(F.round("risk", 4).alias("risk"), F.round("ret", 5).alias("ret"))


@query(f"""WITH {_LATTICE}, o AS (SELECT 'max_sharpe' AS point, candidate, ret, risk, row_number() OVER (ORDER BY -(ret - 0.015) / risk, candidate) AS k FROM pts UNION ALL SELECT 'min_risk', candidate, ret, risk, row_number() OVER (ORDER BY risk, candidate) FROM pts
UNION ALL SELECT 'max_return', candidate, ret, risk, row_number() OVER (ORDER BY -ret, candidate) FROM pts) SELECT point, candidate, round(ret, 5) AS ret, round(risk, 5) AS risk FROM o WHERE k = 1""")
def frontier_special(spark, folder):
    return v.rounded(f.special(f.finite_points(_points(spark, folder))), 5)


#: Candidate weights of the panel itself: each day's shares of the event types.
_SHARES = f"""{v.EVENTS}, k AS (SELECT date, coalesce(sum(nav) FILTER (WHERE asset = 'click'), 0) AS a, coalesce(sum(nav) FILTER (WHERE asset = 'purchase'), 0) AS b, coalesce(sum(nav) FILTER (WHERE asset = 'view'), 0) AS c FROM ev GROUP BY date),
sh AS (SELECT CAST(date AS VARCHAR) AS candidate, a / (a + b + c) AS x, b / (a + b + c) AS y, c / (a + b + c) AS z FROM k WHERE a + b + c > 0)"""


def _shares(spark, folder):
    sums = [F.coalesce(F.sum(F.when(F.col("asset") == a, F.col("nav"))), F.lit(0.0)) for a in ASSETS]
    total = F.col("k")[0] + F.col("k")[1] + F.col("k")[2]
    days = v.events(spark, folder).groupBy("date").agg(F.array(*sums).alias("k")).where(total > 0)
    return days.select(F.col("date").cast("string").alias("candidate"), F.transform("k", lambda x: x / total).alias("w"))


@query(f"WITH {_SHARES} SELECT candidate FROM sh WHERE x + y BETWEEN 0.3 - 1e-9 AND 0.6 + 1e-9 AND z <= 0.5 + 1e-9")
def frontier_group_limits(spark, folder):
    groups = [(("click", "purchase"), 0.3, 0.6), (("view",), 0.0, 0.5)]
    return _shares(spark, folder).where(f.within(F.col("w"), ASSETS, groups)).select("candidate")


_LIMITS = [(("click", "purchase"), 0.3, 0.7)]


@query(f"WITH {_LATTICE}, f AS (SELECT * FROM pts WHERE w1 <= 0.6 + 1e-9 AND w2 <= 0.6 + 1e-9 AND w3 >= 0.1 - 1e-9 AND w1 + w2 BETWEEN 0.3 - 1e-9 AND 0.7 + 1e-9), e AS (SELECT round_even(risk, 4) AS risk, max(ret) AS ret FROM f GROUP BY 1), t AS (SELECT *, max(ret) OVER (ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT round(risk, 4) AS risk, round(ret, 5) AS ret FROM t WHERE top IS NULL OR ret > top")
def frontier_exploration_lattice(spark, folder):
    """The exploration without walks, whose seeds are the lattice points within the bounds."""
    seeds = f.lattice(spark, ASSETS).where((F.col("w")[0] <= 0.6 + 1e-9) & (F.col("w")[1] <= 0.6 + 1e-9) & (F.col("w")[2] >= 0.1 - 1e-9))
    points = f.explored(seeds, _moments(spark, folder), ASSETS, (0.0, 0.0, 0.1), (0.6, 0.6, 1.0), _LIMITS, rounds=0, step=0.1)
    return f.envelope(points).select(F.round("risk", 4).alias("risk"), F.round("ret", 5).alias("ret"))


@query()
def frontier_exploration(spark, folder):
    """The whole exploration: random seeds, repair, group limits and two rounds of walks."""
    points = f.explored(f.random_weights(spark, 3, 2000), _moments(spark, folder), ASSETS, (0.0, 0.0, 0.1), (0.6, 0.6, 1.0), _LIMITS, rounds=2)
    return v.rounded(f.envelope(points), 5)


@query()
def frontier_refined(spark, folder):
    """The lattice points within the bounds and the exact points of least risk beside the best of their return ranges."""
    moments = once(_moments(spark, folder))
    return v.rounded(f.envelope(f.refined(f.evaluated(f.lattice(spark, ASSETS), moments, ASSETS), moments, ASSETS)), 5)


@query()
def frontier_targets(spark, folder):
    """Least risk for 40 target returns over all assets of the panel."""
    rows = v.event_returns(spark, folder).where("ret is not null")
    moments = once(s.pairs(rows).groupBy("a", "b").agg(F.avg("x").alias("mean_a"), F.covar_samp("x", "y").alias("cov")))
    names = [r.a for r in moments.select("a").distinct().orderBy("a").collect()]  # assets are few
    return v.rounded(f.target_frontier(moments, names, 40).select("candidate", "ret", "risk"), 6)


@query(f"WITH {v.EVENTS}, d AS (SELECT max(date) AS date FROM ev) SELECT 'fixed' AS strategy, d.date, asset, round(CASE asset WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 ELSE 0 END / 3 * 150, 2) AS percent FROM (SELECT DISTINCT asset FROM ev) CROSS JOIN d")
def point_weights_fixed(spark, folder):
    return weights.point_weights(v.events(spark, folder), weights.Strategy("fixed", weights={"click": 2, "view": 1}), leverage=1.5)


@query()
def point_weights_budget(spark, folder):
    return weights.point_weights(v.events(spark, folder), weights.Strategy("budget", "risk_budget", budgets={"click": 0.4, "purchase": 0.3, "view": 0.3}))


@query(f"WITH {_LATTICE}, h AS (SELECT min(ret) AS lo, max(ret) AS hi FROM pts), b AS (SELECT CAST(least(coalesce(floor((ret - lo) / nullif(hi - lo, 0) * 7), 0), 6) AS BIGINT) AS bucket, * FROM pts CROSS JOIN h), o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY risk, candidate) AS k FROM b) SELECT bucket, candidate FROM o WHERE k = 1")
def frontier_buckets(spark, folder):
    return f.best_of_buckets(_points(spark, folder), 7).select(F.col("bucket").cast("bigint").alias("bucket"), "candidate")


@query(f"""WITH {_SHARES}, q AS (SELECT candidate, round_even(x / 0.05, 0) * 0.05 AS x, round_even(y / 0.05, 0) * 0.05 AS y, round_even(z / 0.05, 0) * 0.05 AS z FROM sh)
SELECT candidate, round(x / (x + y + z), 6) AS w1, round(y / (x + y + z), 6) AS w2, round(z / (x + y + z), 6) AS w3 FROM q""")
def weights_quantised(spark, folder):
    return _shares(spark, folder).withColumn("q", f.quantised(F.col("w"), 0.05)).select("candidate", *(F.round(F.col("q")[i], 6).alias(f"w{i + 1}") for i in range(3)))


@query(f"""WITH {_SHARES}, c AS (SELECT candidate, least(greatest(x, 0.1), 0.6) AS x, least(greatest(y, 0.2), 0.5) AS y, least(greatest(z, 0), 0.45) AS z FROM sh), g AS (SELECT *, 1 - x - y - z AS gap FROM c),
r AS (SELECT *, CASE WHEN gap > 0 THEN 0.6 - x ELSE x - 0.1 END AS rx, CASE WHEN gap > 0 THEN 0.5 - y ELSE y - 0.2 END AS ry, CASE WHEN gap > 0 THEN 0.45 - z ELSE z END AS rz FROM g)
SELECT candidate, round(x + CASE WHEN abs(gap) < 1e-12 THEN 0 ELSE gap * rx / (rx + ry + rz) END, 6) AS w1, round(y + CASE WHEN abs(gap) < 1e-12 THEN 0 ELSE gap * ry / (rx + ry + rz) END, 6) AS w2, round(z + CASE WHEN abs(gap) < 1e-12 THEN 0 ELSE gap * rz / (rx + ry + rz) END, 6) AS w3 FROM r""")
def weights_repaired(spark, folder):
    rows = _shares(spark, folder).withColumn("r", f.repaired(F.col("w"), (0.1, 0.2, 0.0), (0.6, 0.5, 0.45)))
    return rows.select("candidate", *(F.round(F.col("r")[i], 6).alias(f"w{i + 1}") for i in range(3)))


@query(f"WITH {_SHARES}, t AS (SELECT candidate, unnest([1, 2]) AS turn FROM sh) SELECT candidate, CAST(turn AS INTEGER) AS turn, true AS on_simplex, true AS near FROM t")
def frontier_random(spark, folder):
    """Walks from each day's shares: every step stays on the simplex and no weight moves by more than its size."""
    days = _shares(spark, folder)
    steps = f.walk(days, 0.1, 2).select(F.substring_index("candidate", "/", 1).alias("day"), F.substring_index("candidate", "/", -1).cast("int").alias("turn"), F.col("w").alias("to"))
    joined = steps.join(days.select(F.col("candidate").alias("day"), "w"), "day")
    total = F.aggregate("to", F.lit(0.0), lambda a, x: a + x)
    near = F.forall(F.zip_with("to", "w", lambda a, b: F.abs(a - b)), lambda d: d <= 0.1 + 1e-9)
    return joined.select(F.col("day").alias("candidate"), "turn", ((F.abs(total - 1) < 1e-9) & F.forall("to", lambda x: x >= 0)).alias("on_simplex"), near.alias("near"))


_SCORE = f"""{UNIVERSE}, iv AS (SELECT pos AS id, 'issue' AS k, issue_amount AS x, 0.5 AS w, true AS up FROM universe UNION ALL SELECT pos, 'fee', m_fee, 0.3, false FROM universe UNION ALL SELECT pos, 'return', exp_return, 0.2, true FROM universe),
sc AS (SELECT id, w, round(CASE WHEN up THEN (x - min(x) OVER (PARTITION BY k)) ELSE (max(x) OVER (PARTITION BY k) - x) END / (max(x) OVER (PARTITION BY k) - min(x) OVER (PARTITION BY k)) * 100, 2) AS y FROM iv WHERE x IS NOT NULL)"""


@query(f"WITH {_SCORE} SELECT id, round(sum(y * w) / 1.0, 4) AS score FROM sc GROUP BY id")
def scoring_plan(spark, folder):
    u = universe(spark, folder)
    item = lambda k, c: F.struct(F.lit(k).alias("indicator"), F.col(c).cast("double").alias("value"))
    values = u.select(F.col("pos").alias("id"), F.explode(F.array(item("issue", "issue_amount"), item("fee", "m_fee"), item("return", "exp_return"))).alias("i")).select("id", "i.indicator", "i.value")
    plan = spark.createDataFrame([("issue", 0.5, True), ("fee", 0.3, False), ("return", 0.2, True)], "indicator string, weight double, higher_is_better boolean")
    return v.rounded(scoring.scores(values, plan), 4)


@query(f"WITH {UNIVERSE} SELECT pos AS id FROM universe WHERE market IN ('E', 'O') AND year(list_date) BETWEEN 2010 AND 2015 AND (contains(lower(name), '1') OR contains(lower(code), '1') OR contains(lower(coalesce(management, '')), '1'))")
def scoring_filter(spark, folder):
    u = universe(spark, folder).select("pos", F.col("code").alias("id"), "name", F.coalesce("management", F.lit("")).alias("company"), F.col("market").alias("category"), F.col("fund_type").alias("type"), F.year("list_date").alias("year"))
    return scoring.filtered(u, categories=["E", "O"], years=(2010, 2015), keyword=" 1 ").select(F.col("pos").alias("id"))


@query(f"""WITH {UNIVERSE}, g AS (SELECT pos, market, row_number() OVER (PARTITION BY market ORDER BY pos) AS k, count(*) OVER (PARTITION BY market) AS n FROM universe)
SELECT pos, market, (10000 // n + CASE WHEN k <= 10000 - (10000 // n) * n THEN 1 ELSE 0 END) / 100.0 AS percent FROM g""")
def equal_weights(spark, folder):
    return weights.equal_percents(universe(spark, folder), "market", "pos").select("pos", "market", "percent")


@query(f"""WITH {UNIVERSE}, g AS (SELECT pos, market, row_number() OVER (PARTITION BY market ORDER BY pos) AS k, count(*) OVER (PARTITION BY market) AS n FROM universe)
SELECT pos, market, (10000 // n + CASE WHEN k = 1 THEN 10000 - (10000 // n) * n ELSE 0 END) / 100.0 AS percent FROM g""")
def equal_weights_first(spark, folder):
    return weights.equal_percents_first(universe(spark, folder), "market", "pos").select("pos", "market", "percent")


@query(f"WITH {UNIVERSE} SELECT market AS asset_name, code AS etf_code, name AS etf_name, m_fee AS etf_weight, pos FROM universe")
def alloc_nested_roundtrip(spark, folder):
    rows = universe(spark, folder).select(F.col("market").alias("asset_name"), F.col("code").alias("etf_code"), F.col("name").alias("etf_name"), F.col("m_fee").alias("etf_weight"), "pos")
    return ingest.flat(ingest.nested(rows))


@query(f"WITH {UNIVERSE} SELECT DISTINCT market AS asset_alloc_name FROM universe")
def distinct_allocs(spark, folder):
    return universe(spark, folder).select(F.col("market").alias("asset_alloc_name")).distinct().orderBy("asset_alloc_name")


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_brand AS management, CAST(NULL AS VARCHAR) AS found_date FROM part WHERE p_partkey % 7 <> 0")
def universe_aliases(spark, folder):
    rows = table(spark, folder, "part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey").cast("string")).alias("ts_code"), F.col("p_name").alias("fund_name"), F.col("p_brand").alias("manager"))
    return ingest.universe(rows.unionByName(rows))


@query("SELECT l_partkey, l_suppkey, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, min(l_orderkey * 10 + l_linenumber) AS pos, CASE WHEN min(l_orderkey * 10 + l_linenumber) % 2 = 0 THEN arg_min(l_tax, l_orderkey * 10 + l_linenumber) END AS l_tax FROM lineitem GROUP BY ALL")
def ingest_append_dedupe(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    even, odd = rows.where("pos % 2 = 0").select("l_partkey", "l_suppkey", "l_quantity", "pos", "l_tax"), rows.where("pos % 2 = 1").select("l_partkey", "l_suppkey", "l_quantity", "pos")
    return ingest.appended([even, odd], ["l_partkey", "l_suppkey"], "pos")


@query("SELECT p_partkey AS id, CAST(120 AS BIGINT) AS days, true AS ok FROM part")
def synthetic_prices(spark, folder):
    rows = ingest.synthetic_prices(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("issue_amount")), "2024-01-02", 120)
    good = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.weekday("date") < 5) & (F.col("volume") > 0)
    return rows.groupBy("id").agg(F.count("*").alias("days"), F.min(good).alias("ok"))


@query()
def pca_evr(spark, folder):
    return weights.leading_share(v.event_returns(spark, folder).where("ret is not null"))


def _strategies():
    budgets = {"click": 0.4, "purchase": 0.3, "view": 0.3}
    bounds = {a: (0.05, 0.7) for a in ASSETS}
    w = weights.Strategy
    return [
        w("fixed", weights={"click": 2, "view": 1}), w("budget", "risk_budget", budgets=budgets), w("min_risk", "min_risk", bounds=bounds), w("max_return", "max_return", bounds=bounds),
        w("max_sharpe", "max_sharpe", free=0.015, bounds=bounds), w("max_sharpe_traditional", "max_sharpe_traditional", bounds=bounds), w("risk_min", "risk_min_given_return", target=5.0, bounds=bounds),
        w("return_max", "return_max_given_risk", target=0.2, groups=((("click", "purchase"), 0.2, 0.6),), window_mode="rollingN", length=12), w("tail", "min_risk", risk_metric="es"), w("other", "no_such_model"),
    ]


def _schedule(spark, folder):
    panel = once(v.events(spark, folder).where(F.col("asset").isin(*ASSETS)))
    models = _strategies()
    dates = r.gated(panel, r.rebalance_dates(panel, "fixed", interval=6), "rollingN", 6)
    names = spark.createDataFrame([(m.name,) for m in models], "strategy string")
    return panel, weights.schedule(panel, models, names.crossJoin(dates))


@query()
def schedule_weights(spark, folder):
    return v.rounded(_schedule(spark, folder)[1], 4)


@query(f"""WITH {v.EVENTS}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM ev WHERE asset IN ('click', 'purchase', 'view'))), g AS (SELECT date FROM d WHERE (k - 1) % 6 = 0 AND k >= 6),
n AS (SELECT unnest(['fixed', 'budget', 'min_risk', 'max_return', 'max_sharpe', 'max_sharpe_traditional', 'risk_min', 'return_max', 'tail', 'other']) AS strategy) SELECT strategy, date, true AS sums_to_one, true AS non_negative FROM n CROSS JOIN g""")
def schedule_is_feasible(spark, folder):
    found = _schedule(spark, folder)[1].groupBy("strategy", "date")
    return found.agg((F.abs(F.sum("weight") - 1) < 1e-6).alias("sums_to_one"), (F.min("weight") >= -1e-9).alias("non_negative"))


@query()
def backtest_scheduled(spark, folder):
    panel, found = _schedule(spark, folder)
    path, _ = r.paths(panel, found, found.select("strategy", "date").distinct())
    return v.rounded(path, 6)
