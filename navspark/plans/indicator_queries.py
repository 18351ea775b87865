"""Queries of the kernels, the indicators and the expression language."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from navspark.functions import kernels as k
from navspark.operators import dsl
from navspark.plans import views as v
from navspark.plans.registry import query
from navspark.sources.tables import table

#: The shipped profile's expressions and periods, as far as the events panel reaches.
PROFILE = json.dumps({
    "template": {
        "metadata": {"data_frequency": "日", "annual_risk_free_rate_percent": 1.5},
        "indicators": [
            {"name": "cumulative", "dsl_expression": r"\left(\prod\left(\mathbf{r} + 1\right)\right) - 1", "periods": ["1W", "2W", "1M"]},
            {"name": "volatility", "dsl_expression": r"\operatorname{std}\left(\mathbf{r}, 1\right)", "periods": ["1W", "2M"]},
            {"name": "ratio", "dsl_expression": r"\frac{\left(\prod\left(\mathbf{r} + 1\right)\right) - 1}{\operatorname{std}\left(\mathbf{r}, 1\right)}", "periods": ["1W", "2M", "3M"]},
            {"name": "excess", "dsl_expression": r"\sqrt{\sum((\mathbf{r} - r_{f}) \times (\mathbf{r} - r_{f}))} - \overline{\mathbf{r}} \cdot 2", "periods": ["M1"]},
            {"name": "power", "dsl_expression": r"-(\overline{\mathbf{\ell}})^{2} + \operatorname{MDD}(\operatorname{net}(\mathbf{r}, 100))", "periods": ["1Y"]},
        ],
    }
})


def _since(period: str) -> str:
    n, unit = int(period.strip("WMY")), period.strip("0123456789")
    if unit == "W":
        return f"last - {7 * n}"
    return f"last - INTERVAL {n * (12 if unit == 'Y' else 1)} MONTH"


def _part(period: str) -> str:
    return f"SELECT er.asset, er.date, ret FROM er JOIN z ON er.asset = z.asset WHERE ret IS NOT NULL AND date > {_since(period)}"


_BASE = f"{v.EVENT_RETURNS}, z AS (SELECT asset, max(date) AS last FROM er WHERE ret IS NOT NULL GROUP BY asset)"
_CUM = "product(ret + 1) - 1"
_FREE = 1.015 ** (1 / 252) - 1


def _dsl_sql(name: str, periods, value: str) -> str:
    return " UNION ALL ".join(f"SELECT asset, '{name}' AS indicator, '{p}' AS period, round({value}, 6) AS value FROM ({_part(p.replace('M1', '1M'))}) GROUP BY asset" for p in periods)


def _evaluated(spark, folder, name):
    return v.rounded(dsl.evaluate(v.event_returns(spark, folder), dsl.profile(dsl.profiles(PROFILE)), [name]))


@query(f"WITH {_BASE} {_dsl_sql('cumulative', ['1W', '2W', '1M'], _CUM)}")
def dsl_cumret(spark, folder):
    return _evaluated(spark, folder, "cumulative")


@query(f"WITH {_BASE} {_dsl_sql('volatility', ['1W', '2M'], 'stddev_samp(ret)')}")
def dsl_std(spark, folder):
    return _evaluated(spark, folder, "volatility")


@query(f"WITH {_BASE} {_dsl_sql('ratio', ['1W', '2M', '3M'], f'({_CUM}) / stddev_samp(ret)')}")
def dsl_ratio(spark, folder):
    return _evaluated(spark, folder, "ratio")


@query(f"WITH {_BASE} {_dsl_sql('excess', ['M1'], f'sqrt(sum((ret - {_FREE!r}) * (ret - {_FREE!r}))) - avg(ret) * 2')}")
def dsl_excess(spark, folder):
    return _evaluated(spark, folder, "excess")


@query(f"""WITH {_BASE}, n AS (SELECT asset, date, ret, 100 * product(1 + ret) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM ({_part('1Y')})),
d AS (SELECT *, nav / greatest(100, max(nav) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM n) SELECT asset, 'power' AS indicator, '1Y' AS period, round(-((avg(ln(1 + ret)))^2) + greatest(0, -min(dd)), 6) AS value FROM d GROUP BY asset""")
def dsl_power(spark, folder):
    return _evaluated(spark, folder, "power")


@query("""WITH x AS (SELECT p_partkey AS id, p_size - 25.0 AS a, CAST(p_partkey % 5 AS DOUBLE) - 2 AS b FROM part)
SELECT id, round(a + b, 6) AS add, round(a - b, 6) AS subtract, round(a * b, 6) AS multiply, round(CASE WHEN abs(b) >= 1e-12 THEN a / b END, 6) AS divide, round(-a, 6) AS negate, round(abs(a), 6) AS absolute,
  round(CASE WHEN a >= b THEN a ELSE b END, 6) AS maximum, round(CASE WHEN a <= b THEN a ELSE b END, 6) AS minimum, round(greatest(-10.0, least(10.0, a)), 6) AS clip, round(CASE WHEN abs(b) >= 1e-12 THEN 1 / b END, 6) AS reciprocal,
  round(pow(abs(a), b / 4), 6) AS power, round(CASE WHEN a >= 0 THEN sqrt(a) END, 6) AS root FROM x WHERE a <> 0""")
def kernels_scalar(spark, folder):
    x = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 25.0).alias("a"), ((F.col("p_partkey") % 5).cast("double") - 2).alias("b")).where("a <> 0")
    a, b = F.col("a"), F.col("b")
    return v.rounded(x.select(
        "id", k.add(a, b).alias("add"), k.subtract(a, b).alias("subtract"), k.multiply(a, b).alias("multiply"), k.divide(a, b).alias("divide"), k.negate(a).alias("negate"), k.absolute(a).alias("absolute"),
        k.maximum(a, b).alias("maximum"), k.minimum(a, b).alias("minimum"), k.clip(a, -10, 10).alias("clip"), k.reciprocal(b).alias("reciprocal"), k.power(F.abs(a), b / 4).alias("power"), k.root(a).alias("root"),
    ))


def _series(spark, folder):
    return v.event_returns(spark, folder).where("ret is not null").groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda r: r["ret"]).alias("r"))


_PREFIX = "OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {v.EVENT_RETURNS}, f AS (SELECT asset, date, ret, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM er WHERE ret IS NOT NULL)
SELECT asset, CAST(i AS INTEGER) AS i, round(sum(ret) {_PREFIX}, 6) AS cumsum, round(product(1 + ret) {_PREFIX}, 6) AS cumprod, round(product(1 + ret) {_PREFIX} - 1, 6) AS cumret, round(100 * product(1 + ret) {_PREFIX}, 4) AS net,
  round(product(1 + ret) {_PREFIX} / max(nav) {_PREFIX} - 1, 6) AS drawdown, round(2 * ret, 6) AS twice, round(ret * ret, 6) AS square, 1.0::DOUBLE AS one
FROM (SELECT *, product(1 + ret) {_PREFIX} AS nav FROM f)""")
def kernels_sequence(spark, folder):
    r = F.col("r")
    grown = F.transform(r, lambda x: 1 + x)
    parts = {
        "cumsum": k.sequence_cumsum(r), "cumprod": k.sequence_cumprod(grown), "cumret": k.cumulative_simple_returns(r), "net": F.slice(k.cumulative_net_value(r, 100), 2, F.size(r)),
        "drawdown": k.sequence_drawdown(k.sequence_cumprod(grown)), "twice": k.sequence_add(r, r), "square": k.sequence_multiply(r, r), "one": k.sequence_divide(grown, grown),
    }
    rows = _series(spark, folder).select("asset", F.posexplode(F.arrays_zip(*(c.alias(n) for n, c in parts.items()))).alias("at", "z"))
    return rows.select("asset", (F.col("at") + 1).alias("i"), *(F.round(F.col("z")[n], 4 if n == "net" else 6).alias(n) for n in parts))


@query(f"""WITH {v.EVENT_RETURNS}, f AS (SELECT asset, date, ret, product(1 + ret) {_PREFIX} AS nav FROM er WHERE ret IS NOT NULL), g AS (SELECT *, nav / greatest(1, max(nav) {_PREFIX}) - 1 AS dd FROM f)
SELECT asset, round(sum(ret), 6) AS total, round(product(1 + ret), 6) AS growth, round(avg(ret), 6) AS mean, round(var_samp(ret), 6) AS variance, round(stddev_pop(ret), 6) AS std0, round(min(ret), 6) AS low, round(max(ret), 6) AS high,
  round(exp(avg(ln(1 + ret))), 6) AS gmean, round(product(1 + ret) ^ (252.0 / count(*)) - 1, 3) AS cagr, round(greatest(0, -min(dd)), 6) AS mdd FROM g GROUP BY asset""")
def kernels_aggregate(spark, folder):
    r = F.col("r")
    grown = F.transform(r, lambda x: 1 + x)
    out = _series(spark, folder).select(
        "asset", k.sequence_sum(r).alias("total"), k.sequence_prod(grown).alias("growth"), k.sequence_mean(r).alias("mean"), k.sequence_variance(r).alias("variance"), k.sequence_std(r, 0).alias("std0"),
        k.sequence_min(r).alias("low"), k.sequence_max(r).alias("high"), k.sequence_geometric_mean(grown).alias("gmean"), F.round(k.sequence_compound_annual_growth_rate(r, 252), 3).alias("cagr"),
        k.max_drawdown_rate_and_recovery_days(k.cumulative_net_value(r))["rate"].alias("mdd"),
    )
    return v.rounded(out)


@query(f"""WITH {v.EVENT_RETURNS}, f AS (SELECT asset, count(*) AS n, sum(ret) AS total, product(1 + ret) AS growth, var_samp(ret) AS v, avg(CASE WHEN ret > 0.01 THEN 1.0 ELSE 0 END) AS win, avg(CASE WHEN ret < 0.01 THEN 1.0 ELSE 0 END) AS loss FROM er WHERE ret IS NOT NULL GROUP BY asset),
g AS (SELECT *, total / n AS mean, growth - 1 AS cum, growth ^ (12.0 / n) - 1 AS ann, sqrt(v) * sqrt(12) AS vol FROM f)
SELECT asset, round(mean, 6) AS average, round(cum, 6) AS cumulative, round(ann, 6) AS annual, round(vol, 6) AS annual_vol, round((mean - 0.001) * sqrt(12), 6) AS scaled_excess, round((mean - 0.001) * sqrt(12) / vol, 6) AS sharpe,
  round(win, 6) AS win, round(loss, 6) AS loss, round(ann / 0.25, 6) AS calmar, NULL::DOUBLE AS undefined FROM g""")
def indicators_test_contract(spark, folder):
    r = F.col("r")
    n, per_year = F.size(r), F.lit(12.0)
    cum = k.cumulative_return(k.sequence_prod(F.transform(r, lambda x: 1 + x)), F.lit(1.0))
    mean = k.average_return(k.sequence_sum(r), n)
    vol = k.annualized_volatility(k.volatility_from_variance(k.sequence_variance(r)), per_year)
    excess = k.scale_excess_return_for_sharpe(mean, F.lit(0.001), per_year)
    annual = k.annualized_return(cum, k.annualization_factor(per_year, n))
    out = _series(spark, folder).select(
        "asset", mean.alias("average"), cum.alias("cumulative"), annual.alias("annual"), vol.alias("annual_vol"), excess.alias("scaled_excess"), k.sharpe_ratio(excess, vol).alias("sharpe"),
        k.win_rate(r, 0.01).alias("win"), k.loss_rate(r, 0.01).alias("loss"), k.calmar_ratio(annual, k.max_drawdown_rate_from_min(F.lit(-0.25))).alias("calmar"),
        k.annualized_return(F.lit(-1.5), F.lit(1.0)).alias("undefined"),
    )
    return v.rounded(out)
