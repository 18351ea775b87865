"""Queries of rolling statistics and chart overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from navspark.operators import panel as p
from navspark.operators import stats as s
from navspark.operators import technical as t
from navspark.plans import views as v
from navspark.plans.registry import query


def _w(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_SO_FAR = "OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"


def _rolling(n: int) -> str:
    return f"""b AS (SELECT x.asset, x.date, x.ret AS x, y.ret AS y FROM er x JOIN er y ON x.date = y.date AND y.asset = 'view' WHERE x.asset <> 'view' AND x.ret IS NOT NULL AND y.ret IS NOT NULL),
c AS (SELECT asset, date, coalesce(CASE WHEN count(*) {_w(n)} = {n} THEN covar_samp(x, y) {_w(n)} / nullif(stddev_samp(x) {_w(n)} * stddev_samp(y) {_w(n)}, 0) END, 0) AS corr FROM b)"""


@query(f"WITH {v.EVENT_RETURNS}, {_rolling(10)} SELECT asset, date, round(corr, 6) AS corr FROM c")
def rolling_corr(spark, folder):
    return v.rounded(t.rolling_correlation(v.event_returns(spark, folder), "view", 10))


@query(f"""WITH {v.EVENT_RETURNS}, {_rolling(10)} SELECT asset, round(avg(corr), 6) AS mean, round(median(corr), 6) AS median, round(stddev_pop(corr), 6) AS std FROM c GROUP BY asset""")
def rolling_corr_stats(spark, folder):
    rows = t.rolling_correlation(v.event_returns(spark, folder), "view", 10)
    m = s.moments("corr")
    return v.rounded(rows.groupBy("asset").agg(*(m[k].alias(k) for k in ("mean", "median", "std"))))


@query(f"WITH {v.OHLC} SELECT asset, date, " + ", ".join(f"round(CASE WHEN count(close) {_w(n)} = {n} THEN avg(close) {_w(n)} END, 4) AS ma{n}" for n in (5, 10, 20)) + f", round(CASE WHEN count(volume) {_w(5)} = 5 THEN avg(volume) {_w(5)} END, 4) AS volume5 FROM oh")
def moving_average(spark, folder):
    rows = v.ohlc(spark, folder)
    return v.rounded(rows.select("asset", "date", *(t.moving_average("close", n).alias(f"ma{n}") for n in (5, 10, 20)), t.moving_average("volume", 5).alias("volume5")), 4)


@query(f"""WITH {v.OHLC}, m AS (SELECT asset, date, count(close) {_w(20)} AS n, avg(close) {_w(20)} AS a, stddev_pop(close) {_w(20)} AS s FROM oh)
SELECT asset, date, round(CASE WHEN n = 20 THEN a END, 4) AS middle, round(CASE WHEN n = 20 THEN a + 2 * s END, 4) AS upper, round(CASE WHEN n = 20 THEN a - 2 * s END, 4) AS lower FROM m""")
def bollinger(spark, folder):
    middle, upper, lower = t.bollinger("close")
    return v.rounded(v.ohlc(spark, folder).select("asset", "date", middle.alias("middle"), upper.alias("upper"), lower.alias("lower")), 4)


@query(f"""WITH RECURSIVE {v.OHLC}, r AS (SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) AS i, close, max(high) {_w(9)} AS h, min(low) {_w(9)} AS l FROM oh),
v AS (SELECT asset, date, i, CASE WHEN h = l THEN 50 ELSE (close - l) / (h - l) * 100 END AS rsv FROM r),
k AS (SELECT asset, date, i, round((2 * 50.0 + rsv) / 3, 2) AS k, round((2 * 50.0 + (2 * 50.0 + rsv) / 3) / 3, 2) AS d, round(3 * ((2 * 50.0 + rsv) / 3) - 2 * ((2 * 50.0 + (2 * 50.0 + rsv) / 3) / 3), 2) AS j FROM v WHERE i = 1
  UNION ALL SELECT v.asset, v.date, v.i, round((2 * k.k + rsv) / 3, 2), round((2 * k.d + (2 * k.k + rsv) / 3) / 3, 2), round(3 * ((2 * k.k + rsv) / 3) - 2 * ((2 * k.d + (2 * k.k + rsv) / 3) / 3), 2) FROM k JOIN v ON v.asset = k.asset AND v.i = k.i + 1)
SELECT asset, date, k, d, j FROM k""")
def kdj(spark, folder):
    return t.kdj(v.ohlc(spark, folder))


@query(f"WITH {v.PADDED} SELECT asset, date, round(CASE WHEN count(ret) {_w(20)} >= 2 THEN stddev_samp(ret) {_w(20)} * sqrt(252) * 100 END, 4) AS vol FROM re")
def rolling_vol(spark, folder):
    return v.rounded(v.padded_returns(spark, folder).select("asset", "date", t.rolling_volatility(20).alias("vol")), 4)


@query(f"WITH {v.PADDED}, f AS (SELECT asset, arg_min(nav, date) AS base FROM pa WHERE nav > 0 GROUP BY asset) SELECT pa.asset, date, round(nav / base, 4) AS value FROM pa JOIN f ON pa.asset = f.asset")
def normalised_curve(spark, folder):
    return v.rounded(v.padded_returns(spark, folder).select("asset", "date", p.normalised(F.col("nav")).alias("value")), 4)


@query(f"""WITH {v.PADDED}, f AS (SELECT asset, arg_min(nav, date) AS base FROM pa WHERE nav > 0 GROUP BY asset), n AS (SELECT pa.asset, date, nav / base AS x FROM pa JOIN f ON pa.asset = f.asset)
SELECT asset, date, round((x / greatest(max(x) {_SO_FAR}, 1) - 1) * 100, 2) AS value FROM n""")
def drawdown_curve(spark, folder):
    rows = v.padded_returns(spark, folder).withColumn("x", p.normalised(F.col("nav")))
    return v.rounded(rows.select("asset", "date", (p.drawdown(F.col("x"), 1.0) * 100).alias("value")), 2)


@query(f"WITH {v.OHLC}, l AS (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS b FROM oh) SELECT asset, date, CASE WHEN b <> 0 THEN round((close / b - 1) * 100, 4) END AS change FROM l")
def daily_change(spark, folder):
    return v.ohlc(spark, folder).select("asset", "date", t.percent_change("close").alias("change"))
