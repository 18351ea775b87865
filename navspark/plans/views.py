"""The driver's tables seen as the engine's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.operators import panel as p
from navspark.sources.tables import table

EVENTS = """ev AS (SELECT event_type AS asset, CAST(ts AS DATE) AS date, sum(value) AS nav FROM events GROUP BY ALL)"""
ORDERS = """od AS (SELECT c_mktsegment AS asset, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS nav FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
GRID = f"""{ORDERS}, gr AS (SELECT a.asset, d.date, od.nav FROM (SELECT DISTINCT asset FROM od) a CROSS JOIN (SELECT DISTINCT date FROM od) d LEFT JOIN od ON od.asset = a.asset AND od.date = d.date)"""
#: Padded grid and its simple returns.
PADDED = f"""{GRID}, pa AS (SELECT asset, date, last_value(nav IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM gr),
re AS (SELECT *, nav / nullif(lag(nav) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret FROM pa)"""
EVENT_RETURNS = f"""{EVENTS}, er AS (SELECT *, nav / nullif(lag(nav) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret FROM ev)"""
OHLC = """oh AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) AS open, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS close,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("nav"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("asset"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("nav"))
    return p.mean_per_date(joined)


def padded_returns(spark: SparkSession, folder: str) -> DataFrame:
    return p.returns(p.grid(orders(spark, folder)))


def event_returns(spark: SparkSession, folder: str) -> DataFrame:
    return p.returns(events(spark, folder))


def ohlc(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("l_extendedprice", key).alias("open"), F.max_by("l_extendedprice", key).alias("close"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.sum("l_quantity").alias("volume"),
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for engines that add in another order."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
