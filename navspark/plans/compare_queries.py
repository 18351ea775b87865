"""Queries that compare products, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from navspark.operators import compare as c
from navspark.plans import views as v
from navspark.plans.registry import query
from navspark.plans.universe_queries import UNIVERSE, universe
from navspark.sources.tables import table

_PRESETS = " UNION ALL ".join(f"SELECT asset, '{k}' AS preset, CAST(greatest(lo, CAST(hi - INTERVAL {m} MONTH AS DATE)) AS DATE) AS start, hi AS \"end\" FROM e" for k, m in c.PRESETS.items())


@query(f"WITH {v.ORDERS}, e AS (SELECT asset, min(date) AS lo, max(date) AS hi FROM od GROUP BY asset) {_PRESETS} UNION ALL SELECT asset, 'ALL', lo, hi FROM e")
def range_presets(spark, folder):
    return c.ranges(v.orders(spark, folder))


@query(f"WITH {v.ORDERS} SELECT asset, count(*) AS n, min(date) AS first, max(date) AS last FROM od WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-09-30' GROUP BY asset")
def range_custom(spark, folder):
    rows = c.custom_range(v.orders(spark, folder), "1995-09-30", "1995-03-01")
    return rows.groupBy("asset").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(f"WITH {v.ORDERS}, x AS (SELECT * FROM od WHERE asset = 'BUILDING'), y AS (SELECT * FROM od WHERE asset = 'MACHINERY') SELECT coalesce(x.date, y.date) AS date, round(x.nav, 6) AS a, round(y.nav, 6) AS b FROM x FULL JOIN y ON x.date = y.date")
def series_aligned(spark, folder):
    rows = v.orders(spark, folder)
    return v.rounded(c.aligned(rows.where("asset = 'BUILDING'"), rows.where("asset = 'MACHINERY'")))


@query(f"""WITH {UNIVERSE}, i AS (SELECT pos AS id, 'fee' AS indicator, m_fee AS value FROM universe UNION ALL SELECT pos, 'return', exp_return FROM universe WHERE exp_return IS NOT NULL),
m AS (SELECT *, min(value) OVER (PARTITION BY indicator) AS lo, max(value) OVER (PARTITION BY indicator) AS hi FROM i)
SELECT id, indicator, round(value, 6) AS value, round(CASE WHEN lo = hi THEN 1 WHEN indicator = 'fee' THEN 1 - (value - lo) / (hi - lo) ELSE (value - lo) / (hi - lo) END, 6) AS position FROM m""")
def indicator_positions(spark, folder):
    item = lambda k, x: F.struct(F.lit(k).alias("indicator"), F.col(x).cast("double").alias("value"))
    values = universe(spark, folder).select(F.col("pos").alias("id"), F.explode(F.array(item("fee", "m_fee"), item("return", "exp_return"))).alias("i")).select("id", "i.*")
    return v.rounded(c.positions(values, ["fee"]))


@query(f"""WITH {UNIVERSE}, p AS (SELECT CAST(l_partkey AS VARCHAR) || CASE WHEN l_partkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close FROM lineitem GROUP BY ALL)
SELECT u.ts_code, u.name, u.list_date AS start_date, p.date, round(p.close, 6) AS close FROM universe u LEFT JOIN p ON p.ts_code = u.ts_code WHERE u.ts_code = '15.SZ'""")
def product_detail(spark, folder):
    code = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".SH").otherwise(".SZ"))
    prices = table(spark, folder, "lineitem").groupBy(code.alias("ts_code"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("close"))
    return v.rounded(c.detail(universe(spark, folder), prices, " 15.sz ").select("ts_code", "name", "start_date", "date", "close"))


@query(f"""WITH {UNIVERSE}, a AS (SELECT pos, market FROM universe WHERE market <> 'O'), b AS (SELECT pos, market FROM universe WHERE status = '上市'), al AS (SELECT * FROM a UNION ALL SELECT * FROM b), di AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT 'all' AS op, count(*) AS n, CAST(sum(pos) AS BIGINT) AS s FROM al UNION ALL SELECT 'distinct', count(*), CAST(sum(pos) AS BIGINT) FROM di UNION ALL SELECT 'without', count(*), CAST(sum(pos) AS BIGINT) FROM a WHERE pos NOT IN (SELECT pos FROM b)""")
def set_operations(spark, folder):
    u = universe(spark, folder)
    a, b = (u.where(chosen).select("pos", "market") for chosen in ("market <> 'O'", "status = '上市'"))
    parts = {"all": a.unionByName(b), "distinct": a.union(b).distinct(), "without": c.without_keys(a, b, "pos")}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("pos").alias("s"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey AS id, p_size + 20 AS total, CAST(3 AS INTEGER) AS n FROM part")
def period_lists(spark, folder):
    found = c.period_list(F.concat(F.lit("5，"), F.col("p_size").cast("string"), F.lit(", 15,x,,-3")))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), found.alias("p"))
    return rows.select("id", F.aggregate("p", F.lit(0), lambda a, x: a + x).alias("total"), F.size("p").alias("n"))


@query("SELECT l_returnflag, CAST(d AS DATE) AS date FROM (SELECT l_returnflag, unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS d FROM lineitem GROUP BY l_returnflag) WHERE isodow(d) <= 5")
def business_days(spark, folder):
    return c.business_days(table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate")


_NAMES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"WITH {v.ORDERS} SELECT date, " + ", ".join(f"round(max(nav) FILTER (WHERE asset = '{n}'), 6) AS {n}" for n in _NAMES) + " FROM od GROUP BY date")
def series_aligned_all(spark, folder):
    return v.rounded(c.aligned_all(v.orders(spark, folder), _NAMES))
