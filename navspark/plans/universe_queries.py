"""Queries over the product universe, bound to the part and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.functions import clean
from navspark.operators import universe as u
from navspark.plans.registry import query
from navspark.sources.tables import table

AS_OF = "2022-06-30"

UNIVERSE = """universe AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code,
  CAST(p_partkey AS VARCHAR) AS code, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'nan' ELSE p_brand END AS management,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS fund_type, CASE p_partkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'O' ELSE 'L' END AS market,
  CASE p_partkey % 6 WHEN 0 THEN '终止上市' WHEN 1 THEN '暂停' ELSE '上市' END AS status, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS issue_amount,
  (p_partkey % 20) / 10.0 AS m_fee, (p_partkey % 5) / 20.0 AS c_fee, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 10.0 END AS exp_return, p_size AS duration_year,
  CASE WHEN p_partkey % 19 <> 0 THEN CAST(DATE '2004-01-01' + CAST((p_partkey * 37) % 7000 AS INTEGER) AS DATE) END AS list_date FROM part)"""
FACET = "coalesce(nullif(nullif({}, ''), 'nan'), '未知')"


def universe(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("pos"), F.concat(k.cast("string"), F.when(k % 2 == 0, ".SH").otherwise(".SZ")).alias("ts_code"), k.cast("string").alias("code"), F.col("p_name").alias("name"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "nan").otherwise(F.col("p_brand")).alias("management"), F.when(k % 13 == 0, "").otherwise(F.col("p_type")).alias("fund_type"),
        F.when(k % 3 == 0, "E").when(k % 3 == 1, "O").otherwise("L").alias("market"), F.when(k % 6 == 0, "终止上市").when(k % 6 == 1, "暂停").otherwise("上市").alias("status"),
        F.when(k % 17 != 0, F.col("p_retailprice")).alias("issue_amount"), ((k % 20) / 10.0).alias("m_fee"), ((k % 5) / 20.0).alias("c_fee"),
        F.when(k % 4 != 0, F.col("p_size") / 10.0).alias("exp_return"), F.col("p_size").alias("duration_year"),
        F.when(k % 19 != 0, F.date_add(F.lit("2004-01-01").cast("date"), ((k * 37) % 7000).cast("int"))).alias("list_date"),
    )


_SUMMARY = f"""count(*) AS total, CAST(coalesce(sum(CASE WHEN NOT regexp_matches(coalesce(status, ''), '{clean.INACTIVE}') THEN 1 ELSE 0 END), 0) AS BIGINT) AS active, count(DISTINCT management) AS managers,
  round(coalesce(sum(issue_amount), 0), 4) AS total_issue, round(avg(m_fee), 6) AS avg_m_fee, round(avg(c_fee), 6) AS avg_c_fee, round(avg(exp_return), 6) AS avg_exp_return, round(avg(duration_year), 6) AS avg_duration,
  round(median(issue_amount), 6) AS median_issue, CAST(coalesce(sum(CASE WHEN list_date >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN 1 ELSE 0 END), 0) AS BIGINT) AS listed_last_year"""


@query(f"WITH {UNIVERSE} SELECT {_SUMMARY} FROM universe")
def universe_summary(spark, folder):
    return u.summary(universe(spark, folder), F.lit(AS_OF).cast("date"))


@query(f"WITH {UNIVERSE} SELECT {_SUMMARY} FROM universe WHERE lower({FACET.format('market')}) IN ('e', 'l') AND lower({FACET.format('management')}) IN ('未知', 'brand#13', 'brand#21')")
def universe_filtered_summary(spark, folder):
    chosen = {"market": u.terms("E, l"), "management": u.terms(["未知", "Brand#13,Brand#21"]), "custodian": ["x"]}
    return u.summary(u.with_facets(universe(spark, folder), chosen), F.lit(AS_OF).cast("date"))


@query(f"WITH {UNIVERSE} SELECT {FACET.format('management')} AS name, count(*) AS value, min(pos) AS first_pos FROM universe GROUP BY 1")
def facet_distribution(spark, folder):
    return u.distribution(universe(spark, folder), "management")


@query(f"WITH {UNIVERSE} SELECT {FACET.format('fund_type')} AS name, count(*) AS value, min(pos) AS first_pos FROM universe GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 3")
def facet_distribution_top(spark, folder):
    return u.distribution(universe(spark, folder), "fund_type", 3)


@query(f"WITH {UNIVERSE} SELECT {FACET.format('management')} AS name, count(*) AS n, round(coalesce(sum(issue_amount), 0), 4) AS issue FROM universe GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def top_management(spark, folder):
    return u.grouped(universe(spark, folder), "management", ["n"], 10)


@query(f"WITH {UNIVERSE} SELECT {FACET.format('market')} AS name, count(*) AS n, round(coalesce(sum(issue_amount), 0), 4) AS issue FROM universe GROUP BY 1")
def market_issue(spark, folder):
    return u.grouped(universe(spark, folder), "market", ["issue", "n"])


@query(f"WITH {UNIVERSE} SELECT {FACET.format('fund_type')} AS name, round(avg(m_fee), 6) AS m_fee, round(avg(c_fee), 6) AS c_fee FROM universe GROUP BY 1")
def fee_by_type(spark, folder):
    return u.fees(universe(spark, folder), "fund_type")


@query(f"WITH {UNIVERSE} SELECT CAST(year(list_date) AS INTEGER) AS year, count(*) AS n, round(coalesce(sum(issue_amount), 0), 4) AS issue FROM universe WHERE list_date IS NOT NULL GROUP BY 1")
def list_trend(spark, folder):
    return u.listings(universe(spark, folder))


@query(f"WITH {UNIVERSE} SELECT CAST(year(list_date) AS INTEGER) AS year, count(*) AS n, round(coalesce(sum(issue_amount), 0), 4) AS issue FROM universe WHERE list_date IS NOT NULL AND {FACET.format('market')} IN ('E') GROUP BY 1")
def list_trend_filtered(spark, folder):
    return u.listings(u.with_facet_exact(u.with_facet_exact(universe(spark, folder), "market", ["E"]), "no_such_dimension", ["x"]))


@query(f"WITH {UNIVERSE} SELECT pos, ts_code FROM universe WHERE market IN ('e', 'O')")
def facet_case_sensitive(spark, folder):
    return u.present(u.with_facet_exact(universe(spark, folder), "market", ["e", "O"]), ["pos", "ts_code", "no_such_column"])


@query(f"WITH {UNIVERSE} SELECT pos, ts_code, name FROM universe WHERE contains(lower(ts_code), '1.s') OR contains(lower(code), '1.s') OR contains(lower(name), '1.s') OR contains(lower(management), '1.s')")
def product_search(spark, folder):
    return u.search(universe(spark, folder), " 1.S ").select("pos", "ts_code", "name")


_FOUND = "s AS (SELECT pos, ts_code, management FROM universe WHERE contains(lower(code || ' ' || name || ' ' || coalesce(management, '')), '1'))"


@query(f"""WITH {UNIVERSE}, {_FOUND}, k AS (SELECT * FROM s ORDER BY coalesce(management, '') DESC, pos LIMIT 50)
SELECT pos, ts_code, (SELECT count(*) FROM s) AS total FROM k ORDER BY coalesce(management, '') DESC, pos LIMIT 20 OFFSET 40""")
def product_search_page(spark, folder):
    rows = universe(spark, folder).select("pos", "code", "ts_code", "name", "management")
    return u.search_page(rows, "1", "management", descending=True, top=50, number=3, size=20).select("pos", "ts_code", "total")


@query(f"WITH {UNIVERSE}, {_FOUND} SELECT CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS ts_code, count(*) AS total FROM s")
def product_search_beyond(spark, folder):
    """A page behind the last keeps the total."""
    return u.search_page(universe(spark, folder), "1", number=10_000_000, size=200).select(F.col("pos").cast("bigint").alias("pos"), "ts_code", "total")


@query(f"WITH {UNIVERSE} SELECT pos, ts_code FROM universe WHERE contains(lower(code || ' ' || name || ' ' || coalesce(management, '')), 'brand#2')")
def product_search_joined(spark, folder):
    return u.search_joined(universe(spark, folder), "Brand#2").select("pos", "ts_code")


@query(f"WITH {UNIVERSE} SELECT pos, ts_code, name, issue_amount FROM universe WHERE lower({FACET.format('market')}) IN ('e', 'o') ORDER BY issue_amount DESC NULLS LAST, pos LIMIT 20 OFFSET 40")
def product_page(spark, folder):
    rows = u.with_facets(universe(spark, folder), {"market": ["E", "O"]})
    return u.page(rows, "issue_amount", True, 3, 20).select("pos", "ts_code", "name", "issue_amount")


@query(f"WITH {UNIVERSE} SELECT pos, ts_code, list_date FROM universe ORDER BY list_date ASC NULLS LAST, pos LIMIT 15 OFFSET 15")
def product_page_by_date(spark, folder):
    return u.page(universe(spark, folder), "list_date", False, 2, 15).select("pos", "ts_code", "list_date")


@query(f"WITH {UNIVERSE} SELECT ts_code, name, issue_amount FROM universe ORDER BY issue_amount DESC NULLS LAST, pos LIMIT 10")
def top_issue(spark, folder):
    return u.page(universe(spark, folder), size=10).select("ts_code", "name", "issue_amount")


@query(f"WITH {UNIVERSE} SELECT ts_code, name, list_date FROM universe ORDER BY list_date DESC NULLS LAST, pos LIMIT 10")
def recent_listings(spark, folder):
    return u.page(universe(spark, folder), "list_date", size=10).select("ts_code", "name", "list_date")


@query(f"WITH {UNIVERSE}, s AS (SELECT pos, ts_code, strpos(lower(code || ' ' || name), '12') AS k FROM universe) SELECT pos, ts_code, (k - 1) + 2 * 0.2 AS score FROM s WHERE k > 0 ORDER BY score, pos LIMIT 10")
def fuzzy_topk(spark, folder):
    return u.fuzzy_top(universe(spark, folder), " 12 ").select("pos", "ts_code", "score")


@query(f"WITH {UNIVERSE} SELECT pos, ts_code, name FROM universe WHERE code = '15' ORDER BY pos LIMIT 1")
def product_lookup(spark, folder):
    return u.lookup(universe(spark, folder), "15.XX").select("pos", "ts_code", "name")


@query(f"""WITH {UNIVERSE}, q AS (SELECT DISTINCT CASE pos % 4 WHEN 0 THEN ts_code WHEN 1 THEN code || '.OF' WHEN 2 THEN 'none' || code ELSE substring(code, 2) || '.ZZ' END AS req_code,
  CASE pos % 4 WHEN 2 THEN name ELSE 'x' END AS req_name FROM universe),
m AS (SELECT q.*, u.pos, u.ts_code, u.name, CASE WHEN q.req_code = u.ts_code THEN 0 WHEN split_part(q.req_code, '.', 1) = split_part(u.ts_code, '.', 1) THEN 1 WHEN q.req_name = u.name THEN 2
  WHEN u.pos IS NOT NULL THEN 3 END AS match_rank FROM q LEFT JOIN universe u ON q.req_code = u.ts_code OR split_part(q.req_code, '.', 1) = split_part(u.ts_code, '.', 1) OR q.req_name = u.name OR split_part(q.req_code, '.', 1) <> '' AND contains(u.ts_code, split_part(q.req_code, '.', 1)))
SELECT req_code, req_name, match_rank, ts_code, name FROM (SELECT *, row_number() OVER (PARTITION BY req_code, req_name ORDER BY match_rank, pos) AS k FROM m) WHERE k = 1""")
def code_resolution(spark, folder):
    p = universe(spark, folder)
    k = F.col("pos") % 4
    code = F.when(k == 0, F.col("ts_code")).when(k == 1, F.concat("code", F.lit(".OF"))).when(k == 2, F.concat(F.lit("none"), "code")).otherwise(F.concat(F.substring("code", 2, 60), F.lit(".ZZ")))
    asked = p.select(code.alias("req_code"), F.when(k == 2, F.col("name")).otherwise("x").alias("req_name"))
    return u.resolve(asked, p)


_MESSY = """m AS (SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '1,234.50' WHEN 1 THEN '0.5%' WHEN 2 THEN '3.2亿' WHEN 3 THEN '12万元' WHEN 4 THEN '80000元' WHEN 5 THEN '--' WHEN 6 THEN 'NaN' WHEN 7 THEN '约 3，000 份'
  WHEN 8 THEN ' -7.25 ' WHEN 9 THEN 'abc' WHEN 10 THEN '5年' ELSE CAST(p_size AS VARCHAR) || '亿元' END AS t FROM part)"""
_NULLS = ", ".join(f"'{t}'" for t in clean.NULL_TEXTS)
_UNIT_CASE = " ".join(f"WHEN t LIKE '%{u_}' THEN {f}" for u_, f in clean.UNITS)
_UNIT_RE = "|".join(u_ for u_, _ in clean.UNITS)


@query(rf"""WITH {_MESSY}, n AS (SELECT id, CASE WHEN lower(trim(t)) NOT IN ({_NULLS}) THEN trim(t) END AS t FROM m)
SELECT id, round(TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(t, '(?:{_UNIT_RE})$', ''), '[,， ]', '', 'g'), '[-+]?\d*\.?\d+'), '') AS DOUBLE) * CASE {_UNIT_CASE} ELSE 1.0 END, 6) AS amount,
  round(TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(t, '%$', ''), '[,， ]', '', 'g'), '[-+]?\d*\.?\d+'), '') AS DOUBLE), 6) AS rate,
  round(TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(t, '(?:年|个月)$', ''), '[,， ]', '', 'g'), '[-+]?\d*\.?\d+'), '') AS DOUBLE), 6) AS years FROM n""")
def numeric_clean(spark, folder):
    k = F.col("p_partkey") % 12
    texts = ["1,234.50", "0.5%", "3.2亿", "12万元", "80000元", "--", "NaN", "约 3，000 份", " -7.25 ", "abc", "5年"]
    t = F.when(k == 11, F.concat(F.col("p_size").cast("string"), F.lit("亿元")))
    for i, x in enumerate(texts):
        t = t.when(k == i, x)
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), t.alias("t"))
    return rows.select(
        "id", F.round(clean.number(F.col("t"), amount=True), 6).alias("amount"), F.round(clean.number(F.col("t"), percent=True), 6).alias("rate"),
        F.round(clean.number(F.col("t"), suffixes=("年", "个月")), 6).alias("years"),
    )


@query("""WITH m AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'nan' WHEN 3 THEN ' 2020-02-30' ELSE '20201345' END AS t FROM orders)
SELECT id, CASE WHEN regexp_matches(trim(t), '^[0-9]{8}$') THEN CAST(try_strptime(trim(t), '%Y%m%d') AS DATE) ELSE TRY_CAST(trim(t) AS DATE) END AS d FROM m""")
def date_clean(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, "nan").when(k == 3, " 2020-02-30").otherwise("20201345")
    return o.select(F.col("o_orderkey").alias("id"), clean.normal_date(t).alias("d"))


@query(f"""WITH {UNIVERSE}, s AS (SELECT pos, split_part(trim(ts_code), '.', 1) AS bare, {FACET.format('management')} AS facet, round(issue_amount / 3 + 1e-8, 2) AS up, round_even(issue_amount / 3, 4) AS even,
  CASE WHEN issue_amount IS NULL THEN '--' WHEN issue_amount >= 1500 THEN 'big' ELSE 'small' END AS size FROM universe) SELECT * FROM s""")
def scalar_clean(spark, folder):
    amount = F.col("issue_amount")
    return universe(spark, folder).select(
        "pos", clean.strip_suffix(F.col("ts_code")).alias("bare"), clean.facet(F.col("management")).alias("facet"), clean.round_up_half(amount / 3).alias("up"), clean.round_even(amount / 3).alias("even"),
        F.when(clean.issue_text(amount) == "--", "--").when(amount >= 1500, "big").otherwise("small").alias("size"),
    )


@query(f"WITH {UNIVERSE} SELECT management, min(pos) AS pos, arg_min(ts_code, pos) AS ts_code FROM universe GROUP BY management")
def first_of_each(spark, folder):
    return u.first_rows(universe(spark, folder).select("management", "pos", "ts_code"), ["management"], "pos")


@query(f"WITH {UNIVERSE}, r AS (SELECT market, ts_code, row_number() OVER (PARTITION BY market ORDER BY pos) AS rank FROM universe) SELECT market, ts_code, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def first_in_market(spark, folder):
    return u.rank_within(universe(spark, folder), "market", "pos", 3).select("market", "ts_code", "rank")


@query("SELECT DISTINCT p_brand AS label FROM part WHERE contains(lower(p_brand), 'brand#1')")
def option_search(spark, folder):
    return u.options(table(spark, folder, "part"), "p_brand", " BRAND#1 ")


@query(f"""WITH {UNIVERSE}, t AS (SELECT pos, pos * 1000.0 AS amount, (pos % 9 - 4) * 1234.5 AS move, pos % 7 = 0 AS gone, management FROM universe)
SELECT pos, CASE WHEN gone THEN '--' WHEN amount >= 10000 THEN regexp_replace(regexp_replace(format('{{:,.2f}}', round(amount / 10000, 2)), '0+$', ''), '\\.$', '') || ' 亿' ELSE format('{{:,d}}', CAST(amount AS BIGINT)) || ' 万' END AS issue,
  CASE WHEN gone THEN '--' ELSE CASE WHEN move >= 0 THEN '+' ELSE '' END || format('{{:,.2f}}', move) || '%' END AS change, format('{{:,.1f}}', move * 100) || '%' AS ratio, coalesce(nullif(trim(management), ''), '未知') AS company FROM t""")
def display_texts(spark, folder):
    k = F.col("pos")
    amount, move = F.when(k % 7 != 0, k * 1000.0), (k % 9 - 4) * 1234.5
    return universe(spark, folder).select("pos", clean.amount_text(amount).alias("issue"), clean.percent_text(F.when(k % 7 != 0, move)).alias("change"), clean.ratio_text(move).alias("ratio"), clean.known_text(F.col("management")).alias("company"))
