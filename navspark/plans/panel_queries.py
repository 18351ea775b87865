"""Queries over net-asset-value panels and their statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from navspark.operators import panel as p
from navspark.operators import stats as s
from navspark.operators import technical as t
from navspark.operators.running import long_drawdown, long_net_value, running
from navspark.plans import views as v
from navspark.plans.registry import query
from navspark.sources.tables import table

DAYS = s.DAYS
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_W = "OVER (PARTITION BY asset ORDER BY date)"
_SO_FAR = "OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {v.EVENT_RETURNS}, r AS (SELECT *, nav / max(nav) {_SO_FAR} - 1 AS dd FROM er)
SELECT asset, count(*) AS days, round(avg(ret) * {DAYS}, 6) AS annual_return, round(stddev_samp(ret) * sqrt({DAYS}), 6) AS annual_vol,
  round(quantile_cont(ret, 0.01), 6) AS var99, round(exp(sum(ln(1 + ret))), 6) AS growth, round(min(dd), 6) AS max_drawdown
FROM r GROUP BY asset""")
def panel_metrics(spark, folder):
    rows = v.event_returns(spark, folder).withColumn("dd", p.drawdown(F.col("nav")))
    return v.rounded(rows.groupBy("asset").agg(
        F.count("*").alias("days"), (F.avg("ret") * DAYS).alias("annual_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(DAYS))).alias("annual_vol"),
        F.percentile("ret", F.lit(0.01)).alias("var99"), F.exp(F.sum(F.ln(1 + F.col("ret")))).alias("growth"), F.min("dd").alias("max_drawdown"),
    ))


@query(f"WITH {v.GRID} SELECT asset, date, round(nav, 6) AS nav FROM gr")
def nav_dense_grid(spark, folder):
    return v.rounded(p.grid(v.orders(spark, folder)))


@query(f"WITH {v.ORDERS} SELECT date, " + ", ".join(f"round(avg(nav) FILTER (WHERE asset = '{a}'), 6) AS \"{a}\"" for a in SEGMENTS) + " FROM od GROUP BY date")
def nav_pivot_mean(spark, folder):
    return v.rounded(p.pivot(v.orders(spark, folder), SEGMENTS))


@query(f"WITH {v.GRID} SELECT asset, date, round(nav, 6) AS nav FROM gr")
def nav_melt(spark, folder):
    return v.rounded(p.melt(p.pivot(v.orders(spark, folder), SEGMENTS)))


@query(f"WITH {v.ORDERS}, f AS (SELECT date FROM od GROUP BY date HAVING count(DISTINCT asset) = 5) SELECT asset, date, round(nav, 6) AS nav FROM od SEMI JOIN f ON od.date = f.date")
def nav_complete_dates(spark, folder):
    return v.rounded(p.complete_dates(v.orders(spark, folder), 5))


@query("SELECT c_mktsegment AS asset, CAST(o_orderdate AS DATE) AS date, round(arg_max(o_totalprice, o_orderkey), 6) AS nav FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 9 <> 0 GROUP BY ALL")
def nav_last_per_date(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("asset"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("nav"), "o_orderkey")
    return v.rounded(p.last_per_date(rows, "o_orderkey"))


@query(f"WITH {v.PADDED} SELECT asset, date, round(ret, 6) AS ret FROM re")
def returns_simple_pad(spark, folder):
    return v.rounded(v.padded_returns(spark, folder).select("asset", "date", "ret"))


@query(f"WITH {v.GRID} SELECT asset, date, round(nav / nullif(lag(nav) {_W}, 0) - 1, 6) AS ret FROM gr")
def returns_simple_nopad(spark, folder):
    return v.rounded(p.returns(p.grid(v.orders(spark, folder)), pad=False).select("asset", "date", "ret"))


@query(f"WITH {v.PADDED} SELECT asset, date, round(ln(nav / nullif(lag(nav) {_W}, 0)), 6) AS ret FROM pa")
def returns_log(spark, folder):
    return v.rounded(p.returns(p.grid(v.orders(spark, folder)), log=True).select("asset", "date", "ret"))


_CLASSES = (("growth", "AUTOMOBILE", 60.0), ("growth", "BUILDING", 20.0), ("steady", "FURNITURE", 50.0), ("steady", "HOUSEHOLD", 50.0), ("steady", "MACHINERY", 25.0))
_CLASS_SQL = f"""{v.PADDED}, w AS (SELECT k, a, x / sum(x) OVER (PARTITION BY k) AS w FROM (VALUES {', '.join(f"('{k}', '{a}', {x})" for k, a, x in _CLASSES)}) t(k, a, x)),
c AS (SELECT k AS asset, date, sum(w * coalesce(ret, 0)) AS ret FROM re JOIN w ON re.asset = w.a WHERE date >= DATE '1996-01-01' GROUP BY ALL),
n AS (SELECT asset, date, ret, CASE WHEN row_number() {_W} = 1 THEN 1.0 ELSE product(1 + ret) {_SO_FAR} END AS nav FROM c)"""


def _class_returns(spark, folder):
    weights = spark.createDataFrame(list(_CLASSES), "asset_class string, asset string, weight double")
    return p.classes(v.padded_returns(spark, folder).where("date >= date'1996-01-01'"), weights)


def _class_nav(spark, folder):
    return _class_returns(spark, folder).withColumn("nav", p.net_value(F.col("ret")))


@query(f"WITH {_CLASS_SQL} SELECT asset, date, round(ret, 6) AS ret, round(ln(nav), 5) AS log_nav FROM n")
def class_nav(spark, folder):
    return _class_nav(spark, folder).select("asset", "date", F.round("ret", 6).alias("ret"), F.round(F.ln("nav"), 5).alias("log_nav"))


_TWO = f"""{_CLASS_SQL}, two AS (SELECT x.date, x.ret AS x, y.ret AS y FROM c x JOIN c y ON x.date = y.date WHERE x.asset = 'growth' AND y.asset = 'steady')"""
_W20 = "OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_TWO}, o AS (SELECT covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS overall, count(*) AS n FROM two)
SELECT 'growth' AS asset, date, round(coalesce(CASE WHEN count(*) {_W20} = 20 THEN covar_samp(x, y) {_W20} / nullif(stddev_samp(x) {_W20} * stddev_samp(y) {_W20}, 0) END, 0), 5) AS corr, round(coalesce(overall, 0), 5) AS overall, n FROM two CROSS JOIN o""")
def class_rolling_corr(spark, folder):
    rows = _class_returns(spark, folder).select("asset", "date", "ret")
    found = t.rolling_correlation(rows, "steady", 20).join(t.overall_correlation(rows, "steady"), "asset")
    return v.rounded(found, 5)


def _performance_sql(source: str, value: str = "ret") -> str:
    return f"""pq AS (SELECT asset, quantile_cont({value}, 0.01) AS q FROM {source} GROUP BY asset), pd AS (SELECT *, nav / max(nav) {_SO_FAR} - 1 AS dd FROM {source}),
pm AS (SELECT pd.asset, avg({value}) * {DAYS} AS a, stddev_samp({value}) * sqrt({DAYS}) AS s, -any_value(q) AS var99, -avg(CASE WHEN {value} <= q THEN {value} END) AS es99, min(dd) AS mdd FROM pd JOIN pq ON pd.asset = pq.asset GROUP BY pd.asset)
SELECT asset, round(a, 5) AS annual_return, round(s, 5) AS annual_vol, round(a / nullif(s, 0), 5) AS sharpe, round(var99, 5) AS var99, round(es99, 5) AS es99, round(mdd, 5) AS max_drawdown, round(a / nullif(abs(mdd), 0), 5) AS calmar FROM pm"""


@query(f"WITH {_CLASS_SQL}, nr AS (SELECT asset, date, nav, nav / lag(nav) {_W} - 1 AS ret FROM n), {_performance_sql('nr')}")
def class_metrics(spark, folder):
    return v.rounded(s.performance(_class_nav(spark, folder).select("asset", "date", "nav")), 5)


_CORR = "CASE WHEN stddev_pop(x) * stddev_pop(y) = 0 THEN 0 ELSE greatest(-1, least(1, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)))) END"


@query(f"WITH {v.PADDED}, f AS (SELECT * FROM re WHERE ret IS NOT NULL), j AS (SELECT f.asset AS a, g.asset AS b, f.ret AS x, g.ret AS y FROM f JOIN f g ON f.date = g.date) SELECT a, b, round({_CORR}, 6) AS corr, round(covar_samp(x, y), 6) AS cov FROM j GROUP BY ALL")
def class_corr(spark, folder):
    return v.rounded(s.matrix(v.padded_returns(spark, folder).where("ret is not null")))


@query(f"""WITH {v.PADDED}, f AS (SELECT * FROM re WHERE ret IS NOT NULL), j AS (SELECT f.asset AS a, g.asset AS b, f.ret AS x, g.ret AS y FROM f JOIN f g ON f.date = g.date AND f.asset < g.asset),
c AS (SELECT avg(c) AS mean_corr FROM (SELECT a, b, {_CORR} AS c FROM j GROUP BY ALL)), m AS (SELECT asset, ret - avg(ret) OVER (PARTITION BY date) AS gap FROM f),
t AS (SELECT max(te) AS max_te FROM (SELECT asset, stddev_samp(gap) * sqrt({DAYS}) AS te FROM m GROUP BY asset)) SELECT round(mean_corr, 6) AS mean_corr, round(max_te, 6) AS max_te FROM c CROSS JOIN t""")
def class_consistency(spark, folder):
    rows = v.padded_returns(spark, folder).where("ret is not null")
    return v.rounded(s.mean_correlation(rows).crossJoin(s.tracking_error(rows).agg(F.max("te").alias("max_te"))))


@query(f"WITH {v.ORDERS}, f AS (SELECT max(d) AS start FROM (SELECT asset, min(date) AS d FROM od GROUP BY asset)) SELECT start, count(DISTINCT date) AS n_dates FROM od JOIN f ON date >= start GROUP BY start")
def default_start(spark, folder):
    return p.default_start(v.orders(spark, folder))


@query(f"""WITH {v.EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM ev WHERE date <= DATE '2024-01-20') SELECT asset, date, round(nav, 6) AS nav FROM k WHERE k <= 7""")
def window_slice(spark, folder):
    return v.rounded(p.tail_window(v.events(spark, folder), F.lit("2024-01-20").cast("date"), "ROLLINGn", 7))


@query(f"""WITH {v.EVENT_RETURNS} SELECT asset, round(avg(ret), 8) AS mean, round(median(ret), 8) AS median, round(stddev_pop(ret), 8) AS std,
  round((avg(ret^3) - 3 * avg(ret) * avg(ret^2) + 2 * avg(ret)^3) / (stddev_pop(ret)^3 + 1e-12), 5) AS skew,
  round((avg(ret^4) - 4 * avg(ret) * avg(ret^3) + 6 * avg(ret)^2 * avg(ret^2) - 3 * avg(ret)^4) / (stddev_pop(ret)^4 + 1e-12) - 3, 5) AS kurt FROM er WHERE ret IS NOT NULL GROUP BY asset""")
def series_moments(spark, folder):
    m = s.moments("ret")
    return v.event_returns(spark, folder).where("ret is not null").groupBy("asset").agg(*(F.round(c, 5 if k in ("skew", "kurt") else 8).alias(k) for k, c in m.items()))


_STATS = f"""{v.EVENT_RETURNS}, c AS (SELECT asset, avg(ret) AS mean, stddev_pop(ret) AS std FROM er GROUP BY asset), z AS (SELECT er.asset, ret, mean, std, (ret - mean) / std AS z FROM er JOIN c ON er.asset = c.asset WHERE ret IS NOT NULL),
a AS (SELECT asset, any_value(mean) AS mean, any_value(std) AS std, median(ret) AS median, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive, max(ret) AS best, min(ret) AS worst, count(*) AS n, sum(z^3) AS z3, sum(z^4) AS z4 FROM z GROUP BY asset),
k AS (SELECT *, CASE WHEN n > 2 THEN n / ((n - 1.0) * (n - 2)) * z3 END AS skew, CASE WHEN n > 3 THEN n * (n + 1.0) / ((n - 1.0) * (n - 2) * (n - 3)) * z4 - 3.0 * (n - 1) * (n - 1) / ((n - 2.0) * (n - 3)) END AS kurt FROM a),
st AS (SELECT *, n / 6.0 * (skew^2 + kurt^2 / 4) AS jb FROM k)"""


@query(f"""WITH {_STATS} SELECT asset, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(positive, 6) AS positive, round(best, 6) AS best, round(worst, 6) AS worst, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt,
  round(jb, 6) AS jb, round(exp(-jb / 2), 6) AS p, CASE WHEN jb IS NULL OR exp(-jb / 2) = 0 THEN 'insufficient' WHEN exp(-jb / 2) < 0.05 THEN 'rejected' ELSE 'normal' END AS verdict FROM st""")
def return_stats(spark, folder):
    return v.rounded(s.return_statistics(v.event_returns(spark, folder)))


_HIST = f"""{v.EVENT_RETURNS}, e AS (SELECT asset, CASE WHEN min(ret) = max(ret) THEN min(ret) ELSE floor(min(ret) / 0.2) * 0.2 END AS f, CASE WHEN min(ret) = max(ret) THEN min(ret) + 0.2 ELSE ceil(max(ret) / 0.2) * 0.2 END AS l FROM er GROUP BY asset),
b AS (SELECT *, greatest(1, CAST(round((l - f) / 0.2) AS INTEGER)) AS bins FROM e), g AS (SELECT asset, f, l, bins, unnest(range(0, bins)) AS bin FROM b),
h AS (SELECT er.asset, least(greatest(CAST(floor((ret - f) / 0.2) AS INTEGER), 0), bins - 1) AS bin, count(*) AS n FROM er JOIN b ON er.asset = b.asset WHERE ret IS NOT NULL GROUP BY ALL),
hi AS (SELECT g.asset, CAST(g.bin AS INTEGER) AS bin, f + g.bin * 0.2 AS low, CASE WHEN g.bin = bins - 1 THEN l ELSE f + (g.bin + 1) * 0.2 END AS high, coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON g.asset = h.asset AND g.bin = h.bin)"""


@query(f"WITH {_HIST} SELECT asset, bin, round(low, 6) AS low, round(high, 6) AS high, n FROM hi")
def histogram(spark, folder):
    return v.rounded(s.histogram(v.event_returns(spark, folder), 0.2))


@query(f"""WITH {_HIST}, c AS (SELECT asset, avg(ret) AS m, stddev_pop(ret) AS s, count(ret) AS k FROM er GROUP BY asset)
SELECT hi.asset, bin, round(low, 6) AS low, round(high, 6) AS high, n, round(exp(-(((low + high) / 2 - m)^2) / (2 * s * s)) / sqrt(2 * pi() * s * s) * k * 0.2, 6) AS expected FROM hi JOIN c ON hi.asset = c.asset""")
def normal_curve(spark, folder):
    rows = v.event_returns(spark, folder)
    return v.rounded(s.normal_curve(s.histogram(rows, 0.2), s.return_statistics(rows), 0.2))


@query(f"""WITH {v.PADDED}, q AS (SELECT asset, quantile_cont(ret, 0.25) AS q1, quantile_cont(ret, 0.5) AS q2, quantile_cont(ret, 0.75) AS q3 FROM re GROUP BY asset HAVING count(ret) >= 5),
i AS (SELECT re.asset, ret, q1, q2, q3, ret BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM re JOIN q ON re.asset = q.asset WHERE ret IS NOT NULL)
SELECT asset, round(min(ret) FILTER (WHERE inside), 6) AS low, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, round(max(ret) FILTER (WHERE inside), 6) AS high, count(*) FILTER (WHERE NOT inside) AS outliers FROM i GROUP BY asset""")
def box_plot(spark, folder):
    return v.rounded(s.box_plot(v.padded_returns(spark, folder)))


_ANNUAL = f"""{v.ORDERS}, y AS (SELECT *, year(date) AS year FROM od), r AS (SELECT *, nav / nullif(lag(nav) OVER (PARTITION BY asset, year ORDER BY date), 0) - 1 AS ret, nav / max(nav) OVER (PARTITION BY asset, year ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM y),
g AS (SELECT asset, year, arg_max(nav, date) / arg_min(nav, date) AS ratio, count(*) AS n, count(ret) AS k, avg(ret) AS m, stddev_samp(ret) AS vol, min(dd) AS mdd FROM r GROUP BY ALL),
an AS (SELECT asset, CAST(year AS INTEGER) AS year, CASE WHEN n = 1 THEN 0 ELSE ratio - 1 END AS cumulative, vol AS volatility, CASE WHEN n = 1 THEN 0 ELSE ratio ^ ({DAYS} / greatest(k, 1)) - 1 END AS annual_return, vol * sqrt({DAYS}) AS annual_vol,
  CASE WHEN vol * sqrt({DAYS}) > 1e-12 THEN m * {DAYS} / (vol * sqrt({DAYS})) END AS sharpe, mdd AS max_drawdown, CASE WHEN abs(mdd) > 1e-12 THEN (CASE WHEN n = 1 THEN 0 ELSE ratio ^ ({DAYS} / greatest(k, 1)) - 1 END) / abs(mdd) END AS calmar FROM g)"""
_FIGURES = ("cumulative", "volatility", "annual_return", "annual_vol", "sharpe", "max_drawdown", "calmar")


@query(f"WITH {_ANNUAL} SELECT asset, year, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)} FROM an")
def annual_metrics(spark, folder):
    return v.rounded(s.annual(v.orders(spark, folder)))


@query(f"WITH {_ANNUAL} " + " UNION ALL ".join(f"SELECT asset, CAST(year AS VARCHAR) || '{label}' AS label, round({c} * {k}, 4) AS value FROM an" for c, label, k in s.ANNUAL_LABELS))
def annual_rows(spark, folder):
    return v.rounded(s.annual_rows(s.annual(v.orders(spark, folder))), 4)


@query(f"""WITH {v.ORDERS}, r AS (SELECT *, nav / lag(nav) {_W} - 1 AS ret, nav / max(nav) {_SO_FAR} - 1 AS dd FROM od WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'),
g AS (SELECT asset, (arg_max(nav, date) / arg_min(nav, date) - 1) * 100 AS cum, max(date) - min(date) AS span, stddev_samp(ret) * sqrt({DAYS}) * 100 AS vol, min(dd) * 100 AS mdd FROM r GROUP BY asset),
h AS (SELECT *, ((1 + cum / 100) ^ (365 / span) - 1) * 100 AS ann, CASE asset WHEN 'BUILDING' THEN NULL ELSE length(asset) / 10.0 + 0.1 END AS fee FROM g)
SELECT asset, round(cum, 6) AS cumulative, round(ann, 6) AS annualised, round(vol, 6) AS volatility, round(mdd, 6) AS max_drawdown, round(fee, 6) AS total_fee, round(cum / fee, 6) AS return_to_fee, round(ann / vol, 6) AS sharpe, round(ann / abs(mdd), 6) AS calmar FROM h""")
def derived_metrics(spark, folder):
    panel = v.orders(spark, folder)
    fees = panel.select("asset").distinct().where("asset <> 'BUILDING'").select("asset", (F.length("asset") / 10.0).alias("m_fee"), F.lit(0.1).alias("c_fee"))
    return v.rounded(s.derived(panel, fees, "1995-01-01", "1996-12-31"))


@query(f"WITH {_ANNUAL}, q AS (SELECT annual_vol AS x, annual_return AS y FROM an) SELECT round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(min(x) - 0.1 * (max(x) - min(x)), 6) AS low_x, round(max(x) + 0.1 * (max(x) - min(x)), 6) AS high_x FROM q")
def quadrant(spark, folder):
    return v.rounded(s.quadrant(s.annual(v.orders(spark, folder)), "annual_vol", "annual_return").drop("low_y", "high_y"))


@query(f"""WITH {v.PADDED}, q AS (SELECT asset, quantile_cont(ret, 0.25) AS q1, quantile_cont(ret, 0.75) AS q3 FROM re GROUP BY asset HAVING count(ret) >= 5)
SELECT re.asset, date, round(ret, 6) AS value FROM re JOIN q ON re.asset = q.asset WHERE ret IS NOT NULL AND NOT ret BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, folder):
    return v.rounded(s.outliers(v.padded_returns(spark, folder)))


@query(f"WITH {v.PADDED} SELECT asset, min(date) AS first, max(date) AS last, count(*) AS n FROM re WHERE ret IS NOT NULL GROUP BY asset")
def statistics_range(spark, folder):
    return s.statistics_range(v.padded_returns(spark, folder))


@query(f"""WITH {v.ORDERS}, x AS (SELECT date, nav AS v FROM od WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' UNION ALL SELECT date, max(nav) * 1.1 FROM od WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' GROUP BY date)
SELECT round(min(v) - 0.05 * (max(v) - min(v)), 6) AS low, round(max(v) + 0.05 * (max(v) - min(v)), 6) AS high FROM x""")
def axis_range(spark, folder):
    series = v.orders(spark, folder).select("date", F.col("nav").alias("value"))
    markers = series.groupBy("date").agg((F.max("value") * 1.1).alias("value"))
    return v.rounded(s.axis_range(series, markers, "1993-01-01", "1997-12-31"))


_EACH = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, round(max(value) {_EACH}, 6) AS peak, round(sum(value) {_EACH}, 4) AS total, round(product(1 + value / 1e9) {_EACH}, 6) AS grown, round(value / nullif(max(value) {_EACH}, 0) - 1, 6) AS fall FROM events")
def running_events(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").alias("nav"))
    x = F.col("nav")
    out = running(rows, {"peak": ("max", x), "total": ("sum", x), "grown": ("product", 1 + x / 1e9)}, ("ts", "event_id"), 2)
    return out.select("event_id", F.round("peak", 6).alias("peak"), F.round("total", 4).alias("total"), F.round("grown", 6).alias("grown"), F.round(F.try_divide("nav", "peak") - 1, 6).alias("fall"))


@query(f"WITH {v.EVENTS} SELECT asset, date, round(nav / greatest(max(nav) {_SO_FAR}, 1) - 1, 6) AS drawdown FROM ev")
def drawdown_ranges(spark, folder):
    return v.rounded(long_drawdown(v.events(spark, folder), 1.0, span=7).select("asset", "date", "drawdown"))


@query(f"WITH {v.EVENT_RETURNS} SELECT asset, date, round(CASE WHEN row_number() {_W} = 1 THEN 1 ELSE product(1 + coalesce(ret, 0)) {_SO_FAR} END, 6) AS nav FROM er")
def net_value_ranges(spark, folder):
    return v.rounded(long_net_value(v.event_returns(spark, folder).drop("nav"), span=7).select("asset", "date", "nav"))


@query(f"""WITH {v.EVENTS}, p AS (SELECT *, row_number() {_W} AS i, max(nav) {_SO_FAR} AS peak FROM ev), f AS (SELECT asset, peak, min(i) AS pi FROM p GROUP BY asset, peak), d AS (SELECT p.*, 1 - nav / peak AS dd, pi FROM p JOIN f USING (asset, peak)),
w AS (SELECT asset, arg_max(i, row(dd, -i)) AS li, max(dd) AS mdd, arg_max(peak, row(dd, -i)) AS peak, arg_max(pi, row(dd, -i)) AS pi FROM d GROUP BY asset)
SELECT w.asset, round(any_value(mdd), 6) AS max_drawdown, CAST(CASE WHEN any_value(mdd) = 0 THEN 0 ELSE min(CASE WHEN d.i > li AND d.nav >= w.peak THEN d.i - w.pi END) END AS BIGINT) AS recovery FROM w JOIN d ON w.asset = d.asset GROUP BY w.asset""")
def mdd_recovery(spark, folder):
    return v.rounded(s.recovery(v.events(spark, folder)))


_EWM = f"""{v.EVENT_RETURNS}, f AS (SELECT asset, date, ret, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM er WHERE ret IS NOT NULL), l AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM f WHERE k <= 20),
e AS (SELECT asset, CASE WHEN k = n THEN 0.94 ^ (n - 1) ELSE 0.06 * 0.94 ^ (k - 1) END AS w, ret FROM l), ew AS (SELECT asset, sqrt(greatest(0, (sum(w * ret * ret) - sum(w * ret)^2) / (1 - sum(w * w)))) * sqrt({DAYS}) AS ewm FROM e GROUP BY asset)"""


@query(f"WITH {_EWM} SELECT asset, round(ewm, 6) AS ewm_vol FROM ew")
def ewm_vol(spark, folder):
    return v.rounded(s.risk_metrics(v.event_returns(spark, folder), window=20).select("asset", "ewm_vol"))


@query(f"""WITH {_EWM}, q AS (SELECT asset, quantile_cont(ret, 0.05) AS q FROM er GROUP BY asset), n AS (SELECT asset, date, ret, product(1 + ret) {_SO_FAR} AS nav FROM er WHERE ret IS NOT NULL),
d AS (SELECT asset, ret, nav / greatest(1, max(nav) {_SO_FAR}) - 1 AS dd FROM n)
SELECT d.asset, round(stddev_samp(ret), 6) AS vol, round(stddev_samp(ret) * sqrt({DAYS}), 6) AS annual_vol, round(any_value(ewm), 6) AS ewm_vol, round(coalesce(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0), 6) AS downside_vol,
  round(-any_value(q), 6) AS var, round(-avg(CASE WHEN ret <= q THEN ret END), 6) AS es, round(greatest(-min(dd), 0), 6) AS max_drawdown FROM d JOIN q ON d.asset = q.asset JOIN ew ON d.asset = ew.asset GROUP BY d.asset""")
def risk_metrics_all(spark, folder):
    return v.rounded(s.risk_metrics(v.event_returns(spark, folder), window=20))


@query(f"WITH {v.EVENT_RETURNS} SELECT asset, round(avg(ret), 6) AS mean, round(sum(ret), 6) AS cumulative, round(avg(ret) * {DAYS}, 6) AS annual, round(avg(ret), 6) AS ewm, 0.0::DOUBLE AS other FROM er GROUP BY asset")
def return_metrics_all(spark, folder):
    names = {"mean": "mean", "cumulative": "cumulative", "annual": "annual_mean", "ewm": "ewm", "other": "no_such_metric"}
    return v.rounded(v.event_returns(spark, folder).groupBy("asset").agg(*(s.return_metric(m).alias(k) for k, m in names.items())))


@query(f"""WITH {v.EVENT_RETURNS}, t AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM er WHERE ret IS NOT NULL AND NOT (asset = 'click' AND date > DATE '2024-01-25'))
SELECT a.asset AS a, b.asset AS b, round(covar_samp(a.ret, b.ret), 6) AS cov FROM t a JOIN t b ON a.k = b.k GROUP BY ALL""")
def tail_aligned_covariance(spark, folder):
    back = Window.partitionBy("asset").orderBy(F.desc("date"))
    rows = v.event_returns(spark, folder).where("ret is not null and not (asset = 'click' and date > date'2024-01-25')").withColumn("date", F.row_number().over(back))
    return v.rounded(s.pairs(rows).groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov")))
