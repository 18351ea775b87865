"""Queries of rebalancing calendars and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from navspark.operators import rebalance as r
from navspark.operators.running import held_path
from navspark.plans import views as v
from navspark.plans.registry import query
from navspark.sources.shared import once
from navspark.sources.tables import table

_DATES = f"{v.ORDERS}, dt AS (SELECT DISTINCT date FROM od)"
_CAL = "cal AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM dt), (SELECT max(date) FROM dt), INTERVAL 1 DAY)) AS DATE) AS day), td AS (SELECT day FROM cal WHERE isodow(day) <= 5)"


def calendar(spark, folder):
    """The days from the first to the last order, Mondays to Fridays open."""
    days = table(spark, folder, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).select(F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("d"))
    return days.select(F.lit("sse").alias("exchange"), F.date_format("d", "yyyyMMdd").alias("cal_date"), (F.weekday("d") < 5).cast("int").alias("is_open"))


def _dates(spark, folder):
    return v.orders(spark, folder).select("date").distinct()


@query(f"WITH {_DATES}, {_CAL} SELECT day AS date FROM td WHERE day BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'")
def trading_calendar(spark, folder):
    return r.trading_days(calendar(spark, folder), "1994-01-01", "1995-06-30")


@query(f"WITH {_DATES} SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM dt) WHERE (k - 1) % 20 = 0")
def rebalance_fixed(spark, folder):
    return r.rebalance_dates(_dates(spark, folder), "fixed", interval=20)


def _add(mode: str, unit: str) -> None:
    group = f"SELECT CAST(date_trunc('{unit}', date) AS DATE) AS period, min(date) AS f, max(date) AS l FROM dt GROUP BY ALL"
    for which, pick in (("first", "f"), ("last", "l")):
        def simple(spark, folder, w=which):
            return r.rebalance_dates(_dates(spark, folder), mode, w)

        query(f"WITH {_DATES}, g AS ({group}) SELECT {pick} AS date FROM g", f"rebalance_{mode}_{which}")(simple)

    def natural(spark, folder):
        return r.rebalance_dates(_dates(spark, folder), mode, unit="natural", n=3)

    query(f"WITH {_DATES}, g AS ({group}) SELECT coalesce(min(dt.date), any_value(l)) AS date FROM g LEFT JOIN dt ON date_trunc('{unit}', dt.date) = g.period AND dt.date >= g.f + 2 GROUP BY g.period", f"rebalance_{mode}_nth_natural")(natural)

    def trading(spark, folder):
        return r.rebalance_dates(_dates(spark, folder), mode, n=3, trading=r.trading_days(calendar(spark, folder), "1900-01-01", "2100-12-31"))

    sql = f"""WITH {_DATES}, {_CAL}, g AS ({group}), d AS (SELECT g.period, list(day ORDER BY day) AS days FROM g JOIN td ON day BETWEEN f AND l GROUP BY g.period),
a AS (SELECT CAST(date_trunc('{unit}', date) AS DATE) AS period, list(date ORDER BY date) AS days FROM dt GROUP BY ALL), h AS (SELECT g.period, g.l, coalesce(d.days, a.days) AS days FROM g JOIN a ON g.period = a.period LEFT JOIN d ON g.period = d.period),
t AS (SELECT period, l, days[least(3, len(days))] AS target FROM h) SELECT coalesce(min(dt.date), any_value(l)) AS date FROM t LEFT JOIN dt ON date_trunc('{unit}', dt.date) = t.period AND dt.date >= t.target GROUP BY t.period"""
    query(sql, f"rebalance_{mode}_nth_trading")(trading)


for _mode, _unit in r.PERIODS.items():
    _add(_mode, _unit)


@query(f"WITH {_DATES}, k AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM dt), c AS (SELECT min(date) AS date FROM dt GROUP BY date_trunc('month', date)) SELECT c.date FROM c JOIN k ON c.date = k.date WHERE k >= 60")
def rebalance_gate(spark, folder):
    dates = _dates(spark, folder)
    return r.gated(dates, r.rebalance_dates(dates, "monthly", "first"), "rollingN", 60, strict=False)


@query(f"WITH {_DATES}, k AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM dt WHERE date < DATE '1995-01-20' AND date >= DATE '1995-01-02') SELECT date FROM k WHERE k = 10")
def rebalance_gate_fallback(spark, folder):
    dates = _dates(spark, folder).where("date >= date'1995-01-02' and date < date'1995-01-20'")
    return r.gated(dates, r.rebalance_dates(dates, "monthly", "first"), "rollingN", 10, strict=False)


_WEIGHTS = (("even", "AUTOMOBILE", 1.0), ("even", "BUILDING", 1.0), ("even", "FURNITURE", 1.0), ("tilted", "AUTOMOBILE", 0.6), ("tilted", "MACHINERY", 0.3), ("tilted", "HOUSEHOLD", 0.0))
_VALUES = ", ".join(f"('{s}', '{a}', {x})" for s, a, x in _WEIGHTS)
_PANEL = f"{v.PADDED}, pn AS (SELECT asset, date, nav FROM pa)"


def _panel(spark, folder):
    return v.padded_returns(spark, folder).select("asset", "date", "nav")


def _weights(spark):
    return spark.createDataFrame(list(_WEIGHTS), "strategy string, asset string, weight double")


def _segment_sql(rebalances: str) -> str:
    return f"""{_PANEL}, rb AS ({rebalances}), w AS (SELECT s, a, CAST(x AS DOUBLE) AS x FROM (VALUES {_VALUES}) t(s, a, x)),
sg AS (SELECT date AS start, row_number() OVER (ORDER BY date) AS k, lead(date) OVER (ORDER BY date) AS until FROM rb),
us AS (SELECT w.s, w.a, sg.k, sg.start, sg.until, b.nav AS b, CASE WHEN b.nav IS NOT NULL AND b.nav <> 0 THEN w.x ELSE 0 END AS u FROM sg CROSS JOIN w LEFT JOIN pn b ON b.asset = w.a AND b.date = sg.start),
hd AS (SELECT *, coalesce(u / nullif(sum(u) OVER (PARTITION BY s, k), 0), 0) AS w FROM us),
gr1 AS (SELECT h.s, h.k, CASE WHEN sum(h.w) > 0 THEN sum(CASE WHEN h.w > 0 THEN coalesce(h.w * e.nav / h.b, 0) ELSE 0 END) ELSE 1 END AS g FROM hd h LEFT JOIN pn e ON e.asset = h.a AND e.date = h.until WHERE h.until IS NOT NULL GROUP BY h.s, h.k),
lv AS (SELECT n.s, sg.k, sg.start, sg.until, coalesce(product(coalesce(g, 1)) OVER (PARTITION BY n.s ORDER BY sg.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS level FROM sg CROSS JOIN (SELECT DISTINCT s FROM w) n LEFT JOIN gr1 ON gr1.s = n.s AND gr1.k = sg.k),
path AS (SELECT lv.s AS strategy, t.date, any_value(level) * CASE WHEN sum(h.w) > 0 THEN sum(CASE WHEN h.w > 0 THEN coalesce(h.w * p.nav / h.b, 0) ELSE 0 END) ELSE 1 END AS value
  FROM lv JOIN (SELECT DISTINCT date FROM pn) t ON t.date >= lv.start AND (lv.until IS NULL OR t.date < lv.until) JOIN hd h ON h.s = lv.s AND h.k = lv.k LEFT JOIN pn p ON p.asset = h.a AND p.date = t.date GROUP BY lv.s, t.date)"""


_FIRST = "SELECT min(date) AS date FROM pn"
_MONTHS = "SELECT min(date) AS date FROM pn GROUP BY date_trunc('month', date)"
_FIXED = "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM pn)) WHERE (k - 1) % 20 = 0"


#: Held weights of no usable asset are worth nothing, where rebalanced ones keep their value.
_HELD = f"WITH {_segment_sql(_FIRST)} SELECT strategy, date, round(value, 6) AS value FROM path".replace("ELSE 1 END AS value", "ELSE 0 END AS value")


def _backtest(spark, folder, mode=None, **kw):
    panel = once(_panel(spark, folder))
    weights = _weights(spark)
    chosen = None
    if mode:  # two strategies, which every date meets
        chosen = r.rebalance_dates(panel, mode, **kw).crossJoin(F.broadcast(weights.select("strategy").distinct()))
    return r.paths(panel, weights, chosen)


@query(_HELD)
def backtest_static(spark, folder):
    return v.rounded(_backtest(spark, folder)[0])


@query(_HELD)
def backtest_held(spark, folder):
    """Bought once, without windows over a series."""
    return v.rounded(held_path(once(_panel(spark, folder)), _weights(spark)))


@query(f"WITH {_segment_sql(_MONTHS)} SELECT strategy, date, round(value, 6) AS value FROM path")
def backtest_monthly(spark, folder):
    return v.rounded(_backtest(spark, folder, "monthly", which="first")[0])


@query(f"WITH {_segment_sql(_FIXED)} SELECT strategy, date, round(value, 6) AS value FROM path")
def backtest_fixed20(spark, folder):
    return v.rounded(_backtest(spark, folder, "fixed", interval=20)[0])


@query(f"WITH {_segment_sql(_MONTHS)} SELECT lv.s AS strategy, lv.start AS date, h.a AS asset, round(h.w, 6) AS weight, round(level, 6) AS value FROM lv JOIN hd h ON h.s = lv.s AND h.k = lv.k")
def backtest_markers(spark, folder):
    return v.rounded(_backtest(spark, folder, "monthly", which="first")[1])


_W2 = "OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {_segment_sql(_MONTHS)}, q AS (SELECT strategy, date, value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret, value / max(value) {_W2} - 1 AS dd FROM path), t AS (SELECT strategy, quantile_cont(ret, 0.01) AS q FROM q GROUP BY strategy),
m AS (SELECT q.strategy, avg(ret) * 252 AS a, stddev_samp(ret) * sqrt(252) AS s, -any_value(q) AS v, -avg(CASE WHEN ret <= q THEN ret END) AS es, min(dd) AS d FROM q JOIN t ON q.strategy = t.strategy GROUP BY q.strategy)
SELECT strategy, round(a, 5) AS annual_return, round(s, 5) AS annual_vol, round(a / s, 5) AS sharpe, round(v, 5) AS var99, round(es, 5) AS es99, round(d, 5) AS max_drawdown, round(a / abs(d), 5) AS calmar FROM m""")
def backtest_metrics(spark, folder):
    return v.rounded(r.figures(_backtest(spark, folder, "monthly", which="first")[0]), 5)
