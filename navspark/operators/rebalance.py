"""Rebalancing calendars and segmented backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navspark.operators.stats import performance

PERIODS = {"weekly": "week", "monthly": "month", "yearly": "year"}


def trading_days(calendar: DataFrame, start: str, end: str, exchange: str = "SSE") -> DataFrame:
    """Distinct open days of an exchange (exchange, cal_date as yyyymmdd, is_open) in a closed range."""
    day = F.try_to_date(F.col("cal_date").cast("string"), "yyyyMMdd")
    rows = calendar.where((F.upper("exchange") == exchange.upper()) & (F.col("is_open") == 1)).select(day.alias("date")).distinct()
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def rebalance_dates(dates: DataFrame, mode: str, which: str = "nth", unit: str = "trading", n: int = 1, interval: int = 20, trading: DataFrame | None = None) -> DataFrame:
    """The rebalancing days among the panel's distinct dates.

    ``fixed`` takes every ``interval``-th date.  A week, month or year gives its
    first or last date, or the first date not before its n-th trading or n-th
    natural day, else its last.  Dates are one small dimension: per period they
    are aggregates; only ``fixed`` numbers all of them.
    """
    dates = dates.select("date").distinct()
    if mode == "fixed":
        step = max(1, int(interval))
        return dates.withColumn("k", F.row_number().over(Window.orderBy("date"))).where((F.col("k") - 1) % step == 0).select("date")
    if mode not in PERIODS:
        return dates.limit(0)
    rows = dates.withColumn("period", F.date_trunc(PERIODS[mode], "date").cast("date"))
    ends = rows.groupBy("period").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.array_sort(F.collect_list("date")).alias("all"))
    if which in ("first", "last"):
        return ends.select(F.col(which).alias("date"))
    n = max(1, int(n))
    if unit == "natural":
        target = F.date_add("first", n - 1)
    else:
        days = F.col("all")
        if trading is not None:
            listed = trading.select(F.col("date").alias("day"), F.date_trunc(PERIODS[mode], "date").cast("date").alias("period"))
            listed = listed.join(ends, "period").where("day between first and last").groupBy("period").agg(F.array_sort(F.collect_list("day")).alias("days"))
            ends = ends.join(listed, "period", "left")
            days = F.coalesce("days", "all")
        target = F.element_at(days, F.least(F.lit(n), F.size(days)))
    return ends.withColumn("target", target).select(F.coalesce(F.array_min(F.filter("all", lambda d: d >= F.col("target"))), F.col("last")).alias("date"))


def gated(dates: DataFrame, candidates: DataFrame, mode: str | None = "all", length: int | None = None, strict: bool = True) -> DataFrame:
    """Candidates with enough rows up to them: two, or ``length`` in mode rollingN; else the first date with enough and the candidates behind it.

    Fewer dates than that are a ValueError, for which the dates are counted at
    once; if not ``strict``, they give no row, and nothing runs here.
    """
    required = max(2, int(length or 0)) if (mode or "all").lower() == "rollingn" else 2
    if strict and dates.select("date").distinct().limit(required).count() < required:
        raise ValueError("too few rows for any rebalancing window")
    numbered = dates.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    good = candidates.join(numbered.where(F.col("k") >= required), "date").select("date")
    # One row says whether the fallback counts; candidates behind it would be good themselves, so it stands alone.
    none = good.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(required).alias("k"))
    return good.unionByName(numbered.join(F.broadcast(none), "k").select("date"))


def paths(panel: DataFrame, weights: DataFrame, rebalances: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, markers) of strategies.

    ``panel`` (asset, date, nav), ``weights`` (strategy, asset, weight) or, for
    weights of their own at each rebalancing, (strategy, date, asset, weight);
    ``rebalances`` (strategy, date), without which a strategy holds what it
    bought on the first date.  Path rows are (strategy, date, value), from the
    first rebalancing on; markers (strategy, date, asset, weight, value).

    Between two rebalancings the value is the sum of weight times nav over the
    nav at the segment's start, times the value there; an asset without a nav
    at the start is left out and the others' weights are normed anew, a nav
    missing later counts 0.  There is no loop over segments: each segment's
    growth is one aggregate, and the values at their starts are a running
    product.
    """
    dates = panel.select("date").distinct()
    names = weights.select("strategy").distinct()
    worthless = 0.0 if rebalances is None else 1.0  # held weights without any usable asset are worth nothing
    if rebalances is None:
        rebalances = names.crossJoin(dates.agg(F.min("date").alias("date")))
    rebalances = rebalances.join(dates, "date", "left_semi").select("strategy", "date").distinct()
    order = Window.partitionBy("strategy").orderBy("date")
    segments = rebalances.select("strategy", F.col("date").alias("start"), F.row_number().over(order).alias("segment"), F.lead("date").over(order).alias("until"))
    if "date" in weights.columns:
        held = segments.join(weights.withColumnRenamed("date", "start"), ["strategy", "start"])
    else:
        held = segments.join(weights, "strategy")
    base = held.join(panel.select("asset", F.col("date").alias("start"), F.col("nav").alias("base")), ["asset", "start"], "left")
    usable = F.col("base").isNotNull() & (F.col("base") != 0)
    base = base.withColumn("w", F.when(usable, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    total = F.sum("w").over(Window.partitionBy("strategy", "segment"))
    base = base.withColumn("w", F.coalesce(F.try_divide("w", total), F.lit(0.0)))
    growth = base.where("until is not null").join(panel.select("asset", F.col("date").alias("until"), F.col("nav").alias("end")), ["asset", "until"], "left")
    share = F.when(F.col("w") > 0, F.coalesce(F.col("w") * F.try_divide("end", "base"), F.lit(0.0))).otherwise(0.0)
    growth = growth.groupBy("strategy", "segment").agg(F.when(F.sum("w") > 0, F.sum(share)).otherwise(1.0).alias("growth"))
    before = Window.partitionBy("strategy").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    level = segments.join(growth, ["strategy", "segment"], "left").withColumn("level", F.coalesce(F.product(F.coalesce("growth", F.lit(1.0))).over(before), F.lit(1.0)))
    level = level.select("strategy", "segment", "start", "until", "level")

    # The segments' starts are carried along the dates of each strategy.
    starts = level.select("strategy", F.col("start").alias("date"), F.struct("segment", "level").alias("s"))
    at = names.crossJoin(F.broadcast(dates)).join(starts, ["strategy", "date"], "left").withColumn("s", F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.where("s is not null").select("strategy", "s.segment", "s.level", "date")
    rows = at.join(base.select("strategy", "segment", "asset", "w", "base"), ["strategy", "segment"]).join(panel.select("asset", "date", "nav"), ["asset", "date"], "left")
    share = F.when(F.col("w") > 0, F.coalesce(F.col("w") * F.try_divide("nav", "base"), F.lit(0.0))).otherwise(0.0)
    path = rows.groupBy("strategy", "date").agg((F.first("level") * F.when(F.sum("w") > 0, F.sum(share)).otherwise(worthless)).alias("value"))
    markers = base.select("strategy", "segment", "asset", F.col("start").alias("date"), F.col("w").alias("weight")).join(level.select("strategy", "segment", F.col("level").alias("value")), ["strategy", "segment"]).drop("segment")
    return path, markers.select("strategy", "date", "asset", "weight", "value")


def figures(path: DataFrame) -> DataFrame:
    """Performance of each strategy's path."""
    return performance(path.select(F.col("strategy").alias("asset"), "date", F.col("value").alias("nav"))).withColumnRenamed("asset", "strategy")
