"""Running figures of series too long for one task: each range of dates by itself, then a carry from range to range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How running figures combine rows, and a range's figure with what came before it.
_ROWS = {"max": F.max, "product": F.product, "sum": F.sum}
_JOINED = {"max": lambda a, b: F.greatest(a, b), "product": lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0)), "sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))}


def running(rows: DataFrame, figures: dict[str, tuple[str, Column]], order: Sequence[str] = ("date",), span: float = 256, key: str = "asset") -> DataFrame:
    """``rows`` with running ``figures``: name -> (max, product or sum, of which column), up to and with each row.

    ``order`` is a unique order of a key's rows and starts with a date or time;
    ``span`` days make one range.  A range's rows are one window, so one long
    series is as many tasks as it has ranges; a range's figure is one partial
    aggregate, and only the ranges of a key, one small row each, meet in one
    window for the carry.  Rows without a time form a range ahead of the others.
    Missing values are skipped; a figure is null (sum: 0, product: 1) until
    there is a value.  Columns of ``rows`` may have any names but those of the
    figures.
    """
    taken = set(rows.columns) & set(figures)
    if taken:
        raise ValueError(f"columns are there already: {sorted(taken)}")
    day = F.col(order[0]).cast("timestamp").cast("double") / 86400
    block = F.coalesce(F.floor(day / span), F.lit(-(1 << 62)))
    inputs = {f"running {i}": c for i, (_, c) in enumerate(figures.values())}
    rows = rows.withColumns({"running block": block, **inputs})
    kinds = [kind for kind, _ in figures.values()]
    within = Window.partitionBy(key, "running block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("running block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "running block").agg(*(_ROWS[kind](f"running {i}").alias(f"running total {i}") for i, kind in enumerate(kinds)))
    carry = totals.select(F.col(key).alias("running key"), F.col("running block").alias("running at"), *(_ROWS[kind](f"running total {i}").over(before).alias(f"running carry {i}") for i, kind in enumerate(kinds)))
    here = rows.withColumns({f"running here {i}": _ROWS[kind](f"running {i}").over(within) for i, kind in enumerate(kinds)})
    joined = here.join(carry, here[key].eqNullSafe(carry["running key"]) & (here["running block"] == carry["running at"]))
    kept = [c for c in rows.columns if not c.startswith("running ")]
    return joined.select(*(here[c] for c in kept), *(_JOINED[kind](F.col(f"running carry {i}"), F.col(f"running here {i}")).alias(name) for i, (name, kind) in enumerate(zip(figures, kinds))))


def long_drawdown(panel: DataFrame, start: float | None = None, order: Sequence[str] = ("date",), span: float = 256) -> DataFrame:
    """``panel`` with peak and drawdown, as ``panel.drawdown`` gives them, for series of any length."""
    out = running(panel, {"peak": ("max", F.col("nav"))}, order, span)
    if start is not None:
        out = out.withColumn("peak", F.greatest("peak", F.lit(float(start))))
    return out.withColumn("drawdown", F.when(F.col("peak") > 0, F.try_divide("nav", "peak") - 1))


def long_net_value(returns: DataFrame, order: Sequence[str] = ("date",), span: float = 256) -> DataFrame:
    """``returns`` with nav: compounded returns, where the first row is 1 by definition and a missing return grows nothing.

    The first row's own return counts for nothing that follows only if it is
    missing, as it is in a panel's returns.
    """
    out = running(returns, {"grown": ("product", 1 + F.coalesce("ret", F.lit(0.0))), "n": ("sum", F.lit(1.0))}, order, span)
    return out.withColumn("nav", F.when(F.col("n") == 1, 1.0).otherwise(F.col("grown"))).drop("grown", "n")


def held_path(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(strategy, date, value) of weights (strategy, asset, weight) bought on the panel's first date and held.

    An asset without a nav there, or with a zero one, is left out and the
    others' weights are normed anew; a nav missing later counts 0, and so does
    everything without any usable asset.  First navs are one aggregate and a join, so
    no window runs over a series.
    """
    first = panel.agg(F.min("date").alias("start"))
    base = panel.join(F.broadcast(first), F.col("date") == F.col("start")).where("nav is not null and nav <> 0").groupBy("asset").agg(F.avg("nav").alias("base"))
    held = weights.join(base, "asset", "left").withColumn("w", F.when(F.col("base").isNotNull(), F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    total = held.groupBy("strategy").agg(F.sum("w").alias("total"))
    held = held.join(total, "strategy").select("strategy", "asset", F.coalesce(F.try_divide("w", "total"), F.lit(0.0)).alias("w"), "base")
    share = F.when(F.col("w") > 0, F.coalesce(F.col("w") * F.try_divide("nav", "base"), F.lit(0.0))).otherwise(0.0)
    rows = panel.select("asset", "date", "nav").join(held, "asset")
    return rows.groupBy("strategy", "date").agg(F.sum(share).alias("value"))
