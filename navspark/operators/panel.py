"""Long net-asset-value panels (asset, date, nav): grids, returns, paths.

Panels stay long.  All windows of one query share the partitioning by asset, so
Catalyst plans one exchange for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("date")


def so_far() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int) -> WindowSpec:
    """The last n rows of an asset, the row itself included."""
    return by_date().rowsBetween(-(n - 1), 0)


def mean_per_date(rows: DataFrame) -> DataFrame:
    """One nav of each asset and date, the mean of several."""
    return rows.groupBy("asset", "date").agg(F.avg("nav").alias("nav"))


def last_per_date(rows: DataFrame, order: str) -> DataFrame:
    """One nav of each asset and date, the last that is there."""
    return rows.where("nav is not null").groupBy("asset", "date").agg(F.max_by("nav", order).alias("nav"))


def grid(panel: DataFrame) -> DataFrame:
    """Every asset on every date of the panel; nav is null where it is missing.

    Dates and assets are the two small dimensions of a panel: the cross product
    is the result itself, and both come from partial aggregates.
    """
    dates, assets = panel.select("date").distinct(), panel.select("asset").distinct()
    return assets.crossJoin(dates).join(panel.select("asset", "date", "nav"), ["asset", "date"], "left")


def pivot(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Date by asset; the assets are given, so no job looks for them."""
    return panel.groupBy("date").pivot("asset", list(assets)).agg(F.avg("nav"))


def melt(wide: DataFrame) -> DataFrame:
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "asset", "nav")


def complete_dates(panel: DataFrame, n_assets: int) -> DataFrame:
    """Rows of dates on which all assets have a nav."""
    full = panel.where("nav is not null").groupBy("date").agg(F.countDistinct("asset").alias("n")).where(F.col("n") == n_assets).select("date")
    return panel.join(full, "date", "left_semi")


def simple_return(nav: Column) -> Column:
    return F.try_divide(nav, F.lag(nav).over(by_date())) - 1


def padded(nav: Column) -> Column:
    """The last nav that is there."""
    return F.last(nav, ignorenulls=True).over(so_far())


def returns(panel: DataFrame, pad: bool = True, log: bool = False) -> DataFrame:
    """``panel`` with ret; with ``pad`` a missing nav counts as the one before."""
    if pad:
        panel = panel.withColumn("nav", padded(F.col("nav")))
    before = F.lag("nav").over(by_date())
    ratio = F.try_divide("nav", before)
    return panel.withColumn("ret", F.ln(F.when(ratio > 0, ratio)) if log else ratio - 1)


def net_value(ret: Column) -> Column:
    """Compounded returns, where the first row is 1 by definition."""
    grown = F.product(1 + F.coalesce(ret, F.lit(0.0))).over(so_far())
    return F.when(F.row_number().over(by_date()) == 1, 1.0).otherwise(grown)


def drawdown(nav: Column, start: float | None = None) -> Column:
    """Distance to the running maximum, which starts at ``start`` if given."""
    peak = F.max(nav).over(so_far())
    if start is not None:
        peak = F.greatest(peak, F.lit(start))
    return F.when(peak > 0, F.try_divide(nav, peak) - 1)


def normalised(nav: Column) -> Column:
    """nav over the asset's first positive one."""
    first = F.first(F.when(nav > 0, nav), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.try_divide(nav, first)


def classes(member_returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Returns of asset classes: members (asset, date, ret) times (asset_class, asset, weight), weights normed to 1."""
    total = weights.groupBy("asset_class").agg(F.sum("weight").alias("total"))
    normed = weights.join(total, "asset_class").select("asset_class", "asset", F.try_divide("weight", "total").alias("w"))
    joined = member_returns.join(normed, "asset")
    return joined.groupBy(F.col("asset_class").alias("asset"), "date").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def tail_window(panel: DataFrame, up_to: Column, mode: str | None = "all", length: int | None = None) -> DataFrame:
    """Rows up to a date; with mode ``rollingN`` the last ``length`` of each asset, two at least."""
    panel = panel.where(F.col("date") <= up_to)
    if (mode or "all").lower() != "rollingn":
        return panel
    back = Window.partitionBy("asset").orderBy(F.desc("date"))
    return panel.withColumn("k", F.row_number().over(back)).where(F.col("k") <= max(2, int(length or 0))).drop("k")


def default_start(panel: DataFrame) -> DataFrame:
    """(start, n_dates): the latest of the assets' first dates, and the dates from it on."""
    first = panel.where("nav is not null").groupBy("asset").agg(F.min("date").alias("first")).agg(F.max("first").alias("start"))
    return panel.select("date").distinct().join(F.broadcast(first), F.col("date") >= F.col("start")).groupBy("start").agg(F.count("*").alias("n_dates"))
