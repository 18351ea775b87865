"""Comparing products: periods, aligned series, normalised indicators, one product's details."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions.clean import share
from navspark.operators.universe import lookup

#: Months of the preset periods.
PRESETS = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "2Y": 24, "3Y": 36, "5Y": 60}


def chosen_ids(text: str, most: int = 10) -> list[str]:
    """Ids of a comparison: comma-separated, URL-decoded, trimmed, distinct, the first ten."""
    return list(dict.fromkeys(t for t in (unquote(x).strip() for x in text.split(",")) if t))[:most]


def period_list(text: Column) -> Column:
    """``5,10，20`` as numbers; what is no positive number goes."""
    numbers = F.transform(F.split(text, "[,，\\s]+"), lambda x: x.try_cast("int"))
    return F.filter(numbers, lambda n: n > 0)


def ranges(panel: DataFrame) -> DataFrame:
    """(asset, preset, start, end): each preset back from the asset's last date, not before its first; ALL is everything."""
    ends = panel.where("nav is not null").groupBy("asset").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    items = [F.struct(F.lit(k).alias("preset"), F.greatest("lo", F.add_months("hi", -m)).alias("start")) for k, m in PRESETS.items()]
    items.append(F.struct(F.lit("ALL").alias("preset"), F.col("lo").alias("start")))
    return ends.select("asset", "hi", F.explode(F.array(*items)).alias("r")).select("asset", "r.preset", "r.start", F.col("hi").alias("end"))


def custom_range(panel: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows in a range given in any order; an open end reaches to the panel's."""
    a, b = (F.lit(x).cast("date") if x else None for x in (start, end))
    if a is not None and b is not None:
        return panel.where(F.col("date").between(F.least(a, b), F.greatest(a, b)))
    return panel.where(F.col("date") >= a) if a is not None else panel.where(F.col("date") <= b) if b is not None else panel


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(date, a, b) of two series (date, nav) on the union of their dates."""
    return left.select("date", F.col("nav").alias("a")).join(right.select("date", F.col("nav").alias("b")), "date", "full")


def aligned_all(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, one column a name) of any number of series of a panel (asset, date, nav), on the union of their dates.

    One aggregate by date holds them all, so series are not joined one by one.
    The names are given: they are the result's columns.
    """
    chosen = panel.where(F.col("asset").isin(*names))
    return chosen.groupBy("date").agg(*(F.max(F.when(F.col("asset") == n, F.col("nav"))).alias(n) for n in names))


def business_days(rows: DataFrame, key: str, date: str) -> DataFrame:
    """(key, date): Mondays to Fridays from each key's first to its last date."""
    ends = rows.groupBy(key).agg(F.min(F.to_date(date)).alias("lo"), F.max(F.to_date(date)).alias("hi")).where("lo is not null")
    return ends.select(key, F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)


def positions(values: DataFrame, smaller_is_better: Sequence[str] = ()) -> DataFrame:
    """``values`` (id, indicator, value) with each value's place between the indicator's least and greatest."""
    w = Window.partitionBy("indicator")
    low, high = F.min("value").over(w), F.max("value").over(w)
    at = F.when(F.col("indicator").isin(*smaller_is_better), share(F.col("value"), low, high, True)).otherwise(share(F.col("value"), low, high))
    return values.where("value is not null").withColumn("position", at)


def detail(products: DataFrame, prices: DataFrame, identifier: str) -> DataFrame:
    """The product an identifier means with its start date and price series (ts_code, date, close), a row a day; without prices one row."""
    start = F.coalesce(*(F.col(c) for c in ("list_date", "found_date", "issue_date", "purc_start_date") if c in products.columns))
    found = lookup(products, identifier).withColumn("start_date", start)
    return F.broadcast(found).join(prices, "ts_code", "left")


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not to be deleted; a null key stays."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
