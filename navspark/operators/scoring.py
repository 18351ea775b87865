"""Scores of products over several indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(products: DataFrame, categories=None, types=None, companies=None, years: tuple[int, int] | None = None, keyword: str | None = None) -> DataFrame:
    """Products of an evaluation plan; an empty choice does not filter."""
    for column, chosen in (("category", categories), ("type", types), ("company", companies)):
        if chosen:
            products = products.where(F.col(column).isin(*chosen))
    if years:
        products = products.where(F.col("year").between(*years))
    if keyword and keyword.strip():
        word = F.lit(keyword.strip().lower())
        products = products.where(F.contains(F.lower("name"), word) | F.contains(F.lower("id"), word) | F.contains(F.lower("company"), word))
    return products


def scores(values: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, score) of long values (id, indicator, value) under a plan (indicator, weight, higher_is_better).

    Each indicator is scaled to 0..100 over the products that have it, two
    decimals, all alike being 100; the score is their mean by the plan's weights.
    """
    w = Window.partitionBy("indicator")
    rows = values.where("value is not null").join(F.broadcast(plan), "indicator")
    low, high = F.min("value").over(w), F.max("value").over(w)
    up = F.try_divide(F.col("value") - low, high - low) * 100
    down = F.try_divide(high - F.col("value"), high - low) * 100
    scaled = F.when(low == high, 100.0).otherwise(F.round(F.when(F.col("higher_is_better"), up).otherwise(down), 2))
    total = plan.agg(F.sum("weight").alias("total"))
    summed = rows.withColumn("scaled", scaled).groupBy("id").agg(F.sum(F.col("scaled") * F.col("weight")).alias("s"))
    return summed.crossJoin(F.broadcast(total)).select("id", F.try_divide("s", "total").alias("score"))
