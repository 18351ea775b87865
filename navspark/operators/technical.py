"""Rolling statistics and chart overlays."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.operators.panel import by_date, trailing
from navspark.operators.stats import DAYS


def full(value: Column, n: int, column: str) -> Column:
    """``value`` where the trailing window is full."""
    return F.when(F.count(column).over(trailing(n)) == n, value)


def moving_average(column: str, n: int) -> Column:
    return full(F.avg(column).over(trailing(n)), n, column)


def bollinger(column: str, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """(middle, upper, lower) with the population deviation."""
    middle, s = F.avg(column).over(trailing(n)), F.stddev_pop(column).over(trailing(n))
    return full(middle, n, column), full(middle + k * s, n, column), full(middle - k * s, n, column)


def rolling_correlation(rows: DataFrame, target: str, n: int) -> DataFrame:
    """(asset, date, corr): trailing correlation of each asset's returns with the target's; 0 where it is not defined."""
    other = rows.where(F.col("asset") == target).select("date", F.col("ret").alias("y"))
    both = rows.where(F.col("asset") != target).join(other, "date").select("asset", "date", F.col("ret").alias("x"), "y").where("x is not null and y is not null")
    w = trailing(n)
    ratio = F.try_divide(F.covar_samp("x", "y").over(w), F.stddev_samp("x").over(w) * F.stddev_samp("y").over(w))
    return both.select("asset", "date", F.coalesce(F.when(F.count("*").over(w) == n, ratio), F.lit(0.0)).alias("corr"))


def overall_correlation(rows: DataFrame, target: str) -> DataFrame:
    """(asset, overall, n): correlation of each asset's returns with the target's over all dates that both have; 0 where it is not defined."""
    other = rows.where(F.col("asset") == target).select("date", F.col("ret").alias("y"))
    both = rows.where(F.col("asset") != target).join(other, "date").where("ret is not null and y is not null")
    ratio = F.try_divide(F.covar_samp("ret", "y"), F.stddev_samp("ret") * F.stddev_samp("y"))
    return both.groupBy("asset").agg(F.coalesce(ratio, F.lit(0.0)).alias("overall"), F.count("*").alias("n"))


def rolling_volatility(n: int, column: str = "ret", days: int = DAYS) -> Column:
    """Annualised, in percent, from two returns on."""
    w = trailing(n)
    return F.when(F.count(column).over(w) >= 2, F.stddev_samp(column).over(w) * F.sqrt(F.lit(days)) * 100)


def kdj(ohlc: DataFrame, n: int = 9, k_smooth: int = 3, d_smooth: int = 3) -> DataFrame:
    """(asset, date, k, d, j): stochastic oscillator whose smoothed state is carried on as rounded.

    The rolling high and low are windows.  Rounding at every step keeps the
    recursion from being cut anywhere but between assets, so an asset's rows
    stream by in order, and only two numbers are carried from row to row: a
    series of any length takes one pass and no memory.
    """
    w = trailing(n)
    high, low = F.max("high").over(w), F.min("low").over(w)
    rsv = F.when(high == low, 50.0).otherwise(F.try_divide(F.col("close") - low, high - low) * 100)
    rows = ohlc.select("asset", "date", rsv.alias("rsv")).repartition("asset").sortWithinPartitions("asset", "date")
    cent = Decimal("0.01")

    def rounded(x: float) -> float:
        return float(Decimal(repr(x)).quantize(cent, ROUND_HALF_UP))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asset, k, d = None, 50.0, 50.0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for name, x in zip(batch.column("asset").to_pylist(), batch.column("rsv").to_pylist()):
                if name != asset:
                    asset, k, d = name, 50.0, 50.0
                if x is None or k is None:  # what is not known stays unknown
                    k = d = None
                    new = (None, None, None)
                else:
                    k = ((k_smooth - 1) * k + x) / k_smooth
                    d = ((d_smooth - 1) * d + k) / d_smooth
                    new = (rounded(k), rounded(d), rounded(3 * k - 2 * d))
                    k, d = new[:2]
                for column, value in zip(out, new):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("asset"), batch.column("date"), *(pa.array(c, pa.float64()) for c in out)], names=["asset", "date", "k", "d", "j"])

    kinds = dict(ohlc.dtypes)
    return rows.mapInArrow(steps, f"asset {kinds['asset']}, date {kinds['date']}, k double, d double, j double")


def percent_change(column: str) -> Column:
    """Change on the day before in percent, four decimals; none after a zero."""
    before = F.lag(column).over(by_date())
    return F.when(before != 0, F.round((F.col(column) / before - 1) * 100, 4))
