"""Numeric kernels on scalar columns and on series held as arrays of doubles.

A missing or undefined result is null.  Where rows rather than arrays hold a
series, ``operators.panel`` and ``operators.stats`` have the window forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisors and peaks below this are zero.
TINY = 1e-12

# Scalars.


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= TINY, F.try_divide(a, b))


def negate(a: Column) -> Column:
    return -a


def absolute(a: Column) -> Column:
    return F.abs(a)


def power(a: Column, b: Column) -> Column:
    value = F.pow(a, b)
    return F.when(~F.isnan(value), value)


def maximum(a: Column, b: Column) -> Column:
    return F.when(a >= b, a).otherwise(b)


def minimum(a: Column, b: Column) -> Column:
    return F.when(a <= b, a).otherwise(b)


def clip(a: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError("the lower limit is above the upper one")
    return F.when(a < low, F.lit(float(low))).when(a > high, F.lit(float(high))).otherwise(a)


def reciprocal(a: Column) -> Column:
    return divide(F.lit(1.0), a)


def root(a: Column) -> Column:
    return F.when(a >= 0, F.sqrt(a))


# Series.


def _fold(s: Column, start: float, step) -> Column:
    return F.aggregate(s, F.lit(start), step)


def _scan(s: Column, start: float, step) -> Column:
    """All states of a fold, the start not included."""
    first = F.struct(F.lit(start).alias("v"), F.array().cast("array<double>").alias("out"))

    def grown(state: Column, x: Column) -> Column:
        v = step(state["v"], x)
        return F.struct(v.alias("v"), F.concat(state["out"], F.array(v)).alias("out"))

    return F.aggregate(s, first, grown)["out"]


def _some(s: Column, value: Column) -> Column:
    return F.when(F.size(s) > 0, value)


def sequence_sum(s: Column) -> Column:
    return _fold(s, 0.0, lambda a, x: a + x)


def sequence_cumsum(s: Column) -> Column:
    return _scan(s, 0.0, lambda a, x: a + x)


def sequence_prod(s: Column) -> Column:
    return _fold(s, 1.0, lambda a, x: a * x)


def sequence_cumprod(s: Column) -> Column:
    return _scan(s, 1.0, lambda a, x: a * x)


def sequence_mean(s: Column) -> Column:
    return _some(s, F.try_divide(sequence_sum(s), F.size(s)))


def sequence_variance(s: Column, ddof: int = 1) -> Column:
    mean = sequence_mean(s)
    squares = sequence_sum(F.transform(s, lambda x: (x - mean) * (x - mean)))
    return F.when(F.size(s) > ddof, F.try_divide(squares, F.size(s) - ddof))


def sequence_std(s: Column, ddof: int = 1) -> Column:
    return F.sqrt(sequence_variance(s, ddof))


def sequence_mean_variance_std(s: Column, ddof: int = 1) -> Column:
    return F.struct(sequence_mean(s).alias("mean"), sequence_variance(s, ddof).alias("variance"), sequence_std(s, ddof).alias("std"))


def sequence_min(s: Column) -> Column:
    return F.array_min(s)


def sequence_max(s: Column) -> Column:
    return F.array_max(s)


def _zip(a: Column, b: Column, f) -> Column:
    """Element by element; series of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("series differ in length")).cast("array<double>"))


def sequence_add(a: Column, b: Column) -> Column:
    return _zip(a, b, add)


def sequence_subtract(a: Column, b: Column) -> Column:
    return _zip(a, b, subtract)


def sequence_multiply(a: Column, b: Column) -> Column:
    return _zip(a, b, multiply)


def sequence_divide(a: Column, b: Column) -> Column:
    return _zip(a, b, divide)


def sequence_excess_return(a: Column, b: Column) -> Column:
    return _zip(a, b, subtract)


def cumulative_simple_returns(r: Column) -> Column:
    return F.transform(sequence_cumprod(F.transform(r, lambda x: 1 + x)), lambda x: x - 1)


def sequence_geometric_mean(s: Column) -> Column:
    return F.when((F.size(s) > 0) & F.forall(s, lambda x: x > 0), F.pow(sequence_prod(s), F.try_divide(F.lit(1.0), F.size(s))))


def cumulative_net_value(r: Column, start: float = 1.0) -> Column:
    """One point more than returns, the first the start."""
    return F.concat(F.array(F.lit(float(start))), _scan(r, float(start), lambda v, x: v * (1 + x)))


def sequence_compound_annual_growth_rate(r: Column, per_year: float) -> Column:
    growth = sequence_prod(F.transform(r, lambda x: 1 + x))
    return F.when((F.size(r) > 0) & (growth > 0), F.pow(growth, F.try_divide(F.lit(float(per_year)), F.size(r))) - 1)


def sequence_drawdown(s: Column) -> Column:
    peaks = _scan(s, float("-inf"), lambda p, x: F.greatest(p, x))
    return F.zip_with(s, peaks, lambda x, p: F.when(p > 0, F.try_divide(x - p, p)))


def max_drawdown_rate_and_recovery_days(s: Column) -> Column:
    """(rate, steps): deepest fall, positive, and steps from its peak to as high a value; null if there is none."""
    falls = sequence_drawdown(s)
    worst = F.array_min(falls)
    low = F.array_position(falls, worst).cast("int")
    peak = F.array_max(F.slice(s, 1, low))
    top = F.array_position(F.slice(s, 1, low), peak).cast("int")
    after = F.slice(s, low + 1, F.size(s))
    back = F.element_at(F.filter(F.transform(after, lambda x, i: F.when(x >= peak, i + 1)), lambda i: i.isNotNull()), 1)
    # Of equal peaks the first counts: only a higher value is a new peak.
    steps = F.when(worst == 0, F.lit(0.0)).when(F.exists(after, lambda x: x >= peak), (low + back - top).cast("double"))
    return F.struct(F.when(worst == 0, F.lit(0.0)).otherwise(-worst).alias("rate"), F.when(top.isNotNull(), steps).alias("steps"))


# Indicators from such figures.


def average_return(total: Column, n: Column) -> Column:
    return F.try_divide(total, n)


def cumulative_return(final: Column, initial: Column) -> Column:
    return F.try_divide(final, initial) - 1


def annualization_factor(per_year: Column, n: Column) -> Column:
    return F.try_divide(per_year, n)


def annualized_return(cumulative: Column, factor: Column) -> Column:
    return F.when((1 + cumulative > 0) & factor.isNotNull(), F.pow(1 + cumulative, factor) - 1)


def volatility_from_variance(variance: Column) -> Column:
    return root(variance)


def annualized_volatility(vol: Column, per_year: Column) -> Column:
    return F.when(per_year >= 0, vol * F.sqrt(per_year))


def excess_return(a: Column, b: Column) -> Column:
    return a - b


def scale_excess_return_for_sharpe(mean: Column, free: Column, per_year: Column) -> Column:
    return (mean - free) * root(per_year)


def sharpe_ratio(excess: Column, vol: Column) -> Column:
    return F.try_divide(excess, F.nullif(vol, F.lit(0.0)))


def win_rate(r: Column, threshold: float = 0.0) -> Column:
    return _some(r, F.try_divide(F.size(F.filter(r, lambda x: x > threshold)).cast("double"), F.size(r)))


def loss_rate(r: Column, threshold: float = 0.0) -> Column:
    return _some(r, F.try_divide(F.size(F.filter(r, lambda x: x < threshold)).cast("double"), F.size(r)))


def max_drawdown_rate_from_min(low: Column) -> Column:
    return -low


def calmar_ratio(annual: Column, rate: Column) -> Column:
    return F.try_divide(annual, F.nullif(rate, F.lit(0.0)))
