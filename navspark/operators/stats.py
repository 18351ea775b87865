"""Statistics of return series, as aggregate expressions with guards for degenerate input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.operators.panel import by_date, drawdown, so_far

DAYS = 252


def correlation(a: str, b: str) -> Column:
    """Pearson correlation in [-1, 1]; a constant series gives 0."""
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def pairs(series: DataFrame, value: str = "ret", upper: bool = False) -> DataFrame:
    """(date, a, b, x, y) of every two assets on their common dates; with ``upper`` those with a < b only.

    A date's rows meet once, as one array as long as the assets are many, and
    every two of it are made within that row: there is no self join, and an
    aggregate by assets combines them before anything else moves.
    """
    day = series.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", F.col(value).alias("x")))).alias("all"))
    two = lambda p, q: F.struct(p["asset"].alias("a"), q["asset"].alias("b"), p["x"].alias("x"), q["x"].alias("y"))
    if upper:
        every = F.transform("all", lambda p, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda q: two(p, q)))
    else:
        every = F.transform("all", lambda p: F.transform("all", lambda q: two(p, q)))
    return day.select("date", F.explode(F.flatten(every)).alias("p")).select("date", "p.*")


def matrix(series: DataFrame, value: str = "ret") -> DataFrame:
    """Correlation and sample covariance of every two assets."""
    return pairs(series, value).groupBy("a", "b").agg(correlation("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"))


def mean_correlation(series: DataFrame) -> DataFrame:
    found = pairs(series, upper=True).where("a < b").groupBy("a", "b").agg(correlation("x", "y").alias("c"))
    return found.agg(F.avg("c").alias("mean_corr"))


def tracking_error(series: DataFrame, days: int = DAYS) -> DataFrame:
    """Each asset's annualised deviation from the equally weighted mean."""
    mean = series.groupBy("date").agg(F.avg("ret").alias("mean"))
    gaps = series.join(mean, "date").withColumn("gap", F.col("ret") - F.col("mean"))
    return gaps.groupBy("asset").agg((F.stddev_samp("gap") * F.sqrt(F.lit(days))).alias("te"))


def tail(series: DataFrame, share: float = 0.01, value: str = "ret") -> DataFrame:
    """(asset, q, es): a quantile and the mean of the returns at or below it, signs as they are."""
    return series.withColumn("q", _quantile(value, share)).groupBy("asset").agg(F.first("q").alias("q"), _beyond(value))


def _quantile(value: str, share: float) -> Column:
    """The quantile of the row's asset; a window, so that the series is read once."""
    return F.percentile(value, F.lit(share)).over(Window.partitionBy("asset"))


def _beyond(value: str) -> Column:
    return F.avg(F.when(F.col(value) <= F.col("q"), F.col(value))).alias("es")


def performance(nav: DataFrame, days: int = DAYS) -> DataFrame:
    """Annual return and volatility, Sharpe, VaR99, ES99, maximum drawdown and Calmar of each asset's nav."""
    rows = nav.withColumns({"ret": F.try_divide("nav", F.lag("nav").over(by_date())) - 1, "dd": drawdown(F.col("nav"))})
    rows = rows.withColumn("q", _quantile("ret", 0.01))
    out = rows.groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.min("dd").alias("mdd"), F.count("ret").alias("n"), F.first("q").alias("q"), _beyond("ret"))
    annual, vol = F.col("m") * days, F.col("s") * F.sqrt(F.lit(days))
    figures = {
        "annual_return": annual, "annual_vol": vol, "sharpe": F.try_divide(annual, vol), "var99": -F.col("q"), "es99": -F.col("es"), "max_drawdown": F.col("mdd"),
        "calmar": F.try_divide(annual, F.abs("mdd")),
    }
    return out.select("asset", *(F.when(F.col("n") > 0, x).alias(k) for k, x in figures.items()))


def moments(value: str) -> dict[str, Column]:
    """Mean, median and population moments, with the small term that keeps a constant series finite."""
    mean, s = F.avg(value), F.stddev_pop(value)
    e = lambda k: F.avg(F.pow(F.col(value), F.lit(float(k))))
    m3 = e(3) - 3 * mean * e(2) + 2 * F.pow(mean, F.lit(3.0))
    m4 = e(4) - 4 * mean * e(3) + 6 * mean * mean * e(2) - 3 * F.pow(mean, F.lit(4.0))
    return {"mean": mean, "median": F.median(value), "std": s, "skew": m3 / (F.pow(s, F.lit(3.0)) + 1e-12), "kurt": m4 / (F.pow(s, F.lit(4.0)) + 1e-12) - 3}


def return_statistics(series: DataFrame, value: str = "ret") -> DataFrame:
    """Distribution figures of each asset's returns, with bias-corrected skewness and kurtosis over the population deviation, and the Jarque-Bera test."""
    centre = series.where(F.col(value).isNotNull()).groupBy("asset").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    rows = series.where(F.col(value).isNotNull()).join(centre, "asset").withColumn("z", z)
    agg = rows.groupBy("asset").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.median(value).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("positive"),
        F.max(value).alias("best"), F.min(value).alias("worst"), F.count("*").alias("n"), F.sum(F.pow("z", F.lit(3.0))).alias("z3"), F.sum(F.pow("z", F.lit(4.0))).alias("z4"),
    )
    n = F.col("n").cast("double")
    skew = F.when((n > 2) & (F.col("std") > 0), F.try_divide(n, (n - 1) * (n - 2)) * F.col("z3"))
    kurt = F.when((n > 3) & (F.col("std") > 0), F.try_divide(n * (n + 1), (n - 1) * (n - 2) * (n - 3)) * F.col("z4") - F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3)))
    out = agg.withColumns({"skew": skew, "kurt": kurt}).withColumn("jb", n / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4))
    p = F.exp(-F.col("jb") / 2)
    verdict = F.when(F.col("jb").isNull() | (p == 0), "insufficient").when(p < 0.05, "rejected").otherwise("normal")
    return out.withColumns({"p": p, "verdict": verdict}).drop("z3", "z4")


def histogram(series: DataFrame, width: float, value: str = "ret") -> DataFrame:
    """(asset, bin, low, high, n): bins on multiples of the width, the last one closed, empty ones kept."""
    width = max(width, 0.01)
    rows = series.where(F.col(value).isNotNull())
    ends = rows.groupBy("asset").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    first = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.floor(F.col("lo") / width) * width)
    last = F.when(F.col("lo") == F.col("hi"), F.col("lo") + width).otherwise(F.ceil(F.col("hi") / width) * width)
    ends = ends.withColumns({"first": first, "last": last})
    ends = ends.withColumn("bins", F.greatest(F.lit(1), F.round((F.col("last") - F.col("first")) / width).cast("int")))
    at = F.least(F.greatest(F.floor((F.col(value) - F.col("first")) / width).cast("int"), F.lit(0)), F.col("bins") - 1)
    counted = rows.join(ends, "asset").groupBy("asset", at.alias("bin")).agg(F.count("*").alias("n"))
    empty = ends.select("asset", "first", "last", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    high = F.when(F.col("bin") == F.col("bins") - 1, F.col("last")).otherwise(F.col("first") + (F.col("bin") + 1) * width)
    return empty.join(counted, ["asset", "bin"], "left").select("asset", "bin", (F.col("first") + F.col("bin") * width).alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def normal_curve(bins: DataFrame, stats: DataFrame, width: float) -> DataFrame:
    """Expected counts of a normal distribution of the same mean and deviation, at the bins' centres."""
    joined = bins.join(stats.where("std > 0").select("asset", "mean", "std", F.col("n").alias("size")), "asset")
    x = (F.col("low") + F.col("high")) / 2 - F.col("mean")
    pdf = F.exp(-(x * x) / (2 * F.col("std") * F.col("std"))) / F.sqrt(2 * F.pi() * F.col("std") * F.col("std"))
    return joined.withColumn("expected", pdf * F.col("size") * max(width, 0.01)).drop("mean", "std", "size")


def box_plot(series: DataFrame, value: str = "ret") -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the number of outliers; from five values on."""
    rows = series.where(F.col(value).isNotNull())
    q = rows.groupBy("asset").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n")).where("n >= 5")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    rows = rows.join(q, "asset").withColumn("inside", (F.col(value) >= F.col("q")[0] - reach) & (F.col(value) <= F.col("q")[2] + reach))
    return rows.groupBy("asset").agg(
        F.min(F.when(F.col("inside"), F.col(value))).alias("low"), F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"),
        F.max(F.when(F.col("inside"), F.col(value))).alias("high"), F.sum((~F.col("inside")).cast("bigint")).alias("outliers"),
    )


def outliers(series: DataFrame, value: str = "ret") -> DataFrame:
    """(asset, date, value) of the rows beyond a box plot's whiskers; none for assets of fewer than five values."""
    rows = series.where(F.col(value).isNotNull())
    q = rows.groupBy("asset").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n")).where("n >= 5")
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    beyond = (F.col(value) < F.col("q")[0] - reach) | (F.col(value) > F.col("q")[1] + reach)
    return rows.join(q, "asset").where(beyond).select("asset", "date", F.col(value).alias("value"))


def statistics_range(series: DataFrame, value: str = "ret") -> DataFrame:
    """(asset, first, last, n): the dates between which an asset's values lie, and how many there are."""
    return series.where(F.col(value).isNotNull()).groupBy("asset").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def quadrant(points: DataFrame, x: str, y: str, pad: float = 0.1) -> DataFrame:
    """(mean_x, mean_y, low_x, high_x, low_y, high_y) of points: the lines between the quadrants, and the bounds with some room."""
    ends = {"x": x, "y": y}
    out = points.agg(*(f(c).alias(f"{name}_{k}") for k, c in ends.items() for name, f in (("mean", F.avg), ("low", F.min), ("high", F.max))))
    room = lambda k: pad * (F.col(f"high_{k}") - F.col(f"low_{k}"))
    return out.select("mean_x", "mean_y", *((F.col(f"low_{k}") - room(k)).alias(f"low_{k}") for k in ends), *((F.col(f"high_{k}") + room(k)).alias(f"high_{k}") for k in ends))


def axis_range(series: DataFrame, markers: DataFrame | None = None, start: str | None = None, end: str | None = None, value: str = "value", pad: float = 0.05) -> DataFrame:
    """(low, high) of an axis that shows all values of ``series`` (date, value), and of markers on its dates, from ``start`` to ``end``.

    Both ends get a twentieth of the range as room; equal ends a twentieth of
    their value, or 1 about zero.  No row if there is no finite value.
    """
    rows = series.select("date", F.col(value).alias("v"))
    if markers is not None:
        rows = rows.unionByName(markers.join(series.select("date").distinct(), "date", "left_semi").select("date", F.col(value).alias("v")))
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    ends = rows.where(finite).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    equal = F.when(F.col("lo") == 0, 1.0).otherwise(F.abs("lo") * pad)
    room = F.when(F.col("lo") == F.col("hi"), equal).otherwise((F.col("hi") - F.col("lo")) * pad)
    return ends.select((F.col("lo") - room).alias("low"), (F.col("hi") + room).alias("high"))


def annual(panel: DataFrame, days: int = DAYS) -> DataFrame:
    """Figures of each asset and calendar year, from the year's own rows alone; years without rows between others are kept."""
    year = Window.partitionBy("asset", "year").orderBy("date")
    rows = panel.where("nav is not null").withColumn("year", F.year("date"))
    rows = rows.withColumns({"ret": F.try_divide("nav", F.lag("nav").over(year)) - 1, "dd": F.try_divide("nav", F.max("nav").over(year.rowsBetween(Window.unboundedPreceding, 0))) - 1})
    agg = rows.groupBy("asset", "year").agg(
        F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"), F.count("*").alias("n"), F.count("ret").alias("k"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("volatility"), F.min("dd").alias("max_drawdown"),
    )
    ratio = F.try_divide("last", "first")
    vol = F.col("volatility") * F.sqrt(F.lit(days))
    grown = F.when(F.col("n") == 1, 0.0).otherwise(F.pow(F.when(ratio > 0, ratio), days / F.greatest(F.col("k"), F.lit(1))) - 1)
    out = agg.select(
        "asset", "year", F.when(F.col("n") == 1, 0.0).otherwise(ratio - 1).alias("cumulative"), "volatility", grown.alias("annual_return"), vol.alias("annual_vol"),
        F.when(vol > 1e-12, F.col("m") * days / vol).alias("sharpe"), "max_drawdown", F.when(F.abs("max_drawdown") > 1e-12, grown / F.abs("max_drawdown")).alias("calmar"),
    )
    span = panel.where("nav is not null").agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return panel.select("asset").distinct().crossJoin(span).join(out, ["asset", "year"], "left")


#: Labels and scales of the annual table.
ANNUAL_LABELS = (("cumulative", "累计收益率(%)", 100), ("volatility", "波动率(%)", 100), ("annual_return", "年化收益率(%)", 100), ("annual_vol", "年化波动率(%)", 100), ("sharpe", "夏普比率", 1), ("max_drawdown", "最大回撤(%)", 100), ("calmar", "卡玛比率", 1))


def annual_rows(figures: DataFrame) -> DataFrame:
    """(asset, label, value) rows of the annual table."""
    items = F.array(*(F.struct(F.concat(F.col("year").cast("string"), F.lit(label)).alias("label"), (F.col(name) * scale).alias("value")) for name, label, scale in ANNUAL_LABELS))
    return figures.select("asset", F.explode(items).alias("i")).select("asset", "i.label", "i.value")


def derived(panel: DataFrame, fees: DataFrame, start: str | None = None, end: str | None = None, days: int = DAYS) -> DataFrame:
    """Product figures in percent, annualised by calendar days of 365 a year, against total fees (asset, m_fee, c_fee)."""
    rows = panel.where("nav is not null")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    before = F.lag("nav").over(by_date())
    rows = rows.withColumns({"ret": F.when((F.col("nav") > 0) & (before > 0), F.col("nav") / before - 1), "dd": drawdown(F.col("nav"))})
    agg = rows.groupBy("asset").agg(
        F.min_by("nav", F.when(F.col("nav") > 0, F.col("date"))).alias("base"), F.max_by("nav", "date").alias("last"), F.datediff(F.max("date"), F.min("date")).alias("span"),
        F.stddev_samp("ret").alias("s"), F.min("dd").alias("mdd"), F.count("*").alias("n"),
    ).join(fees, "asset", "left")
    total = F.when(F.col("base").isNotNull(), F.try_divide("last", "base") - 1) * 100
    yearly = F.when(F.col("span") > 0, (F.pow(1 + total / 100, 365 / F.col("span")) - 1) * 100)
    vol, mdd = F.col("s") * F.sqrt(F.lit(days)) * 100, F.when(F.col("n") > 1, F.col("mdd") * 100)
    fee = F.when(F.col("m_fee").isNotNull() | F.col("c_fee").isNotNull(), F.coalesce("m_fee", F.lit(0.0)) + F.coalesce("c_fee", F.lit(0.0)))
    return agg.select(
        "asset", total.alias("cumulative"), yearly.alias("annualised"), vol.alias("volatility"), mdd.alias("max_drawdown"), fee.alias("total_fee"),
        F.try_divide(total, fee).alias("return_to_fee"), F.try_divide(yearly, vol).alias("sharpe"), F.try_divide(yearly, F.abs(mdd)).alias("calmar"),
    )


def recovery(nav: DataFrame) -> DataFrame:
    """(asset, max_drawdown, recovery): the deepest fall as a positive rate and the steps from its peak to the first nav as high again.

    Never recovered is null; a path that never falls has 0 and 0.  Of equal
    peaks the first counts: only a higher nav is a new peak.
    """
    rows = nav.withColumns({"i": F.row_number().over(by_date()), "peak": F.max("nav").over(so_far())})
    rows = rows.withColumn("dd", F.when(F.col("peak") > 0, 1 - F.col("nav") / F.col("peak")))
    before = F.max("nav").over(by_date().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", before.isNull() | (F.col("nav") > before)).withColumn("peak_i", F.max(F.when(F.col("new") & F.col("nav").isNotNull(), F.col("i"))).over(so_far()))
    worst = rows.groupBy("asset").agg(F.max(F.struct("dd", (-F.col("i")).alias("i"), "peak", "peak_i")).alias("w")).select("asset", F.col("w.dd").alias("max_drawdown"), (-F.col("w.i")).alias("low_i"), F.col("w.peak").alias("peak"), F.col("w.peak_i").alias("peak_i"))
    back = rows.select("asset", "i", "nav").join(worst, "asset").groupBy("asset").agg(F.first("max_drawdown").alias("max_drawdown"), F.min(F.when((F.col("i") > F.col("low_i")) & (F.col("nav") >= F.col("peak")), F.col("i") - F.col("peak_i"))).alias("steps"))
    return back.select("asset", "max_drawdown", F.when(F.col("max_drawdown") == 0, 0).otherwise(F.col("steps")).cast("bigint").alias("recovery"))


#: Metrics of return and risk that the portfolio operators choose from.
def return_metric(metric: str, value: str = "ret", days: int | None = None) -> Column:
    """mean, cumulative (a sum), annual or annual_mean, ewm (a mean); an unknown metric is 0."""
    by = {"mean": F.avg(value), "cumulative": F.sum(value), "annual": F.avg(value) * (days or DAYS), "annual_mean": F.avg(value) * (days or DAYS), "ewm": F.avg(value)}
    return by.get(metric, F.lit(0.0))


def risk_metrics(series: DataFrame, days: int = DAYS, decay: float = 0.94, window: int = 60, confidence: float = 95, value: str = "ret") -> DataFrame:
    """Every risk metric of each asset: vol, annual_vol, ewm_vol, downside_vol, var, es, max_drawdown."""
    rows = series.where(F.col(value).isNotNull()).select("asset", "date", F.col(value).alias("r"))
    alpha = max(min(1 - decay, 0.9999), 1e-6)
    back = Window.partitionBy("asset").orderBy(F.desc("date"))
    last = rows.withColumn("k", F.row_number().over(back))
    if window > 0:
        last = last.where(F.col("k") <= max(2, window))
    last = last.withColumn("n", F.count("*").over(Window.partitionBy("asset")))
    weight = F.when(F.col("k") == F.col("n"), F.pow(F.lit(1 - alpha), (F.col("n") - 1).cast("double"))).otherwise(alpha * F.pow(F.lit(1 - alpha), (F.col("k") - 1).cast("double")))
    sums = last.withColumn("w", weight).groupBy("asset").agg(F.sum(F.col("w") * F.col("r")).alias("m1"), F.sum(F.col("w") * F.col("r") * F.col("r")).alias("m2"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    ewm = sums.select("asset", (F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("m2") - F.col("m1") * F.col("m1"), 1 - F.col("ww")))) * F.sqrt(F.lit(days))).alias("ewm_vol"))
    path = rows.withColumn("v", F.product(1 + F.col("r")).over(so_far())).withColumn("dd", drawdown(F.col("v"), 1.0))
    base = path.groupBy("asset").agg(F.stddev_samp("r").alias("vol"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.min("dd").alias("dd"))
    q = tail(rows, 1 - confidence / 100, "r")
    return base.join(ewm, "asset").join(q, "asset").select(
        "asset", "vol", (F.col("vol") * F.sqrt(F.lit(days))).alias("annual_vol"), "ewm_vol", F.coalesce("down", F.lit(0.0)).alias("downside_vol"), (-F.col("q")).alias("var"), (-F.col("es")).alias("es"),
        F.greatest(-F.col("dd"), F.lit(0.0)).alias("max_drawdown"),
    )
