"""Portfolio weights: risk budgets and constrained targets, per strategy and date.

Figures that need only means and covariances are solved from running sums over
dates: a date's moments are a difference of two rows, so the rows that move grow
with the dates.  Tail risks need the returns themselves; their dates are solved
by ranges, each from one copy of its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navspark.operators import solvers
from navspark.sources.shared import once

DAYS = 252
#: Share of the new point, steps and tolerance of the risk-budget iteration.
DAMP, MOST_STEPS, TOLERANCE = 0.7, 5000, 1e-8
#: Ranges of dates whose histories are copied for risks that need the returns themselves.
RANGES = 32


@dataclass(frozen=True)
class Strategy:
    """A strategy's model: ``fixed``, ``risk_budget`` or one of the targets, with bounds by asset and by group."""

    name: str
    kind: str = "fixed"
    weights: dict[str, float] = field(default_factory=dict)
    budgets: dict[str, float] = field(default_factory=dict)
    return_metric: str = "annual"
    risk_metric: str = "vol"
    target: float | None = None
    free: float = 0.0
    days: int | None = None
    confidence: float | None = None
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    groups: tuple[tuple[tuple[str, ...], float, float], ...] = ()
    window_mode: str | None = "all"
    length: int | None = None


def risk_budget(cov: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Weights whose shares of the variance are the budgets, by a damped fixed point from the budgets on.

    Where that ends elsewhere or swings without end, which it may with negative
    covariances, the same point is found by coordinates: each weight in turn
    solves its own equation, which always converges.
    """
    n = len(budgets)
    if n == 1:
        return np.ones(1)
    b = np.maximum(budgets, 0)
    b = b / b.sum() if b.sum() > 0 else np.full(n, 1 / n)
    w = np.maximum(b, 1e-12)
    w = w / w.sum()
    for _ in range(MOST_STEPS):
        load = cov @ w
        aim = np.maximum(b / np.where(np.abs(load) < 1e-12, 1e-12, load), 0)
        if not aim.sum() > 0:
            break
        new = (1 - DAMP) * w + DAMP * aim / aim.sum()
        new /= new.sum()
        moved = np.abs(new - w).sum()
        w = new
        if moved < TOLERANCE:
            break
    own = np.diag(cov)
    share = w * (cov @ w)
    if share.sum() > 0 and np.abs(share / share.sum() - b).max() < 1e-5 or not (own > 1e-18).all():
        return w
    x = np.sqrt(np.maximum(b, 1e-12) / own)
    for _ in range(MOST_STEPS):
        before = x.copy()
        for i in range(n):
            rest = float(cov[i] @ x) - own[i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * own[i] * b[i])) / (2 * own[i])
        if np.abs(x - before).sum() < 1e-10 * np.abs(x).sum():
            break
    return x / x.sum() if x.sum() > 0 else w


def _return(x: np.ndarray, s: Strategy) -> float:
    total = {"mean": x.mean(), "ewm": x.mean(), "cumulative": x.sum()}
    return float(total[s.return_metric] if s.return_metric in total else x.mean() * (s.days or DAYS) if s.return_metric in ("annual", "annual_mean") else 0.0)


def _risk(x: np.ndarray, s: Strategy) -> float:
    if s.risk_metric in ("vol", "annual_vol"):
        return float(x.std(ddof=1) * (np.sqrt(s.days or DAYS) if s.risk_metric == "annual_vol" else 1))
    if s.risk_metric == "downside_vol":
        low = x[x < 0]
        return float(low.std(ddof=1)) if len(low) > 1 else 0.0
    if s.risk_metric in ("var", "es"):
        q = np.quantile(x, 1 - (s.confidence or 95) / 100)
        return float(-q if s.risk_metric == "var" else -x[x <= q].mean())
    if s.risk_metric == "max_drawdown":
        nav = np.concatenate(([1.0], np.cumprod(1 + x)))
        return float(-(nav / np.maximum.accumulate(nav) - 1).min())
    return 0.0


def _goal(returns: np.ndarray, s: Strategy) -> Callable[[np.ndarray], float] | None:
    """The figure to minimise; limits on return or risk are steep penalties."""
    r, k = (lambda w: _return(returns @ w, s)), (lambda w: _risk(returns @ w, s))
    aim = s.target or 0.0
    goals = {
        "min_risk": k,
        "max_return": lambda w: -r(w),
        "max_sharpe": lambda w: -(r(w) - s.free) / max(k(w), 1e-12),
        "max_sharpe_traditional": lambda w: -(float((returns @ w).mean()) * DAYS - s.free) / max(float((returns @ w).std(ddof=1)) * np.sqrt(DAYS), 1e-12),
        "risk_min_given_return": lambda w: k(w) + 1e3 * max(0.0, aim - r(w)),
        "return_max_given_risk": lambda w: -r(w) + 1e3 * max(0.0, k(w) - aim),
    }
    return goals.get(s.kind)


@dataclass(frozen=True)
class Moments:
    """Number of rows, means and sample covariances of returns."""

    rows: int
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(returns: np.ndarray) -> Moments:
        n = len(returns)
        return Moments(n, returns.mean(axis=0) if n else np.zeros(returns.shape[1]), np.atleast_2d(np.cov(returns, rowvar=False, ddof=1)) if n > 1 else np.zeros((returns.shape[1],) * 2))


def by_moments(s: Strategy) -> bool:
    """Whether a strategy is solved from means and covariances alone."""
    return s.kind not in TARGETS or s.kind in ("max_return", "max_sharpe_traditional") or s.risk_metric not in ("downside_vol", "var", "es", "max_drawdown")


TARGETS = ("min_risk", "max_return", "max_sharpe", "max_sharpe_traditional", "risk_min_given_return", "return_max_given_risk")


def _slope(m: Moments, s: Strategy) -> np.ndarray:
    """The return of a portfolio as a linear figure of its weights."""
    times = {"mean": 1.0, "ewm": 1.0, "cumulative": float(m.rows)}
    return m.mean * (times[s.return_metric] if s.return_metric in times else (s.days or DAYS) if s.return_metric in ("annual", "annual_mean") else 0.0)


def _moment_goal(m: Moments, s: Strategy) -> tuple[np.ndarray, Callable[[np.ndarray], float]]:
    """(slope of the return, risk) of a strategy that is solved from moments."""
    traditional = s.kind == "max_sharpe_traditional"
    scale = np.sqrt(DAYS) if traditional else np.sqrt(s.days or DAYS) if s.risk_metric == "annual_vol" else 1.0 if s.risk_metric == "vol" else 0.0
    return m.mean * DAYS if traditional else _slope(m, s), lambda w: float(scale * np.sqrt(max(float(w @ m.cov @ w), 0.0)))


def _region(assets: list[str], s: Strategy) -> solvers.Region:
    low, high = (np.array([s.bounds.get(a, (0.0, 1.0))[i] for a in assets], float) for i in (0, 1))
    return solvers.Region(low, high, tuple((np.array([a in names for a in assets]), float(lo), float(hi)) for names, lo, hi in s.groups))


def solve_moments(m: Moments, assets: list[str], s: Strategy) -> np.ndarray:
    """Weights of one strategy from means and covariances; see ``solve``."""
    n = len(assets)
    equal = np.full(n, 1 / n)
    if s.kind == "fixed":
        w = np.array([float(s.weights.get(a, 0.0)) for a in assets])
        return w / w.sum() if w.sum() > 0 else equal
    if m.rows < 3:
        return equal
    if s.kind == "risk_budget":
        return risk_budget(m.cov, np.array([float(s.budgets.get(a, 0.0)) for a in assets]))
    region = _region(assets, s)
    start = region.nearest(equal) if s.kind in TARGETS else None
    if start is None:
        return equal
    c, risk = _moment_goal(m, s)
    line = solvers.Frontier(region, m.cov, c, start)
    aim = s.target or 0.0
    if s.kind == "min_risk":
        w = line.least()
    elif s.kind == "max_return":
        w = line.greatest()
    elif s.kind == "risk_min_given_return":
        w = line.above(aim)
        w = line.greatest() if w is None else w
    elif s.kind == "return_max_given_risk":
        w = line.below(risk, aim)
        w = line.best(lambda w: 1e3 * risk(w) - float(c @ w)) if w is None else w
    else:
        def ratio(w: np.ndarray) -> float:
            return -(float(c @ w) - s.free) / max(risk(w), 1e-12)

        w = line.best(ratio)
        if ratio(w) >= 0:  # without any excess return, risk makes up for a loss: the best point is a corner
            w = solvers.searched(region, ratio, [w, *_corners(region, c, start)])
    return region.clean(w)


def _corners(region: solvers.Region, c: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Extreme points of the region: towards and away from each asset, the return, and each order of two assets before the others."""
    n = len(c)
    eye = np.eye(n)
    ways = [c / (float(np.abs(c).max()) or 1.0), *eye, *(2 * eye[i] + eye[j] for i in range(n) for j in range(n) if i != j)]
    return [solvers.extreme(region, sign * way, start) for way in ways for sign in (1, -1)]


def solve(returns: np.ndarray, assets: list[str], s: Strategy) -> np.ndarray:
    """Weights of one strategy on one history; fewer than three rows, an unknown kind or bounds that nothing satisfies give equal weights.

    A limit on return is a least return; out of reach, the greatest return is
    taken, or the least risk for a limit on risk.  Volatility and expected
    shortfall are convex and solved as such; value at risk, downside volatility
    and drawdown are not, and are searched from several points of the frontier
    of volatility.
    """
    m = Moments.of(returns)
    if by_moments(s) or m.rows < 3:
        return solve_moments(m, assets, s)
    region = _region(assets, s)
    equal = np.full(len(assets), 1 / len(assets))
    start = region.nearest(equal)
    if start is None:
        return equal
    c, goal, aim = _slope(m, s), _goal(returns, s), s.target or 0.0
    starts = []
    if s.risk_metric == "es":
        k = int((m.rows - 1) * (1 - (s.confidence or 95) / 100)) + 1
        tail = solvers.Shortfall(region, returns, k, c, start)
        ways = {"min_risk": tail.least, "risk_min_given_return": lambda: tail.least(aim=aim), "return_max_given_risk": lambda: tail.below(aim), "max_sharpe": lambda: tail.sharpest(s.free)}
        found = ways[s.kind]()
        if found is not None:
            return region.clean(found)
        starts = [tail.least(), tail.least(slope=1e-3 if s.kind == "return_max_given_risk" else 1.0)]
    line = solvers.Frontier(region, m.cov, c, start)
    starts += [start, line.least(), line.greatest(), *(line.at(t) for t in (0.03, 0.3, 3.0))]
    return region.clean(solvers.searched(region, goal, [w for w in starts if w is not None]))


def _spans(strategies: list[Strategy]) -> list[tuple[str, int]]:
    """(strategy, rows of history) of each; more than any panel has for those that look back to its start."""
    return [(s.name, max(2, int(s.length or 0)) if (s.window_mode or "all").lower() == "rollingn" else 1 << 30) for s in strategies]


def running_moments(panel: DataFrame) -> DataFrame:
    """(k, date, n, firsts, seconds): sums over the dates up to the k-th of the returns of all assets, and of their products.

    ``firsts`` is an array of (asset, sum, centre) by asset, ``seconds`` one of
    (a, b, sum) for a <= b; returns are taken less their mean over the whole
    panel, the centre, which keeps the sums small.  Dates without a return of every asset add
    nothing.  Rows grow with the dates, times the pairs of assets.
    """
    own = Window.partitionBy("asset")
    ret = F.try_divide("nav", F.lag("nav").over(own.orderBy("date"))) - 1
    rows = panel.select("asset", "date", ret.alias("ret")).withColumn("ret", F.when(F.abs("ret") < float("inf"), F.col("ret")))
    rows = rows.withColumn("centre", F.coalesce(F.avg("ret").over(own), F.lit(0.0)))
    day = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", "ret", "centre"))).alias("all"))
    day = day.withColumn("whole", F.forall("all", lambda r: r["ret"].isNotNull()))
    gap = lambda r: F.when(F.col("whole"), r["ret"] - r["centre"]).otherwise(0.0).alias("x")
    day = day.select("date", F.col("whole").cast("double").alias("one"), F.transform("all", lambda r: F.struct(r["asset"].alias("asset"), gap(r), r["centre"].alias("centre"))).alias("g"))
    # Of each date: the date itself, each asset, and each two assets; the parts that a row does not have are null.
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    cell = lambda a, b, x, c: F.struct(a.alias("a"), b.alias("b"), x.alias("x"), c.alias("c"))
    firsts = F.transform("g", lambda r: cell(r["asset"], none, r["x"], r["centre"]))
    seconds = F.flatten(F.transform("g", lambda r, i: F.transform(F.slice("g", i + 1, F.size("g")), lambda q: cell(r["asset"], q["asset"], r["x"] * q["x"], nothing))))
    every = day.select("date", F.explode(F.concat(F.array(cell(none, none, F.col("one"), nothing)), firsts, seconds)).alias("r")).select("date", "r.*")
    series = Window.partitionBy("a", "b").orderBy("date")
    summed = every.select("date", "a", "b", "c", F.sum("x").over(series.rowsBetween(Window.unboundedPreceding, 0)).alias("x"), F.row_number().over(series).alias("k"))
    back = summed.groupBy("k", "date").agg(
        F.max(F.when(F.col("a").isNull(), F.col("x"))).cast("bigint").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("a").isNotNull() & F.col("b").isNull(), F.struct(F.col("a").alias("asset"), "x", F.col("c").alias("centre"))))).alias("firsts"),
        F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b", "x")))).alias("seconds"),
    )
    return back.select("k", "date", "n", "firsts", "seconds")


def moments_between(upto: dict, before: dict | None, centres: np.ndarray) -> Moments:
    """The moments of the dates after ``before`` up to ``upto``, two rows of running sums."""
    n = upto["n"] - (before["n"] if before else 0)
    size = len(centres)
    if n < 1:
        return Moments(0, np.zeros(size), np.zeros((size, size)))
    first = np.array(upto["firsts"]) - (np.array(before["firsts"]) if before else 0.0)
    half = np.array(upto["seconds"]) - (np.array(before["seconds"]) if before else 0.0)
    second = np.zeros((size, size))
    second[np.triu_indices(size)] = half
    second = second + np.triu(second, 1).T
    cov = (second - np.outer(first, first) / n) / (n - 1) if n > 1 else np.zeros((size, size))
    return Moments(int(n), first / n + centres, cov)


def schedule(panel: DataFrame, strategies: list[Strategy], dates: DataFrame) -> DataFrame:
    """(strategy, date, asset, weight) for every strategy and (strategy, date) of ``dates``.

    ``panel`` (asset, date, nav) has a nav for every asset on every date.  Each
    date's history is what ``window_mode`` and ``length`` leave of the rows up
    to it.  Strategies that moments suffice for join two rows of running sums,
    on equality; each (strategy, date) is then solved from its own row.  The
    others are grouped by ranges of dates, and a range's history is copied once.
    """
    spark = panel.sparkSession
    names = {s.name for s in strategies if by_moments(s)}
    parts = []
    plain = [s for s in strategies if s.name in names]
    rest = [s for s in strategies if s.name not in names]
    if plain:
        parts.append(_by_sums(panel, plain, dates.join(F.broadcast(spark.createDataFrame(_spans(plain), "strategy string, span int")), "strategy")))
    if rest:
        parts.append(_by_ranges(panel, rest, dates.join(F.broadcast(spark.createDataFrame(_spans(rest), "strategy string, span int")), "strategy")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


FOUND = "strategy string, date date, asset string, weight double"


def _by_sums(panel: DataFrame, strategies: list[Strategy], wanted: DataFrame) -> DataFrame:
    models = {s.name: s for s in strategies}
    sums = running_moments(panel)
    sums = once(sums) if any(span < 1 << 30 for _, span in _spans(strategies)) else sums  # read twice then
    row = F.struct("n", F.transform("firsts", lambda r: r["x"]).alias("firsts"), F.transform("seconds", lambda r: r["x"]).alias("seconds"))
    ends = sums.select("date", "k", F.transform("firsts", lambda r: r["asset"]).alias("assets"), F.transform("firsts", lambda r: r["centre"]).alias("centres"), row.alias("upto"))
    # The first nav of a window has no return of its own, so what comes up to it is taken off.
    found = wanted.join(ends, "date").withColumn("start", F.col("k") - F.col("span") + 1)
    found = found.join(sums.select(F.col("k").alias("start"), row.alias("before")), "start", "left").select("strategy", "date", "assets", "upto", "before", "centres")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m = moments_between(r.upto, r.before, np.asarray(r.centres, float))
                out.append(pd.DataFrame({"strategy": r.strategy, "date": r.date, "asset": list(r.assets), "weight": solve_moments(m, list(r.assets), models[r.strategy])}))
            if out:
                yield pd.concat(out)

    return found.repartition("strategy", "date").mapInPandas(solved, FOUND)


def _by_ranges(panel: DataFrame, strategies: list[Strategy], wanted: DataFrame) -> DataFrame:
    models = {s.name: s for s in strategies}
    # One row per date of the panel; dates are few, and numbered as a whole.
    numbered = panel.select("date").distinct().withColumn("k", F.expr("row_number() over (order by date)"))
    part = F.expr(f"ntile({RANGES}) over (order by date)")
    at = wanted.select("date").distinct().withColumn("part", part)
    asked = wanted.join(at, "date").join(numbered, "date").select("part", "strategy", F.col("date").alias("at"), F.col("k").alias("upto"), "span")
    # A range needs the rows from its first window's start to its last date, once for all its strategies.
    reach = asked.groupBy("part").agg(F.min(F.greatest(F.lit(1), F.col("upto") - F.col("span") + 1)).alias("low"), F.max("upto").alias("high"))
    copies = reach.select(F.col("part").alias("piece"), F.explode(F.sequence("low", "high")).alias("k")).join(panel.join(numbered, "date"), "k")

    def one(key: tuple, questions: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nav = rows.pivot(index="k", columns="asset", values="nav").sort_index().sort_index(axis=1)
        returns, k, assets = nav.pct_change().to_numpy(float), nav.index.to_numpy(), list(nav.columns)
        good = np.isfinite(returns).all(axis=1)
        out = []
        for q in questions.itertuples(index=False):
            mine = (k > max(1, q.upto - q.span + 1)) & (k <= q.upto) & good
            out.append(pd.DataFrame({"strategy": q.strategy, "date": q.at, "asset": assets, "weight": solve(returns[mine], assets, models[q.strategy])}))
        return pd.concat(out) if out else pd.DataFrame({"strategy": [], "date": [], "asset": [], "weight": []})

    return asked.groupBy("part").cogroup(copies.groupBy("piece")).applyInPandas(one, FOUND)


def point_weights(panel: DataFrame, strategy: Strategy, leverage: float = 1.0) -> DataFrame:
    """(strategy, date, asset, percent): one strategy's weights on the panel's last date, times ``leverage``, in percent with two decimals.

    A risk budget needs three returns; on a shorter panel its weights are in
    proportion to the budgets, or equal if there are none.
    """
    days = panel.agg(F.max("date").alias("date"), F.countDistinct("date").alias("days"))
    found = schedule(panel, [strategy], days.where("date is not null").select(F.lit(strategy.name).alias("strategy"), "date"))
    weight = F.col("weight")
    total = sum(max(0.0, b) for b in strategy.budgets.values())
    if strategy.kind == "risk_budget" and total > 0:
        known = F.create_map(*(F.lit(x) for a, b in strategy.budgets.items() for x in (a, max(0.0, b) / total)))
        weight = F.when(F.col("days") < 4, F.coalesce(F.try_element_at(known, F.col("asset")), F.lit(0.0))).otherwise(weight)
    return found.crossJoin(F.broadcast(days.select("days"))).select("strategy", "date", "asset", F.round(weight * leverage * 100, 2).alias("percent"))


def equal_percents(products: DataFrame, group: str, order: str) -> DataFrame:
    """Equal percents of each group that add up to 100: cents left over go to the first products."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    cents = F.floor(F.lit(10000) / F.count("*").over(w))
    extra = F.row_number().over(w.orderBy(order)) <= 10000 - cents * F.count("*").over(w)
    return products.withColumn("percent", (cents + F.when(extra, 1).otherwise(0)) / 100)


def equal_percents_first(products: DataFrame, group: str, order: str) -> DataFrame:
    """Equal percents of each group, cut to cents, that add up to 100: the first product takes all that is left over."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(group))
    cents = F.floor(F.lit(10000) / n)
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    return products.withColumn("percent", (cents + F.when(first, 10000 - cents * n).otherwise(0)) / 100)


def leading_share(returns: DataFrame) -> DataFrame:
    """(share): the part of the variance on the first principal component, of a long panel (asset, date, ret).

    The covariance of every two assets is an aggregate; only the matrix of
    assets by assets is decomposed, in one group.
    """
    from navspark.operators.stats import pairs

    cov = pairs(returns).groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="a", columns="b", values="cov").fillna(0.0).to_numpy(float)
        values = np.clip(np.linalg.eigvalsh((m + m.T) / 2), 0, None)
        return pd.DataFrame({"share": [float(values[-1] / values.sum()) if values.sum() > 0 else 0.0]})

    return cov.groupBy(F.lit("all").alias("k")).applyInPandas(one, "share double")
