"""Small convex problems over portfolio weights, for use inside tasks.

A region is a box of weights with sum 1 and limits on sums of groups.  Quadratic
problems are solved by a dual active-set method, linear ones by proximal steps
of it, expected shortfall by cutting planes; limits on return are rows of the
region, limits on risk are met by bisection along the efficient frontier.  All
points satisfy the region to about 1e-10.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Violation that counts as none.
SLACK = 1e-11


def quadratic(q: np.ndarray, p: np.ndarray, rows: np.ndarray, least: np.ndarray, n_equal: int) -> np.ndarray | None:
    """The x that minimises x'qx/2 + p'x with rows x >= least, the first ``n_equal`` with equality; None if there is none.

    ``q`` is positive definite.  Starting from the unbounded minimum, the most
    violated row joins the active ones, and rows whose multipliers would turn
    negative leave.
    """
    inverse = np.linalg.inv(q)
    x = -inverse @ p
    rows, least = rows.copy(), least.copy()
    active: list[int] = []
    load: list[float] = []
    for _ in range(50 * (len(rows) + len(p))):
        gap = rows @ x - least
        gap[active] = 0.0
        behind = [i for i in range(n_equal) if i not in active]
        if behind:
            new = behind[0]
            if gap[new] > 0:  # an equality is met from either side
                rows[new], least[new], gap[new] = -rows[new], -least[new], -gap[new]
        else:
            new = int(np.argmin(gap))
            if gap[new] >= -SLACK:
                return x
        pull = 0.0
        while True:
            normal = rows[new]
            if active:
                a = rows[active]
                back = a @ inverse
                r = np.linalg.lstsq(back @ a.T, back @ normal, rcond=None)[0]
                z = inverse @ (normal - a.T @ r)
            else:
                r, z = np.zeros(0), inverse @ normal
            speed = float(normal @ z)
            full = (least[new] - float(normal @ x)) / speed if speed > 1e-13 * float(normal @ inverse @ normal) else np.inf
            leaving, part = -1, np.inf
            for k, i in enumerate(active):
                if i >= n_equal and r[k] > 1e-13 and load[k] / r[k] < part:
                    leaving, part = k, load[k] / r[k]
            step = min(full, part)
            if step == np.inf:
                if new < n_equal and abs(float(normal @ x) - least[new]) < 1e-9:
                    break  # follows from the other rows
                return None
            load = [u - step * v for u, v in zip(load, r)]
            pull += step
            if full < np.inf:
                x = x + step * z
            if step == full:
                active.append(new)
                load.append(pull)
                break
            del active[leaving], load[leaving]
    return x


@dataclass(frozen=True)
class Region:
    """Weights with sum 1 between ``low`` and ``high``; each group (mask, least, most) limits a sum of weights."""

    low: np.ndarray
    high: np.ndarray
    groups: tuple[tuple[np.ndarray, float, float], ...] = ()

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, least) with the sum of weights first."""
        n = len(self.low)
        eye = np.eye(n)
        masks = [g.astype(float) for g, _, _ in self.groups]
        rows = np.vstack([np.ones((1, n)), eye, -eye, *(m[None] for m in masks), *(-m[None] for m in masks)])
        return rows, np.concatenate([[1.0], self.low, -self.high, [lo for _, lo, _ in self.groups], [-hi for _, _, hi in self.groups]])

    def contains(self, w: np.ndarray, slack: float = 1e-9) -> bool:
        rows, least = self.rows()
        return bool((rows @ w - least >= -slack).all() and abs(w.sum() - 1) <= slack)

    def nearest(self, w: np.ndarray) -> np.ndarray | None:
        """The point of the region nearest to ``w``; None if the region is empty."""
        return quadratic(np.eye(len(w)), -w, *self.rows(), 1)

    def clean(self, w: np.ndarray) -> np.ndarray:
        """``w`` without the last bits by which it leaves the box."""
        return np.clip(w, self.low, self.high)


def linear(c: np.ndarray, rows: np.ndarray, least: np.ndarray, start: np.ndarray) -> np.ndarray | None:
    """The x that minimises c'x with rows x >= least, the first with equality, by proximal steps; the least moved from ``start`` of equal ones."""
    size = float(np.abs(c).max())
    if size == 0:
        return quadratic(np.eye(len(c)), -start, rows, least, 1)
    x, weight = start, 0.05
    for _ in range(200):
        new = quadratic(weight * np.eye(len(c)), c / size - weight * x, rows, least, 1)
        if new is None:
            return None
        if np.abs(new - x).max() < 1e-11:
            return new
        x = new
    return x


def extreme(region: Region, c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A point of the region of the greatest c'w."""
    found = linear(-c, *region.rows(), start)
    return start if found is None else found


class Frontier:
    """Points of the region of least w'vw/2 - t c'w: from the least variance (t = 0) to the greatest return."""

    def __init__(self, region: Region, v: np.ndarray, c: np.ndarray, start: np.ndarray):
        scale = float(np.trace(v)) / len(c)
        self.region, self.c, self.start = region, c, start
        self.v = v / scale + 1e-11 * np.eye(len(c)) if scale > 0 else np.eye(len(c)) * 1e-6
        self.size = float(np.abs(c - c.mean()).max()) or 1.0
        self.bounds = region.rows()

    def at(self, t: float) -> np.ndarray:
        found = quadratic(self.v, -t * self.c / self.size, *self.bounds, 1)
        return self.start if found is None else found

    def least(self) -> np.ndarray:
        return self.at(0.0)

    def greatest(self) -> np.ndarray:
        return extreme(self.region, self.c, self.start)

    def above(self, aim: float) -> np.ndarray | None:
        """Least variance with a return of ``aim`` at least; None if that is out of reach."""
        rows, least = self.bounds
        size = self.size
        return quadratic(self.v, np.zeros(len(self.c)), np.vstack([rows, self.c[None] / size]), np.append(least, aim / size), 1)

    def exactly(self, aim: float, slack: float = 1e-10) -> np.ndarray | None:
        """Least variance with a return of ``aim``, to ``slack`` of the returns' spread; None if that is out of reach."""
        rows, least = self.bounds
        c = self.c / self.size
        both = np.append(least, [aim / self.size - slack, -aim / self.size - slack])
        return quadratic(self.v, np.zeros(len(c)), np.vstack([rows, c[None], -c[None]]), both, 1)

    def best(self, goal: Callable[[np.ndarray], float]) -> np.ndarray:
        """The point of the least ``goal``, which falls and then rises along the frontier."""
        points = [self.least(), *(self.at(t) for t in np.geomspace(1e-4, 1e4, 33)), self.greatest()]
        place = [0.0, *np.geomspace(1e-4, 1e4, 33), 1e5]
        cost = [goal(w) for w in points]
        low = min(cost)
        k = next(i for i, x in enumerate(cost) if x <= low + 1e-12 * (1 + abs(low)))  # the last point of a fall, before a level piece
        a, b = place[max(k - 1, 0)], place[min(k + 1, len(place) - 1)]
        found, least = points[k], cost[k]
        share = (np.sqrt(5) - 1) / 2
        x, y = b - share * (b - a), a + share * (b - a)
        wx, wy = self.at(x), self.at(y)
        fx, fy = goal(wx), goal(wy)
        for _ in range(70):
            if fx < least:
                found, least = wx, fx
            if fy < least:
                found, least = wy, fy
            if b - a < 1e-12 * (1 + b):
                break
            if fx <= fy + 1e-12 * (1 + abs(fy)):  # on the level piece the least lies to the left
                b, y, wy, fy = y, x, wx, fx
                x = b - share * (b - a)
                wx = self.at(x)
                fx = goal(wx)
            else:
                a, x, wx, fx = x, y, wy, fy
                y = a + share * (b - a)
                wy = self.at(y)
                fy = goal(wy)
        return found

    def below(self, risk: Callable[[np.ndarray], float], aim: float) -> np.ndarray | None:
        """Greatest return with a ``risk`` of at most ``aim``, by bisection on t; None if that is out of reach."""
        inside = self.least()
        if risk(inside) > aim:
            return None
        top = self.greatest()
        if risk(top) <= aim:
            return top
        a, b = 0.0, 1e-3
        while b < 1e8 and risk(self.at(b)) <= aim:
            a, b = b, 4 * b
        for _ in range(80):
            m = (a + b) / 2
            w = self.at(m)
            if risk(w) <= aim:
                a, inside = m, w
            else:
                b, top = m, w
        # Where the frontier has a straight piece of one t, the limit lies within it.
        x, y = 0.0, 1.0
        for _ in range(60):
            m = (x + y) / 2
            x, y = (m, y) if risk((1 - m) * inside + m * top) <= aim else (x, m)
        return (1 - x) * inside + x * top


class Shortfall:
    """Expected shortfall of the worst ``k`` of the rows ``x``: convex, the greatest of linear pieces, which are added where they bind."""

    def __init__(self, region: Region, x: np.ndarray, k: int, c: np.ndarray, start: np.ndarray):
        self.region, self.x, self.k, self.c, self.start = region, x, k, c, start

    def piece(self, w: np.ndarray) -> np.ndarray:
        """The linear piece that gives the risk at ``w``."""
        worst = np.argsort(self.x @ w, kind="stable")[: self.k]
        return -self.x[worst].mean(axis=0)

    def risk(self, w: np.ndarray) -> float:
        return float(self.piece(w) @ w)

    def least(self, slope: float = 0.0, aim: float | None = None) -> np.ndarray | None:
        """Least risk less ``slope`` times the return, with a return of ``aim`` at least; None if that is out of reach."""
        rows, least = self.region.rows()
        n = len(self.start)
        rows = np.hstack([rows, np.zeros((len(rows), 1))])
        if aim is not None:
            size = float(np.abs(self.c).max()) or 1.0
            rows, least = np.vstack([rows, np.append(self.c / size, 0.0)]), np.append(least, aim / size)
        w = self.start
        scale = float(np.abs(self.x).max()) or 1.0
        for _ in range(60):
            piece = self.piece(w) / scale  # the last variable is the risk in units of ``scale``
            rows, least = np.vstack([rows, np.append(-piece, 1.0)]), np.append(least, 0.0)
            found = linear(np.append(-slope * self.c / scale, 1.0), rows, least, np.append(w, float(piece @ w)))
            if found is None:
                return None
            w = found[:n]
            if self.risk(w) / scale <= found[n] + 1e-10:
                break
        return w

    def below(self, aim: float) -> np.ndarray | None:
        """Greatest return with a risk of at most ``aim``; None if that is out of reach."""
        rows, least = self.region.rows()
        scale = float(np.abs(self.x).max()) or 1.0
        inside = self.least()
        if inside is None or self.risk(inside) > aim + 1e-12:
            return None
        w = extreme(self.region, self.c, self.start)
        for _ in range(60):
            if self.risk(w) <= aim + 1e-11:
                return w
            rows, least = np.vstack([rows, -self.piece(w)[None] / scale]), np.append(least, -aim / scale)
            found = linear(-self.c, rows, least, inside)
            if found is None:
                return inside
            w = found
        return w

    def sharpest(self, free: float) -> np.ndarray | None:
        """Greatest excess return for the risk, by raising the ratio until no point beats it; None if no point has an excess and a risk above zero."""
        w = extreme(self.region, self.c, self.start)
        if float(self.c @ w) - free <= 0 or self.risk(w) <= 1e-12:
            return None
        for _ in range(40):
            ratio = (float(self.c @ w) - free) / self.risk(w)
            new = self.least(slope=1 / ratio)
            if new is not None and self.risk(new) <= 1e-12:  # without risk the ratio has no bound: take the greatest return of such points
                return self.below(0.0)
            if new is None or (float(self.c @ new) - free) / self.risk(new) <= ratio * (1 + 1e-12):
                break
            w = new
        return w


def exchanged(region: Region, goal: Callable[[np.ndarray], float], w: np.ndarray) -> np.ndarray:
    """``w`` after moving weight between pairs in ever smaller steps while ``goal`` falls; for figures that are not convex."""
    n, best, step = len(w), goal(w), 0.25
    while step > 1e-6:
        moved = False
        for i in range(n):
            for j in range(n):
                d = min(step, region.high[i] - w[i], w[j] - region.low[j]) if i != j else 0.0
                if d > 1e-12:
                    trial = w.copy()
                    trial[i] += d
                    trial[j] -= d
                    if region.groups and not region.contains(trial, 1e-10):
                        continue
                    cost = goal(trial)
                    if cost < best - 1e-12:
                        w, best, moved = trial, cost, True
        if not moved:
            step /= 2
    return w


def searched(region: Region, goal: Callable[[np.ndarray], float], starts: list[np.ndarray]) -> np.ndarray:
    """The best of several exchanges; the most promising starts are followed."""
    found = [exchanged(region, goal, w) for w in sorted(starts, key=goal)[:4]]
    return min(found, key=goal)
