"""Indicator expressions in LaTeX, compiled to Spark columns over series arrays."""

from __future__ import annotations

import inspect
import itertools
import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.functions import kernels as k
from navspark.operators.panel import so_far

#: Names of the expression language and the kernels behind them.
FUNCTIONS = {
    "prod": k.sequence_prod, "sum": k.sequence_sum, "std": k.sequence_std, "cumret": k.cumulative_simple_returns, "net": k.cumulative_net_value, "drawdown": k.sequence_drawdown,
    "gmean": k.sequence_geometric_mean, "CAGR": k.sequence_compound_annual_growth_rate, "MDD": k.max_drawdown_rate_and_recovery_days, "sqrt": k.root, "var": k.sequence_variance,
    "cumsum": k.sequence_cumsum, "cumprod": k.sequence_cumprod, "min": k.sequence_min, "max": k.sequence_max, "mean": k.sequence_mean,
}
SERIES_RESULT = {"cumret", "net", "drawdown", "cumsum", "cumprod"}
#: Years of a period's unit, and of the data's frequency.
YEARS = {"D": 1 / 252, "W": 1 / 52, "M": 1 / 12, "Y": 1.0}
FREQUENCY = {"日": 1 / 252, "周": 1 / 52, "月": 1 / 12}

_TOKEN = re.compile(r"\s*(\\[A-Za-z]+|\\[,;! ]|r_\{f\}\^\{annual\}|r_\{f\}|\d+\.?\d*(?:[eE][-+]?\d+)?|\*\*|[-+*/^(){},])")


@dataclass(frozen=True)
class Node:
    """A node of the expression's tree; equal trees are equal values, so repeated parts are one."""

    kind: str
    value: object = None
    inputs: tuple[Node, ...] = ()


class ExpressionError(ValueError):
    """The text is not an expression of the language."""


def _tokens(text: str) -> list[str]:
    text = text.replace("\\left", "").replace("\\right", "")
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected text at {at}: {text[at : at + 12]!r}")
        if not re.fullmatch(r"\\[,;! ]", m[1]):
            out.append(m[1])
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or (wanted and token != wanted):
            raise ExpressionError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.total()
        if self.peek() is not None:
            raise ExpressionError(f"unexpected {self.peek()}")
        return node

    def total(self) -> Node:
        node = self.term()
        while self.peek() in ("+", "-"):
            node = Node("binary", self.take(), (node, self.term()))
        return node

    def term(self) -> Node:
        node = self.unary()
        while self.peek() in ("*", "/", "\\times", "\\cdot"):
            node = Node("binary", "/" if self.take() == "/" else "*", (node, self.unary()))
        return node

    def unary(self) -> Node:
        if self.peek() == "-":
            self.take()
            return Node("negative", None, (self.unary(),))
        return self.raised()

    def raised(self) -> Node:
        node = self.atom()
        if self.peek() in ("^", "**"):
            self.take()
            power = self.braced() if self.peek() == "{" else self.unary()
            node = Node("binary", "^", (node, power))
        return node

    def braced(self) -> Node:
        self.take("{")
        node = self.total()
        self.take("}")
        return node

    def arguments(self) -> tuple[Node, ...]:
        if self.peek() == "{":
            return (self.braced(),)
        self.take("(")
        found = [self.total()]
        while self.peek() == ",":
            self.take()
            found.append(self.total())
        self.take(")")
        return tuple(found)

    def atom(self) -> Node:
        token = self.take()
        if token in ("\\returns", "\\logreturns"):
            return Node("variable", token[1:])
        if token == "(":
            node = self.total()
            self.take(")")
            return node
        if token == "{":
            self.at -= 1
            return self.braced()
        if token[0].isdigit():
            return Node("number", float(token))
        if token == "r_{f}":
            return Node("variable", "free")
        if token == "r_{f}^{annual}":
            return Node("variable", "annual_free")
        if token == "\\frac":
            return Node("binary", "/", (self.braced(), self.braced()))
        if token == "\\sqrt":
            return Node("call", "sqrt", (self.braced(),))
        if token == "\\overline":
            return Node("call", "mean", (self.braced(),))
        if token[0] == "\\" and token[1:] in FUNCTIONS:
            return Node("call", token[1:], self.arguments())
        raise ExpressionError(f"unknown {token}")


def _prepared(text: str) -> str:
    """Names in braces as single commands, which the tokens then are."""
    text = re.sub(r"\\mathbf\{(?:r)\}", r"\\returns ", text)
    text = re.sub(r"\\mathbf\{\\ell\}", r"\\logreturns ", text)
    return re.sub(r"\\operatorname\{([A-Za-z]+)\}", r"\\\1 ", text)


def parse(text: str) -> Node:
    return _Parser(_prepared(text)).whole()


def nodes(root: Node) -> list[Node]:
    """Distinct nodes, inputs first."""
    seen: dict[Node, None] = {}

    def visit(n: Node) -> None:
        for i in n.inputs:
            visit(i)
        seen.setdefault(n)

    visit(root)
    return list(seen)


def is_series(n: Node) -> bool:
    if n.kind == "variable":
        return n.value in ("returns", "logreturns")
    if n.kind == "call":
        return n.value in SERIES_RESULT or (n.value == "sqrt" and is_series(n.inputs[0]))
    return any(is_series(i) for i in n.inputs)


_BINARY = {"+": k.add, "-": k.subtract, "*": k.multiply, "/": k.divide, "^": k.power}


def compiled(n: Node, variables: dict[str, Column]) -> Column:
    """The node as a column: an array where it is a series, else a double."""
    if n.kind == "number":
        return F.lit(n.value)
    if n.kind == "variable":
        return variables[n.value]
    inputs = [compiled(i, variables) for i in n.inputs]
    if n.kind == "negative":
        return F.transform(inputs[0], k.negate) if is_series(n.inputs[0]) else -inputs[0]
    if n.kind == "binary":
        f, (a, b) = _BINARY[n.value], inputs
        left, right = (is_series(i) for i in n.inputs)
        if left and right:
            return F.zip_with(a, b, f)
        if left:
            return F.transform(a, lambda x: f(x, b))
        return F.transform(b, lambda x: f(a, x)) if right else f(a, b)
    rest = []
    for i in n.inputs[1:]:
        if i.kind != "number":
            raise ExpressionError(f"{n.value} takes numbers after its first argument")
        rest.append(int(i.value) if n.value in ("std", "var") else i.value)
    if n.value == "sqrt" and is_series(n.inputs[0]):
        return F.transform(inputs[0], k.root)
    out = FUNCTIONS[n.value](inputs[0], *rest)
    return out["rate"] if n.value == "MDD" else out


def years(period: str) -> float:
    """``3M``, ``M3`` or ``1Y`` as a share of a year."""
    m = re.fullmatch(r"(\d+)([DWMY])|([DWMY])(\d+)", period.strip().upper())
    if not m:
        raise ExpressionError(f"unknown period {period}")
    return int(m[1] or m[4]) * YEARS[m[2] or m[3]]


def _start(last: Column, period: str) -> Column:
    m = re.fullmatch(r"(\d+)([DWMY])|([DWMY])(\d+)", period.strip().upper())
    n, unit = int(m[1] or m[4]), m[2] or m[3]
    if unit in "DW":
        return F.date_sub(last, n * (7 if unit == "W" else 1))
    return F.add_months(last, -n * (12 if unit == "Y" else 1))


@dataclass(frozen=True)
class Indicator:
    name: str
    expression: str
    periods: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    indicators: tuple[Indicator, ...]
    annual_free: float = 0.0
    frequency: str = "日"

    @property
    def free(self) -> float:
        """The annual risk-free rate for one row's period."""
        return (1 + self.annual_free) ** FREQUENCY[self.frequency] - 1


def profiles(text: str) -> dict[str, Profile]:
    """Profiles of a JSON document, by name in its order."""
    out = {}
    for name, p in json.loads(text).items():
        meta = p.get("metadata", {})
        found = tuple(Indicator(i["name"], i["dsl_expression"], tuple(i["periods"])) for i in p["indicators"])
        out[name] = Profile(found, float(meta.get("annual_risk_free_rate_percent") or 0) / 100, meta.get("data_frequency", "日"))
    return out


def profile(found: dict[str, Profile], name: str | None = None) -> Profile:
    """The named profile, or the first."""
    if name is None:
        return next(iter(found.values()))
    if name not in found:
        raise ValueError(f"unknown profile {name}")
    return found[name]


@dataclass(frozen=True)
class _Series:
    """A series held by rows: the values ahead of the first row, and the value of each row."""

    heads: tuple[Column, ...]
    each: Column

    def mapped(self, f: Callable[[Column], Column]) -> _Series:
        return _Series(tuple(f(h) for h in self.heads), f(self.each))


def _reduces(n: Node) -> bool:
    return n.kind == "call" and n.value not in SERIES_RESULT and n.value != "sqrt"


def _scans(n: Node) -> bool:
    return n.kind == "call" and n.value in SERIES_RESULT


def _level(n: Node) -> int:
    """How many aggregations lie below a node, its own included."""
    return max((_level(i) for i in n.inputs), default=0) + _reduces(n)


def _numbers(n: Node) -> list[float]:
    for i in n.inputs[1:]:
        if i.kind != "number":
            raise ExpressionError(f"{n.value} takes numbers after its first argument")
    return [i.value for i in n.inputs[1:]]


def _scanned(n: Node, s: _Series, inside: Column) -> _Series:
    """A cumulative series as window expressions over the asset's rows of the period."""
    w, x = so_far(), F.when(inside, s.each)
    heads: list[Column] = []
    if n.value == "drawdown":
        for h in s.heads:
            heads.append(F.greatest(heads[-1], h) if heads else h)
        peak = F.greatest(F.max(x).over(w), heads[-1]) if heads else F.max(x).over(w)
        fall = lambda v, top: F.when(top > 0, F.try_divide(v - top, top))
        return _Series(tuple(fall(h, top) for h, top in zip(s.heads, heads)), fall(s.each, peak))
    step = {"cumsum": lambda a, v: a + v, "cumprod": lambda a, v: a * v}.get(n.value, lambda a, v: a * (1 + v))
    carry = F.lit({"cumsum": 0.0, "cumprod": 1.0, "cumret": 1.0}.get(n.value, (_numbers(n) or [1.0])[0]))
    if n.value == "net":
        heads.append(carry)
    for h in s.heads:
        carry = step(carry, h)
        heads.append(carry)
    here = {"cumsum": F.sum(x), "cumprod": F.product(x)}.get(n.value, F.product(1 + x)).over(w)
    # What follows a missing value is missing.
    broken = F.max(F.when(inside & s.each.isNull(), 1)).over(w)
    out = _Series(tuple(heads), F.when(broken.isNull(), carry + here if n.value == "cumsum" else carry * here))
    return out.mapped(lambda v: v - 1) if n.value == "cumret" else out


def _reduced(n: Node, s: _Series, inside: Column) -> Column:
    """A figure of a series as an aggregate over the asset's rows of the period, combined within partitions before the shuffle."""
    heads, x, extra = [F.max(h) for h in s.heads], F.when(inside, s.each), _numbers(n)
    if n.value in ("min", "max"):
        low = (F.min if n.value == "min" else F.max)(x)
        return (F.least if n.value == "min" else F.greatest)(low, *heads) if heads else low
    if n.value == "MDD":  # of the series' drawdowns
        worst = F.least(F.min(x), *heads) if heads else F.min(x)
        return F.when(worst == 0, 0.0).otherwise(-worst)
    rows = F.count(F.when(inside, 1))
    whole, size = F.count(x) == rows, rows + len(heads)
    if n.value in ("sum", "mean"):
        total = F.coalesce(F.sum(x), F.lit(0.0))
        for h in heads:
            total = total + h
        return F.when(whole, total if n.value == "sum" else F.try_divide(total, size))
    if n.value in ("prod", "gmean", "CAGR"):
        grown = n.value == "CAGR"
        product = F.coalesce(F.product(1 + x if grown else x), F.lit(1.0))
        for h in heads:
            product = product * (1 + h if grown else h)
        if n.value == "prod":
            return F.when(whole, product)
        if grown:
            return F.when(whole & (size > 0) & (product > 0), F.pow(product, F.try_divide(F.lit(float(extra[0])), size)) - 1)
        least = F.least(F.min(x), *heads) if heads else F.min(x)
        return F.when(whole & (size > 0) & (least > 0), F.pow(product, F.try_divide(F.lit(1.0), size)))
    # Variances: rows by the aggregate, heads one by one.
    count, mean, squares = rows.cast("double"), F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.var_pop(x), F.lit(0.0)) * rows
    for h in heads:
        gap = h - mean
        squares = squares + gap * gap * count / (count + 1)
        mean, count = mean + gap / (count + 1), count + 1
    ddof = int(extra[0]) if extra else 1
    variance = F.when(whole & (size > ddof), F.try_divide(squares, size - ddof))
    return F.sqrt(variance) if n.value == "std" else variance


class _Plan:
    """Expressions over rows (asset, date, ret, last): scans become window columns, reductions one aggregation per level."""

    def __init__(self, rows: DataFrame, figures: DataFrame, chosen: Profile, inside: dict[str, Column]):
        self.rows, self.figures, self.chosen, self.inside = rows, figures, chosen, inside
        self.done: dict[tuple[str, Node], Column | _Series] = {}

    def value(self, period: str, n: Node) -> Column | _Series:
        if n.kind == "number":
            return F.lit(n.value)
        if n.kind == "variable":
            known = {"returns": _Series((), F.col("ret")), "logreturns": _Series((), F.ln(1 + F.col("ret"))), "free": F.lit(self.chosen.free), "annual_free": F.lit(self.chosen.annual_free)}
            return known[n.value]
        if _reduces(n) or _scans(n):
            return self.done[period, n]
        found = [self.value(period, i) for i in n.inputs]
        if n.kind == "binary":
            return _both(_BINARY[n.value], *found)
        one = k.negate if n.kind == "negative" else k.root
        return found[0].mapped(one) if isinstance(found[0], _Series) else one(found[0])

    def build(self, every: Sequence[tuple[str, Node]]) -> None:
        names = itertools.count()
        for level in range(max((_level(n) for _, n in every), default=0) + 1):
            wanted: dict[str, Column] = {}
            for period, n in every:  # inputs first
                if _scans(n) and _level(n) == level:
                    found = _scanned(n, self._series(period, n), self.inside[period])
                    name = f"scan {next(names)}"
                    self.rows = self.rows.withColumn(name, found.each)
                    self.done[period, n] = _Series(found.heads, F.col(f"`{name}`"))
                elif _reduces(n) and _level(n) == level + 1:
                    name = f"figure {next(names)}"
                    wanted[name] = _reduced(n, self._series(period, n), self.inside[period])
                    self.done[period, n] = F.col(f"`{name}`")
            if wanted:
                found = self.rows.groupBy("asset").agg(*(c.alias(name) for name, c in wanted.items()))
                self.figures = self.figures.join(found, "asset")
                if any(_level(n) > level + 1 for _, n in every):
                    self.rows = self.rows.join(found, "asset")

    def _series(self, period: str, n: Node) -> _Series:
        found = self.value(period, n.inputs[0])
        if not isinstance(found, _Series):
            raise ExpressionError(f"{n.value} takes a series")
        return found


def _both(f: Callable[[Column, Column], Column], a: Column | _Series, b: Column | _Series) -> Column | _Series:
    if isinstance(a, _Series) and isinstance(b, _Series):
        if len(a.heads) != len(b.heads):
            raise ExpressionError("series differ in length")
        return _Series(tuple(f(x, y) for x, y in zip(a.heads, b.heads)), f(a.each, b.each))
    if isinstance(a, _Series):
        return a.mapped(lambda x: f(x, b))
    return b.mapped(lambda x: f(a, x)) if isinstance(b, _Series) else f(a, b)


def _with_falls(n: Node) -> Node:
    """The tree where a deepest fall is one of a series of falls."""
    inputs = tuple(_with_falls(i) for i in n.inputs)
    return Node(n.kind, n.value, (Node("call", "drawdown", inputs[:1]), *inputs[1:]) if n.value == "MDD" and n.kind == "call" else inputs)


def evaluate(returns: DataFrame, chosen: Profile, names: Sequence[str] | None = None) -> DataFrame:
    """(asset, indicator, period, value) of returns (asset, date, ret), each over the period up to the asset's last date.

    Only indicators of ``names`` are computed, if they are given.  A period is a
    condition on rows: figures are conditional aggregates, cumulative series are
    windows, so no asset's series is ever one value.  All periods and indicators
    share one aggregation, or one per level where an expression takes figures
    back into a series.  Rows without a return are left out; an asset without
    any has no rows in the result.
    """
    rows = returns.where("ret is not null").select("asset", "date", "ret")
    ends = rows.groupBy("asset").agg(F.max("date").alias("last"))
    rows = rows.join(ends, "asset")
    trees = [(i.name, period, _with_falls(parse(i.expression))) for i in chosen.indicators if names is None or i.name in names for period in i.periods]
    for name, _, tree in trees:
        if is_series(tree):
            raise ExpressionError(f"{name} is a series, not a figure")
    inside = {period: F.col("date") > _start(F.col("last"), period) for _, period, _ in trees}
    plan = _Plan(rows, ends, chosen, inside)
    plan.build(list(dict.fromkeys((period, n) for _, period, tree in trees for n in nodes(tree))))
    items = [F.struct(F.lit(name).alias("indicator"), F.lit(period).alias("period"), plan.value(period, tree).cast("double").alias("value")) for name, period, tree in trees]
    found = F.array(*items) if items else F.array().cast("array<struct<indicator:string,period:string,value:double>>")
    return plan.figures.select("asset", F.explode(found).alias("i")).select("asset", "i.indicator", "i.period", "i.value")


#: How calls are written in the expression language; others are operators by name.
LATEX = {"prod": r"\prod", "sum": r"\sum", "sqrt": r"\sqrt", "mean": r"\overline"}
_VARIABLES = {"returns": r"\mathbf{r}", "logreturns": r"\mathbf{\ell}", "free": "r_{f}", "annual_free": "r_{f}^{annual}"}


def latex(n: Node) -> str:
    """The tree as text of the language; parsing it gives the same tree."""
    if n.kind == "number":
        return f"{n.value:.17g}"
    if n.kind == "variable":
        return _VARIABLES[n.value]
    inputs = [latex(i) for i in n.inputs]
    if n.kind == "negative":
        return f"(-{inputs[0]})"
    if n.kind == "call":
        if n.value in ("sqrt", "mean"):
            return f"{LATEX[n.value]}{{{inputs[0]}}}"
        return f"{LATEX.get(n.value, rf'\operatorname{{{n.value}}}')}({', '.join(inputs)})"
    a, b = inputs
    if n.value == "/":
        return rf"\frac{{{a}}}{{{b}}}"
    return f"({{{a}}}^{{{b}}})" if n.value == "^" else rf"({a} \times {b})" if n.value == "*" else f"({a} {n.value} {b})"


def catalogue() -> list[dict[str, object]]:
    """The language's functions: name, kernel, arguments, whether the result is a series, what it does, and how it is written."""
    out = []
    for name, kernel in FUNCTIONS.items():
        arguments = list(inspect.signature(kernel).parameters)
        shown = ", ".join([r"\mathbf{r}", *arguments[1:]])
        written = f"{LATEX[name]}{{\\mathbf{{r}}}}" if name in ("sqrt", "mean") else f"{LATEX.get(name, rf'\operatorname{{{name}}}')}({shown})"
        doc = (inspect.getdoc(kernel) or "").split("\n")[0]
        out.append({"name": name, "kernel": kernel.__name__, "arguments": arguments, "series": name in SERIES_RESULT, "description": doc, "latex": written})
    return out


def to_dot(root: Node) -> str:
    """The tree's distinct nodes as a DOT graph."""
    order = {n: i for i, n in enumerate(nodes(root))}
    lines = [f'  n{i} [label="{n.kind} {n.value if n.value is not None else ""}"];' for n, i in order.items()]
    lines += [f"  n{order[j]} -> n{i};" for n, i in order.items() for j in n.inputs]
    return "\n".join(["digraph {", *lines, "}"])
