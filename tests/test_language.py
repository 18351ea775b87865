"""Indicator expressions over rows, against their form over arrays."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark.operators import dsl

EXPRESSIONS = [
    r"\left(\prod\left(\mathbf{r} + 1\right)\right) - 1",
    r"\operatorname{std}(\mathbf{r}, 0) + \operatorname{var}(\mathbf{\ell})",
    r"\sum((\mathbf{r} - \overline{\mathbf{r}}) \times (\mathbf{r} - \overline{\mathbf{r}}))",
    r"\operatorname{MDD}(\operatorname{net}(\mathbf{r}, 100))",
    r"\operatorname{min}(\operatorname{drawdown}(\operatorname{cumprod}(\mathbf{r} + 1)))",
    r"\operatorname{std}(\operatorname{net}(\mathbf{r}, 2), 1) / \overline{\operatorname{net}(\mathbf{r}, 2)}",
    r"\operatorname{max}(\operatorname{cumsum}(\mathbf{r} - \operatorname{min}(\mathbf{r})))",
    r"\operatorname{gmean}(\mathbf{r} + 1) + \operatorname{CAGR}(\mathbf{r}, 252)",
    r"\operatorname{gmean}(\mathbf{r})",
    r"\overline{\frac{1}{\mathbf{r}}}",
    r"\operatorname{max}(\operatorname{cumsum}(\sqrt{\mathbf{r}}))",
    r"\operatorname{MDD}(\operatorname{net}(\operatorname{cumret}(\mathbf{r}), 3)) - r_{f} + r_{f}^{annual}",
    r"\prod(\operatorname{net}(\mathbf{r} - \overline{\mathbf{r}}, 1.5))",
    "3 + 4",
]
PERIODS = ["1W", "2M", "1Y", "1D"]


def profile_of(expressions, periods=PERIODS):
    found = [{"name": str(i), "dsl_expression": e, "periods": periods} for i, e in enumerate(expressions)]
    return dsl.profile(dsl.profiles(json.dumps({"x": {"metadata": {"annual_risk_free_rate_percent": 2}, "indicators": found}})))


@pytest.fixture(scope="module")
def returns(spark):
    rng, rows = np.random.default_rng(5), []
    for asset, n in (("a", 200), ("b", 9), ("c", 1)):
        day = dt.date(2024, 1, 3)
        rows += [(asset, day + dt.timedelta(i), None if i % 7 == 6 else 0.0 if i % 11 == 3 else float(rng.normal(0, 0.03))) for i in range(n)]
    rows.append(("none", dt.date(2024, 1, 1), None))
    return spark.createDataFrame(rows, "asset string, date date, ret double")


def over_arrays(returns, chosen):
    """Every figure from its period's returns as one array."""
    rows = returns.where("ret is not null").groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("date", "ret"))).alias("rows"))
    rows = rows.withColumn("last", F.element_at("rows", -1)["date"])
    out = {}
    for i in chosen.indicators:
        for period in i.periods:
            r = F.transform(F.filter("rows", lambda x: x["date"] > dsl._start(F.col("last"), period)), lambda x: x["ret"])
            known = {"returns": r, "logreturns": F.transform(r, lambda x: F.ln(1 + x)), "free": F.lit(chosen.free), "annual_free": F.lit(chosen.annual_free)}
            for asset, value in rows.select("asset", dsl.compiled(dsl.parse(i.expression), known).cast("double")).collect():
                out[asset, i.name, period] = value
    return out


@pytest.mark.parametrize("at", range(0, len(EXPRESSIONS), 5))
def test_rows_equal_arrays(returns, at):
    chosen = profile_of(EXPRESSIONS[at : at + 5])
    found = {(r.asset, r.indicator, r.period): r.value for r in dsl.evaluate(returns, chosen).collect()}
    want = over_arrays(returns, chosen)
    assert set(found) == set(want) and len(want) == 3 * 4 * len(chosen.indicators)
    for key, value in want.items():
        assert found[key] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), key


def test_no_series_is_one_value(returns):
    plan = dsl.evaluate(returns, profile_of(EXPRESSIONS))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan


def test_empty_and_wrong(spark, returns):
    assert dsl.evaluate(returns.where("false"), profile_of(EXPRESSIONS[:2])).count() == 0
    assert dsl.evaluate(returns, profile_of(EXPRESSIONS), ["no such"]).count() == 0
    for bad in (r"\mathbf{r} + 1", r"\overline{3}", r"\sum(\mathbf{r} + \operatorname{net}(\mathbf{r}, 1))", r"\operatorname{std}(\mathbf{r}, \sum(\mathbf{r}))"):
        with pytest.raises(dsl.ExpressionError):
            dsl.evaluate(returns, profile_of([bad]))


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_text_of_a_tree_gives_the_tree(text):
    tree = dsl.parse(text)
    assert dsl.parse(dsl.latex(tree)) == tree


def test_catalogue():
    found = {c["name"]: c for c in dsl.catalogue()}
    assert set(found) == set(dsl.FUNCTIONS)
    assert found["std"]["kernel"] == "sequence_std" and found["std"]["arguments"] == ["s", "ddof"] and not found["std"]["series"]
    assert found["net"]["series"] and found["mean"]["latex"] == r"\overline{\mathbf{r}}" and found["prod"]["latex"] == r"\prod(\mathbf{r})"
