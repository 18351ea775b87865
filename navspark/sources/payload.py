"""Backtests asked for as JSON documents: model settings, strategies, and the run itself."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.operators import rebalance as r
from navspark.operators.running import held_path
from navspark.operators.weights import Strategy, schedule
from navspark.sources.shared import once

#: Settings that a strategy's own level may hold for its model, by kind.
_OWN = {"target": ("days", "risk_free_rate", "constraints", "target_return", "target_risk"), "risk_budget": ()}
_BY_RISK = {"annual_vol": ("days",), "ewm_vol": ("days", "window"), "var": ("confidence",), "es": ("confidence",)}


def model_of(spec: dict) -> dict:
    """A strategy's model settings: its ``model``, then what its own level says, then the defaults.

    A setting of the model always wins.  Risk budgets take days, window and
    confidence only where their risk metric uses them; the window of history is
    ``rollingN`` unless set.
    """
    kind, own = spec.get("type"), dict(spec.get("model") or {})
    out = dict(own)
    if kind == "target":
        out.setdefault("target", spec.get("target") or "min_risk")
        out.setdefault("return_metric", spec.get("return_metric") or "annual")
        out.setdefault("return_type", spec.get("return_type") or "simple")
    if kind in _OWN:
        out.setdefault("risk_metric", spec.get("risk_metric") or "vol")
        taken = _OWN[kind] or _BY_RISK.get(out["risk_metric"], ())
        for name in taken:
            if out.get(name) is None and spec.get(name) is not None:
                out[name] = spec[name]
    out["window_mode"] = out.get("window_mode") or "rollingN"
    return out


def request_of(alloc_name: str, start: str | None, spec: dict) -> dict:
    """What a schedule depends on, for its key: allocation, start, kind, calendar, model and classes."""
    classes = [{"name": c["name"], "budget": float(c.get("budget") or 0.0)} if spec.get("type") == "risk_budget" else {"name": c["name"]} for c in spec.get("classes") or []]
    return {"alloc_name": alloc_name, "start_date": start, "type": spec.get("type"), "rebalance": spec.get("rebalance") or {}, "model": model_of(spec), "classes": classes}


def strategy_of(spec: dict, model: dict | None = None) -> Strategy:
    """The model that a strategy's document describes, with ``model`` as its settings, by default those it has itself."""
    m = dict(spec.get("model") or {}) if model is None else model
    kind = spec.get("type") or "fixed"
    limits = m.get("constraints") or {}
    bounds = {a: (float(v.get("lo", 0.0)), float(v.get("hi", 1.0))) for a, v in (limits.get("single_limits") or {}).items() if isinstance(v, dict)}
    groups = tuple((tuple(g.get("assets") or ()), float(g.get("lo", 0.0)), float(g.get("hi", 1.0))) for g in limits.get("group_limits") or [])
    if kind == "target":
        kind = str(m.get("target") or "min_risk")
    target = m.get("target_return") if kind == "risk_min_given_return" else m.get("target_risk")
    confidence = m.get("confidence") if m.get("risk_confidence") is None else m["risk_confidence"]
    classes = spec.get("classes") or []
    return Strategy(
        name_of(spec), kind, weights={c["name"]: float(c.get("weight") or 0.0) for c in classes}, budgets={c["name"]: float(c.get("budget") or 0.0) for c in classes},
        return_metric=m.get("return_metric") or "annual", risk_metric=m.get("risk_metric") or "vol", target=target, free=float(m.get("risk_free_rate") or 0.0), days=m.get("days"),
        confidence=confidence, bounds=bounds, groups=groups, window_mode=m.get("window_mode") or "all", length=m.get("data_len"),
    )


def name_of(spec: dict) -> str:
    return spec.get("name") or spec.get("type") or "strategy"


def stored_nav(spark: SparkSession, folder: str, alloc_name: str) -> DataFrame:
    """(asset, date, nav) of a saved allocation: one partition of the table, the mean of repeated dates."""
    rows = spark.read.parquet(f"{folder}/asset_nv").where(F.col("asset_alloc_name") == alloc_name)
    return rows.groupBy(F.col("asset_name").alias("asset"), F.col("date").cast("date").alias("date")).agg(F.avg("nv").alias("nav"))


def backtest(panel: DataFrame, specs: list[dict], start: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, markers, figures) of strategies' documents over a panel.

    A strategy without ``rebalance.enabled``, or whose calendar has no date, is
    bought once and held, and has no markers; ``recalc`` solves its model anew on each rebalancing date from the
    panel's history up to it, other ones return to their weights.  Without
    weights the classes count the same.  Repeated names, and panels too short for
    any window of a model, are errors.
    """
    spark = panel.sparkSession
    names = [name_of(s) for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("two strategies have one name")
    full = once(panel)
    panel = full.where(F.col("date") >= F.lit(start).cast("date")) if start else full
    assets = sorted(x.asset for x in full.select("asset").distinct().collect())  # the classes of one allocation
    found_paths, found_markers = [], []
    for spec in specs:
        name, rb = name_of(spec), spec.get("rebalance") or {}
        listed = spec.get("classes")
        given = {c["name"]: float(c.get("weight") or 0.0) for c in listed} if listed else dict(zip(assets, spec.get("weights") or [1.0] * len(assets)))
        fixed = spark.createDataFrame([(name, a, given.get(a, 0.0)) for a in assets], "strategy string, asset string, weight double")
        dates = None
        if rb.get("enabled"):
            dates = once(r.rebalance_dates(panel, str(rb.get("mode", "monthly")), str(rb.get("which", "nth")), str(rb.get("unit", "trading")), int(rb.get("N", 1)), int(rb.get("fixedInterval", 20))))
        if dates is None or dates.isEmpty():
            found_paths.append(held_path(panel, fixed))
            continue
        model = spec.get("model") or {}
        dates = once(r.gated(panel, dates, model.get("window_mode"), model.get("data_len")))
        at = dates.select(F.lit(name).alias("strategy"), "date")
        solved = schedule(full, [strategy_of(spec)], at) if rb.get("recalc") and spec.get("type") in ("risk_budget", "target") else fixed
        path, markers = r.paths(panel, solved, at)
        found_paths.append(path)
        found_markers.append(markers)
    path = once(_all(found_paths, spark, "strategy string, date date, value double"))
    return path, _all(found_markers, spark, "strategy string, date date, asset string, weight double, value double"), r.figures(path)


def _all(parts: list[DataFrame], spark: SparkSession, kind: str) -> DataFrame:
    out = spark.createDataFrame([], kind)
    for p in parts:
        out = out.unionByName(p)
    return out


def run(spark: SparkSession, folder: str, document: str, out: str) -> None:
    """Run the backtest of a JSON document (alloc_name, start_date, strategies) on saved allocations; its tables go to ``out`` as JSON lines."""
    asked = json.loads(document)
    if asked.get("start_date"):
        date.fromisoformat(asked["start_date"])
    panel = stored_nav(spark, folder, asked["alloc_name"])
    for name, rows in zip(("series", "markers", "metrics"), backtest(panel, asked["strategies"], asked.get("start_date"))):
        rows.write.mode("overwrite").json(f"{out}/{name}")
