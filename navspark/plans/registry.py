"""Queries and their SQL twins, collected from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    from navspark.plans import catalogue  # noqa: F401  registers the queries


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
