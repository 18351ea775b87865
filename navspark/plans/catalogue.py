"""Modules that register queries."""

from navspark.plans import backtest_queries, compare_queries, indicator_queries, panel_queries, portfolio_queries, technical_queries, universe_queries  # noqa: F401
