"""Registered queries: compositions of operators, each with its SQL."""

from __future__ import annotations

from . import conditions, contexts, growth, history, knowledge, matching, parsing, replies, reports, routing, scalars, slots, stores, structuring, summaries, values
from .registry import ORACLE_SQL, QUERIES, Query

__all__ = ["conditions", "contexts", "growth", "history", "knowledge", "matching", "parsing", "replies", "reports", "routing", "scalars", "slots", "stores", "structuring", "summaries", "values", "queries", "oracle_sql"]


def queries() -> dict[str, Query]:
    """Name to a function of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to the same query for DuckDB."""
    return dict(ORACLE_SQL)
