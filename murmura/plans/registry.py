"""Name to query and to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, also: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name, with its SQL if SQL can express it, and under an older name that
    it had (also). A name is given once."""

    def add(f: Query) -> Query:
        for name in filter(None, (f.__name__, also)):
            if name in QUERIES:
                raise ValueError(f"{name} is registered by {QUERIES[name].__module__} and {f.__module__}")
            QUERIES[name] = f
            if sql is not None:
                ORACLE_SQL[name] = sql
        return f

    return add
