"""The table of queries: each a function of (spark, sf_dir), with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is there already")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
