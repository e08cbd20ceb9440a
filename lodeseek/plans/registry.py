"""Named queries over the test tables, each with its SQL for DuckDB where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


from . import coverage_queries, maintenance_queries, read_queries, search_queries, serving_queries  # noqa: E402,F401  they register themselves
