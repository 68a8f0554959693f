"""Queries with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracles() -> dict[str, str]:
    return _ORACLES


def half_up_sql(x: str, digits: int) -> str:
    """DuckDB's expression for Spark's round: a half of the number as it is written goes away from zero. DuckDB's own
    round of a double multiplies first, so that 26.549999999999997 becomes 26.6."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"
