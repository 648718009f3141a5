"""Registered queries: one for each operator, over the driver's tables, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from barloom.queries import backtests, indicators, language, metrics, relational, reports, selection, statistics, streams  # noqa: F401

    return QUERIES, SQL
