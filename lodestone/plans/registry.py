"""The catalogue of queries: name to Spark function, and to equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Imports every module that registers queries."""
    from lodestone.plans import console_queries, facade_queries, health_queries, index_queries, ingest_queries, search_queries, stream_queries, vector_queries  # noqa: F401
