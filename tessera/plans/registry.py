"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import search_queries, service_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple = (text_queries, search_queries, service_queries, stream_queries)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
