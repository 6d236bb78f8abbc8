"""Queries over the driver's tables, by name, and their twins in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, content_queries, delivery_queries, function_queries, log_queries, url_queries

MODULES = (url_queries, log_queries, content_queries, archive_queries, function_queries, delivery_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
