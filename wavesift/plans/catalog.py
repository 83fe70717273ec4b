"""All queries of the library by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavesift.plans import engine_queries, kernel_queries, mode_queries, more_queries, scan_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (scan_queries, more_queries, engine_queries, kernel_queries, mode_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
