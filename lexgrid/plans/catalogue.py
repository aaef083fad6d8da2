"""Named queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexgrid.plans import document_queries, layout_queries, retrieval_queries, run_queries, service_queries, stream_queries

MODULES = [retrieval_queries, document_queries, service_queries, layout_queries, stream_queries, run_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
