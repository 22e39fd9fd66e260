"""The registered queries of the grid engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import grid_queries, point_queries, shape_queries
from tessera.plans.entries import Entry

flagship = point_queries.flagship


def entries() -> dict[str, Entry]:
    return point_queries.entries() | shape_queries.entries() | grid_queries.entries()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: e.run for n, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: e.sql for n, e in entries().items() if e.sql}
