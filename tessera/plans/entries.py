"""What a registered query is, and how its result is made comparable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.aggregate import Grid

DIGITS = 6


@dataclass(frozen=True)
class Entry:
    """A query and, where SQL can express it, the SQL of the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(result: Grid | DataFrame) -> DataFrame:
    """The rows with doubles rounded to DIGITS: sums of doubles depend on their order in the last bits."""
    df = result.df if isinstance(result, Grid) else result
    return df.select(*[F.round(c, DIGITS).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def digits(e: str) -> str:
    """SQL of the same."""
    return f"round(({e})::double, {DIGITS})"
