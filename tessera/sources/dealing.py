"""Rows dealt over tasks before each becomes many: a small file is one task otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame

FEW_ROWS, MOST_PARTS = 1000, 10_000
#: Rows of a task at most where each is a shape of its own.
SHAPES = 20_000


def dealt(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """df over enough partitions that each has some `most` rows (by `keys`, if any), and over all cores twice unless it is small."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(MOST_PARTS, max(-(-n // most), min(2 * cores, -(-n // FEW_ROWS))))), *keys)
