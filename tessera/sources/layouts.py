"""Other shapes of input: parallel sequences, arrays, geometry, ragged lists, and spatial filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_sequences(spark: SparkSession, x: Sequence[float], ys: Sequence[Sequence[float]]) -> DataFrame:
    """(ri, series, x, y): many series over one x, with a row of nulls between series so that lines break there."""
    rows, n = [], 0
    for s, y in enumerate(ys):
        for a, b in [*zip(x, y, strict=True), (None, None)]:
            rows.append((n, s, None if a is None else float(a), None if b is None else float(b)))
            n += 1
    return spark.createDataFrame(rows, "ri long, series int, x double, y double")


def array_to_cells(spark: SparkSession, values: Sequence[Sequence[float]]) -> DataFrame:
    """(iy, ix, value) of a matrix."""
    rows = [(j, i, None if v is None else float(v)) for j, row in enumerate(values) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "iy int, ix int, value double")


def column_to_rows(df: DataFrame, array: str, index: str = "ix", value: str = "value") -> DataFrame:
    """A row for each element of an array column, with its position."""
    return df.select("*", F.posexplode(array).alias(index, value)).drop(array)


def within_box(df: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Points in a box (xmin, ymin, xmax, ymax): plain comparisons on columns, which reach the Parquet scan."""
    return df.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def touching_box(df: DataFrame, box: tuple[float, float, float, float], xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """Shapes whose stored bounding boxes meet a box; these reach the Parquet scan too."""
    return df.where((F.col(xmin) <= box[2]) & (F.col(xmax) >= box[0]) & (F.col(ymin) <= box[3]) & (F.col(ymax) >= box[1]))


def with_bounds(df: DataFrame, geometry: str) -> DataFrame:
    """df with xmin, ymin, xmax and ymax of a geometry of any depth, to be stored beside it."""
    depth = dict(df.dtypes)[geometry].count("array<")
    points: Column = F.col(geometry) if depth else F.array(geometry)
    for _ in range(max(depth - 1, 0)):
        points = F.flatten(points)
    get = lambda c: F.transform(points, lambda p: p[c])
    return df.withColumns({"xmin": F.array_min(get("x")), "ymin": F.array_min(get("y")), "xmax": F.array_max(get("x")), "ymax": F.array_max(get("y"))})


# Ragged arrays are array columns; an empty one is missing.

def ragged_isna(a: Column) -> Column:
    return a.isNull() | (F.size(a) == 0)


def ragged_fillna(a: Column, fill: Column) -> Column:
    return F.when(ragged_isna(a), fill).otherwise(a)


def ragged_unique(df: DataFrame, name: str) -> DataFrame:
    """Distinct lists that aren't missing."""
    return df.select(name).where(~ragged_isna(F.col(name))).distinct()


def ragged_shift(df: DataFrame, name: str, order: str, periods: int = 1) -> DataFrame:
    """Lists moved by some rows of the order; rows that nothing moves to get an empty list. The index is joined with itself, no task sees all rows."""
    from tessera.sources.rowindex import numbered

    rows = numbered(df, [order], "_at")
    moved = rows.select((F.col("_at") + periods).alias("_at"), F.col(name).alias("_moved"))
    empty = F.array().cast(dict(df.dtypes)[name])
    return rows.join(moved, "_at", "left").withColumn(name, F.coalesce("_moved", empty)).drop("_at", "_moved")
