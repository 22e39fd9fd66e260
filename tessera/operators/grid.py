"""Operations on sparse grids (py, px[, cat], value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = ("mean", "sum", "max", "min", "median", "std", "var")


def downsample(grid: DataFrame, factor: int, how: str = "mean", value: str = "value") -> DataFrame:
    """Blocks of factor x factor pixels become one."""
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    v = F.col(value).cast("double")
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median, "std": F.stddev_pop, "var": F.var_pop}[how](v)
    return grid.groupBy(F.floor(F.col("py") / factor).cast("int").alias("py"), F.floor(F.col("px") / factor).cast("int").alias("px")).agg(agg.alias(value))


def masked(grid: DataFrame, condition: Column) -> DataFrame:
    """Pixels for which the condition holds."""
    return grid.where(condition)


def over_layers(grid: DataFrame, layer: str = "cat", only: list | None = None, value: str = "value") -> DataFrame:
    """Sum over (some) layers; a pixel in which all are missing stays missing."""
    some = grid.where(F.col(layer).isin(only)) if only is not None else grid
    return some.groupBy("py", "px").agg(F.sum(value).alias(value)).where(F.col(value).isNotNull())


def percentile(grid: DataFrame, q: float, value: str = "value") -> DataFrame:
    """Pixels at or above a percentile of the grid's values."""
    cut = grid.agg(F.percentile(F.col(value), q).alias("_q"))
    return grid.join(F.broadcast(cut), F.col(value) >= F.col("_q")).drop("_q")


def value_ramp(grid: DataFrame, how: str = "linear", num: int = 180, value: str = "value") -> list[float]:
    """num values from the least to the largest, evenly spaced or logarithmically."""
    if how not in ("linear", "log"):
        raise ValueError("how must be linear or log")
    import numpy as np

    lo, hi = grid.agg(F.min(value), F.max(value)).first()
    if how == "log":
        return np.logspace(0, np.log1p(hi - lo), base=np.e, num=num).tolist()
    return np.linspace(lo, hi, num).tolist()


def flip_rows(grid: DataFrame, height: int) -> DataFrame:
    return grid.withColumn("py", (F.lit(height - 1) - F.col("py")).cast("int"))
