"""Spreading: each pixel is copied onto a mask around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.canvas import known
from tessera.functions.colors import channel
from tessera.operators.composite import ARRAY, IMAGE, combine


def mask(px: int, shape: str = "circle") -> list[tuple[int, int]]:
    """Offsets (dy, dx), row by row."""
    if px < 0:
        raise ValueError("px can't be negative")
    if shape not in ("circle", "square"):
        raise ValueError(f"unknown shape {shape!r}")
    r = range(-px, px + 1)
    return [(dy, dx) for dy in r for dx in r if shape == "square" or (dy * dy + dx * dx) ** 0.5 <= px + 0.5]


def spread(grid: DataFrame, shape: tuple[int, int], px: int = 1, form: str = "circle", how: str | None = None, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Dilate an image (py, px, rgba; default over) or a grid (py, px, value; default add) of `shape` (height, width).

    add, max and min are plain aggregates. The order in which others meet matters: sources row by row, then the mask.
    """
    image = "rgba" in grid.columns
    how = how or ("over" if image else "add")
    if how not in (IMAGE if image else ARRAY):
        raise ValueError(f"unknown operator {how!r}")
    cells = offsets if offsets is not None else mask(px, form)
    at = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(cells)]))
    name = "rgba" if image else "value"
    there = channel(F.col("rgba"), 3) > 0 if image else known(F.col("value").cast("double")).isNotNull()
    out = grid.where(there).withColumn("_o", at).select(
        (F.col("py") + F.col("_o.dy")).alias("py"), (F.col("px") + F.col("_o.dx")).alias("px"), F.col("py").alias("_y"), F.col("px").alias("_x"), F.col("_o.k").alias("_k"), name
    ).where(F.col("py").between(0, shape[0] - 1) & F.col("px").between(0, shape[1] - 1))
    if not image and how != "source":
        return out.groupBy("py", "px").agg({"add": F.sum, "max": F.max, "min": F.min}[how]("value").alias("value"))
    if how == "source":
        return out.groupBy("py", "px").agg(F.max_by(name, F.struct("_y", "_x", "_k")).alias(name))
    # at most one entry a mask cell
    met = out.groupBy("py", "px").agg(F.array_sort(F.collect_list(F.struct("_y", "_x", "_k", "rgba"))).alias("_l"))
    folded = F.aggregate("_l", F.lit(0).cast("long"), lambda d, s: combine(s["rgba"], d, how))
    return met.select("py", "px", folded.alias("rgba"))


def density(grid: DataFrame, radius: int = 2) -> float:
    """Share of occupied pixels that have another one within `radius` (both ways); infinite for an empty grid."""
    image = "rgba" in grid.columns
    there = channel(F.col("rgba"), 3) > 0 if image else known(F.col("value").cast("double")).isNotNull() & (F.col("value") != 0)
    own = grid.where(there).select("py", "px")
    r = range(-radius, radius + 1)
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in r for b in r if (a, b) != (0, 0)]))
    around = own.withColumn("_o", at).select((F.col("py") + F.col("_o.a")).alias("py"), (F.col("px") + F.col("_o.b")).alias("px")).distinct()
    total = own.count()
    return own.join(around, ["py", "px"], "left_semi").count() / total if total else float("inf")


def dynspread(grid: DataFrame, shape: tuple[int, int], threshold: float = 0.5, max_px: int = 3, form: str = "circle", how: str | None = None) -> DataFrame:
    """Spread by one pixel less than the first radius at which pixels are dense enough, by max_px at most."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be from 0 to 1")
    if max_px < 0:
        raise ValueError("max_px can't be negative")
    px = 0
    for px in range(1, max_px + 1):
        if density(grid, 2 * px) > threshold:
            px -= 1
            break
    return spread(grid, shape, px, form, how) if px else grid
