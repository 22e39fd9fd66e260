"""Raster resampling: cells(iy, ix, value[, layer]) of an even grid onto a canvas.

Rows and columns are resampled by small per-axis tables (one row for each overlap of a source and an output cell) that are
joined to the cells; their length is that of the axis, not of the data. Downsampling is an aggregate over overlaps weighted by their area.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.canvas import Canvas, known
from tessera.operators.quadmesh import Coordinates
from tessera.plans.aggregate import Grid

TINY = 1e-10
DOWN = ("first", "last", "min", "max", "mode", "mean", "var", "std")
UP = ("nearest", "linear")


def overlaps(n: int, m: int) -> list[tuple[int, int, float]]:
    """(output, source, weight): what each of m output cells covers of n source cells."""
    scale = n / m
    out = []
    for o in range(m):
        a, b = scale * o, scale * o + scale
        first, last = int(a), int(b)
        w0, w1 = 1.0 - (a - first), b - last
        if w1 < TINY:
            w1 = 1.0
            last -= last > first
        for s in range(first, min(last, n - 1) + 1):
            out.append((o, s, w0 if s == first else w1 if s == last else 1.0))
    return out


def taps(n: int, m: int) -> list[tuple[int, int, int, float]]:
    """(output, source, next source, fraction) for linear interpolation of n cells to m."""
    scale = (n - 1.0) / (m - 1.0 if m > 1 else 1.0)
    return [(o, int(scale * o), min(int(scale * o) + 1, n - 1), scale * o - int(scale * o)) for o in range(m)]


def _axis(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def resample(cells: DataFrame, shape: tuple[int, int], size: tuple[int, int], down: str = "mean", up: str = "linear", layer: str | None = None, mode_rank: int = 1) -> DataFrame:
    """(py, px[, layer], value): cells (h, w) onto (H, W). Axes that grow are interpolated after those that shrink are aggregated; a null or NaN value is missing."""
    if down not in DOWN or up not in UP:
        raise ValueError(f"unknown method {down!r} or {up!r}")
    (h, w), (out_h, out_w) = shape, size
    keys = [layer] if layer else []
    df = cells.select(*keys, "iy", "ix", known(F.col("value")).alias("value"))
    shrink_y, shrink_x = out_h < h, out_w < w
    if shrink_y or shrink_x:
        df = _down(df, (h, w), (out_h if shrink_y else h, out_w if shrink_x else w), down, keys, mode_rank)
        df = df.withColumnsRenamed({"py": "iy", "px": "ix"})
        h, w = (out_h if shrink_y else h), (out_w if shrink_x else w)
    if (h, w) != (out_h, out_w):
        df = _up(df, (h, w), (out_h, out_w), up, keys).withColumnsRenamed({"py": "iy", "px": "ix"})
    return df.withColumnsRenamed({"iy": "py", "ix": "px"}).where("value is not null")


def _down(df: DataFrame, shape: tuple[int, int], size: tuple[int, int], how: str, keys: list[str], mode_rank: int) -> DataFrame:
    ys, xs = _axis(df, overlaps(shape[0], size[0]), "py int, iy int, wy double"), _axis(df, overlaps(shape[1], size[1]), "px int, ix int, wx double")
    each = df.where("value is not null").join(ys, "iy").join(xs, "ix").withColumn("_w", F.col("wy") * F.col("wx"))
    group = [*keys, "py", "px"]
    v, wt, at = F.col("value"), F.col("_w"), F.struct("iy", "ix")
    if how == "mode":
        # frequencies count whole cells: each overlap's weight is truncated, as long as the first isn't added to
        freq = each.groupBy(*group, "value").agg(F.sum(F.floor(wt)).alias("_f"), F.min(at).alias("_at"))
        best = Window.partitionBy(*group).orderBy(F.desc("_f"), "_at")
        return freq.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == mode_rank).select(*group, "value")
    total, s1, s2 = F.sum(wt), F.sum(wt * v), F.sum(wt * v * v)
    spread = F.greatest((s2 * total - s1 * s1) / total / total, F.lit(0.0))
    aggs: dict[str, Column] = {
        "first": F.min_by(v, at), "last": F.max_by(v, at), "min": F.min(v), "max": F.max(v),
        "mean": s1 / F.nullif(total, F.lit(0.0)), "var": spread, "std": F.sqrt(spread),
    }
    return each.groupBy(*group).agg(aggs[how].alias("value"))


def _up(df: DataFrame, shape: tuple[int, int], size: tuple[int, int], how: str, keys: list[str]) -> DataFrame:
    if how == "nearest":
        near = lambda n, m: [(o, int(n / m * o)) for o in range(m)]
        ys, xs = _axis(df, near(shape[0], size[0]), "py int, iy int"), _axis(df, near(shape[1], size[1]), "px int, ix int")
        return df.join(ys, "iy").join(xs, "ix").select(*keys, "py", "px", "value")
    rows = lambda n, m: [(o, i, k, f) for o, a, b, f in taps(n, m) for k, i in enumerate((a, b))]
    ys, xs = _axis(df, rows(shape[0], size[0]), "py int, iy int, ky int, fy double"), _axis(df, rows(shape[1], size[1]), "px int, ix int, kx int, fx double")
    each = df.join(ys, "iy").join(xs, "ix")
    pick = {f"v{a}{b}": F.max(F.when((F.col("ky") == a) & (F.col("kx") == b), F.col("value"))) for a in (0, 1) for b in (0, 1)}
    four = each.groupBy(*keys, "py", "px").agg(*[c.alias(n) for n, c in pick.items()], F.max("fy").alias("fy"), F.max("fx").alias("fx"))
    top = F.col("v00") + F.col("fx") * (F.col("v01") - F.col("v00"))
    low = F.col("v10") + F.col("fx") * (F.col("v11") - F.col("v10"))
    left = F.when(F.col("fy") < 0.5, F.col("v00")).otherwise(F.col("v10"))
    right = F.when(F.col("fy") < 0.5, F.col("v01")).otherwise(F.col("v11"))
    value = F.coalesce(top + F.col("fy") * (low - top), F.when(F.col("fx") < 0.5, left).otherwise(right))
    return four.select(*keys, "py", "px", value.alias("value"))


@dataclass(frozen=True)
class Window1:
    """Along one axis: the source cells that the canvas shows, the output cells they fill, and where these start."""

    first: int
    last: int
    size: int
    offset: int


def window(span: tuple[float, float], pixels: int, coords: Coordinates) -> Window1:
    """What of a source axis (ascending) a canvas range shows."""
    lo, hi = coords.bounds
    a, b = max(span[0], lo), min(span[1], hi)
    ratio = min((b - a) / (span[1] - span[0]), 1.0)
    if ratio <= 0 or math.isclose(ratio, 0, abs_tol=1e-8):
        raise ValueError("the canvas ranges don't overlap the source enough to rasterize it")
    n, step = len(coords.values), coords.step
    size = max(int(round(pixels * ratio)), 1)
    first = min(max(int(math.floor((a - lo) / step + TINY)), 0), n - 1)
    last = min(max(int(math.ceil((b - lo) / step - TINY)) - 1, first), n - 1)
    before, after = a - span[0], span[1] - b
    part = before / (before + after) if before + after > 0 else 0.0
    return Window1(first, last, size, max(int(math.ceil((pixels - size) * part)), 0))


def raster(cells: DataFrame, canvas: Canvas, x: Coordinates, y: Coordinates, upsample_method: str = "linear", downsample_method: str = "mean",
           nan_value: float | None = None, layer: str | None = None, select_layer: object = None, mode_rank: int = 1) -> Grid:
    """Resample onto the canvas; pixels outside the source stay empty. Coordinates may descend. select_layer keeps one layer; otherwise every layer is resampled."""
    if select_layer is not None and layer:
        cells = cells.where(F.col(layer) == F.lit(select_layer))
    out = cells
    if nan_value is not None:
        out = out.withColumn("value", F.nullif(F.col("value").cast("double"), F.lit(float(nan_value))))
    sides = {}
    for name, coords in (("ix", x), ("iy", y)):
        n = len(coords.values)
        if n > 1 and coords.values[0] > coords.values[-1]:
            out = out.withColumn(name, n - 1 - F.col(name))
        sides[name] = Coordinates(tuple(sorted(coords.values)))
    canvas = replace(canvas, x_range=canvas.x_range or sides["ix"].bounds, y_range=canvas.y_range or sides["iy"].bounds)
    wx, wy = window(canvas.x.range, canvas.plot_width, sides["ix"]), window(canvas.y.range, canvas.plot_height, sides["iy"])
    out = out.where(F.col("ix").between(wx.first, wx.last) & F.col("iy").between(wy.first, wy.last))
    out = out.withColumns({"ix": F.col("ix") - wx.first, "iy": F.col("iy") - wy.first})
    done = resample(out, (wy.last - wy.first + 1, wx.last - wx.first + 1), (wy.size, wx.size), downsample_method, upsample_method, layer, mode_rank)
    done = done.withColumns({"px": (F.col("px") + wx.offset).cast("int"), "py": (F.col("py") + wy.offset).cast("int")})
    return Grid(done, canvas, {"value": None}, {layer: []} if layer else {})
