"""Quadrilateral meshes: even, uneven (rectilinear) and curvilinear grids of cells as long tables.

cells(iy, ix, value[, layer]); coordinates as x(ix, x) and y(iy, y), or, curvilinear, per cell as qx, qy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.plans.aggregate import Grid, reduce_pixels


def breaks(centres: list[float]) -> list[float]:
    """Cell edges halfway between centres; the outer ones extrapolated."""
    c = np.asarray(centres, float)
    half = 0.5 * np.diff(c)
    return np.concatenate([[c[0] - half[0]], c[:-1] + half, [c[-1] + half[-1]]]).tolist() if len(c) > 1 else [c[0] - 0.5, c[0] + 0.5]


@dataclass(frozen=True)
class Coordinates:
    """A coordinate vector of a grid: one number per row or column, so it is small and kept on the driver."""

    values: tuple[float, ...]

    @classmethod
    def of(cls, df: DataFrame, index: str, value: str) -> Coordinates:
        return cls(tuple(float(r[0]) for r in df.orderBy(index).select(value).collect()))

    @property
    def bounds(self) -> tuple[float, float]:
        b = breaks(list(self.values))
        return min(b[0], b[-1]), max(b[0], b[-1])

    @property
    def even(self) -> bool:
        d = np.diff(self.values)
        return len(d) == 0 or bool(np.allclose(d, d[0]))

    @property
    def step(self) -> float:
        return abs(self.bounds[1] - self.bounds[0]) / len(self.values)


def _cells(axis_range: tuple[float, float], size: int, coords: Coordinates) -> list[tuple[int, int, int]]:
    """(index, first, last pixel) of the cells along an uneven axis: half-open pixel spans, at least one pixel wide."""
    scaled = (np.asarray(breaks(list(coords.values))) - axis_range[0]) / (axis_range[1] - axis_range[0])
    index = np.arange(len(coords.values))
    if len(scaled) > 1 and scaled[0] > scaled[1]:
        scaled, index = scaled[::-1], index[::-1]
    lo = max(int(np.searchsorted(scaled, 0, "right")) - 1, 0)
    hi = int(np.searchsorted(scaled, 1, "left"))
    edges = np.clip((scaled[lo : hi + 1] * size).astype(int), 0, size)
    out = []
    for k in range(len(edges) - 1):
        a, b = int(edges[k]), int(edges[k + 1])
        b += a == b and b != size
        if b > a:
            out.append((int(index[lo + k]), a, b - 1))
    return out


def _spans(df: DataFrame, name: str, pixel: str, cells: list[tuple[int, int, int]]) -> DataFrame:
    """df with a row for each pixel of each cell along one axis; the axis table is as long as the axis and no longer."""
    spark = df.sparkSession
    table = spark.createDataFrame(cells or [(-1, 0, 0)], "_i int, _a int, _b int")
    return df.join(F.broadcast(table), F.col(name) == F.col("_i")).withColumn(pixel, F.explode(F.sequence("_a", "_b"))).drop("_i", "_a", "_b")


def is_upsample(coords: Coordinates, span: tuple[float, float] | None, size: int) -> bool:
    return size >= len(coords.values) if span is None else coords.step >= abs(span[1] - span[0]) / size


def quadmesh(cells: DataFrame, canvas: Canvas, x: Coordinates, y: Coordinates, agg: R.Reduction | None = None, layer: str | None = None) -> Grid:
    """Aggregate cells on a rectilinear grid. Even grids are resampled by index: both axes up (nearest cell, agg ignored) or both down; else by cell edges."""
    agg = agg or R.mean("value")
    keys = [layer] if layer else []
    up = is_upsample(x, canvas.x_range, canvas.plot_width), is_upsample(y, canvas.y_range, canvas.plot_height)
    linear = canvas.x_axis_type == canvas.y_axis_type == "linear"
    from dataclasses import replace

    canvas = replace(canvas, x_range=canvas.x_range or x.bounds, y_range=canvas.y_range or y.bounds)
    if linear and x.even and y.even and up[0] == up[1] and len(x.values) > 1 and len(y.values) > 1:
        out = cells
        for axis, coords, name, pixel in ((canvas.x, x, "ix", "px"), (canvas.y, y, "iy", "py")):
            out = _spans(out, name, pixel, _even(axis.range, axis.size, coords, up[0]))
        return reduce_pixels(out, canvas, R.max("value") if up[0] else agg, keys)
    out = _spans(cells, "ix", "px", _cells(tuple(map(canvas.x.number, canvas.x.range)), canvas.plot_width, Coordinates(tuple(map(canvas.x.number, x.values)))))
    out = _spans(out, "iy", "py", _cells(tuple(map(canvas.y.number, canvas.y.range)), canvas.plot_height, Coordinates(tuple(map(canvas.y.number, y.values)))))
    return reduce_pixels(out, canvas, agg, keys)


def _even(span: tuple[float, float], size: int, coords: Coordinates, up: bool) -> list[tuple[int, int, int]]:
    """(index, first, last pixel) along an even axis; when going down a cell has one pixel."""
    n = len(coords.values)
    b = breaks(list(coords.values))
    lo, hi = b[0], b[-1]
    cell = (hi - lo) / n
    scale = (span[1] - span[0]) / size / cell
    move = (span[0] - lo) / cell
    if up:
        src = np.floor(scale * (np.arange(size) + 0.5) + move).astype(int)
        return [(int(s), int(p), int(p)) for p, s in enumerate(src) if 0 <= s < n]
    out = []
    for p in range(size):
        a, e = np.floor(scale * p + move), np.floor(scale * (p + 1) + move)
        a, e = (e, a) if scale < 0 and a > e else (a, e)
        out += [(i, p, p) for i in range(max(int(a), 0), min(int(e), n))]
    return out


def corners(cells: DataFrame, name: str) -> DataFrame:
    """(jy, jx, name): corner coordinates of a curvilinear grid from cell centres(iy, ix, name): means of the four cells around, extrapolated linearly beyond the rim.

    Each centre goes to the four corners that it touches; rim cells are mirrored outwards first, so no ordering is needed.
    """
    size = cells.agg((F.max("iy") + 1).alias("h"), (F.max("ix") + 1).alias("w")).first()
    h, w = size["h"], size["w"]

    def padded(df: DataFrame, axis: str, n: int) -> DataFrame:
        """One more line of centres each way: 2 a - b with a the rim and b the line within."""
        other = "ix" if axis == "iy" else "iy"
        parts = df
        for rim, inner, at in ((0, 1, -1), (n - 1, n - 2, n)):
            take = F.when(F.col(axis) == rim, 2 * F.col("c")).when(F.col(axis) == (inner if n > 1 else rim), -F.col("c"))
            parts = parts.unionByName(df.where(F.col(axis).isin(rim, inner)).groupBy(other).agg(F.sum(take).alias("c")).withColumn(axis, F.lit(at)).select("iy", "ix", "c"))
        return parts

    grid = padded(padded(cells.select("iy", "ix", F.col(name).cast("double").alias("c")), "ix", w), "iy", h)
    shifts = F.explode(F.array(*[F.struct((F.col("iy") + a).alias("jy"), (F.col("ix") + b).alias("jx")) for a in (0, 1) for b in (0, 1)]))
    all_ = grid.withColumn("_s", shifts).select("_s.jy", "_s.jx", "c").where(F.col("jy").between(0, h) & F.col("jx").between(0, w))
    return all_.groupBy("jy", "jx").agg((F.sum("c") * 0.25).alias(name))


def curvilinear(cells: DataFrame, canvas: Canvas, agg: R.Reduction | None = None, layer: str | None = None) -> Grid:
    """Aggregate cells(iy, ix, qx, qy, value[, layer]): each quad is filled by an odd-even test at integer corners."""
    agg = agg or R.mean("value")
    centres = cells.select("iy", "ix", "qx", "qy").dropDuplicates(["iy", "ix"])
    corner = corners(centres, "qx").join(corners(centres, "qy"), ["jy", "jx"])
    canvas = canvas.fitted(corner, [F.col("qx")], [F.col("qy")])
    trunc = lambda axis, c: ((axis.column(F.col(c)) - F.lit(axis.number(axis.range[0]))) / F.lit(axis.number(axis.range[1]) - axis.number(axis.range[0])) * F.lit(axis.size)).cast("int")
    corner = corner.select("jy", "jx", trunc(canvas.x, "qx").alias("x"), trunc(canvas.y, "qy").alias("y"))
    near = F.explode(F.array(*[F.struct((F.col("jy") - a).alias("iy"), (F.col("jx") - b).alias("ix"), F.lit(k).alias("k")) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    quads = corner.withColumn("_n", near).groupBy(F.col("_n.iy").alias("iy"), F.col("_n.ix").alias("ix")).agg(
        *[F.max(F.when(F.col("_n.k") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in "xy"], F.count("*").alias("_c")
    ).where("_c = 4")
    t = cells.drop("qx", "qy").join(quads, ["iy", "ix"])
    for c, size in (("x", canvas.plot_width), ("y", canvas.plot_height)):
        vs = [F.col(f"{c}{k}") for k in range(4)]
        t = t.withColumns({f"_{c}0": F.least(*vs), f"_{c}1": F.greatest(*vs)}).where((F.col(f"_{c}0") < size) & (F.col(f"_{c}1") >= 0))
        t = t.withColumns({f"_{c}0": F.greatest(F.col(f"_{c}0"), F.lit(0)), f"_{c}1": F.least(F.col(f"_{c}1"), F.lit(size))})
    thin = (F.col("_x0") == F.col("_x1")) | (F.col("_y0") == F.col("_y1"))
    t = t.withColumn("_thin", thin)
    for c, size in (("x", canvas.plot_width), ("y", canvas.plot_height)):
        wide = F.when(F.col("_thin") & (F.col(f"_{c}0") == F.col(f"_{c}1")) & (F.col(f"_{c}1") < size), F.col(f"_{c}1") + 1).otherwise(F.col(f"_{c}1"))
        t = t.withColumn(f"_{c}1", wide).where(F.col(f"_{c}0") < F.col(f"_{c}1")).withColumn(f"p{c}", F.explode(F.sequence(F.col(f"_{c}0"), F.col(f"_{c}1") - 1)))
    hits: Column = F.lit(0)
    for k in range(4):
        j = (k + 1) % 4
        x0, y0, x1, y1 = F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"x{j}"), F.col(f"y{j}")
        ax, ay, bx, by = x0 - F.col("px"), y0 - F.col("py"), x1 - F.col("px"), y1 - F.col("py")
        crosses = ((y0 > F.col("py")) != (y1 > F.col("py"))) & ~((ax < 0) & (bx < 0)) & ((bx * ay - by * ax) * F.signum(y1 - y0) < 0)
        hits = hits + crosses.cast("int")
    return reduce_pixels(t.where(F.col("_thin") | (hits % 2 == 1)), canvas, agg, [layer] if layer else [])
