"""Map tiles of many zoom levels in one aggregation a level."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.functions.geo import Tiling
from tessera.functions.shipping import ship
from tessera.plans.aggregate import needed, reduce_pixels

#: Largest side of a super tile in pixels.
SUPER = 4096


def super_tiles(tiling: Tiling, extent: tuple[float, float, float, float], z: int) -> list[tuple[int, int, int]]:
    """(z, column, row) of the blocks of tiles that are rendered together."""
    side = min(SUPER, tiling.tile_size * 2**z) // tiling.tile_size
    return sorted({(z, tx // side, ty // side) for tx, ty, _, _ in tiling.tiles(extent, z)})


def tile_grid(points: DataFrame, tiling: Tiling, levels: list[int], x: str = "x", y: str = "y", agg: R.Reduction | None = None, order: str | None = None) -> DataFrame:
    """(z, tx, ty, py, px, value): pixels of the tiles of every level, in one pass; py counts from a tile's top."""
    agg = agg or R.count()
    rows = needed(points, [x, y], agg, order)
    rows = rows.where(F.col(x).between(*tiling.x_range) & F.col(y).between(*tiling.y_range)).withColumn("z", F.explode(F.array(*[F.lit(z) for z in levels])))
    scale = {z: 1 / tiling.resolution(z) for z in levels}
    per = F.element_at(F.create_map(*[F.lit(v) for z, s in scale.items() for v in (z, s)]), F.col("z"))
    n = F.lit(tiling.tile_size).cast("long") * F.pow(F.lit(2.0), F.col("z")).cast("long")
    gx = F.least(F.floor((F.col(x) - F.lit(tiling.x_range[0])) * per), n - 1)
    gy = F.least(F.floor((F.col(y) - F.lit(tiling.y_range[0])) * per), n - 1)
    down = n - 1 - gy
    size = tiling.tile_size
    keyed = rows.withColumns({
        "tx": F.floor(gx / size).cast("int"), "ty": F.floor(down / size).cast("int"), "px": (gx % size).cast("int"), "py": (down % size).cast("int"),
    })
    canvas = Canvas(size, size, (0.0, 1.0), (0.0, 1.0))
    return reduce_pixels(keyed, canvas, agg, ["z", "tx", "ty"]).df


def level_stats(grid: DataFrame, value: str = "value") -> dict[int, tuple[float, float]]:
    """Least and largest value of each level, over all of its tiles."""
    return {r["z"]: (r["lo"], r["hi"]) for r in grid.groupBy("z").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}


def shade_tiles(grid: DataFrame, cmap=("lightblue", "darkblue"), how: str = "log") -> DataFrame:
    """(z, tx, ty, py, px, rgba): each level coloured over its own span, so that tiles match along their edges."""
    from tessera.functions.colors import color_map, pack
    from tessera.operators.shade import _curve

    spans = grid.groupBy("z").agg(F.min("value").cast("double").alias("_lo"), F.max("value").cast("double").alias("_hi"))  # one row a level
    both = grid.join(F.broadcast(spans), "z")
    top = _curve(how, F.col("_hi") - F.col("_lo"))
    part = F.coalesce(_curve(how, F.col("value") - F.col("_lo")) / F.nullif(top, F.lit(0.0)), F.lit(0.0))
    colors = color_map(cmap)
    at = part * (len(colors) - 1)
    low = F.least(F.floor(at), F.lit(max(len(colors) - 2, 0))).cast("int")

    def channel(n: int):  # noqa: ANN202
        table = F.array(*[F.lit(float(c[n])) for c in colors])
        a, b = F.element_at(table, low + 1), F.element_at(table, F.least(low + 2, F.lit(len(colors))))
        return a + (b - a) * (at - low)

    return both.select("z", "tx", "ty", "py", "px", pack(channel(0), channel(1), channel(2), F.lit(255)).alias("rgba"))


def to_pngs(image: DataFrame, size: int = 256, post: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(z, tx, ty, png) of (z, tx, ty, py, px, rgba); a group is one tile, size x size pixels at most."""
    from tessera.sources.images import png

    ship(image.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size, 4), np.uint8)
        packed = pdf["rgba"].to_numpy(np.int64)
        for n in range(4):
            out[pdf["py"], pdf["px"], n] = packed >> (8 * n) & 255
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "tx": [pdf["tx"].iloc[0]], "ty": [pdf["ty"].iloc[0]], "png": [png(post(out) if post else out)]})

    return image.groupBy("z", "tx", "ty").applyInPandas(one, "z int, tx int, ty int, png binary")


def write_tiles(pngs: DataFrame, path: str) -> None:
    """{path}/{z}/{x}/{y}.png through Spark's file systems; tiles stream to the driver one partition at a time and are written from there."""
    from tessera.sources.images import write_bytes

    for r in pngs.toLocalIterator():
        write_bytes(pngs, f"{path}/{r['z']}/{r['tx']}/{r['ty']}.png", bytes(r["png"]))


def render_tiles(points: DataFrame, levels: list[int], path: str, tiling: Tiling | None = None, agg: R.Reduction | None = None, how: str = "log", cmap=("lightblue", "darkblue"),
                 post: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[int, tuple[float, float]]:
    """Aggregate, colour by each level's span, and write tiles; gives the spans."""
    tiling = tiling or Tiling()
    grid = tile_grid(points, tiling, levels, agg=agg)
    write_tiles(to_pngs(shade_tiles(grid, cmap, how), tiling.tile_size, post), path)
    return level_stats(grid)
