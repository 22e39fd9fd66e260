"""Polygons with holes and parts: non-zero winding numbers at pixel centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.plans.aggregate import Grid, reduce_pixels
from tessera.sources.dealing import SHAPES, dealt


def _edges(canvas: Canvas) -> Column:
    """Edges of all rings as array<struct<x0, y0, x1, y1, up>> in float pixel coordinates, lower end first; level ones are left out."""
    place = lambda p: F.struct(canvas.x.centre(p["x"]).cast("float").alias("x"), canvas.y.centre(p["y"]).cast("float").alias("y"))

    def of_ring(ring: Column) -> Column:
        pts = F.transform(ring, place)
        n = F.size(pts)
        both = F.zip_with(F.slice(pts, 1, F.greatest(n - 1, F.lit(0))), F.slice(pts, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        up = F.filter(both, lambda e: e["a"]["y"] != e["b"]["y"])

        def sorted_edge(e: Column) -> Column:
            rises = e["b"]["y"] > e["a"]["y"]
            low, high = F.when(rises, e["a"]).otherwise(e["b"]), F.when(rises, e["b"]).otherwise(e["a"])
            return F.struct(low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"), F.when(rises, 1).otherwise(-1).alias("up"))

        return F.transform(up, sorted_edge)

    return F.flatten(F.transform("_rings", of_ring))


def _crossing(e: Column, xi: Column, yi: Column) -> Column:
    """What an edge adds to the winding number of the pixel centre (xi, yi): its direction, if it lies to the right."""
    ax, ay = e["x0"] - xi, e["y0"] - yi
    bx, by = e["x1"] - xi, e["y1"] - yi
    cross = bx * ay - by * ax
    right = ((ax >= 0) & (bx >= 0)) | (cross < 0) | ((cross == 0) & (e["up"] > 0))
    return F.when((ay < 0) & (by >= 0) & ~((ax < 0) & (bx < 0)) & right, e["up"]).otherwise(0)


def polygons(source: DataFrame, canvas: Canvas, geometry: str, agg: R.Reduction | None = None, order: str | None = None) -> Grid:
    """Fill polygons: array<array<array<struct<x, y>>>> (parts, rings, points) or one level less; parts count one by one. Rings must be closed.

    Bounding boxes are clipped to the canvas before anything is exploded, rows before columns, and a row keeps only the
    edges that cross it.
    """
    agg = agg or R.any()
    if order is not None:
        source = source.withColumn(R.ORDER, F.col(order).cast("long"))
    deep = dict(source.dtypes)[geometry].count("array<") == 3
    source = dealt(source, SHAPES)
    parts = source.withColumn("_rings", F.explode(geometry) if deep else F.col(geometry))
    points = F.flatten("_rings")

    def coordinates(c: str) -> Column:
        return F.transform(points, lambda p: p[c].cast("double"))

    box = {f"_{c}{k}": f(coordinates(c)) for c in "xy" for k, f in (("a", F.array_min), ("b", F.array_max))}
    parts = parts.withColumns(box)
    canvas = canvas.fitted(parts, [F.col("_xa"), F.col("_xb")], [F.col("_ya"), F.col("_yb")])
    (xa, xb), (ya, yb) = ([F.lit(float(v)) for v in r] for r in (canvas.x.range, canvas.y.range))
    seen = parts.where(~((F.col("_xb") < xa) | (F.col("_xa") > xb) | (F.col("_yb") < ya) | (F.col("_ya") > yb)))
    seen = seen.withColumns({
        "_x0": canvas.x.vertex(F.greatest(F.col("_xa"), xa)), "_x1": canvas.x.vertex(F.least(F.col("_xb"), xb)),
        "_y0": canvas.y.vertex(F.greatest(F.col("_ya"), ya)), "_y1": canvas.y.vertex(F.least(F.col("_yb"), yb)), "_edges": _edges(canvas),
    })
    thin = (F.col("_x0") == F.col("_x1")) | (F.col("_y0") == F.col("_y1"))
    rows = seen.withColumn("_thin", thin).where("_y0 <= _y1 and _x0 <= _x1").withColumn("py", F.explode(F.sequence("_y0", "_y1")))
    yi = F.col("py").cast("float")
    rows = rows.withColumn("_edges", F.filter("_edges", lambda e: (e["y0"] < yi) & (e["y1"] >= yi))).where(F.col("_thin") | (F.size("_edges") > 0))
    cells = rows.withColumn("px", F.explode(F.sequence("_x0", "_x1")))
    xi = F.col("px").cast("float")
    winding = F.aggregate("_edges", F.lit(0), lambda n, e: n + _crossing(e, xi, yi))
    inside = cells.where(F.col("_thin") | (winding != 0)).where(F.col("px").between(0, canvas.plot_width - 1) & F.col("py").between(0, canvas.plot_height - 1))
    return reduce_pixels(inside, canvas, agg)
