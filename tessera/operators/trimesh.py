"""Triangle meshes: flat or linearly interpolated, with a fill rule that draws shared edges once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.plans.aggregate import Grid, reduce_pixels


def mesh(vertices: DataFrame, simplices: DataFrame, position: str = "vertex_pos", weight: str | None = None, simplex_weight: str | None = None) -> DataFrame:
    """Triangles (ax, ay, bx, by, cx, cy, w0, w1, w2) by three joins of simplices(v0, v1, v2) on vertex position.

    Weights come from the vertices' `weight` column, or else from the simplices' one. Triangles are turned clockwise if
    the first of them (smallest v0, v1, v2) isn't.
    """
    out = simplices
    for i, c in enumerate("abc"):
        cols = [F.col(position).alias(f"_{c}"), F.col("x").cast("double").alias(f"{c}x"), F.col("y").cast("double").alias(f"{c}y")]
        cols += [F.col(weight).cast("double").alias(f"w{i}")] if weight else []
        out = out.join(vertices.select(*cols), F.col(f"v{i}") == F.col(f"_{c}"))
    if not weight:
        w = F.col(simplex_weight).cast("double") if simplex_weight else F.lit(1.0)
        out = out.withColumns({f"w{i}": w for i in range(3)})
    first = out.orderBy(*[c for c in ("tri_pos",) if c in out.columns], "v0", "v1", "v2").first()
    if first and (first["cx"] - first["ax"]) * (first["by"] - first["ay"]) - (first["cy"] - first["ay"]) * (first["bx"] - first["ax"]) < 0:
        out = out.withColumns({"bx": F.col("cx"), "by": F.col("cy"), "cx": F.col("bx"), "cy": F.col("by"), "w1": F.col("w2"), "w2": F.col("w1")})
    return out.drop("_a", "_b", "_c")


def _edge(a: str, b: str, x: Column, y: Column) -> Column:
    ax, ay, bx, by = (F.col(f"{v}{c}") for v in (a, b) for c in "xy")
    return (x - ax) * (by - ay) - (y - ay) * (bx - ax)


def trimesh(triangles: DataFrame, canvas: Canvas, agg: R.Reduction | None = None, interpolate: bool = True) -> Grid:
    """Aggregate the triangles of mesh(): `value` is interpolated between w0, w1 and w2, or their mean. agg reads the column value."""
    agg = agg or R.mean("value")
    canvas = canvas.fitted(triangles, [F.col(f"{v}x") for v in "abc"], [F.col(f"{v}y") for v in "abc"])
    t = triangles.withColumns({f"{v}{c}": getattr(canvas, c).centre(F.col(f"{v}{c}")) for v in "abc" for c in "xy"})
    for c in "xy":
        axis = getattr(canvas, c)
        lo, hi = (axis.number(v) * axis.scale + axis.shift - 0.5 for v in axis.range)
        size = round((axis.range[1] - axis.range[0]) * axis.scale) - 1 if axis.kind == "linear" else axis.size - 1
        t = t.withColumns({"_lo": F.least(*[f"{v}{c}" for v in "abc"]), "_hi": F.greatest(*[f"{v}{c}" for v in "abc"])})
        t = t.where((F.col("_lo") < hi) & (F.col("_hi") >= lo))
        t = t.withColumns({
            f"_{c}0": F.greatest(F.floor(F.greatest(F.col("_lo"), F.lit(lo)) + 0.5), F.lit(0)).cast("int"),
            f"_{c}1": F.least(F.floor(F.least(F.col("_hi"), F.lit(hi)) + 0.5), F.lit(size)).cast("int"),
        })
    dot = (F.col("_x0") == F.col("_x1")) & (F.col("_y0") == F.col("_y1"))
    t = t.withColumn("_dot", dot).where("_x0 <= _x1 and _y0 <= _y1")
    t = t.withColumn("py", F.explode(F.sequence("_y0", "_y1"))).withColumn("px", F.explode(F.sequence("_x0", "_x1")))
    x, y = F.col("px").cast("double"), F.col("py").cast("double")
    t = t.withColumns({"g2": _edge("a", "b", x, y), "g0": _edge("b", "c", x, y), "g1": _edge("c", "a", x, y), "_area": _edge("a", "b", F.col("cx"), F.col("cy"))})

    def own(g: str, a: str, b: str) -> Column:
        ax, ay, bx, by = (F.col(f"{v}{c}") for v in (a, b) for c in "xy")
        open_ = (ay < by) | ((ay == by) & (ax < bx))
        return (F.col(g) > 0) | (~open_ & (F.col(g) == 0))

    # the second test goes by the edge b-c, the third by c-a
    inside = own("g2", "a", "b") & own("g0", "b", "c") & own("g1", "c", "a")
    flat = (F.col("w0") + F.col("w1") + F.col("w2")) / 3
    value = flat
    if interpolate:
        mixed = (F.col("g0") * F.col("w0") + F.col("g1") * F.col("w1") + F.col("g2") * F.col("w2")) / F.nullif("_area", F.lit(0.0))
        value = F.when(F.col("_dot"), flat).otherwise(mixed)
    return reduce_pixels(t.where(F.col("_dot") | inside).withColumn("value", value), canvas, agg)
