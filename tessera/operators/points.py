"""Points and multipoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas, check_numeric
from tessera.plans.aggregate import Grid, needed, reduce_pixels


def points(source: DataFrame, canvas: Canvas, x: str = "x", y: str = "y", agg: R.Reduction | None = None, geometry: str | None = None, order: str | None = None) -> Grid:
    """One pixel for each point inside the canvas; a geometry column holds a struct<x, y> or an array of them."""
    agg = agg or R.count()
    if geometry is not None:
        kind = dict(source.dtypes)[geometry]
        at = F.explode(geometry) if kind.startswith("array") else F.col(geometry)
        source = source.withColumn("_p", at).withColumn("_px", F.col("_p.x")).withColumn("_py", F.col("_p.y"))
        x, y = "_px", "_py"
    check_numeric(source, [x], "x")
    check_numeric(source, [y], "y")
    rows = needed(source, [x, y], agg, order)
    canvas = canvas.fitted(rows, [F.col(x)], [F.col(y)])
    inside = rows.where(canvas.x.inside(F.col(x)) & canvas.y.inside(F.col(y)))
    hit = inside.withColumn("px", canvas.x.pixel(F.col(x))).withColumn("py", canvas.y.pixel(F.col(y)))
    return reduce_pixels(hit, canvas, agg)
