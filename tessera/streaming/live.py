"""Grids over streams: pixels are mergeable aggregates, so a fixed canvas works in update or complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.plans.aggregate import needed


def live_points(stream: DataFrame, canvas: Canvas, x: str, y: str, agg: R.Reduction | None = None, time: str | None = None, late: str = "10 minutes", every: str | None = None) -> DataFrame:
    """A streaming grid of points; the canvas must have ranges. With `every`, one grid for each time window, dropped from state once `late` has passed."""
    agg = agg or R.count()
    if agg.ordered or isinstance(agg, (R.by, R.summary, R.Ranked)):
        raise ValueError("streams take reductions that don't go by row order")
    keep = needed(stream, [x, y, *([time] if time else [])], agg, None)
    if time:
        keep = keep.withWatermark(time, late)
    inside = keep.where(canvas.x.inside(F.col(x)) & canvas.y.inside(F.col(y)))
    hit = inside.withColumn("px", canvas.x.pixel(F.col(x))).withColumn("py", canvas.y.pixel(F.col(y)))
    keys = ["py", "px"] + ([F.window(time, every)] if time and every else [])
    return hit.groupBy(*keys).agg(agg.aggregate().alias("value"))
