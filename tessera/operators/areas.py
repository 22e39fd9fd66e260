"""Filled areas: to zero, or to a second line (stacked, where the lower edge's pixels are left to the area below)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas, known
from tessera.operators import segments as S
from tessera.plans.aggregate import Grid, reduce_spans
from tessera.sources.dealing import SHAPES, dealt


def _clamped(a: Column, b: Column, top: int, stacked: bool) -> tuple[Column, Column, Column]:
    """(draw?, first, last) pixel of a column that runs from a's edge to b's."""
    outside = ((a < 0) & (b <= 0)) | ((a > top) & (b >= top))
    lo = F.greatest(F.lit(0), F.least(F.lit(top), a))
    hi = F.greatest(F.lit(-1), F.least(F.lit(top + 1), b))
    step = F.signum(hi - lo).cast("int")
    if stacked:
        return ~outside & (lo != hi), lo, hi - step
    further = (step != 0) & (hi + step).between(-1, top + 1)
    return ~outside, lo, F.when(step == 0, lo).when(further, hi).otherwise(hi - step)


def fill(traps: DataFrame, canvas: Canvas, stacked: bool) -> DataFrame:
    """A row for each column of trapezoids (x0, x1, top0, low0, top1, low1, start): along x, px and pixels _lo to _hi between two Bresenham edges in closed form."""
    ya, yb = (F.lit(float(v)) for v in canvas.y.range)
    edges = ["top0", "low0", "top1", "low1"]
    out = traps
    for c in ("x0", "x1", *edges):
        out = out.where(known(F.col(c)).isNotNull())
    t0, t1, level = S.clip_span((F.col("x0"), F.col("x1") - F.col("x0"), canvas.x.range))
    out = out.where(~(F.least(*edges) > yb) & ~(F.greatest(*edges) < ya) & level).withColumns({"_t0": t0, "_t1": t1})
    out = S.settled(out, ["_t0", "_t1"]).where("_t0 <= _t1")
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    late, early = F.col("_t0") > 0, F.col("_t1") < 1
    pairs = (("x0", "x1"), ("top0", "top1"), ("low0", "low1"))
    moved = {b: F.when(early, at(a, b, "_t1")).otherwise(F.col(b)) for a, b in pairs} | {a: F.when(late, at(a, b, "_t0")).otherwise(F.col(a)) for a, b in pairs}
    out = out.withColumns(moved | {"cut0": late, "cut1": early})
    xi, yi = canvas.x.vertex, canvas.y.vertex
    out = S.settled(out, ["x0", "x1", *edges, "cut0", "cut1"])
    out = out.withColumns({"_x0": xi(F.col("x0")), "_x1": xi(F.col("x1"))} | {f"_{c}": yi(F.col(c)) for c in edges})
    out = S.settled(out, ["_x0", "_x1", *[f"_{c}" for c in edges]])
    run = F.abs(F.col("_x1") - F.col("_x0")).cast("long")
    first = F.when(F.col("start") | F.col("cut0"), 0).otherwise(1)
    # a segment without width has its far edge as one more column, unless it was cut
    last = F.when((run == 0) & ~(F.col("cut0") | F.col("cut1")), 1).otherwise(run)
    out = out.withColumns({"_run": run, "_k0": first.cast("long"), "_k1": last.cast("long")})
    out = S.settled(out, ["_run", "_k0", "_k1"]).withColumn("_k", F.explode(F.when(F.col("_k0") <= F.col("_k1"), F.sequence("_k0", "_k1"))))
    back = F.col("_x1") < F.col("_x0")

    def edge(a: str, b: str) -> Column:
        d = F.col(b) - F.col(a)
        along = F.col(a) + F.signum(d).cast("long") * S.offset(F.abs(d).cast("long"), F.col("_k"), F.col("_run"), back)
        return F.when((F.col("_run") == 0) & (F.col("_k") == 1), F.col(b)).otherwise(F.when(F.col("_k") == 0, F.col(a)).otherwise(along)).cast("int")

    px = (F.col("_x0") + F.signum(F.col("_x1") - F.col("_x0")).cast("long") * F.col("_k")).cast("int")
    out = S.settled(out.withColumns({"px": px, "_a": edge("_top0", "_top1"), "_b": edge("_low0", "_low1")}), ["px", "_a", "_b"]).where(F.col("px").between(0, canvas.plot_width - 1))
    draw, lo, hi = _clamped(F.col("_a"), F.col("_b"), canvas.plot_height - 1, stacked)
    return out.where(draw).withColumns({"_lo": F.least(lo, hi), "_hi": F.greatest(lo, hi)})


def area(source: DataFrame, canvas: Canvas, x: str | Sequence[str] | Sequence[float], y: str | Sequence[str] | Sequence[float], agg: R.Reduction | None = None,
         axis: int = 0, y_stack: str | Sequence[str] | Sequence[float] | None = None, order: str | None = None) -> Grid:
    """Areas in every layout of lines; y_stack has the layout of y. Without it the area is filled to zero, which the y range then includes."""
    agg = agg or R.any()
    stacked = y_stack is not None
    if order is not None:
        source = source.withColumn(R.ORDER, F.col(order).cast("long"))
    if axis == 1:
        def vector(v: str | Sequence[str] | Sequence[float]) -> Column:
            if isinstance(v, str):
                return F.col(v)
            return F.array(*[F.col(c) for c in v]) if v and isinstance(v[0], str) else S.shared(v)  # type: ignore[arg-type]

        source = dealt(source, SHAPES)
        segs = S.along_arrays(source, vector(x), vector(y), {"low": vector(y_stack)} if stacked else None)  # type: ignore[arg-type]
    else:
        if order is None:
            raise ValueError("an area through rows needs an order column")
        if isinstance(x, str) and isinstance(y, str):
            laid, within = source, None
            segs = S.through_rows(laid, x, y, order, within, [y_stack] if stacked else [])  # type: ignore[list-item]
            if stacked:
                segs = segs.withColumns({"low0": F.col(y_stack).cast("double"), "low1": F.col(f"next_{y_stack}")})  # type: ignore[arg-type]
        else:
            xs = [x] * len(y) if isinstance(x, str) else list(x)
            lows = list(y_stack) if stacked else list(y)  # type: ignore[arg-type]
            parts = [F.struct(F.lit(i).alias("line"), *[F.col(c).cast("double").alias(n) for c, n in zip(t, ("_x", "_y", "_low"))]) for i, t in enumerate(zip(xs, y, lows, strict=True))]  # type: ignore[arg-type]
            laid = source.withColumn("_l", F.explode(F.array(*parts))).select(*source.columns, "_l.line", "_l._x", "_l._y", "_l._low")
            segs = S.through_rows(laid, "_x", "_y", order, ["line"], ["_low"])
            if stacked:
                segs = segs.withColumns({"low0": F.col("_low"), "low1": F.col("next__low")})
    if not stacked:
        segs = segs.withColumns({"low0": F.lit(0.0), "low1": F.lit(0.0)})
    traps = segs.withColumnsRenamed({"y0": "top0", "y1": "top1"})
    canvas = canvas.fitted(traps, [F.col("x0"), F.col("x1")], [F.col(c) for c in ("top0", "top1", "low0", "low1")])
    return reduce_spans(fill(traps, canvas, stacked), canvas, agg, "px", "py")
