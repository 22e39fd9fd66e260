"""Lines, plain (Bresenham in closed form) and antialiased."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.operators import segments as S
from tessera.plans.aggregate import Grid, categorized, joined, reduce_pixels
from tessera.sources.dealing import SHAPES, dealt


def walk(segs: DataFrame, canvas: Canvas) -> DataFrame:
    """A row for each pixel that a segment draws, with px and py; segments must lie within int ranges after clipping."""
    cut = S.clipped(segs, canvas.x.range, canvas.y.range)
    at = cut.withColumns({"_x0": canvas.x.vertex(F.col("x0")), "_y0": canvas.y.vertex(F.col("y0")), "_x1": canvas.x.vertex(F.col("x1")), "_y1": canvas.y.vertex(F.col("y1"))})
    dx, dy = F.abs(F.col("_x1") - F.col("_x0")), F.abs(F.col("_y1") - F.col("_y0"))
    steep = dx < dy
    major, minor = F.greatest(dx, dy).cast("long"), F.least(dx, dy).cast("long")
    sx, sy = F.signum(F.col("_x1") - F.col("_x0")).cast("long"), F.signum(F.col("_y1") - F.col("_y0")).cast("long")
    dot = ~(F.col("cut_start") | F.col("cut_end")) & (major == 0)
    first = F.when(F.col("start") | F.col("cut_start") | dot, 0).otherwise(1).cast("long")
    at = at.withColumns({"_steep": steep, "_major": major, "_minor": minor, "_sx": sx, "_sy": sy, "_k0": first})
    at = at.withColumn("_k", F.explode(F.when(F.col("_k0") <= F.col("_major"), F.sequence("_k0", "_major"))))
    m = S.offset(F.col("_minor"), F.col("_k"), F.col("_major"), F.when(F.col("_steep"), F.col("_sy")).otherwise(F.col("_sx")) < 0)
    px = F.col("_x0") + F.col("_sx") * F.when(F.col("_steep"), m).otherwise(F.col("_k"))
    py = F.col("_y0") + F.col("_sy") * F.when(F.col("_steep"), F.col("_k")).otherwise(m)
    out = at.withColumn("px", px.cast("int")).withColumn("py", py.cast("int"))
    return out.where(F.col("px").between(0, canvas.plot_width - 1) & F.col("py").between(0, canvas.plot_height - 1))


def coverage(segs: DataFrame, canvas: Canvas, width: float, overwrite: bool) -> DataFrame:
    """A row for each pixel that a wide segment covers, with aa (0 to 1) and prev_aa (what the segment before put there already)."""
    scale, width = (width, 1.0) if width < 1 else (1.0, width)
    half = 0.5 * (width + 1.0)
    cut = S.clipped(segs, canvas.x.range, canvas.y.range)
    cx, cy = canvas.x.centre, canvas.y.centre
    at = cut.withColumns({"ax": cx(F.col("x0")), "ay": cy(F.col("y0")), "bx": cx(F.col("x1")), "by": cy(F.col("y1")), "mx": cx(F.col("xm")), "my": cy(F.col("ym"))})
    at = at.withColumn("begins", F.col("start") | F.col("cut_start")).where("ax <> bx or ay <> by")
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    back = F.sqrt(F.pow(F.col("ax") - F.col("mx"), 2) + F.pow(F.col("ay") - F.col("my"), 2))
    at = at.withColumns({"len": length, "plen": F.coalesce(F.when(~F.col("begins"), back), F.lit(0.0))})
    at = at.withColumns({"ux": (F.col("bx") - F.col("ax")) / F.col("len"), "uy": (F.col("by") - F.col("ay")) / F.col("len")})
    joined = ~F.col("begins") & (F.col("plen") > 0) & F.lit(not overwrite)
    plen = F.nullif(F.col("plen"), F.lit(0.0))
    at = at.withColumns({"joined": joined, "wx": (F.col("ax") - F.col("mx")) / plen, "wy": (F.col("ay") - F.col("my")) / plen})
    at = S.settled(at, ["ax", "ay", "bx", "by", "begins", "len", "plen", "ux", "uy", "joined", "wx", "wy"])
    for axis, lo, hi, size in (("px", F.least("ax", "bx"), F.greatest("ax", "bx"), canvas.plot_width), ("py", F.least("ay", "by"), F.greatest("ay", "by"), canvas.plot_height)):
        a, b = F.greatest(F.ceil(lo - 2 * half), F.lit(0)).cast("int"), F.least(F.floor(hi + 2 * half), F.lit(size - 1)).cast("int")
        at = at.withColumns({"_a": a, "_b": b}).withColumn(axis, F.explode(F.when(F.col("_a") <= F.col("_b"), F.sequence("_a", "_b"))))
    rx, ry = F.col("px") - F.col("ax"), F.col("py") - F.col("ay")
    along, across = rx * F.col("ux") + ry * F.col("uy"), F.abs(rx * F.col("uy") - ry * F.col("ux"))
    before, prev_across = rx * F.col("wx") + ry * F.col("wy"), F.abs(rx * F.col("wy") - ry * F.col("wx"))
    at = at.withColumns({"along": along, "across": across}).where(F.col("across") <= half).where(F.col("along").between(F.lit(-half), F.col("len") + half))
    at = S.settled(at.withColumns({"before": before, "pacross": prev_across}), ["along", "across", "before", "pacross"])
    whole = ~F.col("joined")
    overwriting = F.lit(overwrite) | (~F.col("begins") & (F.col("plen") == 0))
    head = (F.col("along") < 0) & (overwriting | F.col("begins") | (F.col("before") > 0))
    tail = (F.col("along") > F.col("len")) & (overwriting | F.col("end"))
    dist = F.when(F.col("along") < 0, F.when(head, F.sqrt(rx * rx + ry * ry))).when(
        F.col("along") > F.col("len"), F.when(tail, F.sqrt(F.pow(F.col("px") - F.col("bx"), 2) + F.pow(F.col("py") - F.col("by"), 2)))
    ).otherwise(F.col("across"))

    def shade(d: Column) -> Column:
        return (1.0 - F.least(F.greatest((d - 0.5 * (width - 1.0)) / (half - 0.5 * (width - 1.0)), F.lit(0.0)), F.lit(1.0))) * scale

    again = ~whole & F.col("along").between(F.lit(0.0), F.col("len")) & F.col("before").between(-F.col("plen"), F.lit(0.0)) & (F.col("pacross") <= half)
    at = at.withColumns({"aa": shade(dist), "prev_aa": F.when(again, shade(F.col("pacross"))).otherwise(0.0)})
    return at.where((F.col("aa") > 0) & (F.col("aa") > F.col("prev_aa")))


#: How plain reductions combine lines; within a line, the largest value x coverage counts (or sums without what overlaps).
ACROSS = {R.count: "sum", R.sum: "sum", R.any: "max", R.max: "max", R.min: "min", R.first: "first", R.last: "last", R.mean: "mean"}


def _antialiased(segs: DataFrame, canvas: Canvas, agg: R.Reduction, width: float, line: list[str], self_intersect: bool, keys: Sequence[str] = (), name: str = "value") -> Grid:
    """Aggregate wide segments by pixel and keys; a summary's parts are computed each on its own."""
    again = lambda part, rows=segs, more=(), n=name: _antialiased(rows, canvas, part, width, line, self_intersect, [*keys, *more], n)
    if isinstance(agg, R.summary):
        return joined({n: again(part, n=n) for n, part in agg.parts.items()})
    if isinstance(agg, R.by):
        rows, layers = categorized(segs, agg)
        inner = again(agg.reduction, rows, ("cat",))
        return Grid(inner.df, canvas, inner.values, inner.layers | {"cat": layers})
    if isinstance(agg, (R.where, R.Ranked)):
        return _ranked(coverage(segs, canvas, width, overwrite=True), canvas, agg, line, keys, name)
    if type(agg) not in ACROSS:
        raise NotImplementedError(f"antialiased lines can't have {type(agg).__name__}")
    how = ACROSS[type(agg)]
    once = self_intersect and how in ("sum", "mean")
    cover = coverage(segs, canvas, width, overwrite=not once)
    value = F.lit(1.0) if agg.column is None or isinstance(agg, (R.count, R.any)) else agg.v
    if agg.column is not None:
        cover = cover.where(agg.v.isNotNull())
    pixel, layers = ["py", "px", *keys], {k: [] for k in keys}
    if once:
        total = F.sum(value * (F.col("aa") - F.col("prev_aa")))
        out = total / F.nullif(F.count(F.when(F.col("prev_aa") == 0, 1)), F.lit(0)) if how == "mean" else total
        return Grid(cover.groupBy(*pixel).agg(out.alias(name)), canvas, {name: agg.empty}, layers)
    inner = F.max(value * F.col("aa"))
    if how == "max":
        return Grid(cover.groupBy(*pixel).agg(inner.alias(name)), canvas, {name: agg.empty}, layers)
    rank = F.min(R.ORDER) if agg.ordered else F.lit(0)
    per = cover.groupBy(*pixel, *[c for c in line if c not in keys]).agg(inner.alias("_v"), rank.alias("_o"))
    outer = {
        "sum": F.sum("_v"), "min": F.min("_v"), "first": F.min_by("_v", "_o"), "last": F.max_by("_v", "_o"), "mean": F.avg("_v"),
    }[how]
    return Grid(per.groupBy(*pixel).agg(outer.alias(name)), canvas, {name: agg.empty}, layers)


def _ranked(cover: DataFrame, canvas: Canvas, agg: R.where | R.Ranked, line: list[str], keys: Sequence[str], name: str) -> Grid:
    """The n best lines of a pixel by value x coverage or by row order, or what a lookup column holds at their rows."""
    selector = agg.selector if isinstance(agg, R.where) else agg
    by_row = isinstance(selector, (R.max_n_row_index, R.min_n_row_index))
    value = F.col("aa") if by_row else selector.v * F.col("aa")
    target = agg.target() if isinstance(agg, R.where) else F.col(R.ORDER)
    pixel, row = ["py", "px", *keys], F.col(R.ORDER)
    best = F.max_by(F.struct(row.alias("o"), target.alias("t")), F.struct(value.alias("v"), (-row).alias("i")))
    per = cover.where(value.isNotNull()).groupBy(*pixel, *[c for c in line if c not in keys]).agg(F.max(value).alias("_v"), best.alias("_b"))
    v, o = F.col("_v"), F.col("_b.o")
    if isinstance(selector, (R.max, R.max_n)):
        order = [v.desc(), o.asc()]
    elif isinstance(selector, (R.min, R.min_n)):
        order = [v.asc(), o.asc()]
    else:
        order = [o.desc() if isinstance(selector, (R.last, R.last_n, R.max_n_row_index)) else o.asc()]
    many = selector.most if isinstance(selector, R.Ranked) else 1
    top = per.withColumn("n", F.row_number().over(Window.partitionBy(*pixel).orderBy(*order))).where(F.col("n") <= many)
    out = F.col("_b.t") if isinstance(agg, R.where) or by_row else v
    layers: dict[str, list] = {k: [] for k in keys}
    if isinstance(selector, R.Ranked):
        return Grid(top.select(*pixel, (F.col("n") - 1).alias("n"), out.alias(name)), canvas, {name: agg.empty}, layers | {"n": list(range(many))})
    return Grid(top.select(*pixel, out.alias(name)), canvas, {name: agg.empty}, layers)


def draw(segs: DataFrame, canvas: Canvas, agg: R.Reduction | None = None, line_width: float = 0, antialias: bool = False, line: list[str] | None = None, self_intersect: bool = True) -> Grid:
    """Aggregate segments; `line` names the columns that tell lines apart (wide lines without overlap sums need them)."""
    agg = agg or R.any()
    if antialias and line_width:
        raise ValueError("give antialias or line_width, not both")
    width = 1.0 if antialias else float(line_width)
    if width < 0:
        raise ValueError("a line's width can't be negative")
    canvas = canvas.fitted(segs, [F.col("x0"), F.col("x1")], [F.col("y0"), F.col("y1")])
    if width:
        return _antialiased(segs, canvas, agg, width, line or [], self_intersect)
    return reduce_pixels(walk(segs, canvas), canvas, agg)


#: Pixels of wide lines that a task may hold at once, each with its line.
HELD = 1_000_000


def _dealt(source: DataFrame, canvas: Canvas, style: dict[str, object]) -> DataFrame:
    """Rows that are lines, over all tasks; for wide lines all of a line in one task, so that its pixels needn't be shuffled."""
    keys = [c for c in (R.ORDER, "line") if c in source.columns][:1]
    if keys and (style.get("line_width") or style.get("antialias")):
        return dealt(source, max(1, HELD // (8 * (canvas.plot_width + canvas.plot_height))), *keys)
    return dealt(source, SHAPES)


def line(source: DataFrame, canvas: Canvas, x: str | Sequence[str] | Sequence[float], y: str | Sequence[str] | Sequence[float], agg: R.Reduction | None = None,
         axis: int = 0, order: str | None = None, geometry: str | None = None, **style: object) -> Grid:
    """Lines in every layout.

    axis 0: x and y are columns, or equally long lists of columns, and each line runs through the rows by `order`.
    axis 1: a line for each row from lists of columns, from array columns, or from one list of numbers that all share.
    geometry: a column of vertices (array<struct<x, y>>), or of arrays of them (each part is a line of its own).
    """
    agg = agg or R.any()
    if order is not None:
        source = source.withColumn(R.ORDER, F.col(order).cast("long"))
    if geometry is not None or axis == 1:
        source = _dealt(source, canvas, style)
    if geometry is not None:
        if dict(source.dtypes)[geometry].startswith("array<array"):
            source = source.withColumn(geometry, F.explode(geometry))
        g = F.col(geometry)
        return draw(S.along_arrays(source, g["x"], g["y"]), canvas, agg, line=list(source.columns), **style)  # type: ignore[arg-type]
    if axis == 1:
        def vector(v: str | Sequence[str] | Sequence[float]) -> Column:
            if isinstance(v, str):
                return F.col(v)
            return F.array(*[F.col(c) for c in v]) if v and isinstance(v[0], str) else S.shared(v)  # type: ignore[arg-type]

        return draw(S.along_arrays(source, vector(x), vector(y)), canvas, agg, line=[c for c in source.columns if c in ("line", R.ORDER)] , **style)  # type: ignore[arg-type]
    if order is None:
        raise ValueError("a line through rows needs an order column")
    if isinstance(x, str) and isinstance(y, str):
        return draw(S.through_rows(source, x, y, order), canvas, agg, **style)  # type: ignore[arg-type]
    xs = [x] * len(y) if isinstance(x, str) else list(x)
    ys = [y] * len(xs) if isinstance(y, str) else list(y)
    laid = S.columns_as_lines(source, xs, ys)  # type: ignore[arg-type]
    return draw(S.through_rows(laid, "_x", "_y", order, ["line"]), canvas, agg, line=["line"], **style)  # type: ignore[arg-type]
