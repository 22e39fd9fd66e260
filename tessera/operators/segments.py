"""Line segments from every layout of lines: (x0, y0, x1, y1, start, end, xm, ym, payload).

start: the segment begins its line (or follows a gap); end: it is the last before a gap or the line's end; (xm, ym): the vertex
before it. Value columns come from the row of the first vertex. A null or NaN coordinate is a gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canvas import known
from tessera.sources.rowindex import neighbours

NAMES = ["x0", "y0", "x1", "y1", "start", "end", "xm", "ym"]


def _gap(x: Column, y: Column) -> Column:
    return known(x.cast("double")).isNull() | known(y.cast("double")).isNull()


def through_rows(df: DataFrame, x: str, y: str, order: str, within: list[str] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One line through all rows by `order`, or one for each group of `within`. extra: further columns whose next value is wanted as next_<name>."""
    around = neighbours(df, order, [x, y, *[e for e in extra if e not in (x, y)]], within)
    prev, nxt, after = F.col("_prev"), F.col("_next"), F.col("_next2")
    out = around.where(nxt.isNotNull())
    columns = {
        "x0": F.col(x).cast("double"), "y0": F.col(y).cast("double"), "x1": nxt[x].cast("double"), "y1": nxt[y].cast("double"),
        "start": prev.isNull() | _gap(prev[x], prev[y]), "end": after.isNull() | _gap(after[x], after[y]),
        "xm": prev[x].cast("double"), "ym": prev[y].cast("double"),
    }
    columns |= {f"next_{e}": nxt[e].cast("double") for e in extra}
    return out.withColumns({f"_{k}": v for k, v in columns.items()}).drop("_prev", "_next", "_next2", *columns).withColumnsRenamed({f"_{k}": k for k in columns})


def along_arrays(df: DataFrame, x: Column, y: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """One line for each row from arrays of coordinates (the shorter one counts). No shuffle. extra: arrays of which name and next_name come along."""
    both = df.withColumn("_x", x.cast("array<double>")).withColumn("_y", y.cast("array<double>"))
    for name, c in (extra or {}).items():
        both = both.withColumn(f"_{name}", c.cast("array<double>"))
    n = F.least(F.size("_x"), F.size("_y"))
    at = both.where(n >= 2).withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1), n - 1)))
    get = lambda a, d: F.try_element_at(F.col(a), F.col("_i") + d)
    before = F.when(F.col("_i") > 1, F.col("_i") - 1)
    xm, ym = F.element_at("_x", before), F.element_at("_y", before)
    columns = {
        "x0": get("_x", 0), "y0": get("_y", 0), "x1": get("_x", 1), "y1": get("_y", 1),
        "start": (F.col("_i") == 1) | _gap(xm, ym), "end": (F.col("_i") == F.col("_n") - 1) | _gap(get("_x", 2), get("_y", 2)), "xm": xm, "ym": ym,
    }
    for name in extra or {}:
        columns |= {f"{name}0": get(f"_{name}", 0), f"{name}1": get(f"_{name}", 1)}
    made = at.withColumns({f"_s_{k}": v for k, v in columns.items()})
    keep = [c for c in df.columns if c not in columns]
    return made.select(*keep, *[F.col(f"_s_{k}").alias(k) for k in columns])


def columns_as_lines(df: DataFrame, xs: Sequence[str], ys: Sequence[str], line: str = "line") -> DataFrame:
    """k lines in zipped column lists as rows (line, _x, _y), for through_rows within [line]."""
    pairs = F.array(*[F.struct(F.lit(i).alias(line), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")) for i, (a, b) in enumerate(zip(xs, ys, strict=True))])
    return df.withColumn("_l", F.explode(pairs)).select(*df.columns, f"_l.{line}", "_l._x", "_l._y")


def shared(values: Sequence[float]) -> Column:
    """A literal coordinate vector that all lines share."""
    return F.array(*[F.lit(float(v)) for v in values])


def clip_span(*axes: tuple[Column, Column, tuple[float, float]]) -> tuple[Column, Column, Column]:
    """Liang-Barsky for (start, change, range) of each axis: where the line enters and leaves (0 and 1 where it isn't cut), and whether level ones are inside.

    In closed form, as steps that build on each other would multiply once Spark pushes filters through them.
    """
    enter, leave, level = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for start, change, (lo, hi) in axes:
        low, high = (F.lit(float(lo)) - start) / F.nullif(change, F.lit(0.0)), (F.lit(float(hi)) - start) / F.nullif(change, F.lit(0.0))
        enter.append(F.when(change > 0, low).when(change < 0, high))
        leave.append(F.when(change > 0, high).when(change < 0, low))
        level = level & ((change != 0) | start.between(F.lit(float(lo)), F.lit(float(hi))))
    return F.greatest(*enter), F.least(*leave), level


def settled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with these columns computed once: as what a generator makes, filters above aren't pushed past them, which would repeat their expressions."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*[F.col(c) for c in names]))))


def clipped(segs: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Segments cut to the ranges, with cut_start and cut_end; those outside and those with a gap are dropped before anything is exploded."""
    (xa, xb), (ya, yb) = ([F.lit(float(v)) for v in r] for r in (x_range, y_range))
    x0, y0, x1, y1 = (F.col(c) for c in NAMES[:4])
    out = settled(segs, NAMES).where(~_gap(x0, y0) & ~_gap(x1, y1))
    out = out.where(~((x0 < xa) & (x1 < xa)) & ~((x0 > xb) & (x1 > xb)) & ~((y0 < ya) & (y1 < ya)) & ~((y0 > yb) & (y1 > yb)))
    dx, dy = x1 - x0, y1 - y0
    t0, t1, level = clip_span((x0, dx, x_range), (y0, dy, y_range))
    out = settled(out.where(level).withColumns({"_t0": t0, "_t1": t1}), ["_t0", "_t1"]).where("_t0 <= _t1")
    late, early = F.col("_t0") > 0, F.col("_t1") < 1
    return out.withColumns({
        "x1": F.when(early, x0 + F.col("_t1") * dx).otherwise(x1), "y1": F.when(early, y0 + F.col("_t1") * dy).otherwise(y1),
        "x0": F.when(late, x0 + F.col("_t0") * dx).otherwise(x0), "y0": F.when(late, y0 + F.col("_t0") * dy).otherwise(y0),
        "cut_start": late, "cut_end": early,
    }).drop("_t0", "_t1")


def offset(minor: Column, k: Column, major: Column, backwards: Column) -> Column:
    """Bresenham's minor offset after k of `major` steps, in closed form; ties go by the major direction."""
    return F.floor((2 * minor * k + major - F.when(backwards, 1).otherwise(0)) / F.greatest(2 * major, F.lit(1))).cast("long")
