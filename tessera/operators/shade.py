"""Shading: grids to images (py, px, rgba)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.canvas import known
from tessera.functions.colors import KEY, color_map, pack, rgb
from tessera.operators.composite import combine

BINS = 65536
How = str | Callable[[Column], Column]


def equalized(grid: DataFrame, value: str = "value", into: str = "value", integer: bool | None = None, bins: int = BINS) -> DataFrame:
    """Histogram equalization: each value's share of values at or below it.

    Integers spanning fewer than `bins` values: exact counts per value. Otherwise counts in `bins` equal bins, and the cumulative
    share interpolated between bin centres. Only the histogram (at most `bins` rows) goes through an ordered window.
    """
    return _equalized(grid, value, into, integer, bins)[0]


def _equalized(grid: DataFrame, value: str, into: str, integer: bool | None = None, bins: int = BINS) -> tuple[DataFrame, DataFrame | None]:
    """The equalized grid, and its histogram: a row for each discrete level."""
    if integer is None:
        integer = dict(grid.dtypes)[value] in ("tinyint", "smallint", "int", "bigint", "boolean")
    v = F.col(value).cast("double")
    lo, hi, n = grid.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return grid.withColumn(into, v), None
    upto = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    if integer and hi - lo < bins:
        counts = grid.groupBy(v.alias("_k")).count()
        share = counts.select("_k", (F.sum("count").over(upto) / F.lit(float(n))).alias("_share"))
        return grid.join(F.broadcast(share), v == F.col("_k")).withColumn(into, F.col("_share")).drop("_k", "_share"), counts
    width = (hi - lo) / bins if hi > lo else 1.0
    at = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = grid.groupBy(at.alias("_k")).count()
    share = counts.select("_k", (F.sum("count").over(upto) / F.lit(float(n))).alias("_share"))
    order = Window.orderBy("_k")
    # empty bins have the share of the bin before; both sides of each occupied bin are kept so that interpolation sees them
    near = share.select("_k", "_share", F.lag("_share", 1, 0.0).over(order).alias("_before"), F.lag("_k").over(order).alias("_pk"), F.lead("_share").over(order).alias("_ns"), F.lead("_k").over(order).alias("_nk"))
    pos = (v - F.lit(lo)) / F.lit(width) - 0.5
    part = pos - F.col("_k")
    below = F.when(F.col("_pk") == F.col("_k") - 1, F.col("_before")).otherwise(F.when(F.col("_pk").isNull(), F.col("_share")).otherwise(F.col("_before")))
    above = F.when(F.col("_nk") == F.col("_k") + 1, F.col("_ns")).otherwise(F.col("_share"))
    mixed = F.when(part < 0, F.when(F.col("_k") == 0, F.col("_share")).otherwise(F.col("_share") + part * (F.col("_share") - below))).otherwise(F.col("_share") + part * (above - F.col("_share")))
    return grid.join(F.broadcast(near), at == F.col("_k")).withColumn(into, mixed).drop("_k", "_share", "_before", "_pk", "_ns", "_nk"), counts


def _curve(how: How, v: Column) -> Column:
    if callable(how):
        return how(v)
    if how == "log":
        return F.log1p(v)
    if how == "cbrt":
        return F.pow(v, F.lit(1 / 3))
    if how == "linear":
        return v
    raise ValueError(f"unknown way to shade: {how!r}")


def _transformed(grid: DataFrame, how: How, span: tuple[float, float] | None, value: str = "value") -> tuple[DataFrame, float, float, float]:
    """The grid with _t (the transformed value), the span of _t, and its number of distinct levels (0: not counted)."""
    v = F.col(value).cast("double")
    if how == "eq_hist":
        if span is not None:
            raise ValueError("eq_hist takes no span")
        eq, levels = _equalized(grid, value, "_t")
        lo, hi = eq.agg(F.min("_t"), F.max("_t")).first()
        return eq, lo or 0.0, hi or 0.0, float(levels.count() if levels is not None else 0)
    if span is None:
        least = grid.agg(F.min(v)).first()[0] or 0.0
        out = grid.withColumn("_t", _curve(how, v - F.lit(float(least))))
        lo, hi = out.agg(F.min("_t"), F.max("_t")).first()
        return out, lo or 0.0, hi or 0.0, 0.0
    a, b = (float(s) for s in span)
    clipped = F.greatest(F.lit(a), F.least(F.lit(b), v))
    out = grid.withColumn("_t", _curve(how, clipped - F.lit(a)))
    ends = grid.sparkSession.range(1).select(_curve(how, F.lit(0.0)), _curve(how, F.lit(b - a))).first()
    return out, ends[0], ends[1], 0.0


def widened_span(lo: float, hi: float, levels: float) -> tuple[float, float]:
    """With few distinct levels the span grows downwards, so that the lowest ones don't look empty."""
    if levels <= 2 or levels >= 100:
        factor = 1.5 if levels <= 2 else 1.0
    else:
        factor = -0.5 / 98.0 * levels + 1.5 + 1.0 / 98.0
    return (hi - factor * (hi - lo), hi) if factor > 1 else (lo, hi)


def ramp(t: Column, lo: float, hi: float, values: Sequence[float]) -> Column:
    """Piecewise linear interpolation over evenly spaced knots from lo to hi."""
    n = len(values)
    if n == 1 or hi == lo:
        return F.lit(float(values[-1] if n == 1 else values[0]))
    step = (hi - lo) / (n - 1)
    out = F.lit(float(values[-1]))
    for k in range(n - 2, -1, -1):
        a = lo + k * step
        out = F.when(t < F.lit(lo + (k + 1) * step), F.lit(float(values[k])) + (t - F.lit(a)) / F.lit(step) * F.lit(float(values[k + 1] - values[k]))).otherwise(out)
    return F.when(t <= lo, F.lit(float(values[0]))).otherwise(out)


def shade(grid: DataFrame, cmap: Sequence[str] | Sequence[Sequence[int]] | str = ("lightblue", "darkblue"), how: How = "eq_hist", alpha: int = 255, min_alpha: int = 40,
          span: tuple[float, float] | None = None, rescale_discrete_levels: bool = False, zero_is_empty: bool = False) -> DataFrame:
    """Colour a grid (py, px, value). Null and NaN are empty, and with zero_is_empty (counts) 0 too. One colour: it stays, and alpha goes from min_alpha to alpha."""
    v = known(F.col("value").cast("double"))
    some = grid.where(v.isNotNull() & (F.lit(not zero_is_empty) | (v != 0)))
    t, lo, hi, levels = _transformed(some, how, span)
    if rescale_discrete_levels and how == "eq_hist":
        lo, hi = widened_span(lo, hi, levels)
    if isinstance(cmap, str):
        r, g, b = rgb(cmap)
        a = ramp(F.col("_t"), lo, hi, [min_alpha, alpha])
        return t.select("py", "px", pack(F.lit(r), F.lit(g), F.lit(b), a).alias("rgba"))
    colors = color_map(cmap)
    channels = [ramp(F.col("_t"), lo, hi, [c[n] for c in colors]) for n in range(3)]
    return t.select("py", "px", pack(*channels, F.lit(alpha)).alias("rgba"))


def shade_categories(grid: DataFrame, color_key: Mapping | Sequence[str] = KEY, layers: Sequence | None = None, how: How = "eq_hist", alpha: int = 255, min_alpha: int = 40,
                     span: tuple[float, float] | None = None, color_baseline: float | None = None, rescale_discrete_levels: bool = False) -> DataFrame:
    """Colour a grid (py, px, cat, value): the mean of the categories' colours weighted by value above the baseline (the least value), alpha by the total."""
    if layers is None:
        layers = sorted(r[0] for r in grid.select("cat").distinct().collect())
    if not isinstance(color_key, Mapping):
        if len(color_key) < len(layers):
            raise ValueError("not enough colours for the categories")
        color_key = dict(zip(layers, color_key))
    v = known(F.col("value").cast("double"))
    present = grid.where(v.isNotNull())
    base = float(color_baseline) if color_baseline is not None else float(present.agg(F.min(v)).first()[0] or 0.0)
    if color_baseline is None and base > 0:
        base = 0.0 if present.groupBy("py", "px").count().where(F.col("count") < len(layers)).limit(1).count() else base
    table = [(k, *map(float, rgb(color_key[k]))) for k in layers]
    kind = dict(grid.dtypes)["cat"]
    colors = F.broadcast(grid.sparkSession.createDataFrame(table, f"cat {kind}, r double, g double, b double"))
    weight = F.col("value") - F.lit(base)
    mixed = present.join(colors, "cat").groupBy("py", "px").agg(
        F.sum("value").alias("value"), F.sum(weight).alias("_w"),
        *[F.sum(weight * F.col(c)).alias(f"_{c}") for c in "rgb"], *[F.avg(F.when(F.col("value") > 0, F.col(c))).alias(f"_m{c}") for c in "rgb"],
    )
    mixed = mixed.where(F.col("value") != 0)
    t, lo, hi, levels = _transformed(mixed, how, span)
    if rescale_discrete_levels and how == "eq_hist":
        lo, hi = widened_span(lo, hi, levels)
    channels = [F.coalesce(F.col(f"_{c}") / F.nullif(F.col("_w"), F.lit(0.0)), F.col(f"_m{c}"), F.lit(0.0)) for c in "rgb"]
    return t.select("py", "px", pack(*channels, ramp(F.col("_t"), lo, hi, [min_alpha, alpha])).alias("rgba"))


def shade_discrete(grid: DataFrame, color_key: Mapping, alpha: int = 255) -> DataFrame:
    """Colour pixels by exact value; values that the key lacks are transparent."""
    table = [(float(k), *rgb(c)) for k, c in color_key.items()]
    colors = F.broadcast(grid.sparkSession.createDataFrame(table, "_k double, r int, g int, b int"))
    return grid.join(colors, F.col("value").cast("double") == F.col("_k"), "left").select(
        "py", "px", F.when(F.col("_k").isNotNull(), pack(F.col("r"), F.col("g"), F.col("b"), F.lit(alpha))).otherwise(F.lit(0).cast("long")).alias("rgba")
    )


def set_background(image: DataFrame, color: str | Sequence[int]) -> DataFrame:
    """The image over an opaque colour."""
    r, g, b = rgb(color)
    back = pack(F.lit(r), F.lit(g), F.lit(b), F.lit(255))
    return image.withColumn("rgba", combine(F.col("rgba"), back, "over"))
