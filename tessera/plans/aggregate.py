"""From rows with pixel numbers to a sparse grid: py, px[, extra keys][, category][, n], values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas


@dataclass(frozen=True)
class Grid:
    """A sparse grid and what is needed to make it dense: `values` maps value columns to their empty value, `layers` other keys to their members."""

    df: DataFrame
    canvas: Canvas
    values: dict[str, object]
    layers: dict[str, list]

    @property
    def keys(self) -> list[str]:
        return ["py", "px", *self.layers]

    def densify(self) -> DataFrame:
        """A row for each pixel and layer; output grows with the canvas, so only small canvases should be made dense."""
        spark = self.df.sparkSession
        full = spark.range(self.canvas.plot_height * self.canvas.plot_width).select(
            F.floor(F.col("id") / self.canvas.plot_width).cast("int").alias("py"), (F.col("id") % self.canvas.plot_width).cast("int").alias("px")
        )
        for name, members in self.layers.items():
            full = full.withColumn(name, F.explode(F.array(*[F.lit(m) for m in members])))
        out = full.join(self.df, self.keys, "left")
        return out.select(*self.keys, *[F.coalesce(F.col(v), F.lit(e)).alias(v) if e is not None else F.col(v) for v, e in self.values.items()])

    def with_coordinates(self) -> DataFrame:
        """The grid with each pixel centre's data coordinates."""
        return self.df.withColumn("x", self.canvas.x.coordinate(F.col("px"))).withColumn("y", self.canvas.y.coordinate(F.col("py")))


def reduce_pixels(rows: DataFrame, canvas: Canvas, agg: R.Reduction, keys: list[str] | None = None, name: str = "value") -> Grid:
    """Aggregate rows(py, px, inputs[, ORDER]) by pixel."""
    extra = list(keys or [])
    if isinstance(agg, R.summary):
        return _summary(rows, canvas, agg, extra)
    if isinstance(agg, R.by):
        coded, members = categorized(rows, agg)
        inner = reduce_pixels(coded, canvas, agg.reduction, [*extra, "cat"], name)
        return Grid(inner.df, canvas, inner.values, inner.layers | {"cat": members})
    group = ["py", "px", *extra]
    layers: dict[str, list] = {k: [] for k in extra}
    ranked = agg.selector if isinstance(agg, R.where) else agg
    if isinstance(ranked, R.Ranked):
        best = Window.partitionBy(*group).orderBy(*ranked.keys())
        target = agg.target() if isinstance(agg, R.where) else (F.col(R.ORDER) if isinstance(ranked, (R.max_n_row_index, R.min_n_row_index)) else ranked.raw)
        top = rows.where(ranked.valid()).withColumn("n", F.row_number().over(best)).where(F.col("n") <= ranked.most)
        df = top.select(*group, (F.col("n") - 1).alias("n"), target.alias(name))
        return Grid(df, canvas, {name: agg.empty}, layers | {"n": list(range(ranked.most))})
    return Grid(rows.groupBy(*group).agg(agg.aggregate().alias(name)), canvas, {name: agg.empty}, layers)


def reduce_spans(rows: DataFrame, canvas: Canvas, agg: R.Reduction, line: str, span: str, keys: list[str] | None = None) -> Grid:
    """Aggregate rows(line, _lo, _hi, inputs[, ORDER]) that cover pixels _lo to _hi along `span` in one column or row of the grid.

    Equal spans are added up before they become pixels, of which there are then no more than spans of a grid, whatever the rows.
    """
    extra = list(keys or [])
    if isinstance(agg, R.by):
        coded, members = categorized(rows, agg)
        inner = reduce_spans(coded, canvas, agg.reduction, line, span, [*extra, "cat"])
        return Grid(inner.df, canvas, inner.values, inner.layers | {"cat": members})
    pixels = lambda df: df.withColumn(span, F.explode(F.sequence("_lo", "_hi")))
    parts = agg.parts()
    if not parts:
        return reduce_pixels(pixels(rows), canvas, agg, extra)
    spans = rows.groupBy(line, "_lo", "_hi", *extra).agg(*[c.alias(n) for n, c in parts.items()])
    df = pixels(spans).groupBy("py", "px", *extra).agg(agg.merged().alias("value"))
    return Grid(df, canvas, {"value": agg.empty}, {k: [] for k in extra})


def categorized(rows: DataFrame, agg: R.by) -> tuple[DataFrame, list]:
    """rows with their category as `cat`, those without one left out, and the categories."""
    category = agg.category.fitted(rows)
    # the code is filtered, not the element: Spark takes the element of an array without nulls for never null, even at a null index
    coded = rows.withColumn("_code", category.code().cast("int")).where(F.col("_code").isNotNull())
    names = F.array(*[F.lit(v) for v in category.layers()]) if category.layers() else F.array(F.lit(None).cast("string"))
    return coded.withColumn("cat", F.get(names, F.col("_code"))), category.layers()


def joined(parts: dict[str, Grid]) -> Grid:
    """One grid of the grids' values; they are joined by the keys that they share."""
    if not parts:
        raise ValueError("a summary needs at least one reduction")
    grid, *others = parts.values()
    for part in others:
        on = [k for k in grid.keys if k in part.keys]
        grid = Grid(grid.df.join(part.df, on, "full"), grid.canvas, grid.values | part.values, grid.layers | part.layers)
    return grid


def _summary(rows: DataFrame, canvas: Canvas, agg: R.summary, extra: list[str]) -> Grid:
    """Plain reductions share one aggregation."""
    plain = {n: r for n, r in agg.parts.items() if not isinstance(getattr(r, "selector", r), (R.Ranked, R.by))}
    group = ["py", "px", *extra]
    parts = {}
    if plain:
        parts["plain"] = Grid(rows.groupBy(*group).agg(*[r.aggregate().alias(n) for n, r in plain.items()]), canvas, {n: r.empty for n, r in plain.items()}, {k: [] for k in extra})
    return joined(parts | {f"of {n}": reduce_pixels(rows, canvas, r, extra, n) for n, r in agg.parts.items() if n not in plain})


def needed(df: DataFrame, columns: list[str], agg: R.Reduction, order: str | None) -> DataFrame:
    """df with only what a glyph and a reduction read, and ORDER from the order column."""
    names = list(dict.fromkeys([*columns, *agg.inputs()]))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"specified column not found: {missing[0]!r}")
    if not agg.ordered:
        return df.select(*names)
    if order is None:
        raise ValueError("this reduction goes by row order: name an order column, or number the rows with sources.rowindex")
    return df.select(*names, F.col(order).cast("long").alias(R.ORDER))
