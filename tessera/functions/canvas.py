"""Canvas and axes: what a grid covers, how fine it is, and how data coordinates become pixel numbers.

A pixel number is scale * m(v) + shift with m the axis' mapping (identity or log10); row 0 is at the bottom.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[float, float]


def known(c: Column) -> Column:
    """A number with NaN as null: NaN is the only missing value of the data model, and Spark orders it above all."""
    return F.nullif(c, F.lit(float("nan")))


@dataclass(frozen=True)
class Axis:
    """One side of a canvas: `kind` is linear or log."""

    size: int
    kind: str
    range: Range

    def __post_init__(self) -> None:
        if self.kind not in ("linear", "log"):
            raise ValueError(f"unknown axis kind {self.kind!r}")
        if self.size <= 0:
            raise ValueError("a canvas needs at least one pixel each way")
        if self.kind == "log" and min(self.range) <= 0:
            raise ValueError("a log axis covers positive values only")

    def number(self, v: float) -> float:
        return math.log10(v) if self.kind == "log" else float(v)

    def column(self, v: Column) -> Column:
        v = v.cast("double")
        return F.log10(v) if self.kind == "log" else v

    @property
    def scale(self) -> float:
        return self.size / (self.number(self.range[1]) - self.number(self.range[0]))

    @property
    def shift(self) -> float:
        return -self.number(self.range[0]) * self.scale

    def place(self, v: Column) -> Column:
        """Position in pixels, fractional."""
        return self.column(v) * F.lit(self.scale) + F.lit(self.shift)

    def inside(self, v: Column) -> Column:
        """Within the range, both ends included; NaN and null aren't."""
        return v.between(F.lit(float(self.range[0])), F.lit(float(self.range[1])))

    def pixel(self, v: Column) -> Column:
        """Pixel of a point inside the range; the upper end belongs to the last pixel."""
        return F.least(self.place(v).cast("int"), F.lit(self.size - 1))

    def vertex(self, v: Column) -> Column:
        """Pixel of a line's or area's vertex: only the upper end itself is moved into the last pixel."""
        end = round(self.number(self.range[1]) * self.scale + self.shift)
        at = self.place(v).cast("int")
        return at - (at == end).cast("int")

    def centre(self, v: Column) -> Column:
        """Position relative to pixel centres."""
        return self.place(v) - F.lit(0.5)

    def coordinate(self, pixel: Column) -> Column:
        """Data coordinate of a pixel's centre."""
        at = (pixel + F.lit(0.5) - F.lit(self.shift)) / F.lit(self.scale)
        return F.pow(F.lit(10.0), at) if self.kind == "log" else at


@dataclass(frozen=True)
class Canvas:
    """An immutable grid definition; a range that is None is found from the data (`fitted`)."""

    plot_width: int = 600
    plot_height: int = 600
    x_range: Range | None = None
    y_range: Range | None = None
    x_axis_type: str = "linear"
    y_axis_type: str = "linear"

    def __post_init__(self) -> None:
        for size, kind, span in ((self.plot_width, self.x_axis_type, self.x_range), (self.plot_height, self.y_axis_type, self.y_range)):
            Axis(size, kind, span or (1.0, 2.0))

    @property
    def x(self) -> Axis:
        return Axis(self.plot_width, self.x_axis_type, self._known(self.x_range))

    @property
    def y(self) -> Axis:
        return Axis(self.plot_height, self.y_axis_type, self._known(self.y_range))

    @staticmethod
    def _known(span: Range | None) -> Range:
        if span is None:
            raise ValueError("the canvas has no range yet; use fitted()")
        return span

    def fitted(self, df: DataFrame, xs: list[Column], ys: list[Column]) -> Canvas:
        """The canvas with missing ranges taken from the data in one aggregation: NaN is skipped, an empty range becomes (-1, 1) or is widened by 1."""
        if self.x_range and self.y_range:
            return self
        sides = {"x": xs if self.x_range is None else [], "y": ys if self.y_range is None else []}
        wanted = [f(known(c.cast("double"))).alias(f"{s}{k}{i}") for s, cols in sides.items() for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max))]
        row = df.agg(*wanted).first().asDict() if wanted else {}

        def span(s: str) -> Range:
            lo = [v for n, v in row.items() if n.startswith(f"{s}lo") and v is not None]
            hi = [v for n, v in row.items() if n.startswith(f"{s}hi") and v is not None]
            return widened(min(lo, default=math.nan), max(hi, default=math.nan))

        return replace(self, x_range=self.x_range or span("x"), y_range=self.y_range or span("y"))


def widened(lo: float, hi: float) -> Range:
    """(-1, 1) for bounds that aren't finite, one more each way for equal bounds."""
    if not (math.isfinite(lo) and math.isfinite(hi)):
        return -1.0, 1.0
    return (lo - 1, hi + 1) if lo == hi else (lo, hi)


def check_numeric(df: DataFrame, names: list[str], what: str) -> None:
    """Names must be real numeric columns; timestamps pass, as they are cast to microseconds by the caller."""
    kinds = dict(df.dtypes)
    for n in names:
        if n not in kinds:
            raise ValueError(f"specified column not found: {n!r}")
        if not kinds[n].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            raise ValueError(f"{what} must be {'real' if len(what) == 1 else 'numeric'}")
