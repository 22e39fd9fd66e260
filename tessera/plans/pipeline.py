"""The whole way from a table to an image."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.functions.canvas import Canvas
from tessera.operators.shade import shade
from tessera.plans.aggregate import Grid


@dataclass(frozen=True)
class Pipeline:
    """glyph(source, canvas) to a grid, then transform, colour and spread; called with ranges and a size for each view."""

    source: DataFrame
    glyph: Callable[[DataFrame, Canvas], Grid]
    transform: Callable[[DataFrame], DataFrame] = lambda g: g
    color: Callable[[DataFrame], DataFrame] = shade
    spread: Callable[[DataFrame], DataFrame] = lambda i: i
    width_scale: float = 1.0
    height_scale: float = 1.0

    def __call__(self, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None, width: int = 600, height: int = 600) -> DataFrame:
        canvas = Canvas(int(width * self.width_scale), int(height * self.height_scale), x_range, y_range)
        return self.spread(self.color(self.transform(self.glyph(self.source, canvas).df)))
