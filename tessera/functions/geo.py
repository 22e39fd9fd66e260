"""Web Mercator: coordinates, pixels and tiles as columns and numbers. Tiles count from the top left."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = math.pi * 6378137.0


def lnglat_to_meters(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    x = longitude * F.lit(HALF / 180.0)
    y = F.ln(F.tan((F.lit(90.0) + latitude) * F.lit(math.pi / 360.0))) * F.lit(HALF / math.pi)
    return x, y


@dataclass(frozen=True)
class Tiling:
    """Square tiles over x_range and y_range; level z has 2^z tiles each way."""

    x_range: tuple[float, float] = (-HALF, HALF)
    y_range: tuple[float, float] = (-HALF, HALF)
    tile_size: int = 256

    def resolution(self, z: int) -> float:
        """Metres a pixel."""
        return (self.x_range[1] - self.x_range[0]) / self.tile_size / 2**z

    def to_pixels(self, x: Column, y: Column, z: int) -> tuple[Column, Column]:
        r = F.lit(self.resolution(z))
        return (x - F.lit(self.x_range[0])) / r, (y - F.lit(self.y_range[0])) / r

    def to_meters(self, px: Column, py: Column, z: int) -> tuple[Column, Column]:
        r = F.lit(self.resolution(z))
        return px * r + F.lit(self.x_range[0]), py * r + F.lit(self.y_range[0])

    def pixels_to_tile(self, px: Column, py: Column, z: int) -> tuple[Column, Column]:
        """A pixel on the edge of two tiles belongs to the lower one; 0 is in the first."""
        side = lambda p: F.when(p == 0, 0).otherwise(F.ceil(p / F.lit(float(self.tile_size))) - 1).cast("int")
        return side(px), (F.lit(2**z - 1) - side(py)).cast("int")

    def tile_of(self, x: Column, y: Column, z: int) -> tuple[Column, Column]:
        return self.pixels_to_tile(*self.to_pixels(x, y, z), z)

    def extent(self, tx: int, ty: int, z: int) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax of a tile in metres."""
        side = self.resolution(z) * self.tile_size
        row = 2**z - 1 - ty
        return self.x_range[0] + tx * side, self.y_range[0] + row * side, self.x_range[0] + (tx + 1) * side, self.y_range[0] + (row + 1) * side

    def valid(self, tx: int, ty: int, z: int) -> bool:
        return 0 <= tx < 2**z and 0 <= ty < 2**z

    def level_for(self, extent: tuple[float, float, float, float], height: int, width: int) -> int:
        """The zoom whose resolution is the first at least as fine as a view needs."""
        need = max((extent[2] - extent[0]) / width, (extent[3] - extent[1]) / height)
        return next((max(z - 1, 0) for z in range(25) if need > self.resolution(z)), 24)

    def tiles(self, extent: tuple[float, float, float, float], z: int) -> list[tuple[int, int, int, tuple[float, float, float, float]]]:
        """(tx, ty, z, extent) of the tiles that cover an extent, row by row."""
        def number(v: float, lo: float) -> int:
            p = (v - lo) / self.resolution(z)
            return 0 if p == 0 else math.ceil(p / self.tile_size) - 1

        x0, x1 = number(extent[0], self.x_range[0]), number(extent[2], self.x_range[0])
        y0, y1 = (2**z - 1 - number(v, self.y_range[0]) for v in (extent[3], extent[1]))
        return [(tx, ty, z, self.extent(tx, ty, z)) for ty in range(y0, y1 + 1) for tx in range(x0, x1 + 1) if self.valid(tx, ty, z)]


def with_mercator(df: DataFrame, longitude: str, latitude: str) -> DataFrame:
    """df with x and y in metres."""
    x, y = lnglat_to_meters(F.col(longitude), F.col(latitude))
    return df.withColumn("x", x).withColumn("y", y)
