"""Categorizers: which layer of a by() a row goes to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Categories:
    """Codes by a declared list of values; rows with other values or null are left out."""

    column: str
    values: tuple = ()

    def code(self) -> Column:
        return F.nullif(F.array_position(F.array(*[F.lit(v) for v in self.values]), F.col(self.column)), F.lit(0)) - 1

    def layers(self) -> list:
        return list(self.values)

    def fitted(self, df: DataFrame) -> Categories:
        """With the sorted distinct values of df where none were declared; the list is meant to be short."""
        if self.values:
            return self
        found = df.select(self.column).where(F.col(self.column).isNotNull()).distinct().orderBy(self.column).collect()
        return Categories(self.column, tuple(r[0] for r in found))


@dataclass(frozen=True)
class CategoryModulo:
    """Codes (value - offset) modulo `modulo`, never negative, of an integer column."""

    column: str
    modulo: int
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.modulo <= 1 << 16:
            raise ValueError("modulo must be from 1 to 65536")

    def code(self) -> Column:
        return F.pmod(F.col(self.column) - F.lit(self.offset), F.lit(self.modulo)).cast("int")

    def layers(self) -> list:
        return list(range(self.modulo))

    def fitted(self, df: DataFrame) -> CategoryModulo:
        if dict(df.dtypes)[self.column] not in ("tinyint", "smallint", "int", "bigint", "boolean"):
            raise ValueError("input must be an integer column")
        return self


@dataclass(frozen=True)
class CategoryBinning:
    """nbins equal bins from lower to upper; one more code at the end takes NaN and, if not included, what lies outside.

    The bin number is truncated towards zero, so values less than one bin below `lower` count as bin 0 in any case.
    """

    column: str
    lower: float
    upper: float
    nbins: int
    include_under: bool = True
    include_over: bool = True

    def code(self) -> Column:
        v = F.col(self.column).cast("double")
        i = ((v - F.lit(float(self.lower))) * F.lit(self.nbins / (self.upper - self.lower))).cast("long")
        out = F.lit(self.nbins)
        return (
            F.when(v.isNull() | F.isnan(v), out)
            .when(i < 0, F.lit(0) if self.include_under else out)
            .when(i >= self.nbins, F.lit(self.nbins - 1) if self.include_over else out)
            .otherwise(i)
            .cast("int")
        )

    def layers(self) -> list:
        return list(range(self.nbins + 1))

    def fitted(self, df: DataFrame) -> CategoryBinning:
        return self
