"""Reductions: what a pixel holds of the rows that fall on it.

Each is a decomposable Spark aggregate over (row, pixel) pairs, so Spark combines before it shuffles. NaN counts as missing;
a pixel without a valid value holds null (counts: 0, any: false, row indices: -1). Row order is the explicit column
ORDER, never the order of partitions. The n-fold ones rank with a window, which Spark trims per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.canvas import known

#: The row index that first, last, where and ties go by.
ORDER = "_ri"


@dataclass(frozen=True)
class Reduction:
    """Base; `column` is None where rows themselves are meant."""

    column: str | None = None

    #: Whether ORDER must exist; the value of a pixel that no row reaches.
    ordered: ClassVar[bool] = False
    empty: ClassVar[object] = None

    @property
    def v(self) -> Column:
        if self.column is None:
            raise ValueError(f"{type(self).__name__} needs a column")
        return known(F.col(self.column).cast("double"))

    @property
    def raw(self) -> Column:
        return known(F.col(self.column))

    def inputs(self) -> list[str]:
        return [self.column] if self.column else []

    def aggregate(self) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no aggregate")

    def parts(self) -> dict[str, Column]:
        """Aggregates of some of a pixel's rows from which `merged` makes the value of all; none where that can't be."""
        return {}

    def merged(self) -> Column:
        raise NotImplementedError(f"{type(self).__name__} can't be merged")


class count(Reduction):
    empty = 0

    def aggregate(self) -> Column:
        return F.count(F.lit(1)) if self.column is None else F.count(known(F.col(self.column)))

    def parts(self) -> dict[str, Column]:
        return {"_n": self.aggregate()}

    def merged(self) -> Column:
        return F.sum("_n")


class any(Reduction):
    empty = False

    def aggregate(self) -> Column:
        return (F.count(F.lit(1)) if self.column is None else F.count(known(F.col(self.column)))) > 0

    def parts(self) -> dict[str, Column]:
        return {"_n": self.aggregate()}

    def merged(self) -> Column:
        return F.max("_n")


class sum(Reduction):
    def aggregate(self) -> Column:
        return F.sum(self.v)

    def parts(self) -> dict[str, Column]:
        return {"_s": F.sum(self.v)}

    def merged(self) -> Column:
        return F.sum("_s")


class sum_zero(Reduction):
    empty = 0.0

    def aggregate(self) -> Column:
        return F.coalesce(F.sum(self.v), F.lit(0.0))

    def parts(self) -> dict[str, Column]:
        return {"_s": F.sum(self.v)}

    def merged(self) -> Column:
        return F.coalesce(F.sum("_s"), F.lit(0.0))


class mean(Reduction):
    def aggregate(self) -> Column:
        return F.avg(self.v)

    def parts(self) -> dict[str, Column]:
        return {"_s": F.sum(self.v), "_n": F.count(self.v)}

    def merged(self) -> Column:
        return F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))


class m2(Reduction):
    """Sum of squared deviations from the mean."""

    def aggregate(self) -> Column:
        return F.var_pop(self.v) * F.count(self.v)


class var(Reduction):
    """Population variance."""

    def aggregate(self) -> Column:
        return F.var_pop(self.v)


class std(Reduction):
    """Population standard deviation."""

    def aggregate(self) -> Column:
        return F.stddev_pop(self.v)


class min(Reduction):
    def aggregate(self) -> Column:
        return F.min(self.v)

    def parts(self) -> dict[str, Column]:
        return {"_v": F.min(self.v)}

    def merged(self) -> Column:
        return F.min("_v")


class max(Reduction):
    def aggregate(self) -> Column:
        return F.max(self.v)

    def parts(self) -> dict[str, Column]:
        return {"_v": F.max(self.v)}

    def merged(self) -> Column:
        return F.max("_v")


class first(Reduction):
    """Value of the first row, in ORDER, that has one."""

    ordered = True

    def aggregate(self) -> Column:
        return F.min_by(self.raw, F.when(self.raw.isNotNull(), F.col(ORDER)))

    def parts(self) -> dict[str, Column]:
        return {"_v": self.aggregate(), "_o": F.min(F.when(self.raw.isNotNull(), F.col(ORDER)))}

    def merged(self) -> Column:
        return F.min_by("_v", "_o")


class last(Reduction):
    ordered = True

    def aggregate(self) -> Column:
        return F.max_by(self.raw, F.when(self.raw.isNotNull(), F.col(ORDER)))

    def parts(self) -> dict[str, Column]:
        return {"_v": self.aggregate(), "_o": F.max(F.when(self.raw.isNotNull(), F.col(ORDER)))}

    def merged(self) -> Column:
        return F.max_by("_v", "_o")


class min_row_index(Reduction):
    ordered = True
    empty = -1

    def aggregate(self) -> Column:
        return F.coalesce(F.min(ORDER), F.lit(-1).cast("long"))

    def parts(self) -> dict[str, Column]:
        return {"_o": F.min(ORDER)}

    def merged(self) -> Column:
        return F.coalesce(F.min("_o"), F.lit(-1).cast("long"))


class max_row_index(Reduction):
    ordered = True
    empty = -1

    def aggregate(self) -> Column:
        return F.coalesce(F.max(ORDER), F.lit(-1).cast("long"))

    def parts(self) -> dict[str, Column]:
        return {"_o": F.max(ORDER)}

    def merged(self) -> Column:
        return F.coalesce(F.max("_o"), F.lit(-1).cast("long"))


class mode(Reduction):
    """Most frequent value; only raster resampling has it."""

    def aggregate(self) -> Column:
        raise NotImplementedError("mode is for Canvas.raster only")


@dataclass(frozen=True)
class Ranked(Reduction):
    """The n best values of a pixel in the order of `keys`."""

    n: int = 1
    ordered = True

    def keys(self) -> list[Column]:
        raise NotImplementedError

    def valid(self) -> Column:
        return self.raw.isNotNull()

    @property
    def most(self) -> int:
        return self.n if self.n > 1 else 1


class first_n(Ranked):
    def keys(self) -> list[Column]:
        return [F.col(ORDER).asc()]


class last_n(Ranked):
    """Latest first."""

    def keys(self) -> list[Column]:
        return [F.col(ORDER).desc()]


class max_n(Ranked):
    """Largest first, repeats kept."""

    def keys(self) -> list[Column]:
        return [self.raw.desc(), F.col(ORDER).asc()]


class min_n(Ranked):
    def keys(self) -> list[Column]:
        return [self.raw.asc(), F.col(ORDER).asc()]


class max_n_row_index(Ranked):
    def keys(self) -> list[Column]:
        return [F.col(ORDER).desc()]

    def valid(self) -> Column:
        return F.lit(True)


class min_n_row_index(Ranked):
    def keys(self) -> list[Column]:
        return [F.col(ORDER).asc()]

    def valid(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class where(Reduction):
    """The lookup column (None: the row index) at the row that a selector picks; on ties the lowest row index wins."""

    selector: Reduction = field(default_factory=count)
    lookup: str | None = None
    ordered = True

    def __init__(self, selector: Reduction, lookup: str | None = None):
        object.__setattr__(self, "selector", selector)
        object.__setattr__(self, "lookup", lookup)
        object.__setattr__(self, "column", selector.column)
        if not isinstance(selector, (first, last, min, max, Ranked)):
            raise TypeError("selector can only be a first, last, min or max, or one of their n-fold forms")
        if lookup is not None and lookup == selector.column:
            raise ValueError("lookup and selector need different columns")

    @property
    def empty(self) -> object:
        return None if self.lookup else -1

    def inputs(self) -> list[str]:
        return [*self.selector.inputs(), *([self.lookup] if self.lookup else [])]

    def target(self) -> Column:
        return known(F.col(self.lookup)) if self.lookup else F.col(ORDER)

    def aggregate(self) -> Column:
        s, ri = self.selector, F.col(ORDER)
        ok = s.raw.isNotNull()
        if isinstance(s, first):
            return F.min_by(self.target(), F.when(ok, ri))
        if isinstance(s, last):
            return F.max_by(self.target(), F.when(ok, ri))
        if isinstance(s, min):
            return F.min_by(self.target(), F.when(ok, F.struct(s.raw.alias("v"), ri.alias("i"))))
        return F.max_by(self.target(), F.when(ok, F.struct(s.raw.alias("v"), (-ri).alias("i"))))


@dataclass(frozen=True)
class by(Reduction):
    """A reduction for each category; every declared category is a layer of the dense grid."""

    category: object = None
    reduction: Reduction = field(default_factory=count)

    def __init__(self, category: object, reduction: Reduction | None = None):
        from tessera.functions.categories import Categories

        object.__setattr__(self, "category", Categories(category) if isinstance(category, str) else category)
        object.__setattr__(self, "reduction", reduction or count())
        object.__setattr__(self, "column", self.reduction.column)

    @property
    def ordered(self) -> bool:
        return self.reduction.ordered

    @property
    def empty(self) -> object:
        return self.reduction.empty

    def inputs(self) -> list[str]:
        return [self.category.column, *self.reduction.inputs()]


def count_cat(column: str) -> by:
    return by(column, count())


@dataclass(frozen=True)
class summary(Reduction):
    """Several reductions in one pass, by name."""

    parts: dict = field(default_factory=dict)

    def __init__(self, **parts: Reduction):
        object.__setattr__(self, "parts", dict(sorted(parts.items())))
        object.__setattr__(self, "column", None)
        sizes = {p.most for p in (getattr(r, "selector", r) for r in parts.values()) if isinstance(p, Ranked)}
        if len(sizes) > 1:
            raise ValueError("n-fold reductions of one summary need the same n")

    @property
    def ordered(self) -> bool:
        return bool([r for r in self.parts.values() if r.ordered])

    def inputs(self) -> list[str]:
        return [c for r in self.parts.values() for c in r.inputs()]
