"""Shading counts discrete levels exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import shade


def test_levels_are_exact(spark):  # noqa: ANN001, ANN201
    for kind in ("long", "double"):
        got = []
        for n in (3, 40, 60, 80, 90, 95, 99):
            grid = spark.range(3 * n).select(F.lit(0).alias("py"), F.col("id").cast("int").alias("px"), (F.col("id") % n).cast(kind).alias("value"))
            got.append(shade._transformed(grid, "eq_hist", None)[3])
        assert got == [3, 40, 60, 80, 90, 95, 99], kind
