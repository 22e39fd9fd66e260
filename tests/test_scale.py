"""Steps whose cost must not be that of all rows in one task, or of all rows times all pixels."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.operators.areas import area
from tessera.operators.lines import line
from tessera.operators.polygons import polygons
from tessera.sources import rowindex

CANVAS = Canvas(12, 10, (0.0, 2.0), (0.0, 20.0))


def _runs(df) -> str:  # noqa: ANN001
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shapes(spark):  # noqa: ANN001, ANN201
    rows = spark.range(3000).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 5 + 3 as double) as b", "cast(id % 7 as double) as c", "if(id % 9 = 0, null, cast(id % 23 as double)) as v", "cast(id % 2 as string) as kind")
    return rows.coalesce(1)


@pytest.mark.parametrize("agg", [R.count(), R.count("v"), R.any(), R.sum("v"), R.sum_zero("v"), R.mean("v"), R.min("v"), R.max("v"), R.first("v"), R.last("v"), R.min_row_index(), R.max_row_index(), R.var("v"), R.where(R.max("v"), "id"), R.by("kind", R.mean("v"))])
def test_areas_add_up_spans(spark, shapes, agg):  # noqa: ANN001, ANN201
    """Any reduction is the same as that of the pixels of each row, and spans are aggregated before they are pixels."""
    got = {tuple(r[k] for k in r.asDict() if k != "value"): r["value"] for r in area(shapes, CANVAS, [0.0, 1.0, 2.0], ["a", "b", "c"], agg, axis=1, order="id").df.collect()}
    first = area(shapes, CANVAS, [0.0, 1.0, 2.0], ["a", "b", "c"], R.by("id", R.count()), axis=1, order="id").df.where("value > 0")
    pixels = first.select("py", "px", F.col("cat").cast("long").alias("id"), F.explode(F.sequence(F.lit(1), F.col("value").cast("int"))).alias("_")).join(shapes, "id").withColumn(R.ORDER, F.col("id"))
    keys = ["py", "px", *(["kind"] if isinstance(agg, R.by) else [])]
    want = {tuple(r[k] for k in keys): r["value"] for r in pixels.groupBy(*keys).agg((agg.reduction if isinstance(agg, R.by) else agg).aggregate().alias("value")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_areas_of_a_small_file_are_many_tasks(spark, shapes):  # noqa: ANN001, ANN201
    plan = _runs(area(shapes, CANVAS, [0.0, 1.0, 2.0], ["a", "b", "c"], R.sum("v"), axis=1).df)
    assert re.search(r"keys=\[px#\d+, _lo#\d+, _hi#\d+", plan)  # spans are grouped before they are pixels
    assert "RoundRobinPartitioning" in plan


def test_polygons_of_a_small_file_are_many_tasks(spark):  # noqa: ANN001, ANN201
    ring = "array(array(named_struct('x', x, 'y', y), named_struct('x', x + 3, 'y', y), named_struct('x', x, 'y', y + 3), named_struct('x', x, 'y', y)))"
    rows = spark.range(3000).selectExpr("id", "cast(id % 2 as double) as x", "cast(id % 7 as double) as y").selectExpr("id", f"{ring} as shape").coalesce(1)
    grid = polygons(rows, Canvas(12, 10, (0.0, 6.0), (0.0, 10.0)), "shape", R.count())
    assert "RoundRobinPartitioning" in _runs(grid.df)
    one = {(r["py"], r["px"]): r["value"] for r in polygons(rows.where("id < 14"), Canvas(12, 10, (0.0, 6.0), (0.0, 10.0)), "shape", R.count()).df.collect()}
    half = {(r["py"], r["px"]): r["value"] for r in polygons(rows.where("id < 28"), Canvas(12, 10, (0.0, 6.0), (0.0, 10.0)), "shape", R.count()).df.collect()}
    assert one and half == {k: 2 * v for k, v in one.items()}


def test_pixels_of_wide_lines_are_not_shuffled_with_their_lines(spark):  # noqa: ANN001, ANN201
    """A line's pixels are added up where the line is; only pixels are exchanged, and rows before."""
    rows = spark.range(3000).selectExpr("id", "array(0D, 1D, 2D) as xs", "array(cast(id % 3 as double), cast(id % 5 as double), cast(id % 2 as double)) as ys", "cast(id % 7 + 1 as double) as v").coalesce(1)
    canvas = Canvas(9, 9, (0.0, 2.0), (0.0, 4.0))
    for agg in (R.min("v"), R.first("v"), R.max("v"), R.any(), R.where(R.max("v"))):
        plan = _runs(line(rows, canvas, "xs", "ys", agg, axis=1, order="id", line_width=2.0).df)
        dealt = re.findall(r"hashpartitioning\(([^)]*)", plan)
        assert dealt and not [d for d in dealt if "py#" in d and R.ORDER in d]


def test_neighbours_within_large_groups_are_found_in_ranges(spark, monkeypatch):  # noqa: ANN001, ANN201
    """Large and small groups, one without a key, order with gaps: as by one window a group, without one task for a group."""
    rows = spark.range(900).selectExpr("id * id % 7919 as o", "if(id % 4 = 3, null, if(id < 880, id % 4, id)) as g", "cast(id as double) as v").where("o % 5 <> 2").dropDuplicates(["o"]).repartition(5)
    read = lambda df: {(r["g"], r["o"]): (r["v"], *[tuple(r[c]) if r[c] else None for c in ("_prev", "_next", "_next2")]) for r in df.collect()}
    want = read(rowindex.neighbours(rows, "o", ["v"], ["g"]))
    monkeypatch.setattr(rowindex, "RANGE_ROWS", 30)
    cut = rowindex.neighbours(rows, "o", ["v"], ["g"])
    assert cut.columns == [*rows.columns, "_prev", "_next", "_next2"]
    assert read(cut) == want and re.search(r"hashpartitioning\(_b#\d+, g#", _runs(cut))
