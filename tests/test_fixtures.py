"""Small tables with known grids, for any number of partitions, and wide lines against a pixel by pixel version."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.functions.categories import Categories, CategoryBinning
from tessera.operators.areas import area
from tessera.operators.lines import line
from tessera.operators.points import points
from tessera.operators.raster import raster
from tessera.operators.quadmesh import Coordinates
from tessera.sources.images import png, to_png
from tessera.sources.layouts import array_to_cells
from tessera.operators.shade import shade

NAN = float("nan")
SQUARE = Canvas(2, 2, (0.0, 1.0), (0.0, 1.0))


def dense(grid, shape):  # noqa: ANN001, ANN201
    out = [[None] * shape[1] for _ in range(shape[0])]
    for r in grid.df.collect():
        out[r["py"]][r["px"]] = r["value"]
    return out


@pytest.fixture(scope="module", params=[1, 2, 4])
def base(spark, request):  # noqa: ANN001, ANN201
    rows = [(i, float(i >= 10), float(i % 10 >= 5), i, NAN if i == 2 else float(i), 0.0 if i < 15 else NAN, "abcd"[i // 5]) for i in range(20)]
    return spark.createDataFrame(rows, "ri long, x double, y double, i32 int, f64 double, empty_bin double, cat string").repartition(request.param)


@pytest.mark.parametrize(("agg", "want"), [
    (R.count(), [[5, 5], [5, 5]]), (R.count("f64"), [[4, 5], [5, 5]]), (R.any("empty_bin"), [[True, True], [True, False]]), (R.sum("i32"), [[10, 60], [35, 85]]),
    (R.sum("f64"), [[8, 60], [35, 85]]), (R.first("i32"), [[0, 10], [5, 15]]), (R.last("f64"), [[4, 14], [9, 19]]), (R.min("f64"), [[0, 10], [5, 15]]),
    (R.mean("f64"), [[2, 12], [7, 17]]), (R.var("i32"), [[2, 2], [2, 2]]), (R.where(R.max("f64"), "i32"), [[4, 14], [9, 19]]), (R.where(R.min("f64")), [[0, 10], [5, 15]]),
])
def test_reductions(base, agg, want):  # noqa: ANN001, ANN201
    got = dense(points(base, SQUARE, agg=agg, order="ri"), (2, 2))
    assert [v for row in got for v in row] == pytest.approx([v for row in want for v in row])


def test_log_axes(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(1.0, 1.0), (10.0, 1.0), (1.0, 10.0), (10.0, 10.0)], "x double, y double")
    assert dense(points(df, Canvas(2, 2, (1.0, 10.0), (1.0, 10.0), "log", "log")), (2, 2)) == [[1, 1], [1, 1]]


def test_bins_and_undeclared_categories(base):  # noqa: ANN001, ANN201
    got = {(r["py"], r["px"], r["cat"]): r["value"] for r in points(base, SQUARE, agg=R.by(CategoryBinning("f64", 0, 20, 4))).df.collect()}
    assert got == {(0, 0, 0): 4, (0, 0, 4): 1, (1, 0, 1): 5, (0, 1, 2): 5, (1, 1, 3): 5}
    some = points(base, SQUARE, agg=R.by(Categories("cat", ("a", "d")))).df.collect()
    assert {(r["py"], r["px"], r["cat"]): r["value"] for r in some} == {(0, 0, "a"): 5, (1, 1, "d"): 5}


def test_point_geometry(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([((0.0, 0.0), 1), ((0.0, 1.0), 2), ((1.0, 1.0), 2), ((0.0, 2.0), 3), ((1.0, 2.0), 3), ((2.0, 2.0), 3)], "g struct<x double, y double>, v int")
    assert dense(points(df, Canvas(3, 3), agg=R.sum("v"), geometry="g"), (3, 3)) == [[1, None, None], [2, 2, None], [3, 3, 3]]


def test_line_with_a_gap_is_a_diamond(spark):  # noqa: ANN001, ANN201
    rows = [(0, 0.0, -4.0), (1, -4.0, 0.0), (2, 0.0, 4.0), (3, NAN, NAN), (4, 0.0, -4.0), (5, 4.0, 0.0), (6, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "ri long, x double, y double").repartition(3)
    got = {(r["py"], r["px"]): r["value"] for r in line(df, Canvas(9, 9, (-3.0, 3.0), (-3.0, 3.0)), "x", "y", R.count(), order="ri").df.collect()}
    full = {(r["py"] - 4, r["px"] - 4): r["value"] for r in line(df, Canvas(9, 9), "x", "y", R.count(), order="ri").df.collect()}
    assert full == {(y, x): 2 if x == 0 else 1 for y in range(-4, 5) for x in range(-4, 5) if abs(x) + abs(y) == 4}
    assert got and all(0 <= y < 9 and 0 <= x < 9 for y, x in got)


def test_area_to_zero(spark):  # noqa: ANN001, ANN201
    rows = list(zip(range(6), [-4.0, -2.0, 0.0, 0.0, 2.0, 4.0], [0.0, -4.0, 0.0, 0.0, -4.0, 0.0]))
    got = area(spark.createDataFrame(rows, "ri long, x double, y double"), Canvas(13, 7), "x", "y", R.any(), order="ri").df.collect()
    columns = {x: sorted(r["py"] for r in got if r["px"] == x) for x in range(13)}
    assert columns[3] == list(range(7)) and columns[9] == list(range(7)) and columns[0] == [6] and columns[12] == [6]


def test_raster_blocks_and_missing(spark):  # noqa: ANN001, ANN201
    cells = array_to_cells(spark, [[9999, 1, 2, 3], [4, 9999, 6, 7], [8, 9, 9999, 11]])
    got = raster(cells, Canvas(2, 2), Coordinates((0.0, 1.0, 2.0, 3.0)), Coordinates((0.0, 1.0, 2.0)), downsample_method="max", nan_value=9999)
    assert dense(got, (2, 2)) == [[4, 7], [9, 11]]


@pytest.mark.parametrize("width", [1.0, 2.5, 0.5])
def test_wide_lines_pixel_by_pixel(spark, width):  # noqa: ANN001, ANN201
    canvas = Canvas(11, 11, (-0.1875, 1.1875), (-0.1875, 1.1875))
    lines = [((0.0, 0.1), (1.0, 0.9), 3.0), ((0.1, 0.8), (0.9, 0.8), 2.0), ((0.3, 0.0), (0.3, 1.0), 1.5)]
    df = spark.createDataFrame([(i, [a[0], b[0]], [a[1], b[1]], v) for i, (a, b, v) in enumerate(lines)], "line long, xs array<double>, ys array<double>, v double")
    got = {(r["py"], r["px"]): r["value"] for r in line(df, canvas, "xs", "ys", R.max("v"), axis=1, order="line", line_width=width).df.collect() if r["value"] > 1e-9}
    w, scale = max(width, 1.0), min(width, 1.0)
    want = {}
    for a, b, v in lines:
        (ax, bx), (ay, by) = ([p * canvas.x.scale + canvas.x.shift - 0.5 for p in c] for c in zip(a, b))
        for py in range(11):
            for px in range(11):
                t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                d = math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))
                aa = scale * (1 - min(1.0, max(0.0, d - 0.5 * (w - 1))))
                if aa > 1e-9:
                    want[py, px] = max(want.get((py, px), 0.0), aa * v)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_png(spark, base):  # noqa: ANN001, ANN201
    image = shade(points(base, SQUARE).df.withColumn("value", F.col("value") + F.col("px")), how="linear")
    assert to_png(image, (2, 2)).startswith(b"\x89PNG") and callable(png)


def test_wrong_arguments(spark, base):  # noqa: ANN001, ANN201
    for bad in (lambda: Canvas(0, 2), lambda: Canvas(2, 2, (0.0, 1.0), None, "log"), lambda: points(base, SQUARE, "cat", "y"), lambda: points(base, SQUARE, "nowhere", "y"), lambda: points(base, SQUARE, agg=R.first("i32")), lambda: R.where(R.max("f64"), "f64")):
        with pytest.raises(ValueError):
            bad()
