"""Wide lines with ranked, categorical and several reductions: row indices pixel by pixel, and against a plain version."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.operators.lines import line

LINES = [((0.5, 1.0, 0.0), 2.2, -9.0), ((1.0, 0.0, 0.5), 3.3, -7.0), ((0.0, 0.5, 1.0), 1.1, -5.0)]
# The rows that come first and second in each of 7 x 7 pixels (-1: none).
FIRST = [
    [[2, -1], [2, -1], [1, -1], [1, 1], [1, -1], [-1, -1], [0, -1]],
    [[2, -1], [2, -1], [1, 2], [1, -1], [1, -1], [0, 1], [0, -1]],
    [[-1, -1], [1, 2], [1, 2], [2, -1], [-1, -1], [0, 1], [0, 1]],
    [[0, -1], [1, -1], [1, 2], [2, 2], [0, 2], [0, -1], [1, -1]],
    [[0, 1], [0, 1], [-1, -1], [2, -1], [0, 2], [0, 2], [-1, -1]],
    [[1, -1], [0, 1], [0, -1], [0, -1], [0, 2], [2, -1], [2, -1]],
    [[1, -1], [-1, -1], [0, -1], [0, 0], [0, -1], [2, -1], [2, -1]],
]
# The pixels in which the order by value x coverage, largest first, differs.
MAX = {(1, 5): [1, 0], (2, 5): [1, 0], (2, 6): [1, 0], (4, 1): [1, 0]}
#: Where the table repeats a row, as it counts segments that cross in a pixel; here each line has one place in a pixel.
TWICE = {(0, 3), (3, 3), (6, 3)}


@pytest.fixture(scope="module")
def lines(spark):  # noqa: ANN001, ANN201
    rows = [(i, [0.0, 1.0, 2.0], list(y), v, o, "ab"[i % 2]) for i, (y, v, o) in enumerate(LINES)]
    return spark.createDataFrame(rows, "i long, xs array<double>, ys array<double>, value double, other double, kind string").repartition(3)


def _grid(df, agg, width=1.0):  # noqa: ANN001, ANN202
    return line(df, Canvas(7, 7), "xs", "ys", agg, axis=1, order="i", line_width=width)


def _wanted(table, k):  # noqa: ANN001, ANN202
    out = {}
    for y, row in enumerate(table):
        for x, pair in enumerate(row):
            if pair[k] >= 0 and not (k and (y, x) in TWICE):
                out[y, x] = pair[k]
    return out


def _max_table():  # noqa: ANN202
    return [[MAX.get((y, x), pair) for x, pair in enumerate(row)] for y, row in enumerate(FIRST)]


@pytest.mark.parametrize("lookup", [None, "other"])
@pytest.mark.parametrize("which", ["first", "last", "max", "min_index", "max_index"])
def test_where(spark, lines, which, lookup):  # noqa: ANN001, ANN201
    selector = {"first": R.first_n("value", 2), "last": R.last_n("value", 2), "max": R.max_n("value", 2), "min_index": R.min_n_row_index(n=2), "max_index": R.max_n_row_index(n=2)}[which]
    got = {(r["py"], r["px"], r["n"]): r["value"] for r in _grid(lines, R.where(selector, lookup)).df.collect()}
    table = _max_table() if which == "max" else FIRST
    flipped = which in ("last", "max_index")
    want = {}
    for k in (0, 1):
        for (y, x), i in _wanted(table, k).items():
            both = (y, x) in _wanted(table, 1)
            want[y, x, (1 - k) if flipped and both else k] = LINES[i][2] if lookup else i
    assert got == want


def test_where_of_one(spark, lines):  # noqa: ANN001, ANN201
    for selector, table in ((R.first("value"), FIRST), (R.max("value"), _max_table())):
        grid = _grid(lines, R.where(selector))
        assert "n" not in grid.keys and {(r["py"], r["px"]): r["value"] for r in grid.df.collect()} == _wanted(table, 0)


@pytest.mark.parametrize("name", ["count", "sum", "min", "max", "mean", "first", "last", "any"])
@pytest.mark.parametrize("width", [1.0, 2.5])
def test_plain_reductions_of_straight_lines(spark, name, width):  # noqa: ANN001, ANN201
    """Lines of one segment: coverage is a function of the distance to the segment."""
    canvas = Canvas(13, 11, (-0.2, 1.2), (-0.2, 1.2))
    ends = [((0.0, 0.1), (1.0, 0.9), 3.0), ((0.1, 0.8), (0.9, 0.8), 2.0), ((0.3, 0.0), (0.3, 1.0), 1.5), ((1.0, 0.2), (0.0, 0.7), 4.0)]
    df = spark.createDataFrame([(i, [a[0], b[0]], [a[1], b[1]], v) for i, (a, b, v) in enumerate(ends)], "i long, xs array<double>, ys array<double>, v double")
    agg = R.count() if name == "count" else R.any() if name == "any" else getattr(R, name)("v")
    got = {(r["py"], r["px"]): r["value"] for r in line(df, canvas, "xs", "ys", agg, axis=1, order="i", line_width=width).df.collect()}
    want = {}
    for py in range(11):
        for px in range(13):
            found = []
            for a, b, v in ends:
                ax, bx = (p * canvas.x.scale + canvas.x.shift - 0.5 for p in (a[0], b[0]))
                ay, by = (p * canvas.y.scale + canvas.y.shift - 0.5 for p in (a[1], b[1]))
                t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                aa = 1 - min(1.0, max(0.0, math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)) - 0.5 * (width - 1)))
                if aa > 0:
                    found.append((aa, v))
            if found:
                x = [aa if name in ("count", "any") else aa * v for aa, v in found]
                want[py, px] = {"count": sum, "sum": sum, "min": min, "max": max, "any": max, "mean": lambda x: sum(x) / len(x), "first": lambda x: x[0], "last": lambda x: x[-1]}[name](x)
    real = {k for k, v in want.items() if v > 1e-9}
    assert real <= got.keys() <= want.keys() | {k for k, v in got.items() if v < 1e-9}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in real)


def test_categories_and_summaries_are_their_parts(spark, lines):  # noqa: ANN001, ANN201
    per = {(r["cat"], r["py"], r["px"]): r["value"] for r in _grid(lines, R.by("kind", R.count())).df.collect()}
    for kind in "ab":
        own = {(kind, r["py"], r["px"]): r["value"] for r in line(lines.where(F.col("kind") == kind), Canvas(7, 7, (0.0, 2.0), (0.0, 1.0)), "xs", "ys", R.count(), axis=1, order="i", line_width=1.0).df.collect()}
        assert own == {k: v for k, v in per.items() if k[0] == kind}
    parts = {"a": R.count(), "b": R.max("value"), "c": R.where(R.first("value"), "other")}
    whole = {(r["py"], r["px"]): r for r in _grid(lines, R.summary(**parts)).df.collect()}
    for n, agg in parts.items():
        assert {(r["py"], r["px"]): r["value"] for r in _grid(lines, agg).df.collect()} == {k: r[n] for k, r in whole.items() if r[n] is not None}


def test_variances_have_no_wide_form(spark, lines):  # noqa: ANN001, ANN201
    with pytest.raises(NotImplementedError):
        _grid(lines, R.std("value"))
