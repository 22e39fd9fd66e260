"""Lines, areas, polygons and triangle meshes in every layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.operators import segments as S
from tessera.operators.areas import area
from tessera.operators.lines import draw, line
from tessera.operators.polygons import polygons
from tessera.operators.trimesh import mesh, trimesh
from tessera.plans import sql
from tessera.plans.entries import Entry, digits, rounded, table

NAN = float("nan")
#: Cuts through the events' values, so that segments are clipped on all sides.
EVENTS = Canvas(80, 50, (40.0, 960.0), (2.0, 40.0))
VECTORS = Canvas(96, 60, (0.0, 63.0), (-0.4, 0.4))
PARTS = Canvas(60, 50, (0.0, 2.5), (5.0, 95.0))
FIELD = Canvas(70, 60, (0.0, 100.0), (0.0, 55.0))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x runs from 0 to 999 again and again; y and z have gaps; ri is the row order."""
    gap = F.col("event_id") % 97 == 13
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ri"), (F.col("event_id") % 1000).cast("double").alias("x"), F.when(gap, F.lit(NAN)).otherwise(F.col("value")).alias("y"),
        (F.col("value") / 4 + F.col("event_id") % 7).alias("z"), F.when(gap, F.lit(NAN)).otherwise(F.col("value") / 2).alias("half"), (F.col("event_id") % 11).cast("double").alias("v"), (F.col("user_id") % 5).alias("series"),
    )


EVENT_SOURCE = """select event_id as ri, (event_id % 1000)::double as x, case when event_id % 97 = 13 then null else value end as y, value / 4 + event_id % 7 as z,
case when event_id % 97 = 13 then null else value / 2 end as half, (event_id % 11)::double as v, user_id % 5 as series from events"""


def through(source: str, xs: list[str], ys: list[str], within: str | None = None, extra: tuple[str, ...] = ()) -> str:
    """Segments through rows by ri; several columns are several lines. extra: columns whose values at both ends come as name0 and name1."""
    out = []
    for n, (x, y) in enumerate(zip(xs, ys)):
        w = f"over (partition by {within} order by ri)" if within else "over (order by ri)"
        more = "".join(f", {e} as {e}0, lead({e}) {w} as {e}1" for e in extra)
        out.append(f"""select * from (select {n} as line, ri, v, {x} as x0, {y} as y0, lead({x}) {w} as x1, lead({y}) {w} as y1, lead(ri) {w} as nxt,
coalesce(lag({x}) {w} is null or lag({y}) {w} is null, true) as s{more} from ({source})) where nxt is not null""")
    return " union all ".join(out)


def along(source: str, x: str, y: str, low: str | None = None) -> str:
    """Segments along lists x and y of each row (id, v)."""
    more = f", {low} as ls" if low else ""
    ends = ", ls[i] as l0, ls[i + 1] as l1" if low else ""
    return f"""select id, v, xs[i] as x0, ys[i] as y0, xs[i + 1] as x1, ys[i + 1] as y1, (i = 1 or xs[i - 1] is null or ys[i - 1] is null) as s{ends}
from (select id, v, {x} as xs, {y} as ys{more}, unnest(range(1, least(len({x}), len({y})))) as i from ({source}))"""


VECTOR_SOURCE = "select vec_id as id, (vec_id % 9)::double as v, list_transform(embedding, lambda e: e::double) as e, list_transform(range(0, 64), lambda i: i::double) as pos from embeddings"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 9).cast("double").alias("v"), F.col("embedding").cast("array<double>").alias("e"),
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double")).alias("at"),
    )


PART_SOURCE = """select p_partkey as id, (p_partkey % 13)::double as v, p_size::double as a, p_retailprice / 20 as b, (p_partkey % 90)::double as c,
(p_size % 3)::double as xa, (p_partkey % 2 + 1)::double as xb, (p_size % 5)::double / 2 as xc from part"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 13).cast("double").alias("v"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 20).alias("b"),
        (F.col("p_partkey") % 90).cast("double").alias("c"), (F.col("p_size") % 3).cast("double").alias("xa"), (F.col("p_partkey") % 2 + 1).cast("double").alias("xb"),
        ((F.col("p_size") % 5).cast("double") / 2).alias("xc"),
    )


def _counted(ctes: str, e: str = "count(*)", source: str = "walk") -> str:
    return f"with {ctes} select py, px, {e} as value from {source} group by py, px"


def _lines() -> dict[str, Entry]:
    def through_rows(agg: R.Reduction, x="x", y="y", canvas: Canvas = EVENTS):  # noqa: ANN001, ANN202
        return lambda spark, sf_dir: rounded(line(events(spark, sf_dir), canvas, x, y, agg, order="ri"))

    one = sql.line_pixels(through(EVENT_SOURCE, ["x"], ["y"]), EVENTS)
    log = Canvas(80, 50, (1.0, 999.0), (1.0, 60.0), "log", "log")

    def series(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(draw(S.through_rows(events(spark, sf_dir), "x", "z", "ri", ["series"]), EVENTS, R.count()))

    def columns(x: object, y: object):  # noqa: ANN202
        return lambda spark, sf_dir: rounded(line(parts(spark, sf_dir), PARTS, x, y, R.sum("v"), axis=1))

    def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(line(vectors(spark, sf_dir), VECTORS, "at", "e", R.count(), axis=1))

    def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir).withColumn("g", F.zip_with("at", "e", lambda a, b: F.struct(a.alias("x"), b.alias("y"))))
        return rounded(line(df.select("v", "g"), VECTORS, [], [], R.max("v"), geometry="g"))

    def multi_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir).withColumn("g", F.zip_with("at", "e", lambda a, b: F.struct(a.alias("x"), b.alias("y"))))
        return rounded(line(df.select("v", F.array(F.slice("g", 1, 20), F.slice("g", 30, 25)).alias("g")), VECTORS, [], [], R.count(), geometry="g"))

    def wide(agg: R.Reduction, width: float, self_intersect: bool = True):  # noqa: ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = vectors(spark, sf_dir).withColumn("line", F.col("id"))
            return rounded(line(df, VECTORS, "at", "e", agg, axis=1, order="id", line_width=width, self_intersect=self_intersect))

        return run

    first = f"with {one} select py, px, arg_min(v, ri) as value from walk group by py, px"
    by_status = f"with {one} select py, px, (ri % 3)::int as cat, count(*) as value from walk group by all"

    def by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir).withColumn("three", (F.col("ri") % 3).cast("int"))
        from tessera.functions.categories import Categories

        return rounded(line(df, EVENTS, "x", "y", R.by(Categories("three", (0, 1, 2))), order="ri"))

    half = "list_slice(pos, {a}, {b}) as pos, list_slice(e, {a}, {b}) as e"
    two = " union all ".join(f"select id, v, {half.format(a=a, b=b)} from ({VECTOR_SOURCE})" for a, b in ((1, 20), (30, 54)))
    flat = lambda x, y: sql.line_pixels(along(PART_SOURCE, x, y), PARTS)
    vector = lambda x, y, source=VECTOR_SOURCE: sql.line_pixels(along(source, x, y), VECTORS)
    return {
        "line_axis0_any": Entry(through_rows(R.any()), _counted(one, "true")),
        "line_axis0_count": Entry(through_rows(R.count()), _counted(one)),
        "line_axis0_mean": Entry(through_rows(R.mean("v")), _counted(one, digits("avg(v)"))),
        "line_axis0_first": Entry(through_rows(R.first("v")), first),
        "line_axis0_by": Entry(by_rows, by_status),
        "line_axis0_log": Entry(through_rows(R.count(), canvas=log), _counted(sql.line_pixels(through(EVENT_SOURCE, ["x"], ["y"]), log))),
        "line_axis0_multi": Entry(through_rows(R.count(), ["x", "x"], ["y", "z"]), _counted(sql.line_pixels(through(EVENT_SOURCE, ["x", "x"], ["y", "z"]), EVENTS))),
        "line_common_x_series": Entry(series, _counted(sql.line_pixels(through(EVENT_SOURCE, ["x"], ["z"], "series"), EVENTS))),
        "line_axis1_columns": Entry(columns(["xa", "xb", "xc"], ["a", "b", "c"]), _counted(flat("[xa, xb, xc]", "[a, b, c]"), digits("sum(v)"))),
        "line_axis1_x_constant": Entry(columns([0.0, 1.0, 2.0], ["a", "b", "c"]), _counted(flat("[0.0::double, 1.0::double, 2.0::double]", "[a, b, c]"), digits("sum(v)"))),
        "line_axis1_y_constant": Entry(columns(["xa", "xb", "xc"], [10.0, 50.0, 90.0]), _counted(flat("[xa, xb, xc]", "[10.0::double, 50.0::double, 90.0::double]"), digits("sum(v)"))),
        "line_ragged": Entry(ragged, _counted(vector("pos", "e"))),
        "line_geometry": Entry(geometry, _counted(vector("pos", "e"), digits("max(v)"))),
        "line_multi_geometry": Entry(multi_geometry, _counted(vector("pos", "e", two))),
        # wide lines are checked against a pixel by pixel version in the tests
        "line_antialiased_count": Entry(wide(R.count(), 1.0)),
        "line_antialiased_sum_wide": Entry(wide(R.sum("v"), 2.5)),
        "line_antialiased_max": Entry(wide(R.max("v"), 1.0)),
        "line_antialiased_min": Entry(wide(R.min("v"), 2.0)),
        "line_antialiased_mean": Entry(wide(R.mean("v"), 1.0, False)),
        "line_antialiased_first": Entry(wide(R.first("v"), 2.0)),
        "line_antialiased_any": Entry(wide(R.any(), 0.5)),
    }


def _areas() -> dict[str, Entry]:
    canvas = Canvas(80, 50, (40.0, 960.0), (0.0, 40.0))
    shift = lambda s: f"select * rename (y0 as u0, y1 as u1) from ({s})"
    zero = lambda s: f"select *, 0.0::double as l0, 0.0::double as l1 from ({shift(s)})"
    low = lambda s, name: f"select * rename (y0 as u0, y1 as u1, {name}0 as l0, {name}1 as l1) from ({s})"
    rows = lambda y, stack=None, x="x": lambda spark, sf_dir: rounded(area(events(spark, sf_dir), canvas, x, y, R.count(), y_stack=stack, order="ri"))
    cols = lambda x, y, stack=None: lambda spark, sf_dir: rounded(area(parts(spark, sf_dir), PARTS, x, y, R.sum("v"), axis=1, y_stack=stack))
    ys = ["a", "b", "c"]
    nums, stacked = [0.0, 1.0, 2.0], ["v", "v", "v"]
    lit = "[0.0::double, 1.0::double, 2.0::double]"
    part = lambda x, y, stack=None: sql.area_pixels(zero(along(PART_SOURCE, x, y)) if stack is None else shift(along(PART_SOURCE, x, y, stack)), PARTS, stack is not None)

    def ragged(stack: bool):  # noqa: ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = vectors(spark, sf_dir).withColumn("low", F.transform("e", lambda v: v / 2))
            return rounded(area(df, VECTORS, "at", "e", R.count(), axis=1, y_stack="low" if stack else None))

        return run

    multi = " union all ".join(through(EVENT_SOURCE, ["x"], [y]) for y in ("y", "z"))
    multi_low = " union all ".join(f"select * rename ({c}0 as k0, {c}1 as k1) from ({through(EVENT_SOURCE, ['x'], [y], extra=(c,))})" for y, c in (("y", "half"), ("z", "half")))
    halves = "list_transform(e, lambda q: q / 2)"
    return {
        "area_axis0_to_zero": Entry(rows("y"), _counted(sql.area_pixels(zero(through(EVENT_SOURCE, ["x"], ["y"])), canvas, False))),
        "area_axis0_to_line": Entry(rows("y", "half"), _counted(sql.area_pixels(low(through(EVENT_SOURCE, ["x"], ["y"], extra=("half",)), "half"), canvas, True))),
        "area_axis0_multi": Entry(rows(["y", "z"], None, ["x", "x"]), _counted(sql.area_pixels(zero(multi), canvas, False))),
        "area_axis0_multi_to_line": Entry(rows(["y", "z"], ["half", "half"], ["x", "x"]), _counted(sql.area_pixels(low(multi_low, "k"), canvas, True))),
        "area_axis1_to_zero": Entry(cols(["xa", "xb", "xc"], ys), _counted(part("[xa, xb, xc]", "[a, b, c]"), digits("sum(v)"))),
        "area_axis1_to_line": Entry(cols(["xa", "xb", "xc"], ys, stacked), _counted(part("[xa, xb, xc]", "[a, b, c]", "[v, v, v]"), digits("sum(v)"))),
        "area_axis1_x_constant": Entry(cols(nums, ys), _counted(part(lit, "[a, b, c]"), digits("sum(v)"))),
        "area_axis1_x_constant_to_line": Entry(cols(nums, ys, stacked), _counted(part(lit, "[a, b, c]", "[v, v, v]"), digits("sum(v)"))),
        "area_axis1_y_constant": Entry(cols(["xa", "xb", "xc"], [20.0, 60.0, 40.0]), _counted(part("[xa, xb, xc]", "[20.0::double, 60.0::double, 40.0::double]"), digits("sum(v)"))),
        "area_axis1_y_constant_to_line": Entry(cols(["xa", "xb", "xc"], [20.0, 60.0, 40.0], [10.0, 30.0, 35.0]), _counted(part("[xa, xb, xc]", "[20.0::double, 60.0::double, 40.0::double]", "[10.0::double, 30.0::double, 35.0::double]"), digits("sum(v)"))),
        "area_ragged": Entry(ragged(False), _counted(sql.area_pixels(zero(along(VECTOR_SOURCE, "pos", "e")), VECTORS, False))),
        "area_ragged_to_line": Entry(ragged(True), _counted(sql.area_pixels(shift(along(VECTOR_SOURCE, "pos", "e", halves)), VECTORS, True))),
    }


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with a triangular hole for each part, and a diamond beside it as a second part."""
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    at = lambda dx, dy: F.struct((cx + r * dx).alias("x"), (cy + r * dy).alias("y"))
    ring = lambda pts: F.array(*[at(*p) for p in pts])
    outer, hole, diamond = ring([(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]), ring([(-0.5, -0.5), (0, 0.5), (0.5, -0.5), (-0.5, -0.5)]), ring([(2, -1), (3, 0), (2, 1), (1.5, 0), (2, -1)])
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 13).cast("double").alias("v"), (F.col("p_partkey") % 101).cast("double").alias("cx"), F.col("p_size").cast("double").alias("cy"),
        ((F.col("p_partkey") % 5).cast("double") * 0.75 + 0.25).alias("r"),
    )
    return df.select("id", "v", F.array(F.array(outer, hole), F.array(diamond)).alias("shape"))


def _polygon_sql(e: str) -> str:
    x, y = FIELD.x, FIELD.y
    points = ((0, 0, ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))), (0, 1, ((-0.5, -0.5), (0, 0.5), (0.5, -0.5), (-0.5, -0.5))), (1, 0, ((2, -1), (3, 0), (2, 1), (1.5, 0), (2, -1))))
    values = ", ".join(f"({p}, {r}, {k}, {sql.number(dx)}, {sql.number(dy)})" for p, r, pts in points for k, (dx, dy) in enumerate(pts))
    return f"""with s as (select p_partkey as id, (p_partkey % 13)::double as v, (p_partkey % 101)::double as cx, p_size::double as cy, (p_partkey % 5)::double * 0.75 + 0.25 as r from part),
pt as (select id, v, part, ring, k, cx + r * dx as x, cy + r * dy as y from s cross join (values {values}) t(part, ring, k, dx, dy)),
bb as (select id, part, any_value(v) as v, min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb from pt group by id, part),
vis as (select * from bb where not (xb < {sql.number(x.range[0])} or xa > {sql.number(x.range[1])} or yb < {sql.number(y.range[0])} or ya > {sql.number(y.range[1])})),
box as (select id, part, v, {sql.vertex(x, f'greatest(xa, {sql.number(x.range[0])})')} as x0, {sql.vertex(x, f'least(xb, {sql.number(x.range[1])})')} as x1,
 {sql.vertex(y, f'greatest(ya, {sql.number(y.range[0])})')} as y0, {sql.vertex(y, f'least(yb, {sql.number(y.range[1])})')} as y1 from vis),
cel as (select *, unnest(range(x0, x1 + 1)) as px from (select *, unnest(range(y0, y1 + 1)) as py from box)),
fl as (select id, part, ring, k, ({sql.place(x, 'x')} - 0.5::double)::float as x, ({sql.place(y, 'y')} - 0.5::double)::float as y from pt),
ed as (select *, lead(x) over w as nx, lead(y) over w as ny from fl window w as (partition by id, part, ring order by k)),
up as (select id, part, case when ny > y then x else nx end as ax, case when ny > y then y else ny end as ay, case when ny > y then nx else x end as bx, case when ny > y then ny else y end as by_, case when ny > y then 1 else -1 end as dir
       from ed where nx is not null and ny <> y),
rel as (select c.id, c.part, c.v, c.px, c.py, c.x0 = c.x1 or c.y0 = c.y1 as thin, u.dir, u.ax - c.px::float as ax, u.ay - c.py::float as ay, u.bx - c.px::float as bx, u.by_ - c.py::float as by_
        from cel c left join up u on u.id = c.id and u.part = c.part),
wn as (select id, part, any_value(v) as v, px, py, any_value(thin) as thin, sum(case when ay < 0 and by_ >= 0 and not (ax < 0 and bx < 0)
       and ((ax >= 0 and bx >= 0) or bx * ay - by_ * ax < 0 or (bx * ay - by_ * ax = 0 and dir > 0)) then dir else 0 end) as w from rel group by id, part, px, py),
walk as (select * from wn where (thin or w <> 0) and px between 0 and {FIELD.plot_width - 1} and py between 0 and {FIELD.plot_height - 1})
select py::int as py, px::int as px, {e} as value from walk group by all"""


def _polygons() -> dict[str, Entry]:
    run = lambda agg: lambda spark, sf_dir: rounded(polygons(_shapes(spark, sf_dir), FIELD, "shape", agg))
    return {"polygons_count": Entry(run(R.count()), _polygon_sql("count(*)")), "polygons_sum": Entry(run(R.sum("v")), _polygon_sql(digits("sum(v)"))), "polygons_max": Entry(run(R.max("v")), _polygon_sql(digits("max(v)")))}


def _net(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex_pos"), (F.col("p_partkey") * 37 % 101).cast("double").alias("x"), (F.col("p_partkey") * 53 % 59).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))
    simplices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tri_pos"), F.col("p_partkey").alias("v0"), (F.col("p_partkey") + 1).alias("v1"), (F.col("p_partkey") + 2).alias("v2"), (F.col("p_partkey") % 7).cast("double").alias("val"))
    return vertices, simplices


def _mesh_sql(interpolate: bool, vertex_weight: bool, e: str) -> str:
    axes = {"x": FIELD.x, "y": FIELD.y}
    edge = lambda a, b: f"((px - {a}x) * ({b}y - {a}y) - (py - {a}y) * ({b}x - {a}x))"
    own = lambda w, a, b: f"({w} > 0 or ({w} = 0 and not ({a}y < {b}y or ({a}y = {b}y and {a}x < {b}x))))"
    weights = ("f.z", "g.z", "h.z") if vertex_weight else ("s.val",) * 3
    flat = "(w0 + w1 + w2) / 3"
    value = f"case when dot then {flat} else (e0 * w0 + e1 * w1 + e2 * w2) / area end" if interpolate else flat
    lim = {c: (a.number(a.range[0]) * a.scale + a.shift - 0.5, a.number(a.range[1]) * a.scale + a.shift - 0.5, a.size - 1) for c, a in axes.items()}
    low = lambda c: f"greatest(floor(greatest(least(f{c}, g{c}, h{c}), {sql.number(lim[c][0])}) + 0.5), 0)::int"
    high = lambda c: f"least(floor(least(greatest(f{c}, g{c}, h{c}), {sql.number(lim[c][1])}) + 0.5), {lim[c][2]})::int"
    seen = " and ".join(f"least(f{c}, g{c}, h{c}) < {sql.number(lim[c][1])} and greatest(f{c}, g{c}, h{c}) >= {sql.number(lim[c][0])}" for c in "xy")
    turned = ", ".join(f"case when turn then {b} else {a} end as {a}" for a, b in (("gx", "hx"), ("hx", "gx"), ("gy", "hy"), ("hy", "gy"), ("w1", "w2"), ("w2", "w1")))
    return f"""with vt as (select p_partkey as pos, (p_partkey * 37 % 101)::double as x, (p_partkey * 53 % 59)::double as y, p_size::double as z from part),
sm as (select p_partkey as v0, p_partkey + 1 as v1, p_partkey + 2 as v2, (p_partkey % 7)::double as val from part),
tri as (select s.v0, f.x as fx, f.y as fy, g.x as gx, g.y as gy, h.x as hx, h.y as hy, {', '.join(f'{w} as w{n}' for n, w in enumerate(weights))}
        from sm s join vt f on f.pos = s.v0 join vt g on g.pos = s.v1 join vt h on h.pos = s.v2),
fst as (select (hx - fx) * (gy - fy) - (hy - fy) * (gx - fx) < 0 as turn from tri order by v0 limit 1),
fix as (select fx, fy, w0, {turned} from tri cross join fst),
scr as (select w0, w1, w2, {', '.join(f"{sql.place(a, v + c)} - 0.5::double as {v}{c}" for v in 'fgh' for c, a in axes.items())} from fix),
box as (select *, {low('x')} as x0, {high('x')} as x1, {low('y')} as y0, {high('y')} as y1 from scr where {seen}),
cel as (select *, x0 = x1 and y0 = y1 as dot, unnest(range(x0, x1 + 1)) as px from (select *, unnest(range(y0, y1 + 1)) as py from box)),
edg as (select *, {edge('g', 'h')} as e0, {edge('h', 'f')} as e1, {edge('f', 'g')} as e2, (hx - fx) * (gy - fy) - (hy - fy) * (gx - fx) as area from cel),
walk as (select py, px, {value} as value from edg where dot or ({own('e2', 'f', 'g')} and {own('e0', 'g', 'h')} and {own('e1', 'h', 'f')}))
select py::int as py, px::int as px, {e} as value from walk group by all"""


def _meshes() -> dict[str, Entry]:
    def run(agg: R.Reduction, interpolate: bool, vertex_weight: bool):  # noqa: ANN202
        def go(spark: SparkSession, sf_dir: str) -> DataFrame:
            vertices, simplices = _net(spark, sf_dir)
            triangles = mesh(vertices, simplices, weight="z" if vertex_weight else None, simplex_weight=None if vertex_weight else "val")
            return rounded(trimesh(triangles, FIELD, agg, interpolate))

        return go

    return {
        "trimesh_interpolated": Entry(run(R.mean("value"), True, True), _mesh_sql(True, True, digits("avg(value)"))),
        "trimesh_nearest": Entry(run(R.max("value"), False, True), _mesh_sql(False, True, digits("max(value)"))),
        "trimesh_simplex_weights": Entry(run(R.sum("value"), True, False), _mesh_sql(True, False, digits("sum(value)"))),
    }


def entries() -> dict[str, Entry]:
    return _lines() | _areas() | _polygons() | _meshes()
