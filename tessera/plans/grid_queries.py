"""Gridded sources, transfer functions, compositing, graphs, tiles, layouts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.functions.colors import rgb
from tessera.functions.geo import Tiling, with_mercator
from tessera.operators import composite, graph, grid, quadmesh, raster, shade, spread, tiles
from tessera.operators.points import points
from tessera.plans import sql
from tessera.plans.entries import Entry, digits, rounded, table
from tessera.plans.pipeline import Pipeline
from tessera.plans.point_queries import ITEM_SOURCE, ITEMS
from tessera.sources import layouts
from tessera.sources.rowindex import numbered
from tessera.streaming.live import live_points

W, H = 64, 40
XS, YS = quadmesh.Coordinates(tuple(float(i) for i in range(W))), quadmesh.Coordinates(tuple(float(i) for i in range(H)))
UNEVEN = quadmesh.Coordinates(tuple(i + i * i / 128 for i in range(W)))
CELLS = f"""select (vec_id // {H})::int as band, (vec_id % {H})::int as iy, (u.i - 1)::int as ix, embedding[u.i]::double as value from embeddings cross join range(1, {W + 1}) u(i)"""
GRID = f"with {sql.hits(ITEM_SOURCE, ITEMS)}, grid as (select py, px, count(*) as value from hit group by py, px)"
LAYERED = f"with {sql.hits(ITEM_SOURCE, ITEMS)}, grid as (select py, px, flag as cat, count(*) as value from hit group by all)"
FLAGS = ("A", "N", "R")
KEY = {"A": "#ff0000", "N": "#00ff00", "R": "#0000ff"}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as bands of H rows by W columns."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.floor(F.col("vec_id") / H).cast("int").alias("band"), (F.col("vec_id") % H).cast("int").alias("iy"), F.posexplode("embedding").alias("ix", "value")).withColumn("value", F.col("value").cast("double"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "lineitem"), ITEMS, "l_extendedprice", "l_quantity").df


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.categories import Categories

    return points(table(spark, sf_dir, "lineitem"), ITEMS, "l_extendedprice", "l_quantity", R.by(Categories("l_returnflag", FLAGS))).df


def _meshes() -> dict[str, Entry]:
    mesh = lambda canvas, xs, agg=None: lambda spark, sf_dir: rounded(quadmesh.quadmesh(cells(spark, sf_dir), canvas, xs, YS, agg, layer="band"))
    lo, hi, uneven = 0.0, 90.0, Canvas(50, 20, (0.0, 90.0), (-0.5, H - 0.5))
    spans = f"""xc as (select i::int as ix, i + i * i / 128.0::double as c from range({W}) t(i)),
xb as (select ix, c, lead(c) over w as nc, lag(c) over w as pc from xc window w as (order by ix)),
xe as (select ix, case when pc is null then c - 0.5 * (nc - c) else pc + 0.5 * (c - pc) end as a, case when nc is null then c + 0.5 * (c - pc) else c + 0.5 * (nc - c) end as b from xb),
xs as (select ix, (a - {lo}) / {hi - lo} as a, (b - {lo}) / {hi - lo} as b from xe),
xp as (select ix, greatest(0, least(50, trunc(a * 50)))::int as p, greatest(0, least(50, trunc(b * 50)))::int as q from xs where b > 0 and a < 1),
sx as (select ix, unnest(range(p, case when p = q and q <> 50 then q + 1 else q end))::int as px from xp)"""

    def curved(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = cells(spark, sf_dir).withColumns({"qx": F.col("ix") + 0.25 * F.col("iy"), "qy": F.col("iy") - 0.125 * F.col("ix")})
        return rounded(quadmesh.curvilinear(df, Canvas(50, 40, (0.0, 75.0), (-8.0, 40.0)), layer="band"))

    corner = lambda k, a, b: f"trunc((((c.ix {b}) + 0.25 * (c.iy {a})) - 0.0) / 75.0 * 50)::int as x{k}, trunc((((c.iy {a}) - 0.125 * (c.ix {b})) + 8.0) / 48.0 * 40)::int as y{k}"
    cross = " + ".join(
        f"(case when (y{k} > py) <> (y{j} > py) and not (x{k} < px and x{j} < px) and ((x{j} - px) * (y{k} - py) - (y{j} - py) * (x{k} - px)) * sign(y{j} - y{k}) < 0 then 1 else 0 end)" for k, j in ((0, 1), (1, 2), (2, 3), (3, 0))
    )
    wide = lambda c, o, n: f"case when thin and least({c}0, {c}1, {c}2, {c}3) = greatest({c}0, {c}1, {c}2, {c}3) and greatest({c}0, {c}1, {c}2, {c}3) < {n} then greatest({c}0, {c}1, {c}2, {c}3) + 1 else least(greatest({c}0, {c}1, {c}2, {c}3), {n}) end"
    curve = f"""with c as ({CELLS}), k as (select c.band, c.value, {corner(0, '- 0.5::double', '- 0.5::double')}, {corner(1, '- 0.5::double', '+ 0.5::double')}, {corner(2, '+ 0.5::double', '+ 0.5::double')}, {corner(3, '+ 0.5::double', '- 0.5::double')} from c),
t as (select *, greatest(least(x0, x1, x2, x3), 0) = least(greatest(x0, x1, x2, x3), 50) or greatest(least(y0, y1, y2, y3), 0) = least(greatest(y0, y1, y2, y3), 40) as thin from k
      where least(x0, x1, x2, x3) < 50 and greatest(x0, x1, x2, x3) >= 0 and least(y0, y1, y2, y3) < 40 and greatest(y0, y1, y2, y3) >= 0),
e as (select *, unnest(range(greatest(least(x0, x1, x2, x3), 0), {wide('x', 'y', 50)})) as px from (select *, unnest(range(greatest(least(y0, y1, y2, y3), 0), {wide('y', 'x', 40)})) as py from t))
select py::int as py, px::int as px, band, {digits('avg(value)')} as value from e where thin or ({cross}) % 2 = 1 group by all"""
    return {
        "quadmesh_upsample": Entry(mesh(Canvas(2 * W, 2 * H), XS), f"with c as ({CELLS}) select y.py::int as py, x.px::int as px, band, {digits('max(value)')} as value from c join range({2 * W}) x(px) on x.px // 2 = ix join range({2 * H}) y(py) on y.py // 2 = iy group by all"),
        "quadmesh_downsample": Entry(mesh(Canvas(W // 4, H // 4), XS, R.mean("value")), f"with c as ({CELLS}) select (iy // 4)::int as py, (ix // 4)::int as px, band, {digits('avg(value)')} as value from c group by all"),
        "quadmesh_rectilinear": Entry(mesh(uneven, UNEVEN, R.sum("value")), f"with c as ({CELLS}), {spans} select (iy // 2)::int as py, px, band, {digits('sum(value)')} as value from c join sx using (ix) group by all"),
        "quadmesh_curvilinear": Entry(curved, curve),
    }


def _rasters() -> dict[str, Entry]:
    down = lambda how: lambda spark, sf_dir: rounded(raster.raster(cells(spark, sf_dir), Canvas(24, 15), XS, YS, downsample_method=how, layer="band"))
    cover = lambda n, m, o, s, w: f"(select o::int as {o}, s::int as {s}, least(s + 1, (o + 1) * {n}.0::double / {m}) - greatest(s, o * {n}.0::double / {m}) as {w} from range({m}) a(o) cross join range({n}) b(s))"
    each = f"with c as ({CELLS}), w as (select band, py, px, iy, ix, value, wy * wx as w from c join {cover(H, 15, 'py', 'iy', 'wy')} y using (iy) join {cover(W, 24, 'px', 'ix', 'wx')} x using (ix) where wy > 1e-9 and wx > 1e-9)"
    spread_ = "greatest(0, (sum(w * value * value) * sum(w) - sum(w * value) * sum(w * value)) / sum(w) / sum(w))"
    aggs = {"mean": "sum(w * value) / sum(w)", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, iy * 1000 + ix)", "last": "arg_max(value, iy * 1000 + ix)", "var": spread_, "std": f"sqrt({spread_})"}
    out = {f"raster_{n}": Entry(down(n), f"{each} select py, px, band, {digits(e)} as value from w group by all") for n, e in aggs.items()}
    near = f"with c as ({CELLS}) select y.py::int as py, x.px::int as px, band, {digits('value')} as value from c join range(160) x(px) on trunc(0.4::double * x.px) = ix join range(80) y(py) on y.py // 2 = iy"
    taps = lambda n, m: f"(select o, trunc({n - 1}.0::double / {m - 1} * o)::int as a, {n - 1}.0::double / {m - 1} * o - trunc({n - 1}.0::double / {m - 1} * o) as f from range({m}) t(o))"
    linear = f"""with c as ({CELLS}), p as (select y.o as py, x.o as px, y.f as fy, x.f as fx, c.band, c.value as v00, coalesce(r.value, c.value) as v01, coalesce(d.value, c.value) as v10,
coalesce(e.value, case when y.a = {H - 1} then r.value when x.a = {W - 1} then d.value end, c.value) as v11 from c join {taps(H, 80)} y on y.a = c.iy join {taps(W, 160)} x on x.a = c.ix
left join c r on r.band = c.band and r.iy = c.iy and r.ix = c.ix + 1 left join c d on d.band = c.band and d.iy = c.iy + 1 and d.ix = c.ix left join c e on e.band = c.band and e.iy = c.iy + 1 and e.ix = c.ix + 1
where c.band < (select max(band) from c))
select py::int as py, px::int as px, band, {digits('(v00 + fx * (v01 - v00)) + fy * ((v10 + fx * (v11 - v10)) - (v00 + fx * (v01 - v00)))')} as value from p"""
    up = lambda how: lambda spark, sf_dir: raster.raster(cells(spark, sf_dir), Canvas(160, 80), XS, YS, upsample_method=how, layer="band").df
    # the last band may be cut off in the middle, where interpolation falls back to the nearest cell
    whole = lambda spark, sf_dir: rounded(up("linear")(spark, sf_dir).join(F.broadcast(cells(spark, sf_dir).agg(F.max("band").alias("_b"))), F.col("band") < F.col("_b")).drop("_b"))
    mode = lambda spark, sf_dir: rounded(raster.raster(cells(spark, sf_dir).withColumn("value", F.round(F.col("value") * 10)), Canvas(W // 4, H // 4), XS, YS, downsample_method="mode", layer="band"))
    modes = f"""with c as (select band, iy // 4 as py, ix // 4 as px, round(value * 10) + 0.0 as v, min(iy * 1000 + ix) as f, count(*) as n from ({CELLS}) group by all),
r as (select *, row_number() over (partition by band, py, px order by n desc, f) as k from c) select py::int as py, px::int as px, band, {digits('v')} as value from r where k = 1"""
    return out | {"raster_mode": Entry(mode, modes), "raster_nearest": Entry(lambda spark, sf_dir: rounded(up("nearest")(spark, sf_dir)), near), "raster_linear": Entry(whole, linear)}


def _ramp(t: str, lo: str, hi: str, a: int, b: int) -> str:
    return f"(case when {t} <= {lo} then {float(a)}::double when {t} < {hi} then {float(a)}::double + ({t} - {lo}) / ({hi} - {lo}) * {float(b - a)}::double else {float(b)}::double end)"


def _shades() -> dict[str, Entry]:
    a, b = rgb("lightblue"), rgb("darkblue")
    curves = {"linear": "v", "log": "ln(1 + v)", "cbrt": "pow(v, 1 / 3.0::double)"}
    colored = f"select py, px, {sql.packed(*[_ramp('t', 'lo', 'hi', p, q) for p, q in zip(a, b)], '255')} as rgba"
    out = {
        f"shade_{how}": Entry(lambda spark, sf_dir, how=how: shade.shade(counts(spark, sf_dir), how=how), f"""{GRID}, s as (select py, px, (value - min(value) over ())::double as v from grid),
t as (select py, px, {e} as t from s), r as (select *, min(t) over () as lo, max(t) over () as hi from t) {colored} from r""")
        for how, e in curves.items()
    }
    equal = f"{GRID}, t as (select py, px, cume_dist() over (order by value) as t from grid), r as (select *, min(t) over () as lo, max(t) over () as hi from t)"
    mixed = f"""{LAYERED}, k(cat, r, g, b) as (values {', '.join(f"('{c}', {', '.join(f'{v}.0::double' for v in rgb(h))})" for c, h in KEY.items())}),
l as (select case when min(value) > 0 and min(n) < {len(FLAGS)} then 0 else min(value) end as base from (select value, count(*) over (partition by py, px) as n from grid)),
m as (select py, px, sum(value)::double as value, sum(value - base)::double as w, {', '.join(f'sum((value - base) * {c}) as s{c}, avg(case when value > 0 then {c} end) as m{c}' for c in 'rgb')} from grid join k using (cat) cross join l group by py, px),
t as (select *, value - min(value) over () as t from m), q as (select *, min(t) over () as lo, max(t) over () as hi from t)
select py, px, {sql.packed(*[f'coalesce(s{c} / nullif(w, 0), m{c}, 0)' for c in 'rgb'], _ramp('t', 'lo', 'hi', 40, 255))} as rgba from q"""
    key = {1: "red", 2: "#00ff7f", 5: (1, 2, 3)}
    exact = " ".join(f"when value = {k} then {sql.packed(*map(str, rgb(c)), '255')}" for k, c in key.items())
    return out | {
        "eq_hist": Entry(lambda spark, sf_dir: rounded(shade.equalized(counts(spark, sf_dir))), f"{GRID} select py, px, {digits('cume_dist() over (order by value)')} as value from grid"),
        "shade_eq_hist": Entry(lambda spark, sf_dir: shade.shade(counts(spark, sf_dir)), f"{equal} {colored} from r"),
        "shade_categories": Entry(lambda spark, sf_dir: shade.shade_categories(layered(spark, sf_dir), KEY, FLAGS, how="linear"), mixed),
        "shade_discrete": Entry(lambda spark, sf_dir: shade.shade_discrete(counts(spark, sf_dir), key), f"{GRID} select py, px, (case {exact} else 0 end)::bigint as rgba from grid"),
    }


def images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two half transparent images of shifted counts."""
    g = counts(spark, sf_dir)
    byte = lambda c, m: F.pmod(F.col("value") * m + c, F.lit(256)).cast("long")
    from tessera.functions.colors import pack

    one = g.select("py", "px", pack(byte(3, 7), byte(90, 11), byte(200, 5), byte(100, 13)).alias("rgba"))
    two = g.select("py", (F.col("px") + 3).alias("px"), pack(byte(30, 3), byte(9, 17), byte(20, 19), byte(10, 23)).alias("rgba"))
    return one, two


def _image_sql(shift: int, *channels: tuple[int, int]) -> str:
    return f"select py, px + {shift} as px, {sql.packed(*[f'(value * {m} + {c}) % 256' for c, m in channels])} as rgba from grid"


def _composites() -> dict[str, Entry]:
    both = f"{GRID}, a as ({_image_sql(0, (3, 7), (90, 11), (200, 5), (100, 13))}), b as ({_image_sql(3, (30, 3), (9, 17), (20, 19), (10, 23))}), j as (select py, px, coalesce(a.rgba, 0)::bigint as d, coalesce(b.rgba, 0)::bigint as s from a full join b using (py, px))"
    out = {f"stack_{how}": Entry(lambda spark, sf_dir, how=how: composite.stack(list(images(spark, sf_dir)), how), f"{both} select py, px, {sql.composite('s', 'd', how)} as rgba from j") for how in composite.IMAGE}
    white = 255 | 255 << 8 | 255 << 16 | 255 << 24
    disc = spread.mask(2)
    offsets = ", ".join(f"({a}, {b})" for a, b in disc)
    shape = (ITEMS.plot_height, ITEMS.plot_width)
    spreads = {how: f"{GRID}, o(dy, dx) as (values {offsets}) select (py + dy)::int as py, (px + dx)::int as px, {e}(value)::bigint as value from grid cross join o where py + dy between 0 and {shape[0] - 1} and px + dx between 0 and {shape[1] - 1} group by all" for how, e in (("add", "sum"), ("max", "max"), ("min", "min"))}
    out |= {f"spread_{how}": Entry(lambda spark, sf_dir, how=how: spread.spread(counts(spark, sf_dir), shape, 2, how=how), text) for how, text in spreads.items()}
    near = f"{GRID} select count(*) filter (where exists (select 1 from grid b where abs(b.py - a.py) <= 2 and abs(b.px - a.px) <= 2 and (b.py <> a.py or b.px <> a.px)))::double / count(*) as density from grid a"
    ramp = f"{GRID}, b as (select py // 3 as y, px // 3 as x, value from grid)"
    return out | {
        "set_background": Entry(lambda spark, sf_dir: shade.set_background(images(spark, sf_dir)[0], "white"), f"{both} select py, px, {sql.composite('rgba', f'{white}::bigint', 'over')} as rgba from a"),
        "spread_image": Entry(lambda spark, sf_dir: spread.spread(images(spark, sf_dir)[0], shape, 1)),
        "dynspread": Entry(lambda spark, sf_dir: spread.dynspread(images(spark, sf_dir)[0], shape, 0.9)),
        "density": Entry(lambda spark, sf_dir: spark.createDataFrame([(spread.density(counts(spark, sf_dir)),)], "density double"), near),
        "grid_downsample": Entry(lambda spark, sf_dir: rounded(grid.downsample(counts(spark, sf_dir), 3, "mean")), f"{ramp} select y::int as py, x::int as px, {digits('avg(value)')} as value from b group by all"),
        "grid_downsample_median": Entry(lambda spark, sf_dir: rounded(grid.downsample(counts(spark, sf_dir), 3, "median")), f"{ramp} select y::int as py, x::int as px, {digits('median(value)')} as value from b group by all"),
        "grid_over_layers": Entry(lambda spark, sf_dir: grid.over_layers(layered(spark, sf_dir), only=["A", "R"]), f"{LAYERED} select py, px, sum(value)::bigint as value from grid where cat in ('A', 'R') group by all"),
        "grid_masked": Entry(lambda spark, sf_dir: grid.percentile(counts(spark, sf_dir), 0.9), f"{GRID} select py, px, value from grid where value >= (select quantile_cont(value, 0.9) from grid)"),
        "pipeline_image": Entry(lambda spark, sf_dir: Pipeline(table(spark, sf_dir, "lineitem"), lambda s, c: points(s, c, "l_extendedprice", "l_quantity"))(ITEMS.x_range, ITEMS.y_range, ITEMS.plot_width, ITEMS.plot_height), _shades()["shade_eq_hist"].sql),
    }


def net(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1600).alias("target"), (F.col("o_orderkey") % 5).cast("double").alias("weight"))
    return nodes, edges


NET = """nodes as (select c_custkey as id, c_acctbal as x, c_nationkey::double as y from customer),
edges as (select o_orderkey as edge_id, o_custkey as source, (o_custkey * 7 + o_orderkey) % 1600 as target, (o_orderkey % 5)::double as weight from orders)"""


def _graphs() -> dict[str, Entry]:
    ends = f"with {NET}, j as (select edge_id, weight, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from edges join nodes a on a.id = source join nodes b on b.id = target)"

    circle = "with n as (select c_custkey as id, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from customer)"
    return {
        "connect_edges": Entry(lambda spark, sf_dir: rounded(graph.connect_edges(*net(spark, sf_dir), weight="weight")), f"{ends} select edge_id, 0 as k, {digits('x0')} as x, {digits('y0')} as y, weight from j union all select edge_id, 1, {digits('x1')}, {digits('y1')}, weight from j union all select edge_id, 2, null, null, weight from j"),
        "graph_adjacency": Entry(lambda spark, sf_dir: rounded(graph.adjacency(net(spark, sf_dir)[1], weight="weight")), f"with {NET} select a, b, {digits('sum(w)')} as w from (select source as a, target as b, weight as w from edges union all select target, source, weight from edges where source <> target) group by a, b"),
        "circular_layout": Entry(lambda spark, sf_dir: rounded(graph.circular_layout(net(spark, sf_dir)[0].select("id"))), f"{circle} select id, {digits('0.5 + 0.5 * cos(i / n::double * 2 * pi())')} as x, {digits('0.5 + 0.5 * sin(i / n::double * 2 * pi())')} as y from n"),
        "random_layout": Entry(lambda spark, sf_dir: graph.random_layout(net(spark, sf_dir)[0].select("id"), 3)),
        "forceatlas2_layout": Entry(lambda spark, sf_dir: graph.forceatlas2_layout(net(spark, sf_dir)[0].select("id"), net(spark, sf_dir)[1])),
        "hammer_bundle": Entry(lambda spark, sf_dir: graph.hammer_bundle(*net(spark, sf_dir))),
    }


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") % 340 - 170).alias("lon"), (F.col("l_quantity") * 3 - 76).alias("lat"))
    return with_mercator(df, "lon", "lat")


def _maps() -> dict[str, Entry]:
    t = Tiling()
    half = sql.number(t.x_range[1])
    source = f"""with p as (select l_extendedprice % 340 - 170 as lon, l_quantity * 3 - 76 as lat from lineitem),
m as (select lon, lat, lon * {sql.number(t.x_range[1] / 180.0)} as x, ln(tan((90.0 + lat) * pi() / 360.0)) * {sql.number(t.x_range[1])} / pi() as y from p)"""
    level = lambda z: f"select {z} as z, least(floor((x + {half}) * {sql.number(1 / t.resolution(z))}), {256 * 2**z - 1})::bigint as gx, {256 * 2**z - 1} - least(floor((y + {half}) * {sql.number(1 / t.resolution(z))}), {256 * 2**z - 1})::bigint as gy from m where x between -{half} and {half} and y between -{half} and {half}"
    tiled = f"{source}, g as ({' union all '.join(level(z) for z in (0, 1, 2))}), c as (select z::int as z, (gx // 256)::int as tx, (gy // 256)::int as ty, (gy % 256)::int as py, (gx % 256)::int as px, count(*) as value from g group by all)"
    grid_ = lambda spark, sf_dir: tiles.tile_grid(spots(spark, sf_dir), t, [0, 1, 2])
    stats = lambda spark, sf_dir: spark.createDataFrame([(z, *s) for z, s in tiles.level_stats(grid_(spark, sf_dir)).items()], "z int, lo long, hi long")

    def pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = tiles.to_pngs(tiles.shade_tiles(grid_(spark, sf_dir)))
        return made.select("z", "tx", "ty", (F.substring("png", 2, 3) == F.lit(b"PNG")).alias("is_png"))

    return {
        "mercator": Entry(lambda spark, sf_dir: rounded(spots(spark, sf_dir).select("lon", "lat", (F.col("x") / 1e6).alias("x"), (F.col("y") / 1e6).alias("y"))), f"{source} select {digits('lon')} as lon, {digits('lat')} as lat, {digits('x / 1e6::double')} as x, {digits('y / 1e6::double')} as y from m"),
        "tile_grid": Entry(grid_, f"{tiled} select * from c"),
        "tile_stats": Entry(stats, f"{tiled} select z, min(value) as lo, max(value) as hi from c group by z"),
        "tile_images": Entry(pngs, f"{tiled} select distinct z, tx, ty, true as is_png from c"),
    }


def _layouts() -> dict[str, Entry]:
    lists = lambda spark, sf_dir: table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.slice(F.array((F.col("p_size") % 3).cast("double"), F.lit(2.0), F.lit(3.0)), F.lit(1), (F.col("p_partkey") % 3).cast("int")).alias("a"))
    base = "with l as (select p_partkey as id, list_slice([(p_size % 3)::double, 2.0::double, 3.0::double], 1, p_partkey % 3) as a from part)"
    text = lambda df: df.withColumn("a", F.array_join(F.col("a").cast("array<int>").cast("array<string>"), ","))
    joined = "array_to_string(list_transform({a}, lambda v: v::int::varchar), ',')"

    def live(spark: SparkSession, sf_dir: str) -> DataFrame:
        static = table(spark, sf_dir, "lineitem")
        stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
        out = live_points(stream, ITEMS, "l_extendedprice", "l_quantity", R.count())
        name = f"live_{uuid.uuid4().hex}"
        run = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.table(name)

    return {
        "row_numbers": Entry(lambda spark, sf_dir: numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]), "select o_orderkey, o_custkey, row_number() over (order by o_custkey, o_orderkey) - 1 as ri from orders"),
        "ragged_missing": Entry(lambda spark, sf_dir: text(lists(spark, sf_dir).select("id", layouts.ragged_fillna(F.col("a"), F.array(F.lit(9.0))).alias("a"))), f"{base} select id, {joined.format(a='case when len(a) = 0 then [9.0::double] else a end')} as a from l"),
        "ragged_unique": Entry(lambda spark, sf_dir: text(layouts.ragged_unique(lists(spark, sf_dir), "a")), f"{base} select distinct {joined.format(a='a')} as a from l where len(a) > 0"),
        "ragged_shift": Entry(lambda spark, sf_dir: text(layouts.ragged_shift(lists(spark, sf_dir), "a", "id", 2)), f"{base} select id, {joined.format(a='coalesce(lag(a, 2) over (order by id), [])')} as a from l"),
        "streaming_points": Entry(live, f"{GRID} select * from grid"),
    }


def entries() -> dict[str, Entry]:
    return _meshes() | _rasters() | _shades() | _composites() | _graphs() | _maps() | _layouts()
