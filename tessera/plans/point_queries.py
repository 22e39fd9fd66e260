"""Points with every reduction, categorizer, axis kind and source shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import reductions as R
from tessera.functions.canvas import Canvas
from tessera.functions.categories import Categories, CategoryBinning, CategoryModulo
from tessera.operators.points import points
from tessera.plans import sql
from tessera.plans.entries import Entry, digits, rounded, table
from tessera.sources.layouts import within_box

NAN = float("nan")
ITEMS = Canvas(96, 50, (0.0, 105000.0), (0.0, 51.0))
ORDERS = Canvas(24, 20, (0.0, 500000.0), (0.0, 100.0))
STATUS = ("F", "O", "P")
BOX = (20000.0, 10.0, 60000.0, 30.0)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, v (quarters, NaN for every seventh order), w, status, k and the row order ri."""
    v = F.when(F.col("o_orderkey") % 7 == 3, F.lit(NAN)).otherwise((F.col("o_custkey") % 37).cast("double") * 0.25)
    return table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), F.col("o_orderkey").alias("ri"), v.alias("v"),
        F.col("o_totalprice").alias("w"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") - 50).alias("k"),
    )


SOURCE = """select o_totalprice as x, (o_custkey % 100)::double as y, o_orderkey as ri, case when o_orderkey % 7 = 3 then null else (o_custkey % 37)::double * 0.25::double end as v,
o_totalprice as w, o_orderstatus as status, o_custkey - 50 as k from orders"""
HITS = f"with {sql.hits(SOURCE, ORDERS)}"
ITEM_SOURCE = "select l_extendedprice as x, l_quantity as y, l_discount as d, l_tax as t, l_returnflag as flag from lineitem"


def _orders(agg: R.Reduction):  # noqa: ANN202
    return lambda spark, sf_dir: rounded(points(orders(spark, sf_dir), ORDERS, "x", "y", agg, order="ri"))


def _ranked(order: str, valid: str, most: int, value: str, keys: str = "py, px") -> str:
    return f"""{HITS}, top as (select *, row_number() over (partition by {keys} order by {order}) as r from hit where {valid})
select {keys}, (r - 1)::int as n, {value} as value from top where r <= {most}"""


def _picked(order: str, value: str, keys: str = "py, px") -> str:
    """The row that comes first by order, of those with v; pixels without one have null."""
    return f"""{HITS}, top as (select *, row_number() over (partition by {keys} order by v is null, {order}) as r from hit)
select {keys}, max(case when r = 1 and v is not null then {value} end) as value from top group by {keys}"""


def _plain() -> dict[str, Entry]:
    aggregates = {
        "count": (R.count(), "count(*)"), "count_column": (R.count("v"), "count(v)"), "any": (R.any(), "count(*) > 0"), "any_column": (R.any("v"), "count(v) > 0"),
        "sum": (R.sum("v"), digits("sum(v)")), "sum_zero": (R.sum_zero("v"), digits("coalesce(sum(v), 0)")), "mean": (R.mean("v"), digits("avg(v)")),
        "m2": (R.m2("v"), digits("var_pop(v) * count(v)")), "var": (R.var("v"), digits("var_pop(v)")), "std": (R.std("v"), digits("stddev_pop(v)")),
        "min": (R.min("v"), digits("min(v)")), "max": (R.max("v"), digits("max(v)")),
        "min_row_index": (R.min_row_index(), "min(ri)"), "max_row_index": (R.max_row_index(), "max(ri)"),
    }
    return {f"reduce_{n}": Entry(_orders(a), f"{HITS} select py, px, {e} as value from hit group by py, px") for n, (a, e) in aggregates.items()}


def _ordered() -> dict[str, Entry]:
    picks = {
        "first": (R.first("v"), "ri", "v"), "last": (R.last("v"), "ri desc", "v"),
        "where_first": (R.where(R.first("v"), "w"), "ri", "w"), "where_last": (R.where(R.last("v"), "w"), "ri desc", "w"),
        "where_min": (R.where(R.min("v"), "w"), "v, ri", "w"), "where_max": (R.where(R.max("v"), "w"), "v desc, ri", "w"),
        "where_max_row": (R.where(R.max("v")), "v desc, ri", "ri"), "where_min_row": (R.where(R.min("v")), "v, ri", "ri"),
    }
    out = {f"reduce_{n}": Entry(_orders(a), _picked(o, digits(v) if v != "ri" else v)) for n, (a, o, v) in picks.items()}
    ranks = {
        "first_n": (R.first_n("v", n=3), "ri", "v is not null", digits("v")), "last_n": (R.last_n("v", n=3), "ri desc", "v is not null", digits("v")),
        "max_n": (R.max_n("v", n=4), "v desc, ri", "v is not null", digits("v")), "min_n": (R.min_n("v", n=4), "v, ri", "v is not null", digits("v")),
        "max_n_row_index": (R.max_n_row_index(n=3), "ri desc", "true", "ri"), "min_n_row_index": (R.min_n_row_index(n=3), "ri", "true", "ri"),
        "where_max_n": (R.where(R.max_n("v", n=3), "w"), "v desc, ri", "v is not null", digits("w")), "where_min_n": (R.where(R.min_n("v", n=3), "w"), "v, ri", "v is not null", digits("w")),
        "where_first_n": (R.where(R.first_n("v", n=3), "w"), "ri", "v is not null", digits("w")), "where_last_n": (R.where(R.last_n("v", n=3)), "ri desc", "v is not null", "ri"),
    }
    return out | {f"reduce_{n}": Entry(_orders(a), _ranked(o, ok, a.selector.most if isinstance(a, R.where) else a.most, v)) for n, (a, o, ok, v) in ranks.items()}


def _categories() -> dict[str, Entry]:
    status = Categories("status", STATUS)
    modulo = "((k - 3) % 5 + 5) % 5"
    step = 8 / 4.0
    bins = f"""case when v is null then 4 when trunc((v - 1) / {step}::double) < 0 then 4 when trunc((v - 1) / {step}::double) >= 4 then 3 else trunc((v - 1) / {step}::double) end"""
    per = lambda cat, e: f"{HITS} select py, px, {cat} as cat, {e} as value from hit group by all"
    by_first = f"""{HITS}, top as (select *, row_number() over (partition by py, px, status order by ri) as r from hit where v is not null)
select py, px, status as cat, (r - 1)::int as n, {digits('v')} as value from top where r <= 2"""
    by_where = f"""{HITS}, top as (select *, row_number() over (partition by py, px, status order by v is null, v desc, ri) as r from hit)
select py, px, status as cat, max(case when r = 1 and v is not null then {digits('w')} end) as value from top group by all"""
    full = f"""{HITS}, g as (select py, px, status as cat, count(*) as n from hit group by all)
select y.py::int as py, x.px::int as px, c.cat, coalesce(g.n, 0) as value from range({ORDERS.plot_height}) y(py) cross join range({ORDERS.plot_width}) x(px)
cross join (values {', '.join(f"('{s}')" for s in STATUS)}) c(cat) left join g on g.py = y.py and g.px = x.px and g.cat = c.cat"""
    return {
        "by_count": Entry(_orders(R.count_cat("status")), per("status", "count(*)")),
        "by_mean": Entry(_orders(R.by(status, R.mean("v"))), per("status", digits("avg(v)"))),
        "by_where_max": Entry(_orders(R.by(status, R.where(R.max("v"), "w"))), by_where),
        "by_first_n": Entry(_orders(R.by(status, R.first_n("v", n=2))), by_first),
        "by_modulo": Entry(_orders(R.by(CategoryModulo("k", 5, 3))), per(f"({modulo})::int", "count(*)")),
        "by_binning": Entry(_orders(R.by(CategoryBinning("v", 1.0, 9.0, 4, include_under=False))), per(f"({bins})::int", "count(*)")),
        "by_count_dense": Entry(lambda spark, sf_dir: points(orders(spark, sf_dir), ORDERS, "x", "y", R.by(status)).densify(), full),
    }


def _summary() -> dict[str, Entry]:
    agg = R.summary(n=R.count(), avg=R.mean("v"), top=R.max("v"), pick=R.where(R.min("v"), "w"))
    text = f"""{HITS}, top as (select *, row_number() over (partition by py, px order by v is null, v, ri) as r from hit)
select py, px, {digits('avg(v)')} as avg, count(*) as n, max(case when r = 1 and v is not null then {digits('w')} end) as pick, {digits('max(v)')} as top from top group by py, px"""
    ranked = R.summary(best=R.max_n("v", n=2), early=R.first_n("v", n=2))
    both = f"""{HITS}, top as (select *, row_number() over (partition by py, px order by v desc, ri) as a, row_number() over (partition by py, px order by ri) as b from hit where v is not null),
l as (select py, px, (a - 1)::int as n, v from top where a <= 2), f as (select py, px, (b - 1)::int as n, v from top where b <= 2)
select py, px, n, {digits('l.v')} as best, {digits('f.v')} as early from l full join f using (py, px, n)"""
    return {"summary": Entry(_orders(agg), text), "summary_ranked": Entry(_orders(ranked), both)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem on a canvas: rows and mean discount per pixel."""
    return rounded(points(table(spark, sf_dir, "lineitem"), ITEMS, "l_extendedprice", "l_quantity", R.summary(n=R.count(), discount=R.mean("l_discount"))))


def _canvases() -> dict[str, Entry]:
    log = Canvas(40, 30, (900.0, 105000.0), (1.0, 50.0), "log", "log")
    auto = Canvas(50, 40)
    item = lambda canvas, agg: lambda spark, sf_dir: rounded(points(table(spark, sf_dir, "lineitem"), canvas, "l_extendedprice", "l_quantity", agg))
    fitted = f"""with src as ({ITEM_SOURCE}), r as (select min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb from src),
s as (select xa, ya, 50 / (xb - xa) as sx, 40 / (yb - ya) as sy from r)
select least(trunc(y * sy + -ya * sy)::int, 39) as py, least(trunc(x * sx + -xa * sx)::int, 49) as px, count(*) as value from src cross join s group by all"""

    def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").withColumn("g", F.array(
            F.struct(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y")), F.struct((F.col("l_extendedprice") / 2).alias("x"), (F.lit(51.0) - F.col("l_quantity")).alias("y"))))
        return rounded(points(df, ITEMS, agg=R.sum("l_tax"), geometry="g"))

    def single(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").withColumn("g", F.struct(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y")))
        return rounded(points(df, ITEMS, agg=R.sum("l_tax"), geometry="g"))

    pair = "select l_extendedprice as x, l_quantity as y, l_tax as t from lineitem union all select l_extendedprice / 2, 51 - l_quantity, l_tax from lineitem"
    located = f"""with {sql.hits(ITEM_SOURCE, log)}, g as (select py, px, count(*) as value from hit group by py, px)
select py, px, value, {digits(f"pow(10.0::double, (px + 0.5::double - {sql.number(log.x.shift)}) / {sql.number(log.x.scale)})")} as x,
{digits(f"pow(10.0::double, (py + 0.5::double - {sql.number(log.y.shift)}) / {sql.number(log.y.scale)})")} as y from g"""

    def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = within_box(table(spark, sf_dir, "lineitem"), BOX, "l_extendedprice", "l_quantity")
        return rounded(points(near, Canvas(40, 20, (BOX[0], BOX[2]), (BOX[1], BOX[3])), "l_extendedprice", "l_quantity", R.mean("l_discount")))

    return {
        "points_flagship": Entry(flagship, f"with {sql.hits(ITEM_SOURCE, ITEMS)} select py, px, {digits('avg(d)')} as discount, count(*) as n from hit group by py, px"),
        "points_sum": Entry(item(ITEMS, R.sum("l_discount")), f"with {sql.hits(ITEM_SOURCE, ITEMS)} select py, px, {digits('sum(d)')} as value from hit group by py, px"),
        "points_log_axes": Entry(item(log, R.count()), f"with {sql.hits(ITEM_SOURCE, log)} select py, px, count(*) as value from hit group by py, px"),
        "points_auto_range": Entry(item(auto, R.count()), fitted),
        "points_geometry": Entry(single, f"with {sql.hits(ITEM_SOURCE, ITEMS)} select py, px, {digits('sum(t)')} as value from hit group by py, px"),
        "points_multipoint": Entry(multi, f"with {sql.hits(pair, ITEMS)} select py, px, {digits('sum(t)')} as value from hit group by py, px"),
        "points_box_filter": Entry(boxed, f"with {sql.hits(ITEM_SOURCE, Canvas(40, 20, (BOX[0], BOX[2]), (BOX[1], BOX[3])))} select py, px, {digits('avg(d)')} as value from hit group by py, px"),
        "canvas_coordinates": Entry(lambda spark, sf_dir: rounded(points(table(spark, sf_dir, "lineitem"), log, "l_extendedprice", "l_quantity").with_coordinates()), located),
    }


def entries() -> dict[str, Entry]:
    return _canvases() | _plain() | _ordered() | _categories() | _summary()
