"""Row order: a dense index for tables without an order column, and neighbours in a global order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.sources.durable import durable


def numbered(df: DataFrame, order_by: list[str] | None = None, name: str = "ri") -> DataFrame:
    """df with 0, 1, 2, ... in the order of order_by, or of partitions where there is none.

    Rows are numbered within sorted ranges and shifted by the sizes of the ranges before (one row a range); no task
    sees all rows. The numbered table is written once, so that sizes and rows come from the same ranges.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    tagged = durable(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(part.alias("p")).count()
    before = F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("p").alias("_p"), F.coalesce(before, F.lit(0)).alias("_b"))
    return tagged.join(F.broadcast(sizes), part == F.col("_p")).withColumn(name, at + F.col("_b")).drop("_m", "_p", "_b")


RANGE_ROWS, MAX_RANGES = 200_000, 4096


def neighbours(df: DataFrame, order: str, values: list[str], within: list[str] | None = None) -> DataFrame:
    """df with structs _prev, _next and _next2 of `values`: the rows around each one by ascending order, null beyond the ends.

    With `within`, order counts within each of its groups; without, all rows are one sequence. Sequences of over RANGE_ROWS
    rows are cut into ranges of the order column, windows run within ranges, and rows at the ranges' ends (four a range)
    get their neighbours from a table of just such rows. Order values should be unique in a sequence.
    """
    row = F.struct(*[F.col(v) for v in values])

    def around(d: DataFrame, w: Window) -> DataFrame:
        return d.withColumn("_prev", F.lag(row).over(w)).withColumn("_next", F.lead(row).over(w)).withColumn("_next2", F.lead(row, 2).over(w))

    if within:
        return _around_within(df, order, within, around)
    key = F.col(order).cast("double")
    n = df.count()
    parts = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    limits = sorted(set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < key)) if limits else F.lit(0)
    tagged = df.withColumn("_b", bucket)
    w = Window.partitionBy("_b").orderBy(order)
    inner = around(tagged, w).withColumn("_up", F.row_number().over(w)).withColumn("_down", F.count("*").over(Window.partitionBy("_b")) - F.col("_up") + 1)
    if not limits:
        return inner.drop("_b", "_up", "_down")
    edges = inner.where((F.col("_up") <= 2) | (F.col("_down") <= 2)).select(F.col(order).alias("_o"), *values)
    fixed = around(edges, Window.orderBy("_o")).select("_o", *[F.col(c).alias(f"_e{c}") for c in ("_prev", "_next", "_next2")])
    joined = inner.join(F.broadcast(fixed), F.col(order) == F.col("_o"), "left")  # four rows a range at most
    for c, here in (("_prev", F.col("_up") == 1), ("_next", F.col("_down") == 1), ("_next2", F.col("_down") <= 2)):
        joined = joined.withColumn(c, F.when(here, F.col(f"_e{c}")).otherwise(F.col(c)))
    return joined.drop("_b", "_up", "_down", "_o", "_e_prev", "_e_next", "_e_next2")


def _around_within(df: DataFrame, order: str, within: list[str], around: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """neighbours() within groups: each group above RANGE_ROWS is cut into ranges of its own."""
    spark, key = df.sparkSession, F.col(order).cast("double")
    named = [f"_g{k}" for k in range(len(within))]
    fields = df.select(*[F.col(c).alias(n) for c, n in zip(within, named)]).schema
    sizes = {tuple(r)[:-1]: r["count"] for r in df.groupBy(*within).count().where(F.col("count") > RANGE_ROWS).collect()}
    if not sizes:
        return around(df, Window.partitionBy(*within).orderBy(order))
    same = F.lit(True)
    for c, n in zip(within, named):
        same = same & F.col(c).eqNullSafe(F.col(n))
    parts = {g: min(MAX_RANGES, -(-n // RANGE_ROWS)) for g, n in sizes.items()}
    most = max(parts.values())
    cuts = df.join(F.broadcast(spark.createDataFrame(list(sizes), fields)), same).groupBy(*named).agg(F.percentile_approx(key, [i / most for i in range(1, most)], 10_000).alias("q")).collect()
    limits = []
    for r in cuts:
        *group, q = tuple(r)
        limits.append((*group, sorted({q[i * most // parts[tuple(group)] - 1] for i in range(1, parts[tuple(group)])} if q else ())))
    held = spark.createDataFrame(limits, StructType([*fields, StructField("_limits", ArrayType(DoubleType()))]))
    tagged = df.join(F.broadcast(held), same, "left").withColumn("_b", F.coalesce(F.size(F.filter("_limits", lambda x: x < key)), F.lit(0)))
    tagged = tagged.withColumn("_cut", F.col("_limits").isNotNull()).drop(*named, "_limits")
    tagged = tagged.repartition(sum(parts.values()) + int(spark.conf.get("spark.sql.shuffle.partitions")), "_b", *within)  # a few ranges a task at most
    w = Window.partitionBy("_b", *within).orderBy(order)
    inner = around(tagged, w).withColumn("_up", F.row_number().over(w)).withColumn("_down", F.count("*").over(Window.partitionBy("_b", *within)) - F.col("_up") + 1)
    edges = inner.where(F.col("_cut") & ((F.col("_up") <= 2) | (F.col("_down") <= 2)))
    edges = edges.select(F.col(order).alias("_o"), *[F.col(c).alias(f"_h{c}") for c in within], *[c for c in df.columns if c not in within and c != order])
    ends = around(edges.withColumns({c: F.col(f"_h{c}") for c in within} | {order: F.col("_o")}), Window.partitionBy(*[f"_h{c}" for c in within]).orderBy("_o"))
    ends = ends.select("_o", *[F.col(f"_h{c}") for c in within], *[F.col(c).alias(f"_e{c}") for c in ("_prev", "_next", "_next2")])
    on = F.col(order) == F.col("_o")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_h{c}"))
    joined = inner.join(F.broadcast(ends), on, "left")  # four rows a range of RANGE_ROWS at most
    for c, here in (("_prev", F.col("_up") == 1), ("_next", F.col("_down") == 1), ("_next2", F.col("_down") <= 2)):
        joined = joined.withColumn(c, F.when(F.col("_cut") & here, F.col(f"_e{c}")).otherwise(F.col(c)))
    return joined.drop("_b", "_cut", "_up", "_down", "_o", *[f"_h{c}" for c in within], "_e_prev", "_e_next", "_e_next2")
