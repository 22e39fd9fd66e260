"""Connected components of a link table by alternating large-star and small-star rounds.

Rounds are joins and pre-aggregated minima; each round's links are written to the shared folder, so lineage stays
short. A node with very many links is one hot join key, which adaptive execution splits. Links are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, forget


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that links(a, b) names: root is the smallest node that it reaches.

    Loops, repeated links and either direction are fine; links with a null end are left out.
    """
    linked = links.where("a is not null and b is not null and a <> b")
    now = durable(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        then = durable(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        forget(now)
        now = then
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct().toDF("node", "root"))
