"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies is target / source_size; the whole
part of it is certain, and what is left of the target is drawn: documents are ranked by random odds
divided by inclusion odds (U/(1-U)) / (p/(1-p)), and the first ones are taken until the words are used up; then the next by rank if that
ends nearer to the target (of small sources, where one document is much of the target, one of the AHEAD next).
Inclusion odds are those of the residual fraction of the source, tilted by size so that documents shorter
than their source's mean are likelier (by 4 at most); the common factor cancels within a source.

A source may hold most of the rows, so nothing sorts a whole source: ranks fall into RANK_BINS equal bins, sums
per (source, bin) are pre-aggregated, and only the one bin in which the target is reached is sorted.

Defined cases: null text and null source are an empty text and a source of its own (last); empty
documents have size 0 and taken 0; equal ranks go by doc_id, then size, then row; repeated rows
are documents of their own; texts of any length count whole; an empty table gives an empty result; other columns pass through `expand`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, fresh, word_count

RANK_BINS = 4096
#: Documents after the cut that may fill what is left of the target, and what part of it may stay open.
AHEAD, NEAR = 64, 0.01
#: Largest factor by which a document's size tilts its inclusion odds.
TILT = 4.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target) for (source, size) rows.

    Sources by code point, null last, get the weights in turn. Targets share the total by weight but stop at cap x
    source_size; the excess goes to the others by weight until none is above (water filling, in closed form: the
    capped ones are a prefix in the order of cap / weight). The windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", pick.cast("long")).withColumn("_cap", F.col("source_size") * F.lit(cap).cast("long"))
    order = [(F.col("_cap").cast("double") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0).cast("long"))
    per = per.withColumn("_total", total).withColumn(
        "_full", F.col("_cap").cast("double") * F.sum("_w").over(onward).cast("double") <= left.cast("double") * F.col("_w").cast("double")
    )
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0).cast("long"))
    rest = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
    level = (F.col("_total") - used).cast("double") / rest.cast("double")
    return per.select("source", "source_size", "n_docs", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level * F.col("_w")).alias("target"))


def uniform(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of its MD5."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def draw(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, _key for every row of docs(doc_id, text, source)."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("_key"))
    base = durable(sized.withColumn("_row", F.monotonically_increasing_id()))
    u = uniform(F.col("doc_id"), seed)
    per = targets(base, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = durable(
        per.withColumn("_whole", whole)
        .withColumn("_rest", F.when(F.col("source_size") > 0, F.col("target") - (F.col("_whole") * F.col("source_size")).cast("double")).otherwise(0.0))
        .withColumn("_mean", F.when(F.col("n_docs") > 0, F.col("source_size").cast("double") / F.col("n_docs")).otherwise(0.0))
    ).withColumnRenamed("source", "_source")
    tilt = F.greatest(F.lit(1 / TILT), F.least(F.lit(TILT), F.col("_mean") / F.col("size")))
    ranked = (
        base.join(per, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rank", F.when((F.col("size") > 0) & (F.col("_rest") > 0), (u / (F.lit(1.0) - u)) / tilt))
        .withColumn("_bin", F.floor(F.col("_rank") / (F.lit(1.0) + F.col("_rank")) * RANK_BINS).cast("int"))
    )
    ranked = durable(ranked.drop("_source", "_mean", "n_docs"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = ranked.where("_bin is not null").groupBy("source", "_bin").agg(F.sum("size").alias("_n"), F.first("_rest").alias("_r"))
    cut = (
        bins.withColumn("_upto", F.sum("_n").over(upto))
        .where(F.col("_upto") > F.col("_r"))
        .groupBy("source")
        .agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_n")).alias("below")), "_bin").alias("c"))
        .select(F.col("source").alias("_source"), F.col("c._bin").alias("_cut"), F.col("c.below").alias("_below"))
    )
    cut = durable(cut)
    order = Window.partitionBy("source").orderBy("_rank", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    there = ranked.join(cut, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("_bin") == F.col("_cut")).drop("_source")
    there = there.withColumn("_fill", F.col("_below") + F.sum("size").over(order))
    #: Inside the bin: what still fits; over the source: the words that are still open then.
    fits = durable(there.select("source", "_row", "size", "_rest", "_below", (F.col("_fill") <= F.col("_rest")).alias("_fits")))
    gap = fits.groupBy("source").agg((F.first("_rest") - F.first("_below") - F.coalesce(F.sum(F.when(F.col("_fits"), F.col("size"))), F.lit(0))).alias("_gap"))
    cut = cut.join(gap, F.col("_source").eqNullSafe(gap["source"])).drop("source")
    got = (
        ranked.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        .join(fits.where("_fits").select("_row", F.lit(1).alias("_in")), "_row", "left")
        .withColumn("_drawn", F.when(F.col("_rank").isNull(), 0).when(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut")), 1).otherwise(F.coalesce(F.col("_in"), F.lit(0))))
    )
    got = durable(got.drop("_in"))
    # of the next documents by rank, the first with which the total ends NEAR the target is the last one drawn, or else the one that ends nearest
    by_rank = Window.partitionBy("source").orderBy("_rank", "doc_id", "size", "_row")
    ahead = got.where((F.col("_drawn") == 0) & F.col("_rank").isNotNull()).select("source", "_rank", "doc_id", "size", "_row", "_gap", "target")
    ahead = ahead.withColumn("_n", F.row_number().over(by_rank)).where(F.col("_n") <= AHEAD)
    off = F.abs(F.col("size") - F.col("_gap"))
    last = ahead.where(off < F.col("_gap")).groupBy("source").agg(F.min_by("_row", F.struct(F.when(off > NEAR * F.col("target"), off).otherwise(0.0), "_n")).alias("_row"))
    got = got.join(last.select("_row", F.lit(1).alias("_last")), "_row", "left")
    copies = F.col("_whole") + F.col("_drawn") + F.coalesce(F.col("_last"), F.lit(0))
    return got.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_key")


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is drawn, none where it isn't. Identical rows are pooled."""
    *names, copies, copy = fresh(docs, "_doc", "_src", "_none", "_text", "_copies", "_copy")
    keys = [F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()]
    named = lambda last: [k.alias(n) for k, n in zip([*keys, last], names, strict=True)]
    want = draw(docs, **options).where("copies > 0").select("copies", *named(F.col("_key"))).groupBy(*names).agg(F.sum("copies").alias(copies))
    kept = docs.select("*", *named(F.xxhash64("text"))).dropDuplicates(names)
    on = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    joined = kept.alias("l").join(want.alias("r"), on[0] & on[1] & on[2] & on[3])
    return joined.select(*[f"l.`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).drop(copy)
