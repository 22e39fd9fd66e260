"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A document's hash is 60 bits of the MD5 of its id. Bytes are summed per prefix of SLACK bits more than an
even spread would need; from these sums each bucket's depth follows: it splits on another bit as long as its bytes
exceed the limit. Where buckets are still too large at that depth, only their documents are summed again with more
bits. Documents that no bit can part (equal ids) are filled one after the other into numbered parts of the last
bucket, none above the limit; numbers may be left out. A document above the limit fills a shard of its own.

Defined cases: null text has 0 bytes; a null id hashes as an empty one; equal ids go by a hash of id and text;
repeated rows are documents of their own; texts of any length count whole; an empty table has no shards; other columns can be joined by id,
and aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, text_or_empty

BITS = 60
SLACK = 4
#: Ranges in which the bytes of one hash are added up.
CHUNKS = 4096


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    return F.expr(f"shiftrightunsigned(h, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftrightunsigned", F.col("h"), F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int, start: int, depth: int) -> DataFrame:
    """(cell, depth, over) for each occupied prefix of `depth` bits: the depth of its bucket, and whether that is still too large.

    Buckets of `start` bits are known to be needed. One row per prefix, not per document.
    """
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d")
    sums = cells.select("cell", "bytes", "n", levels).withColumn("p", F.call_function("shiftrightunsigned", F.col("cell"), F.lit(depth) - F.col("d")))
    big = sums.groupBy("d", "p").agg(F.sum("bytes").alias("all"), F.sum("n").alias("docs")).where((F.col("all") > limit) & (F.col("docs") > 1))
    deep = sums.join(big.select("d", "p"), ["d", "p"]).groupBy("cell").agg(F.max("d").alias("last"))
    at = F.coalesce(F.col("last") + 1, F.lit(start))
    return cells.join(deep, "cell", "left").select("cell", F.least(at, F.lit(depth)).alias("depth"), (at > depth).alias("over"))


def assign(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """(doc_id, bytes, depth, prefix, part) for each row; (depth, prefix, part) names its shard.

    prefix is the bucket's leading bits as a binary string of `depth` digits; part is 0 except for equal hashes, whose parts may leave numbers out.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    t = text_or_empty(text)
    rows = durable(docs.select("doc_id", F.octet_length(t).cast("long").alias("bytes"), F.xxhash64(t).alias("x"), hash_bits(F.col("doc_id")).alias("h")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    start, depth = 0, min(BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + SLACK))
    done: list[DataFrame] = []
    while True:
        cells = durable(directory(rows, limit, start, depth))
        dealt = rows.withColumn("cell", _prefix(depth)).join(cells, "cell")
        last = depth == BITS
        done.append((dealt if last else dealt.where("not over")).select("doc_id", "bytes", "x", "h", "depth", "over"))
        if last or not cells.where("over").limit(1).count():
            break
        rows = durable(dealt.where("over").select("doc_id", "bytes", "x", "h"))
        start, depth = depth, min(BITS, depth + 2 * SLACK)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    # binary string of the leading bits; the marker bit keeps leading zeros
    marked = F.call_function("shiftrightunsigned", F.col("h"), F.lit(BITS) - F.col("depth"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(marked.cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    named = out.withColumn("prefix", bits)
    if not last:
        return named.select("doc_id", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("part"))
    fill = _filled(named.where("over"), limit)
    return named.where("not over").withColumn("part", F.lit(0).cast("long")).select("doc_id", "bytes", "depth", "prefix", "part").union(fill)


def _filled(rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, bytes, depth, prefix, part) of rows whose hashes are equal in all bits: parts of each hash, filled one after the other.

    A document that crosses a multiple of the running bytes is alone in its part; those between two multiples share one. The running
    bytes come from sums: identical rows are one row of a count, those of a hash are added up in CHUNKS ranges, and identical
    rows are numbered by input partition, so no hash, however frequent, is sorted in one task.
    """
    rows = durable(rows.withColumn("_pid", F.spark_partition_id()).withColumn("_k", F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "x")))
    same = ["h", "_k", "bytes"]
    per = durable(rows.groupBy(*same, "_pid").agg(F.count("*").alias("c")))
    sums = durable(per.groupBy(*same).agg(F.sum(F.col("c") * F.col("bytes")).alias("w")).withColumn("_chunk", F.shiftright("_k", 64 - CHUNKS.bit_length() + 1)))
    before = lambda w: F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    chunks = sums.groupBy("h", "_chunk").agg(F.sum("w").alias("w")).select("h", "_chunk", before(Window.partitionBy("h").orderBy("_chunk")).alias("_low"))
    starts = sums.withColumn("_high", before(Window.partitionBy("h", "_chunk").orderBy("_k", "bytes"))).join(chunks, ["h", "_chunk"])
    starts = starts.select(*same, (F.col("_low") + F.col("_high")).alias("_start"))
    first = F.coalesce(F.sum("c").over(Window.partitionBy(*same).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    firsts = per.withColumn("_first", first).drop("c")
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same, "_pid").orderBy("doc_id")))
    placed = own.join(firsts, [*same, "_pid"]).join(starts, same)
    end = F.col("_start") + (F.col("_first") + F.col("_n")) * F.col("bytes")
    cell = F.floor((end - F.col("bytes")) / limit)
    return placed.select("doc_id", "bytes", "depth", "prefix", (2 * cell + (end > (cell + 1) * limit).cast("long")).alias("part"))


def oracle(limit: int, deepest: int = 24) -> str:
    """DuckDB SQL of assign() for tables whose buckets fit within `deepest` bits."""
    return f"""
with b as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select d, (h >> (60 - d)) as p, sum(bytes) as total, count(*) as n from b, range(0, {deepest}) r(d) group by 1, 2),
l as (select b.*, coalesce((select max(d) + 1 from s where s.p = (b.h >> (60 - s.d)) and s.total > {limit} and s.n > 1), 0) as depth from b)
select doc_id, bytes, depth::int as depth, right(lpad(bin(h), 60, '0'), 60)[:depth] as prefix, 0::bigint as part from l
"""
