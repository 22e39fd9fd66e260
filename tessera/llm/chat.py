"""Chat formatting: collapse cumulative snapshots of a conversation, then render what is left.

A logged conversation that is a prefix of a longer one (or equal to one with a smaller id) goes. Each turn's
hash covers its position, role and text; the rolling hash of a prefix is the running exclusive-or of two 64-bit
turn hashes, so prefixes compare as (length, 128 bits). Prefix rows are pre-aggregated per prefix, so an opening that
every conversation shares costs a row a task, and an anti-join keeps the maximal conversations.

Defined cases: turns go by turn (null first), then role, then text; identical rows of a conversation are one turn; null
role and text are null in the hash (not empty) and render as empty; a null conv_id is a conversation of its own;
of equal conversations the smallest conv_id (null first) stays; texts of any length count whole; other columns are not read, whatever their
names; an empty table gives an empty result; a turn's text can't forge markers, as "<|" in it becomes "< |".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable

START, END = "<|im_start|>", "<|im_end|>"
#: Makes the second of two independent 64-bit hashes.
SALT = "tessera-chat"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at, n, p, q): position from 1, length of the conversation, rolling hash so far."""
    rows = turns.select("conv_id", "turn", "role", "text").dropDuplicates()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    known = (F.col("role").isNull().cast("int"), F.col("text").isNull().cast("int"))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    rows = rows.withColumn("_p", F.xxhash64("at", "role", "text", *known)).withColumn("_q", F.xxhash64(F.lit(SALT), "text", "at", "role", *known))
    return rows.withColumn("p", F.bit_xor("_p").over(upto)).withColumn("q", F.bit_xor("_q").over(upto)).drop("_p", "_q")


def maximal(turns: DataFrame) -> DataFrame:
    """The prefix rows of the conversations that no other one extends or equals, with the number of snapshots each stands for."""
    rows = durable(prefixes(turns))
    ends = F.col("at") == F.col("n")
    per = rows.groupBy("at", "p", "q").agg(
        F.max((~ends).cast("int")).alias("extended"), F.count(F.when(ends, 1)).alias("equals"), F.min(F.when(ends, F.struct("conv_id"))).alias("first")
    )
    per = per.where("equals > 0").select(F.col("at").alias("k"), F.col("p").alias("kp"), F.col("q").alias("kq"), "extended", "equals", "first")
    heads = rows.where(ends).join(per, (F.col("at") == F.col("k")) & (F.col("p") == F.col("kp")) & (F.col("q") == F.col("kq")))
    gone = (F.col("extended") == 1) | ~F.col("conv_id").eqNullSafe(F.col("first.conv_id"))
    drop = heads.where(gone).select(F.col("conv_id").alias("_gone"))
    kept = rows.join(drop, F.col("conv_id").eqNullSafe(F.col("_gone")), "left_anti")
    same = heads.where(~gone).select(F.col("conv_id").alias("_id"), F.col("equals").alias("copies"))
    return kept.join(same, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, chat) for each maximal conversation: the text a model would be trained on."""
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(START), safe("role"), F.lit("\n"), safe("text"), F.lit(END + "\n"))
    return (
        maximal(turns)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("turns"), F.max("copies").alias("copies"))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join("turns.line", "").alias("chat"))
    )


ORACLE = """
with t as (select distinct conv_id, turn, role, text from conversations),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos,
             count(*) over (partition by conv_id) as n from t),
h as (select *, md5(string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-'), chr(2)) over (partition by conv_id order by pos)) as p from r),
x as (select pos, p, max(case when pos < n then 1 else 0 end) as extended, min(case when pos = n then conv_id end) as first_id, count(case when pos = n then 1 end) as equals
      from h group by pos, p),
k as (select h.conv_id, x.equals from h join x using (pos, p) where h.pos = h.n and x.extended = 0 and x.first_id = h.conv_id)
select h.conv_id, count(*) as n_turns, max(k.equals) as copies,
       string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' order by pos) as chat
from h join k on h.conv_id = k.conv_id group by h.conv_id
"""
