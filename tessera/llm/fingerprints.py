"""Document fingerprints by consistent weighted sampling (improved consistent weighted sampling, ICWS).

Terms are words, weights their counts. For sample j and term k: r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from a hash of
(k, j); t = floor(ln(weight) / r + b), ln a = ln c - r (t - b + 1); the term with the least a, together with its t, is
the sample. Two texts share a sample with a probability equal to their generalised Jaccard similarity, the sum of
minima over the sum of maxima of weights, so the share of equal samples estimates it.

r, c and b are drawn for each sample and term, through variables that are independent and easy to draw. With e = exp(-r (1 - b)) and
f = exp(-r b), which are independent and uniform, a = c e (e f)^t. Of x = c e and y = c (1 - e), both are Exp(1) and
independent (a Gamma(2, 1) number split at a uniform share). So x, y and f are drawn, e = x / (x + y), and a = x (e f)^t. A weight of 1 has t = 0
and a = x. What is compared is 1 - exp(-a), in 47 bits: it rises with a and is uniform where a = x, so a term that occurs once costs one hash
and no logarithm.

All of it is built-in functions. A sample's a and 16 bits of its identity (term, t) are packed into one long, so a fingerprint is SAMPLES
plain minima; texts are shuffled by document once, and counting terms and taking minima then need no other shuffle. 1 in 65,536
pairs of unequal samples look equal.

Defined cases: null text is empty; a text without words has the all-ones fingerprint, alike only to its kind;
rows with equal doc_id and text are one document in the order, and each gets a row; equal ids go by text hash; a null id
comes last; of an only document the next is itself; texts of any length count whole (a document's terms are grouped in one task, a row a term);
other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, durable, text_or_empty

SAMPLES = 64
#: Samples of a term in one row, and of a term that occurs more than once.
PER_SET, PER_ROW = 16, 4
STEPS = PER_SET // PER_ROW
#: Documents a range of ids should hold; the ranges' limits are at most MAX_RANGES numbers.
RANGE_ROWS, MAX_RANGES = 50_000, 4096
#: Stands for a null doc_id, and for the samples of a text without words.
NO_ID, _NONE = -(1 << 63), -1
_LOW = 0xFFFF


_gen = random.Random(20240607)
_SALTS = [_gen.getrandbits(64) - (1 << 63) for _ in range(PER_SET)]


def _unit(h: Column, shift: int, bits: int) -> Column:
    """`bits` bits of h as a number within (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(1.0 / (1 << bits))


def weighted(rows: DataFrame) -> DataFrame:
    """rows(base, lw, g) plus s0 ... s{PER_ROW - 1}: where g is not negative, the samples g % STEPS * PER_ROW + (0, 1, ...) of a term of ln weight lw in a set of PER_SET.

    Each is one long, whose minimum over the terms is the sample. Each step is a projection of its own, so that nothing is computed twice.
    """
    each, here = range(PER_ROW), F.col("g") >= 0
    some = lambda c: F.when(here, c)
    salt = [F.get(F.array(*[F.lit(_SALTS[k * PER_ROW + i]) for k in range(STEPS)]), F.col("g") % STEPS) for i in each]
    rows = rows.withColumns({f"h{i}": some(_own(salt[i])) for i in each})
    rows = rows.withColumns({f"u{i}": some(F.xxhash64(F.lit(i), f"h{i}")) for i in each} | {f"x{i}": some(-F.log1p(-_unit(F.col(f"h{i}"), 17, 47))) for i in each})
    rows = rows.withColumns({f"e{i}": some(F.col(f"x{i}") / (F.col(f"x{i}") - F.ln(_unit(F.col(f"u{i}"), 0, 32)))) for i in each} | {f"f{i}": some(_unit(F.col(f"u{i}"), 32, 32)) for i in each})
    rows = rows.withColumns({f"l{i}": some(F.ln(F.col(f"e{i}") * F.col(f"f{i}"))) for i in each})
    rows = rows.withColumns({f"t{i}": some(F.floor((F.ln(f"f{i}") - F.col("lw")) / F.col(f"l{i}"))) for i in each})

    def packed(i: int) -> Column:
        h, t, moved = F.col(f"h{i}"), F.col(f"t{i}"), -F.expm1(-F.col(f"x{i}") * F.exp(F.col(f"t{i}") * F.col(f"l{i}")))
        top = F.least((moved * F.lit(float(1 << 47))).cast("long"), F.lit((1 << 47) - 1))
        own = F.shiftrightunsigned(h, 1)
        return F.when(t > 0, F.shiftleft(top, 16).bitwiseOR(own.bitwiseXOR(t).bitwiseAND(F.lit(_LOW)))).otherwise(own)

    return rows.withColumns({f"s{i}": packed(i) for i in each})


def _own(salt: Column) -> Column:
    """The number that a term and a sample have of their own; from it all their draws follow."""
    return F.xxhash64(F.col("base").bitwiseXOR(salt))


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, sig): array<short> of samples, a multiple of PER_SET, for each text that has words. texts should be partitioned by keys; a column `copies` says how often each is there.

    A term that occurs once has a row for each set of PER_SET samples, which are hashes. Another has one for each PER_ROW samples, so that
    the code for a row stays small enough for the JVM to compile it.
    """
    sets = samples // PER_SET
    copies = F.col("copies") if "copies" in texts.columns else F.lit(1)
    words = texts.select(*keys, copies.alias("copies"), F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    counts = words.groupBy(*keys, "copies", F.xxhash64("w").alias("term")).agg(F.count("*").alias("n"))
    # negative: the row of set -1 - g; else set g / STEPS
    shares = F.explode(F.when(F.col("n") > F.col("copies"), F.array(*[F.lit(g) for g in range(sets * STEPS)])).otherwise(F.array(*[F.lit(-1 - q) for q in range(sets)])))
    rows = counts.select(*keys, F.ln(F.col("n") / F.col("copies")).alias("lw"), "term", shares.alias("g"))
    rows = rows.withColumn("q", F.when(F.col("g") < 0, -1 - F.col("g")).otherwise(F.shiftright("g", STEPS.bit_length() - 1)))
    rows = weighted(rows.withColumn("base", F.xxhash64("term", "q")))
    once, step = F.col("g") < 0, F.col("g") % STEPS
    mins = [F.min(F.when(once, F.shiftrightunsigned(_own(F.lit(x)), 1)).when(step == j // PER_ROW, F.col(f"s{j % PER_ROW}"))).alias(f"m{j}") for j, x in enumerate(_SALTS)]
    least = rows.groupBy(*keys, "q").agg(*mins).select(*keys, F.struct("q", F.array(*[F.col(f"m{j}") for j in range(PER_SET)]).alias("least")).alias("part"))
    least = least.groupBy(*keys).agg(F.flatten(F.sort_array(F.collect_list("part"))["least"]).alias("_least"))
    return least.select(*keys, F.transform("_least", lambda m: (m.bitwiseAND(F.lit(_LOW)) - 32768).cast("short")).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def hexed(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(_LOW))), 4, "0"))), "")


def successors(ids: DataFrame) -> DataFrame:
    """ids(id, h) plus (next_id, next_h): the following row by descending id (null last), then h; after the last, the first.

    ids must be distinct. Rows fall into ranges of ids, ordered within each; ranges are tied by their first rows.
    """
    n = ids.count()
    parts = max(1, min(MAX_RANGES, math.ceil(n / RANGE_ROWS)))
    limits: list[int] = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        limits = sorted(set(ids.agg(F.percentile_approx("id", at, 10_000)).first()[0] or []))
    bucket = F.lit(0)
    if limits:
        bucket = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x >= F.col("id")))
    rows = ids.withColumn("_b", F.when(F.col("id").isNull(), len(limits) + 1).otherwise(bucket))
    order = Window.partitionBy("_b").orderBy(F.col("id").desc_nulls_last(), F.col("h"))
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("_n", F.lead(F.struct("id", "h")).over(order))
    rows = durable(rows)
    heads = rows.where("_at = 1").select(F.col("_b").alias("_hb"), F.struct("id", "h").alias("_head"))
    by_range = Window.orderBy("_hb")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_hb", F.coalesce(F.lead("_head").over(by_range), F.first("_head").over(whole)).alias("_after"))
    got = rows.join(heads, F.col("_b") == F.col("_hb")).withColumn("_n", F.coalesce("_n", "_after"))
    return got.select(*ids.columns, F.col("_n.id").alias("next_id"), F.col("_n.h").alias("next_h"))


def edited_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, h, copies, text, edited) for each row, partitioned by (d, h), and (id, h, n, copies, next_id, next_h) for each distinct (d, h).

    d is doc_id with NO_ID for null, h the text's hash. edited has the last floor(n/2) code points replaced by the
    first as many (or all) of the next document. Texts are shuffled once: both joins read the same exchange.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), text_or_empty("text").alias("text")).withColumn("h", F.xxhash64("text"))
    slim = texts.select(F.col("d").alias("id"), "h", F.length("text").cast("long").alias("n")).groupBy("id", "h", "n").agg(F.count("*").alias("copies"))
    order = durable(successors(durable(slim)))
    give = order.select(
        F.col("next_id").alias("d"), F.col("next_h").alias("h"), F.col("id").alias("to_d"), F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("need"), "copies"
    )
    pieces = texts.join(give.hint("merge"), ["d", "h"]).select(F.col("to_d").alias("d"), F.col("to_h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("piece"), "copies")
    pieces = pieces.groupBy("d", "h").agg(F.max("piece").alias("piece"), F.max("copies").alias("copies"))
    full = texts.join(pieces.hint("merge"), ["d", "h"])
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("piece"))
    return full.select("d", "h", "copies", "text", edited.alias("edited")), order


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs(doc_id, text).

    One job reads the texts: the digest of the edited text goes along as a note beside the two versions.
    """
    pairs, order = edited_pairs(docs)
    note = F.sha2("edited", 256)
    versions = [F.struct(F.lit(v).alias("v"), t.alias("text"), x.alias("note")) for v, t, x in ((0, F.col("text"), F.lit(None).cast("string")), (1, F.col("edited"), F.lit(None).cast("string")), (2, F.lit("note"), note))]
    all_ = pairs.select("d", "h", "copies", F.explode(F.array(*versions)).alias("x")).select("d", "h", "copies", "x.v", "x.text", "x.note")
    sigs = fingerprint(all_, ["d", "h", "v", "note"], samples=samples)
    of = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    sigs = durable(sigs.groupBy("d", "h").agg(of(0, "sig").alias("sig"), of(1, "sig").alias("edited_sig"), of(2, "note").alias("edited_sha256")))
    following = sigs.select(F.col("d").alias("next_id"), F.col("h").alias("next_h"), F.col("sig").alias("next_sig"))
    ahead = order.withColumnRenamed("id", "d").join(following, ["next_id", "next_h"]).select("d", "h", "n", "copies", "next_sig")
    got = sigs.join(ahead, ["d", "h"])
    none = F.array_repeat(F.lit(_NONE).cast("short"), samples)
    sig, edited, after = (F.coalesce(c, none) for c in ("sig", "edited_sig", "next_sig"))
    return got.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", hexed(sig).alias("fingerprint"), hexed(edited).alias("edited_fingerprint"),
        likeness(sig, edited).alias("near_edited"), likeness(sig, after).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
