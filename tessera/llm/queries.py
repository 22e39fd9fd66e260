"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tessera.llm import bpe, chat, fingerprints, hnsw, mixing, pii, sharding, simhash, suffix_dedup, toxicity
from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    spans = F.col("spans")
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"), pii.scored(spans).alias("scores"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return got.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.classify(docs, labels)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Largest number of text bytes in a shard.
SHARD_BYTES = 1 << 20


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN))


def queries() -> dict[str, Query]:
    return {
        "op1_pareto_mix": op1_pareto_mix, "op2_pii": op2_pii, "op3_suffix_dedup": op3_suffix_dedup, "op4_chat_snapshots": op4_chat_snapshots, "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity, "op7_weighted_sampling": op7_weighted_sampling, "op8_hnsw": op8_hnsw, "op9_extendible_sharding": op9_extendible_sharding, "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_snapshots": chat.ORACLE, "op9_extendible_sharding": sharding.oracle(SHARD_BYTES)}
