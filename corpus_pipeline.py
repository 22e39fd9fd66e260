"""A training corpus from raw documents: toxic ones go, near-duplicates go, personal data is masked, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, pii, simhash, toxicity
from tessera.llm.common import durable, fresh, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones that aren't held out, doesn't call toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    score, toxic = fresh(docs, "score", "predicted")
    return toxicity.classify(docs, labels, into=score, predicted=toxic).where(F.col(toxic) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group joined by pairs with 0.8 or more of their five-word shingles in common (Jaccard).

    SimHash fingerprints in a Gray-order index give the first pairs; an exact pass over the rest loses none that they miss.
    """
    return simhash.keep_first_similar(docs, shingle=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span replaced by its kind."""
    return pii.redact(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: doc_id, source, copies' ids and their number; every encoding is decoded and compared with its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.checked(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the classifier; tests compare every stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
