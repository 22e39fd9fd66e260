"""Helpers that the operators share: tables, words, durable intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.durable import durable, forget, shared_dir

__all__ = ["WORD", "durable", "few", "forget", "fresh", "partitions_for", "shared_dir", "table", "text_or_empty", "tidy", "word_count"]

#: A word: a run of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: str | Column = "text") -> Column:
    """Number of words, as a long; null texts have none."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df needs."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows of a few longs that every executor may hold: some 50 MB.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df, a written table of a few longs, with a broadcast hint if it has at most FEW rows; else joins with it are shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches], forget_: Callable[[], None] | None = None) -> Callable[[Batches], Batches]:
    """run for mapInArrow, whose worker gives freed memory back when a task is over.

    Workers outlive tasks and stages: what one stage has used would otherwise count against the next ones. forget_ empties caches first.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            if forget_ is not None:
                forget_()
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc
