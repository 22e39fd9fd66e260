"""The pipeline's stages, each on what the one before kept, against plain versions."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, mixing, pii, toxicity
from tessera.llm.common import durable, table
from tests.llm import plain
from tests.llm.test_similar import _kept as similar_kept


def test_stages(spark):  # noqa: ANN001, ANN201
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        assert docs.columns == names, name
        kept.append([tuple(r) for r in docs.collect()])
    start = [tuple(r) for r in table(spark, sf_dir, "documents").collect()]
    at = names.index("text")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    calm, single, masked, mixed = kept
    assert set(calm) < set(start)
    gone = [labels[r[0]] for r in set(start) - set(calm) if labels.get(r[0]) is not None]
    stay = [labels[r[0]] for r in calm if labels.get(r[0]) is not None]
    assert sum(gone) > 0.9 * (sum(gone) + sum(stay)) and gone.count(0) <= 0.05 * (gone.count(0) + stay.count(0))
    assert set(single) <= set(calm) and Counter(r[0] for r in single) == similar_kept([(r[0], r[at]) for r in calm])
    for a, b in zip(sorted(single), sorted(masked)):
        assert a[0] == b[0] and (a[at] == b[at]) == (b[at] is None or "[" not in b[at] or a[at] == b[at])
        if not plain.base_spans(a[at]) and a[at] == b[at]:
            continue
        assert not plain.base_spans(b[at]) or plain.base_spans(a[at]) != plain.base_spans(b[at])
    want = Counter()
    for r in mixing.draw(spark.createDataFrame(masked, table(spark, sf_dir, "documents").schema)).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r[0] for r in mixed) == +want
    done = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    real = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in done) == Counter((r[0], tuple(real.encode_ordinary(r[at] or ""))) for r in mixed)
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in done)


def test_run_is_the_stages_in_order(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    key = lambda df: Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_empty_and_awkward(spark, tmp_path):  # noqa: ANN001, ANN201
    for n, rows in enumerate(([], plain.documents())):
        d = str(tmp_path / str(n))
        spark.createDataFrame(rows, plain.SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d)
        assert got.count() if rows else got.count() == 0
        docs = table(spark, d, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, d))
            assert docs.columns == [f.split()[0] for f in plain.SCHEMA.split(", ")], name
            assert docs.where("score <> 7.5 or spans <> 'mine' or _h <> 1").count() == 0, name


def test_redacted_texts_have_no_base_spans(spark, sf_dir):  # noqa: ANN001, ANN201
    made = pii.redact(table(spark, sf_dir, "documents")).select("text").collect()
    assert sum(bool(plain.base_spans(r["text"])) for r in made) <= 0.01 * len(made)


def test_training_is_bounded(spark, sf_dir):  # noqa: ANN001, ANN201
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(table(spark, sf_dir, "documents"), labels, sample=20)
    assert len(model.landmarks) <= toxicity.LANDMARKS
    assert toxicity.score(table(spark, sf_dir, "documents"), model).where(F.col("score").isNull()).count() == 0
