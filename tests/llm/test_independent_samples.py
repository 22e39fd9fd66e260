"""The likeness of fingerprints is as accurate as that of 64 independent samples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints


@pytest.mark.parametrize("weight", [1, 3])
def test_spread_of_likeness(spark, weight):  # noqa: ANN001, ANN201
    # 300 pairs of texts with words of their own; 20 of 40 words are shared, J = 20 / 60 (in the other half the weights differ)
    rows = []
    for i in range(300):
        words = [[f"p{i}w{k}" for k in r] for r in (range(0, 40), range(20, 60))]
        rows += [(2 * i + v, " ".join(w * weight)) for v, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).repartition(8, "doc_id", "h")
    sig = {r["doc_id"]: np.array(r["sig"]) for r in fingerprints.fingerprint(df, ["doc_id", "h"]).collect()}
    near = np.array([np.mean(sig[2 * i] == sig[2 * i + 1]) for i in range(300)])
    p = 1 / 3
    assert all(len(s) == fingerprints.SAMPLES for s in sig.values())
    assert abs(near.mean() - p) < 0.015
    assert near.std() < 1.2 * (p * (1 - p) / fingerprints.SAMPLES) ** 0.5


def test_weights(spark):  # noqa: ANN001, ANN201
    # weights 2, 1 and 5 against 3, 4 and 5 on 20 words each: J = (2 + 1 + 5) / (3 + 4 + 5)
    rows = []
    for i in range(100):
        for v, w in enumerate(((2, 1, 5), (3, 4, 5))):
            rows.append((2 * i + v, " ".join(f"p{i}w{k}" for k in range(60) for _ in range(w[k % 3]))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).repartition(8, "doc_id", "h")
    sig = {r["doc_id"]: np.array(r["sig"]) for r in fingerprints.fingerprint(df, ["doc_id", "h"]).collect()}
    near = np.array([np.mean(sig[2 * i] == sig[2 * i + 1]) for i in range(100)])
    assert abs(near.mean() - 8 / 12) < 0.025
    assert near.std() < 0.08
