"""Documents with one id fill parts within the limit."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from tessera.llm import sharding


def test_no_part_passes_the_limit(spark):  # noqa: ANN001, ANN201
    gen = random.Random(5)
    rows = [(1, "x" * n) for n in (5, 9, 5)] + [(None, "y" * gen.choice((0, 1, 3, 5, 9, 10, 11, 25))) for _ in range(200)] + [(2, "z" * 10)] * 4
    shards = defaultdict(list)
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10).collect()
    for r in got:
        shards[(r["depth"], r["prefix"], r["part"])].append(r["bytes"])
    assert Counter((r["doc_id"], r["bytes"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    for sizes in shards.values():
        assert sum(sizes) <= 10 or len(sizes) == 1
