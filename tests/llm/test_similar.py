"""Near-duplicates by exact Jaccard similarity, against all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import simhash
from tessera.llm.common import table
from tests.llm import plain


def _shingles(text: str | None) -> set[str]:
    words = plain.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows: list[tuple[int | None, str | None]]) -> Counter:
    sets = [_shingles(t) for _, t in rows]
    by: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s or {""}:
            by.setdefault(g, []).append(i)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s or {""} for j in by[g] if j < i).items():
            if 10 * both >= 8 * (len(s or {""}) + len(sets[j] or {""}) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        c = find(i)
        first[c] = min(d, first.get(c, d), key=lambda x: (x is None, x or 0))
    return Counter(first.values())


def _edited() -> list[tuple[int, str]]:
    """Prose and copies with a few changed words: similarities on both sides of 0.8."""
    rows = []
    for i in range(30):
        words = plain.prose(500 + i, 200).split()
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 8):
            rows.append((10 * i + k, " ".join(w if (n + 7 * k) % (200 // k) else f"x{k}" for n, w in enumerate(words))))
    return rows


@pytest.mark.parametrize("which", ["edited", "awkward", "generated"])
def test_stage_keeps_one_of_each_similar_group(spark, which):  # noqa: ANN001, ANN201
    if which == "edited":
        docs = spark.createDataFrame(_edited(), "doc_id long, text string").repartition(5)
    elif which == "awkward":
        docs = spark.createDataFrame(plain.documents(), plain.SCHEMA).repartition(5)
    else:
        docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == _kept(rows)


def test_tokens_in_blocks(spark, monkeypatch):  # noqa: ANN001, ANN201
    """Blocks of three rows: every token is cut, and pairs of different blocks are found."""
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rows = _edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(r["doc_id"] for r in simhash.keep_first_similar(docs).collect()) == _kept(rows)


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):  # noqa: ANN001, ANN201
    words = plain.prose(77, 150).split()
    rows = [(i, " ".join(w if (n * 131 + i * 17) % 97 else f"x{i}" for n, w in enumerate(words))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []

    def counting(find):  # noqa: ANN001, ANN202
        def found(*args):  # noqa: ANN002, ANN202
            out = find(*args).cache()
            seen.append(out.count())
            return out

        return found

    for name in ("linking_pairs", "remaining_pairs"):
        monkeypatch.setattr(simhash, name, counting(getattr(simhash, name)))
    assert Counter(r["doc_id"] for r in simhash.keep_first_similar(docs).collect()) == _kept(rows)
    assert len(seen) == 2 and sum(seen) < 600 * 60


def test_bitmaps_never_exceed_the_difference():  # noqa: ANN201
    texts = [" ".join(plain.prose(k, 40 * (k + 1)).split()) for k in range(6)]
    sets = [simhash.shingles(t) for t in texts] + [simhash.shingles(texts[-1] + " more words at its end"), simhash.shingles("")]
    maps = simhash.Bitmaps([simhash.bitmap(s) for s in sets])
    for i in range(len(sets)):
        for j in range(len(sets)):
            got = int(maps.differ(np.array([i]), np.array([j]))[0])
            assert got <= len(np.setxor1d(sets[i], sets[j])) and (i != j or got == 0)


def _near_fingerprints(n: int) -> np.ndarray:
    """Distinct fingerprints: n at random, and around each many that differ from it in up to four bits."""
    gen = np.random.default_rng(11)
    base = gen.integers(0, 1 << 64, n, dtype=np.uint64)
    made = [base]
    for _ in range(60):
        x = base.copy()
        for _ in range(gen.integers(1, 5)):
            x ^= np.uint64(1) << gen.integers(0, 64, n).astype(np.uint64)
        made.append(x)
    return np.unique(np.concatenate(made))


def _joined(a: np.ndarray, b: np.ndarray) -> set[tuple[int, int]]:
    return set(zip(*(x.tolist() for x in simhash.forest(a, b)), strict=True))


@pytest.mark.parametrize("part", [simhash.NEAR_PART, 97])
def test_index_gives_pairs_that_join_all_within_the_radius(spark, monkeypatch, part):  # noqa: ANN001, ANN201
    """In one range and in many: each pair is within the radius, and together they join what all such pairs do, in one range by a forest a table, however many pairs there are."""
    monkeypatch.setattr(simhash, "QUERIES", 50)
    fp = _near_fingerprints(20)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.NEAR_BITS, 1))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(4)
    got = simhash.links(df, simhash.NEAR_BITS, part, pairs=True).collect()
    a, b = (np.array([r[c] for r in got], np.int64).view(np.uint64) for c in ("a", "b"))
    assert (np.bitwise_count(a ^ b) <= simhash.NEAR_BITS).all()
    assert _joined(a, b) == _joined(fp[i], fp[j])
    assert part < len(fp) or len(got) <= (simhash.NEAR_BITS + 1) * (len(fp) - 1) < len(i) / 2


def test_stage_joins_by_fingerprints_first(spark, monkeypatch):  # noqa: ANN001, ANN201
    """Without the passes for the rest, the stage still drops what has near fingerprints and is similar, and nothing else."""
    none = spark.createDataFrame([], "a long, b long")
    for name in ("linking_pairs", "remaining_pairs"):
        monkeypatch.setattr(simhash, name, lambda *_: none)
    rows = _edited()
    sets = [_shingles(t) for _, t in rows]
    fp = np.array([simhash.majority(simhash.shingles(t)) for _, t in rows], np.uint64)
    near = np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.NEAR_BITS, 1)
    pairs = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    gone = _joined(*np.array([[rows[i][0] for i in p] for p in pairs]).T)
    assert len(gone) > 10 and {d for d, _ in rows} - kept == {d for d, _ in gone}
