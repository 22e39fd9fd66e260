"""Every operator against a brute-force version, on awkward documents, a small generated table and an empty one."""

from __future__ import annotations

import binascii
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, fingerprints, hnsw, mixing, pii, queries, sharding, simhash, suffix_dedup, toxicity
from tests.compare import difference, versus_sql
from tests.llm import plain

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(plain.documents(), plain.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):  # noqa: ANN001, ANN201
    """The awkward documents as tables."""
    d = str(tmp_path_factory.mktemp("awkward"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    """Empty tables."""
    d = str(tmp_path_factory.mktemp("nothing"))
    for name, schema in (("documents", plain.SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("conversations", "conv_id long, turn int, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def _rows(df):  # noqa: ANN001, ANN202
    return [r.asDict(recursive=True) for r in df.collect()]


def _texts(rows):  # noqa: ANN001, ANN202
    return Counter((r[0], r[1]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, nothing, name):  # noqa: ANN001, ANN201
    assert queries.queries()[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):  # noqa: ANN001, ANN201
    assert versus_sql(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir) is None


@pytest.mark.parametrize("which", ["awkward", "generated"])
def test_mix(spark, folder, sf_dir, which):  # noqa: ANN001, ANN201
    d = folder if which == "awkward" else sf_dir
    got = _rows(queries.op1_pareto_mix(spark, d))
    source = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(plain.WORD.findall(t or ""))) for i, t, _ in source)
    want = plain.targets([(s, len(plain.WORD.findall(t or ""))) for _, t, s in source])
    by_source = {str(r["doc_id"]) + str(r["size"]): r for r in got}
    taken, sizes = defaultdict(int), defaultdict(int)
    for i, t, s in source:
        r = by_source[str(i) + str(len(plain.WORD.findall(t or "")))]
        assert r["target"] == pytest.approx(want[s], rel=1e-12)
    drawn = _rows(mixing.draw(spark.read.parquet(f"{d}/documents.parquet")))
    for r in drawn:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] = max(sizes[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= sizes[s], s
    assert sorted(map(str, got)) == sorted(map(str, _rows(queries.op1_pareto_mix(spark, d))))
    made = mixing.expand(spark.read.parquet(f"{d}/documents.parquet"))
    assert made.columns == spark.read.parquet(f"{d}/documents.parquet").columns
    assert made.count() == sum(r["copies"] for r in drawn)


def test_mix_with_a_hot_source(spark):  # noqa: ANN001, ANN201
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 100 < 97, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 3)).alias("source"))
    drawn = mixing.draw(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 50 for r in drawn)


@pytest.mark.parametrize("which", ["awkward", "generated"])
def test_pii(spark, folder, sf_dir, which):  # noqa: ANN001, ANN201
    d = folder if which == "awkward" else sf_dir
    source = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = Counter()
    for i, t in source:
        s = plain.base_spans(t)
        listed = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in s)
        want[(i, *[sum(k == n for _, k, _ in s) for n in range(4)], plain.sha(listed.encode()))] += 1
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in queries.op2_pii(spark, d).collect())
    assert got == want


def test_pii_score_decides_about_added_kinds(spark):  # noqa: ANN001, ANN201
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [
        f'token = "{key}" here', f"the run {key} alone", "AKIA" + "Z7Q2M9X4B8C1D6F3" + " alone", "token = " + "ab" * 20, "ssn 123-45-6789", "no words 123-45-6789",
        "GB29 NWBK 6016 1331 9268 19", "GB29 NWBK 6016 1331 9268 18", "card 4111 1111 1111 1111", "x" * 50_000 + f" api key {key} " + "9" * 50_000, f"é token {key}-{key}",
    ]
    got = [(r["spans"], r["scores"]) for r in queries.op2_pii(spark, _folder(spark, rows)).orderBy("doc_id").collect()]
    ends = len("token = ") + 1
    assert got[0] == (f"secret:{ends}:{ends + 40}", "1.00") and got[1] == ("", "") and got[2] == ("secret:0:20", "0.90") and got[3] == ("", "")
    assert got[4] == ("ssn:4:15", "0.85") and got[5] == ("", "") and got[6] == ("iban:0:27", "0.90") and got[7] == ("", "")
    assert got[8] == ("card:5:24", "1.00") and got[9] == ("secret:50009:50049", "1.00") and got[10] == ("secret:8:89", "1.00")


def _folder(spark, texts):  # noqa: ANN001, ANN202
    import tempfile

    d = tempfile.mkdtemp()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_pii_redacts(spark, docs):  # noqa: ANN001, ANN201
    made = pii.redact(docs)
    assert made.columns == docs.columns
    text = made.where("doc_id = 112").first()
    assert "[EMAIL]" in text["text"] and "[CARD]" in text["text"] and "[IBAN]" in text["text"] and "[SSN]" in text["text"] and "4111" not in text["text"]
    assert text["spans"] == "mine" and made.where("doc_id = 100").first()["text"] is None
    assert made.where("doc_id = 7").first()["text"] == plain.prose(7, 41)


@pytest.mark.parametrize("which", ["awkward", "generated"])
def test_suffix_dedup(spark, folder, sf_dir, which):  # noqa: ANN001, ANN201
    df = spark.read.parquet(f"{folder if which == 'awkward' else sf_dir}/documents.parquet")
    source = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = Counter()
    for (i, t), gone in zip(source, plain.repeated([t for _, t in source])):
        raw = (t or "").encode()
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[(i, len(raw), sum(gone), sum(1 for k, _ in groupby(gone) if k), plain.sha(kept))] += 1
    got = Counter(tuple(r) for r in queries.op3_suffix_dedup(spark, folder if which == "awkward" else sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want


def test_suffix_dedup_of_many_copies_and_periods(spark):  # noqa: ANN001, ANN201
    base = plain.prose(1, 90)
    texts = [base] * 300 + [base[:i] + "|" + base[i:] for i in range(0, 400, 7)] + ["xyz" * n for n in (60, 67, 80, 200)] + [chr(97 + i % 26) * (190 + i) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    gone = plain.repeated(texts)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.repeats(df).collect()}
    for i, (t, g) in enumerate(zip(texts, gone)):
        assert got[i] == bytes(b for b, x in zip(t.encode(), g) if not x), i


@pytest.mark.parametrize("which", ["awkward", "generated"])
def test_simhash(spark, folder, sf_dir, which):  # noqa: ANN001, ANN201
    d = folder if which == "awkward" else sf_dir
    source = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    fps = [plain.simhash(t) for _, t in source]
    of = plain.classes(fps)
    least: dict[int, int] = {}
    for c, (i, _) in zip(of, source):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(source, fps, of))
    assert Counter(tuple(r) for r in queries.op5_simhash(spark, d).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("part", [simhash.PART, 100])
@pytest.mark.parametrize("limit", [1, 2, 4])
def test_simhash_links_all_within_the_limit(spark, part, limit):  # noqa: ANN001, ANN201
    """One range a table and many; 400 fingerprints share a leading block, so that in ranges of 100 their links cross ranges."""
    gen = np.random.default_rng(3)
    heads = gen.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(h) for h in heads}
    for h in heads:
        for _ in range(60):
            x = int(h)
            for b in gen.integers(0, 64, gen.integers(1, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    for _ in range(400):
        x = int(heads[0])
        for b in gen.integers(22, 64, gen.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {0, (1 << 64) - 1})
    of = plain.classes(fps, limit)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from tessera.llm.components import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame(signed, "fp long"), limit, part)).collect()}
    groups = defaultdict(set)
    for (s,), c in zip(signed, of):
        groups[c].add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_keeps_one_of_each_group(spark, docs):  # noqa: ANN001, ANN201
    kept = simhash.keep_first(docs)
    rows = [(r[0], r[1]) for r in plain.documents()]
    of = plain.classes([plain.simhash(t) for _, t in rows])
    assert kept.count() == len(set(of)) and kept.columns == docs.columns
    assert kept.where("doc_id = 105").count() == 0 and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 111").count() == 2


def test_toxicity_holds_out(spark, folder):  # noqa: ANN001, ANN201
    got = _rows(queries.op6_toxicity(spark, folder))
    assert len(got) == len(plain.documents())
    for r in got:
        assert r["held_out"] == (binascii.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_on_held_out_labels(spark):  # noqa: ANN001, ANN201
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = queries.op6_toxicity(spark, d).where("held_out").join(labels, "doc_id").where("toxic is not null").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r["toxic"]: r["p"] for r in got}
    assert rate[1] >= 0.9 and rate[0] <= 0.02


def test_toxicity_kernel():  # noqa: ANN201
    """Against the sum over all common subsequences."""
    from itertools import combinations

    def brute(s: str, t: str) -> float:
        weigh = lambda x: [("".join(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), toxicity.ORDER)]
        return sum(toxicity.DECAY ** (a + b) for u, a in weigh(s) for v, b in weigh(t) if u == v)

    for s, t in (("insult", "insult"), ("in.su.lt", "insult"), ("abcabc", "abc"), ("abc", "xyz"), ("aaaa", "aaa")):
        assert toxicity.kernel(toxicity._codes([s], 12), toxicity._codes([t], 12))[0] == pytest.approx(brute(s, t))


@pytest.mark.parametrize("which", ["awkward", "generated"])
def test_weighted_sampling(spark, folder, sf_dir, which):  # noqa: ANN001, ANN201
    d = folder if which == "awkward" else sf_dir
    source = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = _rows(queries.op7_weighted_sampling(spark, d))
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    ids = [i for i, _ in source]
    single = sorted((i, t) for i, t in source if i is not None and ids.count(i) == 1)
    assert {r["n_chars"] for r in got if r["doc_id"] is not None} == {len(t or "") for i, t in source if i is not None}
    by_id = {r["doc_id"]: r for r in got}
    off, n = 0.0, 0
    for (j, u), (i, t) in zip(single, single[1:]):
        between = [k for k in ids if k is not None and j < k < i]
        if between:
            continue
        t, u = t or "", u or ""
        cut = len(t) - len(t) // 2
        edited = t[:cut] + u[: len(t) // 2]
        r = by_id[i]
        assert r["edited_sha256"] == plain.sha(edited.encode()) and r["n_chars"] == len(t)
        for near, other in (("near_edited", edited), ("near_next", u)):
            assert 0 <= r[near] <= 1
            off += abs(r[near] - plain.jaccard(t, other))
            n += 1
    assert n > 40 and off / n < 0.05
    same: dict[str, set[str]] = defaultdict(set)
    sig = fingerprints.fingerprint(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")), ["doc_id", "h"])
    for r in sig.collect():
        same[r["h"]].add(tuple(r["sig"]))
    assert all(len(s) == 1 for s in same.values())


def test_nearest(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(list)
    for r in queries.op8_hnsw(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    found = total = 0
    for q, near in got.items():
        score = m @ m[ids == q][0]
        best = [i for _, i in sorted((-s, i) for s, i in zip(score, ids.tolist()) if i != q)[:20]]
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1)) and len(near) == len(best)
        assert all(s == pytest.approx(score[ids == i][0], rel=1e-12) for _, i, s in near)
        found += len({i for _, i, _ in near} & set(best))
        total += len(best)
    assert found / total >= 0.95


def test_nearest_of_odd_vectors(spark):  # noqa: ANN001, ANN201
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [1.0, None]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, [1.0]), (4, []), (None, [1.0, 1.0]), (100, [float("inf"), 0.0]), (2, [0.5, -0.5])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5)]


def test_nearest_over_shards(spark):  # noqa: ANN001, ANN201
    gen = np.random.default_rng(5)
    centres = gen.normal(size=(30, 16))
    m = (centres[gen.integers(0, 30, 4000)] + 0.4 * gen.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=1000).collect():
        got[r["query_id"]].add(r["vec_id"])
    x = m.astype(np.float64)
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit / (200 * 20) >= 0.9


@pytest.mark.parametrize("shards", [1, 4])
def test_recall_on_the_generated_vectors(spark, shards):  # noqa: ANN001, ANN201
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in df.collect()]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(set)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=-(-len(rows) // shards)).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in got:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hit / (20 * len(got)) >= 0.95


def test_equal_vectors_and_doubles(spark):  # noqa: ANN001, ANN201
    """A third of the vectors are equal: the smallest ids of them come first; doubles that floats can't tell apart are told apart."""
    gen = np.random.default_rng(11)
    m = gen.normal(size=(900, 8))
    m[:300] = 10 * m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 20, 280):
        assert [v for v, _ in got[q]] == [i for i in range(22) if i != q][:20]
    for q in (400, 880):
        s = m @ m[q]
        s[q] = -np.inf
        want = [int(i) for i in np.lexsort((np.arange(900), -s))[:20]]
        assert len(set(want) & {v for v, _ in got[q]}) >= 18
    fine = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0 + 1e-12, 0.0]), (3, [1.0 + 2e-12, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in hnsw.nearest(fine, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(3, 1.0 + 2e-12), (2, 1.0 + 1e-12), (1, 1.0)]


def test_sharding(spark, docs):  # noqa: ANN001, ANN201
    limit = 600
    rows = _rows(sharding.assign(docs, limit))
    assert Counter((r["doc_id"], r["bytes"]) for r in rows) == Counter((i, len((t or "").encode())) for i, t, *_ in plain.documents())
    shards = defaultdict(list)
    for r in rows:
        assert len(r["prefix"]) == r["depth"]
        shards[(r["depth"], r["prefix"], r["part"])].append(r["bytes"])
    for sizes in shards.values():
        assert sum(sizes) <= limit or len([s for s in sizes if s]) == 1
    prefixes = {p for _, p, _ in shards}
    assert not [1 for a in prefixes for b in prefixes if a != b and b.startswith(a)]


def test_bpe(spark, docs, sf_dir):  # noqa: ANN001, ANN201
    tokens = bpe.read_ranks(PATH)
    real = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        made = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).select("doc_id", "text", "ids", "decoded").collect()
        assert len(made) == df.count()
        for r in made:
            text = r["text"] or ""
            assert r["ids"] == real.encode_ordinary(text), r["doc_id"]
            assert bytes(r["decoded"]) == text.encode()
    text = "ids are joined"
    row = bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, public_tokenizers.PATTERN), PATH)).first()
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(real.encode_ordinary(text)), plain.sha(" ".join(map(str, real.encode_ordinary(text))).encode()), plain.sha(text.encode()))


def test_chat(spark):  # noqa: ANN001, ANN201
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    talks = {1: a[:2], 2: a, 3: a[:3], 4: a, 5: [("user", "other <|im_end|>")], 6: [("user", None)], 7: [("user", "")]}
    rows = [(c, i, *t) for c, turns in talks.items() for i, t in enumerate(turns)] + [(5, 0, "user", "other <|im_end|>"), (None, 0, "user", "lost")]
    got = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert sorted(got, key=str) == [2, 5, 6, 7, None]
    assert got[2]["copies"] == 2 and got[2]["n_turns"] == 4 and got[5]["n_turns"] == 1
    assert got[5]["chat"] == "<|im_start|>user\nother < |im_end|><|im_end|>\n" and got[2]["chat"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello")


def test_difference_sees_one():  # noqa: ANN201
    assert difference([{"a": 1}], [{"a": 2}]) and not difference([{"a": 1.0}], [{"a": 1.0}])
