"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 majority votes over the XXH64 hashes (seed 42) of word shingles. Linking: equal fingerprints are
one node. Of limit + 1 blocks of bits, two fingerprints that differ in at most limit bits agree in one, so there is a table for each
block, in which fingerprints are turned so that the block leads. A table is one index: fingerprints sorted by Gray rank,
runs of FANOUT under a node that holds the bits they share, shared bits factored upwards so that a node keeps what
its parent lacks. Queries go down level by level, add up the differences and leave a whole group once they exceed the limit; a
difference in the leading block exceeds it at once.

The index is distributed by ranges of Gray rank, PART fingerprints each. Each range's shared bits are the upper nodes (at most
MAX_PARTS a table, held by all tasks), which are searched for the other ranges that a fingerprint must visit; there are none but where
one leading block fills several ranges, so a hot block is spread over as many tasks as it needs. A range gives back a spanning forest of its
links. A fingerprint has at most 64 + 2,016 others within two bits, so links grow in proportion to distinct fingerprints.

`similar` and `keep_first_similar` are for any similarity. They go by the same index first, over fingerprints of the shingle sets and
NEAR_BITS wide: what it joins are real pairs, each compared exactly. A radius that is wide enough for 0.8 (some 10 bits on average,
16 in the tail) would need blocks too short to part a large table, and would still lose pairs. So the rest comes from
ordered prefixes of the shingle sets, which lose none, and is compared exactly too. Groups of many near copies are joined by few of their pairs first.

Defined cases: null and empty texts have fingerprint zero and link like others; fewer words than a shingle needs
form one shingle; ties go to the smallest doc_id; repeated rows share fingerprint and component; null doc_ids are
kept, and a component of nothing else has a null id; an empty table gives an empty result; `keep_first` passes other columns on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shipping import ship
from tessera.llm.common import durable, few, fresh, partitions_for, tidy
from tessera.llm.components import components

FANOUT = 8
#: Distinct fingerprints in a range of the index, and most ranges of a table.
PART, MAX_PARTS = 1 << 18, 4096
#: (query, node) pairs held at once while the index is searched, for links and for pairs.
FRONT, PAIR_FRONT = 2_000_000, 250_000
#: Differing bits up to which the index gives candidates for any similarity, and distinct fingerprints in a range of it then.
NEAR_BITS, NEAR_PART = 6, 1 << 15
#: Fingerprints that are looked up before what they join is noted in the index.
QUERIES = 1024
#: Rows of a shingle that meet in one group.
BLOCK = 100_000
#: Candidates a row up to which a group's are compared without a look at bitmaps.
DENSE = 4
#: Documents sampled for frequent shingles, in how many of them one is frequent, and how many are kept at most.
SAMPLE_DOCS, OFTEN, MAX_FREQUENT = 5_000, 4, 200_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of hashes: a bit is 1 if set in over half of them; zero of none."""
    if not len(h):
        return 0
    cols = h.view(np.uint8).reshape(-1, 8)
    votes = [np.bincount(cols[:, k], minlength=256) @ _BITS for k in range(8)]
    ones = (2 * np.concatenate(votes) > len(h)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, h, fp) for each row: the text's hash, and the fingerprint as a signed long."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each codeword in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Tree:
    """Masked bit patterns in Gray order under nodes of what FANOUT of them share."""

    def __init__(self, masks: np.ndarray, patterns: np.ndarray):
        levels, self.patterns = [masks], [patterns]
        while len(levels[-1]) > FANOUT:
            m, p = levels[-1], self.patterns[-1]
            starts = np.arange(0, len(m), FANOUT)
            head = np.repeat(p[starts], np.diff([*starts, len(m)]))
            shared = np.bitwise_and.reduceat(m & ~(p ^ head), starts)
            levels.append(shared)
            self.patterns.append(p[starts] & shared)
        #: What a node has beyond its parent.
        self.own = [m & ~np.repeat(levels[k + 1], FANOUT)[: len(m)] if k + 1 < len(levels) else m for k, m in enumerate(levels)]

    def common(self, label: np.ndarray) -> list[np.ndarray]:
        """By level, the label that all leaves of a node have, or -1; labels aren't negative."""
        out = [label]
        for below in self.own[:-1]:
            starts = np.arange(0, len(below), FANOUT)
            least, most = np.minimum.reduceat(out[-1], starts), np.maximum.reduceat(out[-1], starts)
            out.append(np.where(least == most, least, -1))
        return out

    def search(self, queries: np.ndarray, limit: int, lead: np.uint64, joined: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) index pairs that differ in at most limit shared bits and in none of lead.

        joined holds labels of queries and leaves: pairs of one label are left out, and so are whole nodes whose leaves all have the query's.
        """
        labels, front = (self.common(joined[1]), PAIR_FRONT) if joined else ([], FRONT)
        top = len(self.own) - 1
        roots = len(self.own[top])
        step = max(1, front // max(roots, 1))
        for lo in range(0, len(queries) if roots else 0, step):
            n = min(step, len(queries) - lo)
            todo = [(top, np.repeat(np.arange(lo, lo + n), roots), np.tile(np.arange(roots), n), np.zeros(n * roots, np.int64))]
            while todo:
                k, q, node, acc = todo.pop()
                apart = (queries[q] ^ self.patterns[k][node]) & self.own[k][node]
                acc = acc + np.bitwise_count(apart) + (limit + 1) * ((apart & lead) != 0)
                keep = acc <= limit
                if joined:
                    keep &= labels[k][node] != joined[0][q]
                q, node, acc = q[keep], node[keep], acc[keep]
                if not k:
                    yield q, node
                    continue
                for at in range(0, len(q), front // FANOUT):
                    some = slice(at, at + front // FANOUT)
                    child = (node[some, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = child < len(self.own[k - 1])
                    todo.append((k - 1, np.repeat(q[some], FANOUT)[there], child[there], np.repeat(acc[some], FANOUT)[there]))


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def index_links(x: np.ndarray, guests: np.ndarray, limit: int, lead: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct x, and of guests with x, that differ in at most limit bits and in none of lead."""
    s = x[np.argsort(gray_rank(x), kind="stable")]
    tree = Tree(np.full(len(s), _FULL), s)
    a, b = [s[:0]], [s[:0]]
    for q, leaf in tree.search(s, limit, lead):
        later = leaf > q
        a.append(s[q[later]])
        b.append(s[leaf[later]])
    for q, leaf in tree.search(guests, limit, lead):
        a.append(guests[q])
        b.append(s[leaf])
    return np.concatenate(a), np.concatenate(b)


def tables(limit: int) -> list[tuple[np.uint64, np.uint64]]:
    """For each of limit + 1 blocks: by how much to turn a fingerprint left so that the block leads, and the block's mask then."""
    edges = [64 * k // (limit + 1) for k in range(limit + 2)]
    return [(np.uint64(lo), _FULL << np.uint64(64 - (hi - lo))) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _turn(x: np.ndarray, by: np.uint64) -> np.ndarray:
    return x << by | x >> np.uint64(64) - by if by else x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links a-b."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links u-v among n nodes make a forest with the same components, earlier links first, and each node's label then."""
    label, left, kept = np.arange(n), np.arange(len(u)), [np.empty(0, np.int64)]
    while True:
        left = left[label[u[left]] != label[v[left]]]
        if not len(left):
            return np.concatenate(kept), label
        best = np.full(n, len(u))
        np.minimum.at(best, label[u[left]], left)
        np.minimum.at(best, label[v[left]], left)
        take = np.unique(best[best < len(u)])
        kept.append(take)
        to = np.arange(n)
        own, root = forest(label[u[take]], label[v[take]])
        to[own] = root
        label = to[label]


def index_pairs(x: np.ndarray, guests: np.ndarray, limit: int, lead: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of index_links(), some that join the same: a forest, so that many near each other cost no square of their number."""
    s = x[np.argsort(gray_rank(x), kind="stable")]
    tree = Tree(np.full(len(s), _FULL), s)
    every = np.concatenate([s, guests])
    label = np.arange(len(every))
    a, b = [s[:0]], [s[:0]]
    for lo in range(0, len(every), QUERIES):
        some = slice(lo, lo + QUERIES)
        for q, leaf in tree.search(every[some], limit, lead, (label[some], label[: len(s)])):
            new = label[lo + q] != label[leaf]
            q, leaf = lo + q[new], leaf[new]
            closest = np.argsort(np.bitwise_count(every[q] ^ s[leaf]), kind="stable")
            q, leaf = q[closest], leaf[closest]
            take, to = spanning(label[q], label[leaf], len(every))
            label = to[label]
            a.append(every[q[take]])
            b.append(s[leaf[take]])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, limit: int = 2, part: int = PART, pairs: bool = False) -> DataFrame:
    """(a, b) long: links that join whatever distinct(fp) has within limit differing bits; if pairs, a and b of each differ in no more themselves."""
    if not 0 <= limit <= 7:
        raise ValueError("blocks would be too short for more than seven differing bits")
    spark = distinct.sparkSession
    ship(spark)
    turns = tables(limit)
    flip = np.uint64(1 << 63)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for k, (by, _) in enumerate(turns):
                x = _turn(fp, by)
                rank = (gray_rank(x) ^ flip).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(rank), pa.array(x.view(np.int64))], names=["k", "rank", "x"])

    rows = durable(distinct.mapInArrow(tidy(turned), "k int, rank long, x long"))
    parts = min(MAX_PARTS, max(1, -(-rows.where("k = 0").count() // part)))
    at = [i / parts for i in range(1, parts)]
    cuts = {r["k"]: np.unique(np.array(r["c"], np.int64)) for r in rows.groupBy("k").agg(F.percentile_approx("rank", at, 10_000).alias("c")).collect()} if at else {}
    none = np.empty(0, np.int64)

    def own_part(k: int, rank: np.ndarray) -> np.ndarray:
        return k * MAX_PARTS + np.searchsorted(cuts.get(k, none), rank, side="left")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, rank = np.asarray(b.column(0)), np.asarray(b.column(1))
            of = np.empty(len(k), np.int64)
            for n in range(len(turns)):
                of[k == n] = own_part(n, rank[k == n])
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), b.column(2)], names=["part", "x"])

    rows = durable(rows.mapInArrow(tidy(placed), "part int, x long"))
    # a row for each range: at most MAX_PARTS a table
    upper = rows.groupBy("part").agg(F.bit_and("x").alias("all"), F.bit_or("x").alias("any")).orderBy("part").collect()
    parted = np.array([r["part"] for r in upper], np.int64)
    every, some = (np.array([r[c] for r in upper], np.int64).view(np.uint64) for c in ("all", "any"))
    nodes = [np.flatnonzero(parted // MAX_PARTS == n) for n in range(len(turns))]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(~(every[i] ^ some[i]), every[i]) for i in nodes]
        for b in batches:
            of, x = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
            yield out(of, np.zeros(len(of), np.int32), x)
            for n, tree in enumerate(trees):
                mine = np.flatnonzero(of // MAX_PARTS == n)
                for q, leaf in tree.search(x[mine], limit, turns[n][1]):
                    to = parted[nodes[n][leaf]]
                    # of two ranges the lower one's fingerprints visit
                    go = to > of[mine[q]]
                    yield out(to[go], np.ones(int(go.sum()), np.int32), x[mine[q[go]]])

    def out(to: np.ndarray, guest: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(guest), pa.array(x.view(np.int64))], names=["part", "guest", "x"])

    dealt = rows.mapInArrow(tidy(sent), "part int, guest int, x long")
    dealt = dealt.repartition(max(partitions_for(spark), min(len(upper), 8 * partitions_for(spark))), "part").sortWithinPartitions("part")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            of, guest, x = np.asarray(columns[0]), np.asarray(columns[1]) > 0, np.asarray(columns[2]).view(np.uint64)
            for n in np.unique(of):
                mine = of == n
                by, lead = turns[n // MAX_PARTS]
                a, b = (index_pairs if pairs else index_links)(x[mine & ~guest], x[mine & guest], limit, lead)
                a, b = _turn(a, (np.uint64(64) - by) % np.uint64(64)), _turn(b, (np.uint64(64) - by) % np.uint64(64))
                if not pairs:
                    a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(tidy(found), "a long, b long")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def labelled(docs: DataFrame, shingle: int, limit: int) -> DataFrame:
    """(doc_id, h, fp, component_id, root) for each row of docs(doc_id, text); h is the text's hash, root the component's least fingerprint."""
    each = durable(fingerprints(docs, shingle))
    nodes = durable(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), limit))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = durable(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(named.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text)."""
    return labelled(docs, shingle, limit).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, of the smallest doc_id (null last), then text hash."""
    return _first_rows(docs, labelled(docs, shingle, limit))


def _first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of docs, one row of each root that rows(doc_id, h, root) names.

    Most rows stay as they are, so what is joined are the (doc_id, text hash) that go or are there more than once.
    """
    id_, h_, first, h = fresh(docs, "_id", "_h", "_first", "_own")
    per = durable(rows.groupBy("doc_id", "h", "root").agg(F.count("*").alias("c")))
    best = per.groupBy(F.col("root").alias("to")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))).alias("best"))
    is_first = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    marked = per.join(best, F.col("root") == F.col("to")).withColumn("is_first", is_first).where("not is_first or c > 1")
    marked = few(durable(marked.select(F.col("doc_id").alias(id_), F.col("h").alias(h_), F.col("is_first").alias(first))))
    own = docs.withColumn(h, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(h_))
    again = own.join(marked.where(F.col(first)), same, "left_semi").dropDuplicates(["doc_id", h])
    return own.join(marked, same, "left_anti").union(again).select(*[f"`{c}`" for c in docs.columns])


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; words and short texts as in fingerprint(), none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))


def least_overlap(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """ceil(similarity * n), safe against rounding: what a set of n must share with one that similar."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def most_apart(n: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles two sets of n in all can differ: n - 2 w, where w is what they share."""
    return n - 2 * least_overlap(n, similarity / (1 + similarity))


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that occur in several documents of a sample, rarest first. They only order the prefixes; no result depends on them."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *got]).view(np.int64))], names=["g"])

    counts = sample.mapInArrow(tidy(run), "g long").groupBy("g").count().where(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "g").limit(MAX_FREQUENT).collect()
    return np.array([r["g"] for r in reversed(top)], np.int64).view(np.uint64)


def _fits(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and j, different ones that share a token at their positions, can be that similar by their sizes."""
    shared = np.minimum(n[i] - at[i], n[j] - at[j])
    least = np.maximum(least_overlap(n[i] + n[j], similarity / (1 + similarity)), least_overlap(np.maximum(n[i], n[j]), similarity))
    return (shared >= least) & (s[i] != s[j])


def bitmap(g: np.ndarray) -> bytes:
    """Eight bits or more for each shingle of a set; a bit is the parity of the shingles that fall on it, so two maps differ in no more bits than the sets in shingles."""
    width = 8
    while len(g) > width:
        width *= 2
    return np.packbits(np.bincount((g & np.uint64(8 * width - 1)).astype(np.int64), minlength=8 * width).astype(np.uint8) & 1, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of sets by row; a wider one folds to the width of a narrower one."""

    def __init__(self, maps: list[bytes]):
        sizes = np.array([len(m) for m in maps])
        self.width, self.place, self.of = sizes, np.zeros(len(maps), np.int64), {}
        for w in np.unique(sizes):
            own = np.flatnonzero(sizes == w)
            self.place[own] = np.arange(len(own))
            self.of[w] = np.frombuffer(b"".join(maps[k] for k in own), np.uint64).reshape(len(own), w // 8)

    def _at(self, rows: np.ndarray, wide: int, narrow: int) -> np.ndarray:
        got = self.of[wide][self.place[rows]]
        return got if wide == narrow else np.bitwise_xor.reduce(got.reshape(len(rows), wide // narrow, narrow // 8), axis=1)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits rows i and j differ: at most the shingles that only one of them has."""
        out = np.zeros(len(i), np.int64)
        kinds = np.stack([self.width[i], self.width[j]], 1)
        for x, y in np.unique(kinds, axis=0):
            own = np.flatnonzero((kinds == (x, y)).all(axis=1))
            low = min(x, y)
            step = max(1, FRONT * 8 // low)
            for at in range(0, len(own), step):
                k = own[at : at + step]
                out[k] = np.bitwise_count(self._at(i[k], x, low) ^ self._at(j[k], y, low)).sum(axis=1)
        return out


def _near_pairs(group: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the next one of its group (whole runs) that it can be similar to: at most a pair a row."""
    i = np.arange(len(group))
    d = 1
    while len(i):
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        ok = _fits(i, i + d, s, n, at, similarity)
        yield i[ok], i[ok] + d
        i = i[~ok]
        d += 1


def _cross_pairs(group: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, block: np.ndarray, same: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group (whole runs, each by rising n), of different roots, and of different blocks unless same, that can be similar."""
    i = np.arange(len(group))
    d = 1
    while len(i):
        i = i[i + d < len(group)]
        j = i + d
        go = (group[i] == group[j]) & (n[i] >= least_overlap(n[j], similarity))
        i, j = i[go], j[go]
        ok = (root[i] != root[j]) & ((same[i] > 0) | (block[i] != block[j]))
        ok[ok] = _fits(i[ok], j[ok], s, n, at, similarity)
        yield i[ok], j[ok]
        d += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of one or more whole runs of equal values of the first."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first = np.asarray(b.column(0))
        last = np.flatnonzero(first != first[-1])
        end = int(last[-1]) + 1 if len(last) else 0
        if held and (end or first[0] != held[0].column(0)[-1].as_py()):
            yield [pa.concat_arrays(c) for c in zip(*[h.columns for h in [*held, b.slice(0, end)]], strict=True)]
            held, b = [], b.slice(end)
        held.append(b)
    if held:
        yield [pa.concat_arrays(c) for c in zip(*[h.columns for h in held], strict=True)]


def _pair_batch(s: np.ndarray, i: np.ndarray, j: np.ndarray, *before: None) -> pa.RecordBatch:
    """(a, b), a < b, without repeats; a null column stands before them if asked for."""
    got = np.unique(np.stack([np.minimum(s[i], s[j]), np.maximum(s[i], s[j])], 1), axis=0)
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(got), pa.int64()) for _ in before], pa.array(got[:, 0]), pa.array(got[:, 1])], names=[*["group" for _ in before], "a", "b"])


def fingerprint_pairs(rows: DataFrame, limit: int = NEAR_BITS) -> DataFrame:
    """(a, b), a < b: candidates that join what rows(id, fp) has within limit differing bits, by few pairs: each row with the first of its fingerprint, and those firsts by the index."""
    heads = durable(rows.groupBy("fp").agg(F.min("id").alias("head")))
    across = links(heads.select("fp"), limit, NEAR_PART, pairs=True).distinct()
    across = across.join(heads.toDF("a", "p"), "a").join(heads.toDF("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    twins = rows.join(heads, "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return across.union(twins).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs(a, b) that roots(node, root) don't join yet."""
    two = pairs.join(roots.toDF("a", "x"), "a", "left").join(roots.toDF("b", "y"), "b", "left")
    return two.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def linking_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: candidates of rows(token, c, s, n, at), one a row at most; c is how many rows the token has.

    The rows of a token are shuffled, each token's in its own way, and cut into blocks, so that sets meet others in every token.
    """
    block = F.pmod(F.xxhash64("s", "token"), F.ceil(F.col("c") / BLOCK))
    size = F.floor(F.ln("n") / -math.log(similarity))
    # a hash stands for token, block and size: two that clash only add candidates
    dealt = rows.select(F.xxhash64("token", block, size).alias("group"), "s", "n", "at", F.xxhash64("token", "s").alias("place"))
    dealt = dealt.repartition(partitions_for(rows.sparkSession), "group").sortWithinPartitions("group", "place").drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            group, s, n, at = (np.asarray(c) for c in columns)
            for i, j in _near_pairs(group, s, n, at, similarity):
                yield _pair_batch(s, i, j)

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def remaining_pairs(rows: DataFrame, roots: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all candidates out of rows(token, c, s, n, at) that roots(node, root) don't join yet; maps(s, bits) are the sets' bitmaps.

    Tokens whose sets all have one root are left out before anything is gathered. What is left of a token of over BLOCK rows is cut into
    blocks, and each two blocks meet in a group of their own. Where a group has no more than DENSE candidates a row, they go out as they are.
    In other groups the rows' bitmaps are compared first, which rule out what shares too little.
    """
    named = durable(rows.join(roots, F.col("s") == F.col("node"), "left").select("token", "s", "n", "at", F.coalesce("root", "s").alias("root")))
    mixed = named.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).where("x <> y").select("token", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    cut = named.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))
    cut = durable(cut.select(group.alias("group"), "s", "n", "at", "root", "block", (F.col("block") == F.col("other")).cast("long").alias("same")))
    dealt = lambda df: df.repartition(partitions_for(rows.sparkSession), "group").sortWithinPartitions("group", "n", "s")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of groups with few, as (null, a, b); of the others the rows that have a candidate, as (group, s, null)."""
        for columns in _runs(batches):
            x = [np.asarray(c) for c in columns]
            of = np.cumsum(np.r_[False, x[0][1:] != x[0][:-1]])
            pairs, found = np.zeros(of[-1] + 1, np.int64), np.zeros(len(of), bool)
            for i, j in _cross_pairs(*x, similarity):
                pairs += np.bincount(of[i], minlength=len(pairs))
                found[i] = found[j] = True
            dense = (pairs > DENSE * np.bincount(of))[of]
            few_ = ~dense & (pairs > 0)[of]
            for i, j in _cross_pairs(*[c[few_] for c in x], similarity):
                yield _pair_batch(x[1][few_], i, j, None)
            mine = dense & found
            yield pa.RecordBatch.from_arrays([pa.array(x[0][mine]), pa.array(x[1][mine]), pa.nulls(int(mine.sum()), pa.int64())], names=["group", "a", "b"])

    first = durable(dealt(cut).mapInArrow(tidy(sparse), "group long, a long, b long"))
    live = first.where("group is not null").select("group", F.col("a").alias("s"))
    maps = maps.join(few(durable(live.select("s").distinct())), "s", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            x = [np.asarray(c) for c in columns[:-1]]
            s, n, maps_ = x[1], x[2], Bitmaps(columns[-1].to_pylist())
            for i, j in _cross_pairs(*x, similarity):
                ok = maps_.differ(i, j) <= most_apart(n[i] + n[j], similarity)
                yield _pair_batch(s, i[ok], j[ok])

    checked = dealt(cut.join(live, ["group", "s"]).join(maps, "s").select(*cut.columns, "bits")).mapInArrow(tidy(run), "a long, b long")
    return first.where("group is null").select("a", "b").union(checked).distinct()


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, root) for each row of docs(doc_id, text): rows of one root are joined by pairs whose shingle sets have that Jaccard similarity or more.

    Candidates are compared exactly, and come from SimHash first: pairs that the index joins within NEAR_BITS differing bits.

    No pair of that similarity is lost: the shingles of a set are ordered (frequent ones last), and two sets that similar share one among the first
    n - ceil(similarity * n) + 1 of each. What shares one is a candidate. Of what SimHash hasn't joined, each set meets one other for each
    shingle, which joins a group of many near copies at a cost in proportion to its size; then all candidates that aren't joined by that and whose bitmaps allow it.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    often = frequent_shingles(docs, shingle)
    order = np.argsort(often)
    ranked = often[order]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("id", "h", "s", "n", "fp")], T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            ids = pa.array(range(number, number + b.num_rows), pa.int64())
            number += b.num_rows
            keys, sizes, votes, prefixes, maps = [], [], [], [], []
            for t in b.column(2):
                g = shingles(t.as_py(), shingle)
                keys.append(xxhash.xxh64_intdigest(g.tobytes(), 42))
                sizes.append(len(g))
                votes.append(majority(g))
                maps.append(bitmap(g))
                where = np.minimum(np.searchsorted(ranked, g), max(len(ranked) - 1, 0))
                known = ranked[where] == g if len(ranked) else np.zeros(len(g), bool)
                late = g[known][np.argsort(order[where[known]])] if known.any() else g[:0]
                front = len(g) - int(least_overlap(len(g), similarity)) + 1 if len(g) else 0
                prefixes.append(np.concatenate([g[~known], late])[:front].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            s, fp = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in (keys, votes))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, b.column(1), s, pa.array(sizes, pa.int64()), fp, lists, pa.array(maps, pa.binary())], names=schema.names)

    each = durable(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(tidy(run), schema))
    # rows of equal sets: all but one are left out, and go with that one in the end
    sets = each.groupBy("s").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = few(durable(each.select("id", "s").join(sets, "s").where("id <> first").select("id", "first")))
    lone = each.join(copies, "id", "left_anti")
    rows = lone.select(F.col("id").alias("s"), "n", F.posexplode("prefix").alias("at", "token")).select("token", "s", "n", F.col("at").cast("long").alias("at"))
    shared = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    rows = durable(rows.join(shared, "token"))
    texts = docs.withColumn("h", F.xxhash64("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["s", "g"])

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            i = np.arange(b.num_rows)
            n = np.asarray(b.column(2)) + np.asarray(b.column(3))
            both = Bitmaps(b.column(4).to_pylist() + b.column(5).to_pylist())
            yield b.select([0, 1]).filter(pa.array(both.differ(i, i + b.num_rows) <= most_apart(n, similarity)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    maps = each.select(F.col("id").alias("s"), "n", "bits")

    def joined(pairs: DataFrame) -> DataFrame:
        """The pairs that are that similar; those whose bitmaps differ too much go before texts are read."""
        two = pairs.join(maps.toDF("a", "na", "bits_a"), "a").join(maps.toDF("b", "nb", "bits_b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
        pairs = durable(two.mapInArrow(tidy(plausible), "a long, b long"))
        needed = few(durable(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(each.select(F.col("id").alias("s"), "h"), "s")))
        full = durable(texts.join(needed, "h").select("s", "text").dropDuplicates(["s"]).mapInArrow(tidy(whole), "s long, g binary"))
        a, b = full.toDF("a", "ga"), full.toDF("b", "gb")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb").mapInArrow(tidy(compare), "a long, b long")

    hashed = durable(fingerprint_pairs(lone.select("id", "fp")))
    near = durable(joined(hashed))
    first = durable(apart(linking_pairs(rows, similarity), components(near)).join(hashed, ["a", "b"], "left_anti"))
    links_ = durable(near.union(joined(first)))
    rest = durable(remaining_pairs(rows, components(links_), maps.drop("n"), similarity).join(first.union(hashed), ["a", "b"], "left_anti"))
    roots = components(links_.union(joined(rest)))
    own = each.join(copies, "id", "left").select("doc_id", "h", F.coalesce("first", "id").alias("own"))
    return own.join(roots, F.col("own") == roots["node"], "left").select("doc_id", "h", F.coalesce("root", "own").alias("root"))


def keep_first_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates by exact Jaccard similarity of their shingle sets; rows stay as in keep_first()."""
    return _first_rows(docs, similar(docs, shingle, similarity))
