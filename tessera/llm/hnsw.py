"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt to shards by a hash of their id, as many as SHARD_BYTES hold: each query goes to every shard, so shards are as large as a
task's memory allows (some 90,000 vectors of 64 floats), and work grows in proportion to queries and their number. Equal vectors of a shard are one node.
A shard's graph is built by insertion in batches: random levels, nodes in descending order of level (so that each layer is a prefix of the nodes),
candidates from a beam search of the graph so far and from the batch itself, diversified links, and back-links that
are diversified again where a node has too many. A layer is one flat int32 array of neighbours, -1 where
there is none. Inner products are searched as angles: each vector gets one more component that makes all norms equal
within its shard. A shard's graph is held once and query blocks stream past it; each answers
with its best k per query, re-scored in double precision on the original vectors (doubles stay doubles), and a window merges k rows a shard.

Defined cases: null ids and vectors that are null, empty, zero, of another length than the most common one, or hold a
null or non-finite component take no part; ties go to the smaller id; rows that repeat an id are candidates of
their own but one query; fewer candidates than k give them all; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.llm.common import durable, partitions_for, tidy

#: Bytes of a shard's vectors and links.
SHARD_BYTES = 64 << 20
#: Links a node on upper layers (twice as many on the lowest), beam widths, nodes expanded at once, batch.
LINKS, BUILD_BEAM, SEARCH_BEAM, WIDTH, BATCH = 24, 96, 384, 4, 256


class Graph:
    """Layers of flat neighbour arrays over vectors whose first rows have the highest levels."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray]):
        """ids: those of the first node, by size, then those of the second, ...; counts: how many each has."""
        self.ids, self.counts, self.vectors, self.layers = ids, counts, vectors, layers
        self.starts = np.cumsum(counts) - counts
        scale = np.abs(vectors).max(initial=0.0) or 1.0
        even = (vectors / scale).astype(np.float32)
        norms = np.einsum("ij,ij->i", even, even, dtype=np.float64)
        lift = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.raised = np.concatenate([even, lift[:, None].astype(np.float32)], axis=1)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, most: int, seed: int = 7) -> Graph:
        """The graph of the distinct vectors, each with the `most` smallest of its ids."""
        _, first, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        n = len(first)
        gen = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - gen.random(n)) / math.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        level, place = level[order], np.empty(n, np.int64)
        place[order] = np.arange(n)
        of = place[of.ravel()]
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        layers = [np.full((m, LINKS * (1 if k else 2)), -1, np.int32) for k, m in enumerate(sizes)]
        by_node = np.lexsort((ids, of))
        counts = np.bincount(of, minlength=n)
        kept = by_node[np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts) < most]
        graph = cls(ids[kept], np.minimum(counts, most), vectors[first[order]], layers)
        at = 1
        while at < n:
            end = min([n, at + min(BATCH, max(16, at)), *(m for m in sizes if m > at)])
            graph._insert(at, end)
            at = end
        return graph

    def _insert(self, at: int, end: int) -> None:
        q = self.raised[at:end]
        starts = np.zeros((end - at, 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            links = self.layers[k]
            if len(links) < end:
                starts, _ = self._beam(q, starts, k, 4, at)
                continue
            found, near = self._beam(q, starts, k, BUILD_BEAM, at)
            starts = found[:, :4]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            top = min(16, end - at - 1)
            if top:
                pick = np.argpartition(-own, top - 1, axis=1)[:, :top]
                found = np.concatenate([found, pick + at], axis=1)
                near = np.concatenate([near, np.take_along_axis(own, pick, 1).astype(np.float32)], axis=1)
            chosen = self._diverse(found, near, LINKS)
            links[at:end, : chosen.shape[1]] = chosen
            row, col = np.nonzero(chosen >= 0)
            self._link_back(links, chosen[row, col], row + at)

    def _diverse(self, found: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's candidates, nearest first, none nearer to a chosen one than to the row; then the nearest left."""
        order = np.argsort(-near, axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        valid = np.isfinite(near) & (found >= 0)
        v = self.raised[np.where(valid, found, 0)]
        between = v @ v.transpose(0, 2, 1)
        good = np.zeros(found.shape, bool)
        for c in range(found.shape[1]):
            worse = (good[:, :c] & (between[:, c, :c] > near[:, c : c + 1])).any(axis=1)
            good[:, c] = valid[:, c] & ~worse & (good[:, :c].sum(axis=1) < most)
        rank = np.where(good, 0, np.where(valid, 1, 2))
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(valid, keep, 1), np.take_along_axis(found, keep, 1), -1).astype(np.int32)

    def _link_back(self, links: np.ndarray, to: np.ndarray, source: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        width = links.shape[1]
        for lo in range(0, len(nodes), BATCH):
            some, f, c = nodes[lo : lo + BATCH], first[lo : lo + BATCH], count[lo : lo + BATCH]
            new = np.full((len(some), int(c.max())), -1, np.int64)
            mask = np.arange(new.shape[1]) < c[:, None]
            new[mask] = source[np.repeat(f, c) + np.concatenate([np.arange(x) for x in c])]
            every = np.concatenate([links[some], new], axis=1)
            every[:, width:][(every[:, None, :width] == every[:, width:, None]).any(axis=2)] = -1
            near = np.einsum("bmd,bd->bm", self.raised[np.maximum(every, 0)], self.raised[some])
            near = np.where(every >= 0, near, -np.inf)
            full = (every >= 0).sum(axis=1) > width
            packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :width]
            if full.any():
                packed[full] = self._diverse(every[full], near[full], width)
            links[some] = packed

    def _beam(self, q: np.ndarray, starts: np.ndarray, k: int, width: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nodes (and products) that a beam search of layer k ends with, best first; -1 and -inf where there are fewer."""
        links, b = self.layers[k], len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(links) + 1), bool)
        starts = np.where((starts < len(links)) & (starts >= 0), starts, len(links))
        ids = np.full((b, width), -1, np.int64)
        near = np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        s = starts[:, :width]
        seen[rows, s] = True
        ids[:, : s.shape[1]] = np.where(s < len(links), s, -1)
        near[:, : s.shape[1]] = np.where(s < len(links), np.einsum("bmd,bd->bm", self.raised[np.minimum(s, len(links) - 1)], q), -np.inf)
        done[:, : s.shape[1]] = s >= len(links)
        seen[:, len(links)] = True
        live = np.arange(b)
        while len(live):
            open_ = np.where(done[live], -np.inf, near[live])
            take = np.argsort(-open_, axis=1, kind="stable")[:, : min(WIDTH, width)]
            real = np.isfinite(np.take_along_axis(open_, take, 1))
            some = real.any(axis=1)
            live, take, real = live[some], take[some], real[some]
            if not len(live):
                break
            r = live[:, None]
            done[r, take] |= real
            nb = links[np.where(real, ids[r, take], 0)].astype(np.int64)
            nb = np.where(real[:, :, None], nb, -1).reshape(len(live), -1)
            nb = np.where(nb < 0, len(links), nb)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = len(links)
            nb[seen[r, nb]] = len(links)
            seen[r, nb] = True
            nb.sort(axis=1)
            most = int((nb < len(links)).sum(axis=1).max(initial=0))
            if not most:
                continue
            nb = nb[:, :most]
            sim = np.einsum("bmd,bd->bm", self.raised[np.minimum(nb, len(links) - 1)], q[live])
            sim[nb == len(links)] = -np.inf
            all_near = np.concatenate([near[live], sim], axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            near[live] = np.take_along_axis(all_near, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(nb == len(links), -1, nb)], axis=1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], nb == len(links)], axis=1), best, 1)
        return ids, near

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the best k of each query, its own id left out."""
        beam = max(beam, k + 1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(query_ids), BATCH):
            qid, q = query_ids[lo : lo + BATCH], queries[lo : lo + BATCH]
            even = (q / np.maximum(np.abs(q).max(axis=1, keepdims=True), np.finfo(q.dtype).tiny)).astype(np.float32)
            raised = np.concatenate([even, np.zeros((len(q), 1), np.float32)], axis=1)
            found = np.zeros((len(qid), 1), np.int64)
            for layer in range(len(self.layers) - 1, -1, -1):
                found, _ = self._beam(raised, found, layer, beam if layer == 0 else 8)
            node = np.maximum(found, 0)
            score = np.einsum("bmd,bd->bm", self.vectors[node].astype(np.float64), q.astype(np.float64))
            score[found < 0] = -np.inf
            # a node has an id that isn't the query's, or is the query itself: k + 1 of them hold the best k
            best = np.lexsort((self.ids[self.starts[node]], -score), axis=1)[:, : k + 1]
            node, score = np.take_along_axis(node, best, 1), np.take_along_axis(score, best, 1)
            n = np.where(np.isfinite(score), self.counts[node], 0).ravel()
            row = np.repeat(np.repeat(np.arange(len(qid)), node.shape[1]), n)
            own = self.ids[np.repeat(self.starts[node].ravel(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            score = np.repeat(score.ravel(), n)
            other = own != qid[row]
            row, own, score = row[other], own[other], score[other]
            order = np.lexsort((own, -score, row))
            row, own, score = row[order], own[order], score[order]
            per = np.bincount(row, minlength=len(qid))
            top = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) < k
            out.append((qid[row[top]], own[top], score[top]))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else empty  # type: ignore[return-value]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, v, dims) of the rows that take part; v has floats, or doubles where the column has anything else."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector).cast(f"array<{'float' if kind == 'float' else 'double'}>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dims"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where("dims > 0").where(~bad & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", shard_rows: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query (a condition on vec_id) holds for."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, vector)
    item = 4 if rows.schema["v"].dataType.elementType.simpleString() == "float" else 8
    kind = np.float32 if item == 4 else np.float64
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims, total = (common["dims"], common["count"]) if common else (1, 0)
    rows = rows.where(F.col("dims") == dims)
    shard_rows = shard_rows or max(1, SHARD_BYTES // ((item + 4) * dims + 4 * 2 * LINKS + 16))
    shards = max(1, math.ceil(total / shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    parts = min(shards, max(partitions_for(spark), 1) * 8)
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "vec_id")
    fields = "shard int, kind int, ids binary, counts binary, vectors binary, sizes array<int>, links binary"

    def row(shard: int, of: int, ids: np.ndarray, counts: np.ndarray, vecs: np.ndarray, layers: list[np.ndarray]) -> pa.RecordBatch:
        links = b"".join(x.tobytes() for x in layers)
        columns = [pa.array([shard], pa.int32()), pa.array([of], pa.int32()), *(pa.array([x.tobytes()]) for x in (ids, counts.astype(np.int32), vecs))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([[len(x) for x in layers]], pa.list_(pa.int32())), pa.array([links])], names=[f.split()[0] for f in fields.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard = None

        def graph() -> pa.RecordBatch:
            ids, vecs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            g = Graph.build(ids, vecs, k + 1)
            return row(shard, 0, g.ids, g.counts, g.vectors, g.layers)

        for b in batches:
            of = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if shard is not None and of[lo] != shard:
                    yield graph()
                shard = int(of[lo])
                part = b.slice(lo, hi - lo)
                held.append((np.array(part.column(1)), np.array(_matrix(part.column(2), dims))))
        if held:
            yield graph()

    graphs = durable(dealt.mapInArrow(tidy(build), fields))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4 * BATCH):
                part = b.slice(lo, 4 * BATCH)
                yield row(-1, 1, np.array(part.column(0)), np.empty(0), _matrix(part.column(1), dims), [])

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = queries.mapInArrow(tidy(block), fields).drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = graphs.unionByName(blocks).repartition(parts, "shard").sortWithinPartitions("shard", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, shard = None, None
        for b in batches:
            for i in range(b.num_rows):
                of, what, ids, counts, vecs = (b.column(c)[i].as_py() for c in range(5))
                ids, vecs = np.frombuffer(ids, np.int64), np.frombuffer(vecs, kind).reshape(-1, dims)
                if what == 0:
                    sizes, flat = b.column(5)[i].as_py(), np.frombuffer(b.column(6)[i].as_py(), np.int32)
                    widths = [LINKS * (1 if n else 2) for n in range(len(sizes))]
                    ends = np.cumsum([0, *(s * w for s, w in zip(sizes, widths))])
                    layers = [flat[ends[n] : ends[n + 1]].reshape(s, -1) for n, s in enumerate(sizes)]
                    graph, shard = Graph(ids, np.frombuffer(counts, np.int32).astype(np.int64), vecs, layers), of
                elif graph is not None and shard == of:
                    q, v, s = graph.search(ids, vecs, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(tidy(answer), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
