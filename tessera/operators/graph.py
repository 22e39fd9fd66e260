"""Graphs: nodes(id, x, y), edges(source, target[, weight]); layouts, direct edges and bundled ones."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.sources.dealing import dealt
from tessera.sources.durable import durable, forget
from tessera.sources.rowindex import numbered


def joined(nodes: DataFrame, edges: DataFrame, source: str = "source", target: str = "target", weight: str | None = None) -> DataFrame:
    """(edge_id, x0, y0, x1, y1[, weight]): two inner joins of edges with their ends. edges may have an edge_id."""
    if "edge_id" not in edges.columns:
        edges = numbered(edges, [source, target], "edge_id")
    ends = lambda k: nodes.select(F.col("id").alias(f"_id{k}"), F.col("x").cast("double").alias(f"x{k}"), F.col("y").cast("double").alias(f"y{k}"))
    both = edges.join(ends(0), F.col(source) == F.col("_id0")).join(ends(1), F.col(target) == F.col("_id1"))
    return both.select("edge_id", "x0", "y0", "x1", "y1", *([weight] if weight else []))


def connect_edges(nodes: DataFrame, edges: DataFrame, source: str = "source", target: str = "target", weight: str | None = None) -> DataFrame:
    """(edge_id, k, x, y[, weight]): start, end and a null separator for each edge."""
    null = F.lit(None).cast("double")
    vertices = [F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")), (null, null)))]
    out = joined(nodes, edges, source, target, weight).withColumn("_v", F.explode(F.array(*vertices)))
    return out.select("edge_id", "_v.k", "_v.x", "_v.y", *([weight] if weight else []))


def random_layout(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """nodes with x and y uniform within (0, 1), by a hash of id and seed, so any partitioning gives the same."""
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return nodes.withColumn("x", unit(0)).withColumn("y", unit(1))


def circular_layout(nodes: DataFrame, uniform: bool = True, seed: int = 0) -> DataFrame:
    """nodes on a circle of radius 0.5 around (0.5, 0.5): evenly, by id, or at random angles."""
    if uniform:
        rows = numbered(nodes, ["id"], "_i")
        turn = F.col("_i") / F.lit(float(max(nodes.count(), 1)))
    else:
        rows = nodes.withColumn("_i", F.lit(0))
        turn = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    angle = turn * F.lit(2 * math.pi)
    return rows.withColumn("x", 0.5 + 0.5 * F.cos(angle)).withColumn("y", 0.5 + 0.5 * F.sin(angle)).drop("_i")


def adjacency(edges: DataFrame, source: str = "source", target: str = "target", weight: str | None = None) -> DataFrame:
    """(a, b, w): symmetric sums of weights; a loop counts once."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), w.alias("w"))
    return one.union(one.where("a <> b").select("b", "a", "w").toDF("a", "b", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def forceatlas2_layout(nodes: DataFrame, edges: DataFrame, iterations: int = 10, linlog: bool = False, nohubs: bool = False, k: float | None = None, seed: int = 0,
                       weight: str | None = None, cells: int | None = 32) -> DataFrame:
    """Force-directed layout: linked nodes attract, all repel, steps shrink.

    Repulsion comes from cell totals of a cells x cells grid instead of every other node, so an iteration costs nodes times
    cells, not nodes squared; within a node's own cell the other nodes' mean place counts. With cells=None every other node repels on its own, for
    at most EXACT_NODES nodes, whose places all tasks then hold. Each iteration is written to the shared folder, and goes with the next.
    """
    n = max(nodes.count(), 1)
    if cells is None and n > EXACT_NODES:
        raise ValueError(f"without cells, {EXACT_NODES} nodes are the most")
    best = k if k is not None else math.sqrt(1.0 / n)
    at = nodes if {"x", "y"} <= set(nodes.columns) else random_layout(nodes, seed)
    pos = durable(at.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    links = durable(adjacency(edges, weight=weight).where("a < b"))  # each pair once
    heat = 0.1
    cooling = heat / (iterations + 1)
    for _ in range(iterations):
        pushed = _pushed(pos, best, cells)
        a, b = pos.toDF("a", "ax", "ay"), pos.toDF("b", "bx", "by")
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        dist = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(0.01))
        pull = F.log1p(dist) / dist if linlog else dist / F.lit(best)
        force = links.join(a, "a").join(b, "b").select("a", "b", (F.col("w") * pull * dx).alias("gx"), (F.col("w") * pull * dy).alias("gy"))
        # rows lie by b already, so its sums need no exchange; both sums read the same joined rows
        ends = [force.groupBy(F.col(c).alias("id")).agg(F.sum(sign * F.col("gx")).alias("gx"), F.sum(sign * F.col("gy")).alias("gy"), F.count("*").alias("deg")) for c, sign in (("a", 1.0), ("b", -1.0))]
        drawn = ends[0].union(ends[1]).groupBy("id").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.sum("deg").alias("deg"))
        both = pushed.join(drawn, "id", "left")
        hub = F.col("deg") + 1 if nohubs else F.lit(1.0)
        fx, fy = (F.col(f"f{c}") + F.coalesce(F.col(f"g{c}") / hub, F.lit(0.0)) for c in "xy")
        size = F.greatest(F.sqrt(fx * fx + fy * fy), F.lit(0.01))
        moved = durable(both.select("id", (F.col("x") + fx * heat / size).alias("x"), (F.col("y") + fy * heat / size).alias("y")))
        forget(pos)
        pos = moved
        heat -= cooling
    return nodes.drop("x", "y").join(pos, "id")


#: Most nodes whose places every task may hold: 3 MB.
EXACT_NODES = 200_000


def _pushed(pos: DataFrame, best: float, cells: int | None) -> DataFrame:
    """(id, x, y, fx, fy): each node's repulsion by the totals of a grid's cells, or by every other node."""
    ship(pos.sparkSession)
    box = pos.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if cells is None:
        every = pos.select("x", "y", F.lit(1.0), F.lit(-1)).toPandas().to_numpy(float)
        box = None
    else:
        at = [F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(max(hi - lo, 1e-9)) * cells), F.lit(cells - 1)) for c, lo, hi in (("x", box[0], box[1]), ("y", box[2], box[3]))]
        totals = pos.groupBy((at[1] * cells + at[0]).cast("int").alias("cell")).agg(F.sum("x"), F.sum("y"), F.count("*"))
        every = totals.toPandas().to_numpy(float)[:, [1, 2, 3, 0]]  # cells^2 rows at most
    held = pos.sparkSession.sparkContext.broadcast(every)

    def run(batches):  # noqa: ANN001, ANN202
        sx, sy, n, cell = held.value.T
        step = max(1, 1_000_000 // max(len(n), 1))
        for pdf in batches:
            force = np.empty((len(pdf), 2))
            for at in range(0, len(pdf), step):
                x, y = (pdf[c].to_numpy()[at : at + step, None] for c in "xy")
                if box is None:
                    m, dx, dy = n, x - sx, y - sy
                else:
                    i, j = (np.minimum(np.floor((v - lo) / max(hi - lo, 1e-9) * cells), cells - 1) for v, lo, hi in ((x, box[0], box[1]), (y, box[2], box[3])))
                    own = j * cells + i == cell
                    m = n - own
                    dx, dy = (v - (total - own * v) / np.maximum(m, 1) for v, total in ((x, sx), (y, sy)))
                f = m * best * best / np.maximum(dx * dx + dy * dy, 1e-4)
                force[at : at + step] = np.stack([(f * dx).sum(1), (f * dy).sum(1)], 1)
            yield pdf.assign(fx=force[:, 0], fy=force[:, 1])

    return pos.mapInPandas(run, ", ".join([*(f"{n} {t}" for n, t in pos.dtypes), "fx double", "fy double"]))


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-6)) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        image = np.apply_along_axis(np.convolve, axis, np.pad(image, pad, mode="edge"), kernel, "valid")
    return image


def _slopes(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel slopes along x and y; edge pixels are repeated outwards."""
    p = np.pad(image, 1, mode="edge")
    x, y = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return x[:-2] + 2 * x[1:-1] + x[2:], y[:, :-2] + 2 * y[:, 1:-1] + y[:, 2:]


def _resampled(p: np.ndarray, shortest: float, longest: float) -> np.ndarray:
    """Points too near the last kept one go, gaps that are too long are halved; the ends stay."""
    return _all_resampled(p, np.array([len(p)]), shortest, longest)[0]


def _all_resampled(p: np.ndarray, sizes: np.ndarray, shortest: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many lines laid end to end, point by point of all lines at once; with how many points each then has."""
    starts = np.cumsum(sizes) - sizes
    gaps = np.hypot(*np.diff(p, axis=0, append=p[-1:]).T)
    counted = np.ones(len(p), bool)  # gaps between a line's points, but for its last
    counted[starts + sizes - 1] = counted[starts + sizes - 2] = False
    near = np.logical_or.reduceat(counted & (gaps < shortest), starts)
    if near.any():
        keep = np.ones(len(p), bool)
        order = np.argsort(-sizes[near], kind="stable")
        first, n = starts[near][order], sizes[near][order]
        last = p[first]
        for k in range(1, n[0] - 1):
            m = np.searchsorted(-n, -(k + 1))  # lines for which point k isn't an end
            here = p[first[:m] + k]
            far = np.hypot(*(here - last[:m]).T) >= shortest
            keep[first[:m] + k] = far
            last[:m][far] = here[far]
        sizes = np.add.reduceat(keep.astype(np.int64), starts)
        p = p[keep]
        starts = np.cumsum(sizes) - sizes
        gaps = np.hypot(*np.diff(p, axis=0, append=p[-1:]).T)
    n = np.maximum(1, np.ceil(gaps / longest)).astype(np.int64)
    n[starts + sizes - 1] = 1
    if (n == 1).all():
        return p, sizes
    step = np.diff(p, axis=0, append=p[-1:])
    step[starts + sizes - 1] = 0
    part = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) / np.repeat(n, n)
    return np.repeat(p, n, axis=0) + np.repeat(step, n, axis=0) * part[:, None], np.add.reduceat(n, starts)


#: Edges of a task at most, of which each has some 20 to 180 points.
EDGES = 50_000
#: Points that move together: what a step touches stays in the processor's caches.
MOVED = 8192


def _advected(p: np.ndarray, sizes: np.ndarray, table: np.ndarray, steps: int, accuracy: int) -> np.ndarray:
    """Inner points moved `steps` times by the table's entry at their pixel (complex, flat, its edges repeated steps + 2 pixels outwards)."""
    inner, pad = _inner(sizes), steps + 2
    width = accuracy + 2 * pad
    moving = p[inner]
    at, cell = np.empty((MOVED, 2)), np.empty((MOVED, 2), np.int64)
    index, push = np.empty(MOVED, np.int64), np.empty(MOVED, complex)
    for begin in range(0, len(moving), MOVED):
        q = moving[begin : begin + MOVED]
        n = len(q)
        a, c, i, s, z = at[:n], cell[:n], index[:n], push[:n], q.view(complex)[:, 0]
        for _ in range(steps):
            np.multiply(q, accuracy, out=a)
            np.copyto(c, a, casting="unsafe")
            np.multiply(c[:, 1], width, out=i)
            i += c[:, 0]
            i += pad * width + pad
            np.take(table, i, out=s, mode="clip")
            z += s
    p = p.copy()
    p[inner] = moving
    return np.clip(p, 0, 1)


def _smoothed(p: np.ndarray, sizes: np.ndarray, tension: float) -> np.ndarray:
    ends = np.cumsum(sizes)
    ends = np.concatenate([ends - 1, ends - sizes])
    for _ in range(10):
        q = p.copy()
        q[1:-1] = (1 - tension) * p[1:-1] + tension * 0.5 * (p[:-2] + p[2:])
        q[ends] = p[ends]
        p = q
    return p


def _inner(sizes: np.ndarray) -> np.ndarray:
    """Where, of lines laid end to end, the points that aren't ends are."""
    inner = np.ones(sizes.sum(), bool)
    ends = np.cumsum(sizes)
    inner[ends - 1] = inner[ends - sizes] = False
    return np.flatnonzero(inner)


def hammer_bundle(nodes: DataFrame, edges: DataFrame, initial_bandwidth: float = 0.05, decay: float = 0.7, iterations: int = 4, tension: float = 0.3, accuracy: int = 500,
                  advect_iterations: int = 50, min_segment_length: float = 0.008, max_segment_length: float = 0.016, weight: str | None = None) -> DataFrame:
    """(edge_id, k, x, y[, weight]): edges drawn together along the density of all edges, a null separator at k = -1.

    Per round: resample edges, add up their density on an accuracy x accuracy grid (in workers, one grid a task), blur it and take its
    slope on the driver (the grid's size is fixed), then move the edges' points in workers, an Arrow batch of edges at a time. Edges
    come as their two ends; points are first written once they were moved.
    """
    spark = edges.sparkSession
    ship(spark)
    flat = joined(nodes, edges, weight=weight)
    wt = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = durable(dealt(flat.select(F.col("edge_id").cast("long"), wt.alias("w"), "x0", "y0", "x1", "y1"), EDGES))
    box = flat.agg(F.least(F.min("x0"), F.min("x1")), F.greatest(F.max("x0"), F.max("x1")), F.least(F.min("y0"), F.min("y1")), F.greatest(F.max("y0"), F.max("y1"))).first()
    x0, y0 = box[0] or 0.0, box[2] or 0.0
    size = max((box[1] or 1.0) - x0, (box[3] or 1.0) - y0) or 1.0
    schema = "edge_id long, w double, xs array<double>, ys array<double>"

    def points_of(slopes):  # noqa: ANN001, ANN202
        """From Arrow batches of ends or of points to (edge_id, w, points end to end, how many each line has), moved by each of the slopes."""
        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                if not b.num_rows:
                    continue
                at = {n: b.column(k) for k, n in enumerate(b.schema.names)}
                if "xs" in at:
                    xs, ys = at["xs"], at["ys"]
                    p, sizes = np.c_[xs.flatten().to_numpy(), ys.flatten().to_numpy()], np.diff(xs.offsets.to_numpy())
                else:
                    ends = [(at[n].to_numpy(zero_copy_only=False) - o) / size for n, o in (("x0", x0), ("y0", y0), ("x1", x0), ("y1", y0))]
                    p, sizes = _all_resampled(np.stack(ends, 1).reshape(-1, 2), np.full(b.num_rows, 2), min_segment_length, max_segment_length)
                for s in slopes:
                    p, sizes = _all_resampled(_advected(p, sizes, s.value, advect_iterations, accuracy), sizes, min_segment_length, max_segment_length)
                yield at["edge_id"], at["w"], p, sizes

        return run

    def density(lines: DataFrame, slopes) -> np.ndarray:  # noqa: ANN001
        moved = points_of(slopes)

        def run(batches):  # noqa: ANN001, ANN202
            total = np.zeros(accuracy * accuracy)
            for _, w, p, sizes in moved(batches):
                i, j = np.clip(np.floor(p * accuracy), 0, accuracy - 1).astype(np.int64).T
                total += np.bincount(j * accuracy + i, np.repeat(w.fill_null(0.0).to_numpy(), sizes), accuracy * accuracy)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "d"])

        image = np.zeros(accuracy * accuracy)
        cells = lines.mapInArrow(run, "cell int, d double").groupBy("cell").agg(F.sum("d").alias("d")).toPandas()
        image[cells["cell"]] = cells["d"]
        return image.reshape(accuracy, accuracy)

    def stored(lines: DataFrame, slopes) -> DataFrame:  # noqa: ANN001
        moved = points_of(slopes)

        def run(batches):  # noqa: ANN001, ANN202
            for e, w, p, sizes in moved(batches):
                cut = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([e, w, *[pa.ListArray.from_arrays(cut, pa.array(np.ascontiguousarray(p[:, c]))) for c in (0, 1)]], ["edge_id", "w", "xs", "ys"])

        return durable(lines.mapInArrow(run, schema))

    lines, slopes = flat, []
    bandwidth = initial_bandwidth
    for _ in range(iterations):
        pixels = bandwidth * accuracy / 2
        if pixels < 0.5:
            break
        if slopes:
            moved = stored(lines, slopes)
            forget(lines)
            lines, slopes = moved, []
        gx, gy = _slopes(_blur(density(lines, slopes), pixels))
        norm = np.hypot(gx, gy)
        norm[norm == 0] = 1.0
        table = np.pad(gx / norm / accuracy + 1j * (gy / norm / accuracy), advect_iterations + 2, mode="edge")
        slopes.append(spark.sparkContext.broadcast(table.ravel()))
        bandwidth *= decay

    moved = points_of(slopes)

    def drawn(batches):  # noqa: ANN001, ANN202
        for e, w, p, sizes in moved(batches):
            p = _smoothed(p, sizes, tension)
            ends = np.cumsum(sizes)
            line = np.repeat(np.arange(len(sizes)), sizes + 1)
            k = np.arange(len(line)) - np.repeat(ends - sizes + np.arange(len(sizes)), sizes + 1)
            gap = np.zeros(len(line), bool)
            gap[ends + np.arange(len(sizes))] = True
            k[gap] = -1
            columns = []
            for c, o in ((0, x0), (1, y0)):
                v = np.zeros(len(line))
                v[~gap] = p[:, c] * size + o
                columns.append(pa.array(v, mask=gap))
            at = pa.array(line)
            yield pa.RecordBatch.from_arrays([e.take(at), w.take(at), pa.array(k.astype(np.int32)), *columns], ["edge_id", "w", "k", "x", "y"])

    out = lines.mapInArrow(drawn, "edge_id long, w double, k int, x double, y double")
    return out.withColumnRenamed("w", weight) if weight else out.drop("w")
