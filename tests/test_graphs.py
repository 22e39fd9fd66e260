"""Layouts and bundling against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph


@pytest.fixture(scope="module")
def small(spark):  # noqa: ANN001, ANN201
    gen = np.random.default_rng(4)
    places = gen.random((40, 2))
    pairs = sorted({(int(a), int(b)) for a, b in gen.integers(0, 40, (70, 2)) if a != b})
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id long, x double, y double").repartition(3)
    edges = spark.createDataFrame([(i, a, b, 1.0 + i % 3) for i, (a, b) in enumerate(pairs)], "edge_id long, source long, target long, weight double").repartition(3)
    return nodes, edges, places, pairs


def _forces(places, pairs, weights, iterations, linlog, nohubs):  # noqa: ANN001, ANN202
    n, p = len(places), places.copy()
    w = np.zeros((n, n))
    for (a, b), x in zip(pairs, weights):
        w[a, b] += x
        w[b, a] += x
    k, heat = math.sqrt(1 / n), 0.1
    step = heat / (iterations + 1)
    for _ in range(iterations):
        away = p[:, None] - p[None]
        dist = np.maximum(np.sqrt((away**2).sum(-1)), 0.01)
        pull = w * (np.log1p(dist) / dist if linlog else dist / k)
        if nohubs:
            pull = pull / ((w > 0).sum(1) + 1)[:, None]
        force = (away * (k * k / dist**2 - pull)[..., None]).sum(1)
        p = p + force * heat / np.maximum(np.sqrt((force**2).sum(1)), 0.01)[:, None]
        heat -= step
    return p


@pytest.mark.parametrize("linlog, nohubs", [(False, False), (True, False), (False, True)])
def test_forces(spark, small, linlog, nohubs):  # noqa: ANN001, ANN201
    nodes, edges, places, pairs = small
    want = _forces(places, pairs, [1.0 + i % 3 for i in range(len(pairs))], 3, linlog, nohubs)
    got = {r["id"]: (r["x"], r["y"]) for r in graph.forceatlas2_layout(nodes, edges, iterations=3, linlog=linlog, nohubs=nohubs, weight="weight", cells=None).collect()}
    assert np.allclose([got[i] for i in range(40)], want, atol=1e-9)
    near = {r["id"]: (r["x"], r["y"]) for r in graph.forceatlas2_layout(nodes, edges, iterations=1, linlog=linlog, nohubs=nohubs, weight="weight", cells=64).collect()}
    one = _forces(places, pairs, [1.0 + i % 3 for i in range(len(pairs))], 1, linlog, nohubs)
    # of a step of 0.1, cell totals move a node's place by little
    assert np.median(np.abs(np.array([near[i] for i in range(40)]) - one)) < 0.005


def test_exact_forces_are_bounded(spark, small, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(graph, "EXACT_NODES", 10)
    with pytest.raises(ValueError):
        graph.forceatlas2_layout(small[0], small[1], cells=None)


def test_random_places_are_even_and_steady(spark):  # noqa: ANN001, ANN201
    nodes = spark.range(4000)
    rows = {r["id"]: (r["x"], r["y"]) for r in graph.random_layout(nodes, 3).collect()}
    assert rows == {r["id"]: (r["x"], r["y"]) for r in graph.random_layout(nodes.repartition(7), 3).collect()}
    p = np.array(list(rows.values()))
    assert (p > 0).all() and (p < 1).all() and np.abs(p.mean(0) - 0.5).max() < 0.02 and abs(np.corrcoef(p.T)[0, 1]) < 0.05
    assert np.histogram2d(p[:, 0], p[:, 1], bins=4, range=[[0, 1], [0, 1]])[0].min() > 180
    assert rows != {r["id"]: (r["x"], r["y"]) for r in graph.random_layout(nodes, 4).collect()}


def test_slopes():  # noqa: ANN201
    y, x = np.mgrid[0:7, 0:9]
    gx, gy = graph._slopes(3.0 * x - 2.0 * y)
    assert (gx[:, 1:-1] == 24).all() and (gy[1:-1] == -16).all()
    gx, gy = graph._slopes(np.eye(3))
    assert gx[1, 1] == 0 and gy[1, 1] == 0 and gx[0, 0] == -2 and gx.shape == (3, 3)


def test_bundles_keep_ends_and_meet(spark):  # noqa: ANN001, ANN201
    """Two parallel edges are drawn together between their ends, which stay; edges keep their weights."""
    nodes = spark.createDataFrame([(0, 0.0, 0.45), (1, 1.0, 0.45), (2, 0.0, 0.55), (3, 1.0, 0.55), (4, 0.5, 0.0), (5, 0.5, 1.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(7, 0, 1, 2.0), (8, 2, 3, 3.0)], "edge_id long, source long, target long, weight double")
    rows = graph.hammer_bundle(nodes, edges, weight="weight", initial_bandwidth=0.2).collect()
    for e, y, w in ((7, 0.45, 2.0), (8, 0.55, 3.0)):
        own = sorted((r["k"], r["x"], r["y"], r["weight"]) for r in rows if r["edge_id"] == e and r["k"] >= 0)
        assert own[0][1:3] == (pytest.approx(0.0), pytest.approx(y)) and own[-1][1:3] == (pytest.approx(1.0), pytest.approx(y)) and {r[3] for r in own} == {w}
        assert sum(r["k"] == -1 and r["x"] is None for r in rows if r["edge_id"] == e) == 1
        assert [r[0] for r in own] == list(range(len(own)))
    middle = [np.mean([r["y"] for r in rows if r["edge_id"] == e and r["k"] >= 0 and 0.3 < r["x"] < 0.7]) for e in (7, 8)]
    assert abs(middle[1] - middle[0]) < 0.05


def test_resampling():  # noqa: ANN201
    p = np.array([[0.0, 0.0], [0.001, 0.0], [0.5, 0.0], [1.0, 0.0]])
    got = graph._resampled(p, 0.01, 0.1)
    gaps = np.hypot(*np.diff(got, axis=0).T)
    assert (got[0] == p[0]).all() and (got[-1] == p[-1]).all() and gaps.max() <= 0.1 + 1e-12 and len(got) == 11


def test_joined_drops_edges_without_ends(spark):  # noqa: ANN001, ANN201
    nodes = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(5, 0, 1), (6, 0, 9)], "edge_id long, source long, target long")
    assert [tuple(r) for r in graph.joined(nodes, edges).collect()] == [(5, 1.0, 2.0, 3.0, 4.0)]
    assert graph.connect_edges(nodes, edges).where(F.col("x").isNull()).count() == 1


def test_many_lines_resample_as_each_does():  # noqa: ANN201
    gen = np.random.default_rng(7)
    lines = [np.cumsum(gen.random((n, 2)) * gen.choice([0.002, 0.02, 0.2]), axis=0) for n in gen.integers(2, 40, 60)]
    p, sizes = graph._all_resampled(np.concatenate(lines), np.array([len(q) for q in lines]), 0.01, 0.05)
    each = [graph._resampled(q, 0.01, 0.05) for q in lines]
    assert sizes.tolist() == [len(q) for q in each] and (p == np.concatenate(each)).all()
    for q, r in zip(lines, each):
        kept = [q[0]]
        for v in q[1:-1]:
            if np.hypot(*(v - kept[-1])) >= 0.01:
                kept.append(v)
        kept.append(q[-1])
        assert set(map(tuple, kept)) <= set(map(tuple, r)) and np.hypot(*np.diff(r, axis=0).T).max() <= 0.05 + 1e-12


def test_bundling_spreads_edges_of_one_file(spark, tmp_path):  # noqa: ANN001, ANN201
    """Edges that come in one partition are moved in many."""
    nodes = spark.range(3000).selectExpr("id", "cast(id as double) as x", "cast(id % 7 as double) as y")
    edges = spark.range(3000).selectExpr("id as edge_id", "id as source", "(id * 17 + 5) % 3000 as target").coalesce(1)
    out = graph.hammer_bundle(nodes, edges, iterations=1)
    assert out.rdd.getNumPartitions() > 1 and out.where("k = -1").count() == 3000


def test_forces_hold_each_pair_once(spark, small, monkeypatch):  # noqa: ANN001, ANN201
    held = []
    monkeypatch.setattr(graph, "durable", lambda df: held.append(df) or df.localCheckpoint())
    monkeypatch.setattr(graph, "forget", lambda df: None)
    graph.forceatlas2_layout(small[0], small[1], iterations=0)
    links = next(df for df in held if "w" in df.columns)
    assert links.count() == len({frozenset(p) for p in small[3]})
