"""The map of all points: its graph against brute force, and neighbours kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import storage
from lectern.operators import landscape


def unit(n, dim=12, blobs=5, seed=3):
    r = np.random.default_rng(seed)
    v = r.normal(size=(blobs, dim))[np.arange(n) % blobs] + 0.6 * r.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def trust(x, y, k=8):
    """Trustworthiness: how little the map's neighbours are strangers."""
    n = len(x)
    d, e = landscape._squares(x), landscape._squares(y)
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.argsort(np.argsort(d, 1), 1) + 1
    near = np.argsort(e, 1)[:, :k]
    return 1 - 2 * np.clip(np.take_along_axis(rank, near, 1) - k, 0, None).sum() / (n * k * (2 * n - 3 * k - 1))


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")


@pytest.mark.parametrize("cell", [2048, 20])
def test_graph_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(landscape, "CELL", cell)
    v = np.concatenate([unit(90), unit(5)[:1].repeat(4, axis=0)])  # with equal vectors
    points = frame(spark, v)
    anchors = storage.stored(points.where("id < 4"), "anchors")
    got = {}
    for r in landscape.neighbour_graph(points, anchors, 6).collect():
        got.setdefault(r.id, set()).add(r.other)
    s = v @ v.T
    want = {i: {j for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))[:6]} for i in range(len(v))}
    kth = {i: min(s[i, j] for j in want[i]) for i in want}
    assert all(len(got[i]) == 6 and all(s[i, j] >= kth[i] - 1e-12 for j in got[i]) for i in want)
    p = landscape.graph_affinities(landscape.neighbour_graph(points, anchors, 6), 3.0)
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-9
    both = {(r.id, r.other): r.p for r in p.collect()}
    assert all(abs(both[j, i] - x) < 1e-12 for (i, j), x in both.items())


def test_refined_points_keep_their_neighbours(spark):
    v = unit(120, blobs=8)
    points = frame(spark, v)
    coords = storage.stored(landscape.fit(points, 30), "fit")
    after = landscape.refined(coords, points, steps=12, perplexity=10.0)
    xy = lambda df: np.array([[r.x, r.y] for r in df.orderBy("id").collect()])
    placed, moved, exact = trust(v, xy(coords)), trust(v, xy(after)), trust(v, landscape.embed2(v, 10.0, 250))
    assert moved > placed and moved > exact - 0.05
    assert {r.placed for r in after.collect()} == {"fit", "incremental"} and after.count() == 120


def test_a_step_holds_few_tables_of_all_pairs():
    import tracemalloc

    x = np.random.default_rng(3).normal(size=(600, 8))
    p = landscape.affinities(x, 10.0)
    tracemalloc.start()
    with pytest.MonkeyPatch.context() as own:
        own.setattr(landscape, "affinities", lambda *_: p)
        landscape.embed2(x, 10.0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * p.nbytes


def test_all_points_are_fitted_beyond_what_the_driver_takes(spark, monkeypatch):
    """Every point stands where the method on all pairs puts it; the blocks
    are of unequal sizes, with copies, and steps of both kinds."""
    v = np.concatenate([unit(66), unit(66)[:4]])
    for name, value in {"FIT_POINTS": 40, "PERPLEXITY": 8.0, "STEPS": 8, "EXAGGERATED_STEPS": 4}.items():
        monkeypatch.setattr(landscape, name, value)
    monkeypatch.setattr(landscape.allpairs, "LEAST", 32)
    want = landscape.embed2(v, 8.0, 8)
    got = landscape.fit(frame(spark, v).repartition(5)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(70)) and {r.placed for r in got} == {"fit"}
    assert np.allclose([[r.x, r.y] for r in got], want, rtol=0, atol=1e-6 * np.abs(want).max())


def test_tiles_of_vectors_keep_whole_rows(spark):
    odd = frame(spark, unit(20)).union(spark.createDataFrame([(20, [1.0])], "id long, vector array<double>"))
    with pytest.raises(Exception, match="no vector of 12 numbers"):
        landscape.allpairs.blocks(odd, 8)
