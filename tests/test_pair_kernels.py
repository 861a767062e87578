"""Kernels of two blocks: single precision only leaves pairs out, and pairs are worked on in strips."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbifold.functions.geometry import space
from orbifold.operators import pairs
from orbifold.operators.pairs import Block, Nearest
from orbifold.operators.similarity import repelled


def on(k, n, seed=2):
    s = np.random.default_rng(seed).normal(size=(n, 2))
    x = np.column_stack([np.sqrt(1 + (s**2).sum(1)), s])
    return s if k == 0 else x if k < 0 else x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_closer_than_single_precision_tells():
    """Distances that differ in the tenth digit, equal ones, and numbers too large for single precision."""
    rng, at = np.random.default_rng(4), space(0.0)
    x = np.zeros((300, 20))
    x[:, 0], x[:150, 1] = 1 + 1e-10 * rng.permutation(300), 1e-3
    x[100:120] = x[50]
    assert at.rough_products(x, x)[0].dtype == np.float32 and at.rough_products(x * 1e15, x)[0].dtype == np.float64
    for own in (x, x * 1e15, rng.normal(size=(300, 20))):
        d = at.distances(own, own) + np.diag(np.full(300, np.inf))
        near = Nearest(np.arange(300), own, 7, at)
        for s in range(0, 300, 37):
            near.take(np.arange(s, min(300, s + 37)), own[s : s + 37])
        want = np.array([np.lexsort((np.arange(300), row))[:7] for row in d])
        assert (near.j == want).all() and (near.d == np.take_along_axis(d, want, axis=1)).all()


def test_blocks_are_sent_as_bytes(make_points):
    p = make_points(on(0.0, 50))
    plan = pairs.mean_distance(p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # packed once for each block, not for each group that it is sent to


@pytest.mark.parametrize("k", [0.0, 1.0, -1.0, -0.25, 4.0])
def test_repulsion_in_strips(k):
    at, x = space(k), on(k, 2048)
    x = x * (at.r if k else 1)
    a, b = Block(np.arange(1024), x[:1024], None, {}, number=0), Block(np.arange(1024, 2048), x[1024:], None, {}, number=1)
    tracemalloc.start()
    z, away = repelled(a, b, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1024 * 1024 * 8  # less than one matrix of all pairs
    d = at.distances(a.x, b.x)
    assert np.allclose(at.fast_distances(a.x, b.x), d, rtol=1e-8, atol=0)
    kernel = 1 / (1 + d * d)
    one, two = at.pull(a.x, b.x, d, 4 * d * kernel**2), at.pull(b.x, a.x, d.T, 4 * (d * kernel**2).T)
    assert np.allclose(z, np.concatenate([kernel.sum(axis=1), kernel.sum(axis=0)]), rtol=1e-9) and np.allclose(away, np.concatenate([one, two]), rtol=1e-8, atol=1e-8)
    step = 1e-5  # the gradient by differences, along the first coordinates of a point
    w = np.random.default_rng(0).normal(size=d.shape[1])
    for c in range(x.shape[1]):
        e = np.zeros(x.shape[1])
        e[c] = step
        told = ((at.distances(x[:1] + e, b.x) - at.distances(x[:1] - e, b.x))[0] * w).sum() / (2 * step)
        assert np.isclose(at.pull(x[:1], b.x, d[:1], w[None])[0, c], told, rtol=1e-4, atol=1e-4)
    both = repelled(a, a, at)
    assert len(both[0]) == 1024 and np.allclose(both[0], (1 / (1 + at.distances(a.x, a.x) ** 2)).sum(axis=1) - 1, rtol=1e-6, atol=2e-6)


@pytest.mark.parametrize("counted", [0, 12])
def test_ranks_that_single_precision_does_not_tell(make_points, monkeypatch, counted):
    """Points whose distances differ in the tenth digit or not at all, counted and sorted."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "COUNTED", counted)
    rng, at = np.random.default_rng(4), space(0.0)
    x = np.zeros((60, 20))
    x[:, 0] = 1 + 1e-10 * rng.permutation(60)
    x[20:25], x[40:] = x[50], rng.normal(size=(20, 20))
    d = at.distances(x, x) + np.diag(np.full(60, np.inf))
    order = [np.lexsort((np.arange(60), row)).tolist() for row in d]
    p = make_points(x)
    asked = p.crossJoin(p.select(F.explode(F.array(F.lit(1), F.lit(22), F.lit(31), F.lit(55))).alias("j")).distinct()).select(F.col("id").alias("i"), F.col("j").cast("long")).where("i <> j AND (i + j) % 5 > 0")
    told = {(r.i, r.j): r["rank"] for r in pairs.ranks(p, asked).collect()}
    far = lambda i, j: np.abs(np.delete(d[i], j) - d[i, j]).min() > 1e-13 * d[i, j] or (d[i] == d[i, j]).sum() > 1
    assert len(told) > 150 and all(order[i].index(j) + 1 == rank for (i, j), rank in told.items() if far(i, j))
    d = np.round(rng.random((5, 40)), 1).astype(np.float32)
    starts, low, high = np.array([0, 2, 2, 5, 6, 7]), np.linspace(0.2, 0.8, 7, dtype=np.float32), np.linspace(0.3, 0.9, 7, dtype=np.float32)
    rows = np.repeat(np.arange(5), np.diff(starts))
    for found, bound in zip(pairs._below(d, starts, low, high), (low, high), strict=True):
        assert found.tolist() == [(d[r] < v).sum() for r, v in zip(rows, bound, strict=True)]


def test_neighbours_are_looked_for_once(make_points, monkeypatch):
    """Neighbours, affinities and the targets of ranks are read from where they are stored, and are not made again."""
    from orbifold.operators import affinities, metrics, similarity

    p = make_points(on(0.0, 40), np.arange(40) % 3)
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    near = pairs.knn(p, 4)
    assert steps(pairs.mutual_knn(p, 4)) == steps(near)
    want = {(r.i, r.j) for r in near.collect()}
    assert {tuple(r) for r in pairs.mutual_knn(p, 4).collect()} == {(i, j) for i, j in want if i < j and (j, i) in want}
    v = affinities.affinities(p, 5.0)
    assert steps(v) == 0 and steps(pairs.ranks(p, near)) == steps(pairs.mean_distance(p)) + 1  # both sides are packed
    made = v.mapInArrow(lambda batches: batches, "i long, j long, v double")
    assert steps(similarity.kl_loss(p, made)) == steps(similarity.partition_sum(p)) + 1
    assert steps(metrics.davies_bouldin(p)) == 0
