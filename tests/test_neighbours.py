"""Streamed neighbours, metrics of given distances, exact quantiles and losses against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbifold.functions.geometry import space
from orbifold.operators import metrics, pair_metrics, pairs, quantiles

from .test_core import brute_trust, matrix, on


def spread(k, groups=12, each=40, seed=3):
    """Points in groups that lie well apart, in the space of curvature ``k``."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 3)) * (4 if k <= 0 else 1)
    s = np.repeat(centres, each, axis=0) + 0.02 * rng.normal(size=(groups * each, 3))
    if k == 0:
        return s
    r2 = 1 / abs(k)
    if k < 0:
        return np.column_stack([np.sqrt(r2 + (s**2).sum(1)), s])
    return s / np.linalg.norm(s, axis=1, keepdims=True) * math.sqrt(r2)


@pytest.mark.parametrize("k", [0.0, 1.0, 0.5, -1.0, -2.0])
def test_streamed_neighbours_are_brute_force_and_skip_blocks(make_points, monkeypatch, k):
    monkeypatch.setattr(pairs, "BLOCK", 30)
    x = spread(k)
    p, at = make_points(x), space(k)
    d = at.distances(x, x)
    np.fill_diagonal(d, np.inf)
    blocks, pivots = pairs._dealt(p, at)
    asked = pairs.block_partners(blocks, pivots, 5, at).collect()
    total = int(pivots.first[-1])
    assert total > 16 and len(asked) < 0.6 * total**2  # far blocks are not even sent
    for r in asked:  # no bound is too great
        a, b = (np.array([q.id for q in row.p]) for row in (next(x for x in blocks.where(F.col("block") == c).collect()) for c in (r.a, r.b))) if r.a % 9 == 0 and r.b % 7 == 0 else ([], [])
        if len(a) and r.a != r.b:
            assert r.bound <= d[np.ix_(a, b)].min() + 1e-9
    near = {(r.i, r.rank): (r.j, r.d) for r in pairs.knn(p, 5, k).collect()}
    assert len(near) == 5 * len(x)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:5]
        assert [near[i, n + 1][0] for n in range(5)] == order.tolist() and np.allclose([near[i, n + 1][1] for n in range(5)], d[i][order])


def test_neighbours_in_parts_and_few(make_points, monkeypatch):
    x = on(0.0, 60)
    whole = {tuple(r) for r in pairs.knn(make_points(x), 4).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 5)
    monkeypatch.setattr(pairs, "PARTNERS", 3)
    assert {tuple(r) for r in pairs.knn(make_points(x), 4).collect()} == whole
    assert {(r.i, r.j) for r in pairs.knn(make_points(x[:3]), 9).collect()} == {(i, j) for i in range(3) for j in range(3) if i != j}
    assert pairs.knn(make_points(x[:1]), 3).count() == 0 and pairs.knn(make_points(x).limit(0), 3).count() == 0


def test_neighbours_leave_tasks_as_k_rows_a_point(make_points):
    plan = pairs.knn(make_points(on(0.0, 60)), 4)._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_of_given_pairs(make_points, monkeypatch):
    monkeypatch.setattr(pairs, "HELD", 100)
    p = make_points(on(0.0, 40))
    d = pairs.all_pairs(p)
    ties = d.withColumn("d", F.round("d", 1)).union(d.select("i", F.col("i").alias("j"), F.lit(0.0)))
    got = {(r.i, r.rank): r.j for r in pairs.nearest_of_pairs(ties.repartition(3), 6).collect()}
    m = matrix(ties.where("i <> j"), 40)
    np.fill_diagonal(m, np.inf)
    assert got == {(i, n + 1): j for i in range(40) for n, j in enumerate(np.lexsort((np.arange(40), m[i]))[:6].tolist())}


def test_metrics_of_given_distances(make_points):
    rng = np.random.RandomState(42)
    x, y = np.vstack([rng.normal(0, 0.5, (30, 3)), rng.normal(5, 0.5, (29, 3)), [[9, 9, 9]]]), [0] * 30 + [1] * 29 + [2]
    e = np.random.RandomState(99).normal(size=(60, 2))
    p, q = make_points(x, y), make_points(e, y)
    h, low, value = pairs.all_pairs(p), pairs.all_pairs(q), lambda df: df.first().value
    assert abs(value(pair_metrics.trustworthiness(h, low, 5)) - brute_trust(x, e, 5)) < 1e-9
    assert abs(value(pair_metrics.continuity(h, low, 5)) - brute_trust(e, x, 5)) < 1e-9
    for mine, other in (
        (pair_metrics.knn_overlap(h, low, 7), metrics.knn_overlap(p, q, 7)),
        (pair_metrics.silhouette(h, p), metrics.silhouette(p)),
        (pair_metrics.davies_bouldin(h, p), metrics.davies_bouldin(p)),
        (pair_metrics.db_ratio(h, low, p), metrics.db_ratio(p, q)),
        (pair_metrics.dunn(h, p), metrics.dunn(p)),
    ):
        assert abs(value(mine) - value(other)) < 1e-9
    one = make_points(np.eye(5), [0] * 5)
    d = pairs.all_pairs(one)
    assert [value(f(d, one)) for f in (pair_metrics.silhouette, pair_metrics.davies_bouldin, pair_metrics.dunn)] == [0] * 3
    assert 0 <= value(pair_metrics.knn_overlap(d, d, 100)) <= 1
    row = metrics.all_metrics(None, q, distances=h).first().asDict()
    both = metrics.all_metrics(p, q).first().asDict()
    assert row["trustworthiness"] is None and row["continuity"] is None
    assert abs(row["knn_overlap"] - both["knn_overlap"]) < 1e-9 and abs(row["db_index_ratio"] - both["db_index_ratio"]) < 1e-9


def test_ranks_of_more_points_than_32_bits_count(make_points, monkeypatch):
    x, e = on(0.0, 40), on(0.0, 40, 9)
    h, low = pairs.all_pairs(make_points(x)), pairs.all_pairs(make_points(e))
    monkeypatch.setattr(pair_metrics, "_points", lambda pairs: 12_000)
    over = (1 - brute_trust(x, e, 10)) * 40 * 10 * (80 - 31) / 2
    assert abs(1 - pair_metrics.trustworthiness(h, low, 10).first().value - 2 * over / (12_000 * 10 * (24_000 - 31))) < 1e-12


def test_exact_quantiles(spark, make_points, monkeypatch):
    monkeypatch.setattr(quantiles, "CELLS", 4)
    rng = np.random.default_rng(0)
    for values in ([3.0], [2.0, 2.0, 2.0, 5.0], rng.normal(size=501).tolist(), np.round(rng.normal(size=400), 1).tolist(), [1e300, -1e300, 0.0, 1e-300], [1.0, np.nextafter(1.0, 2.0)]):
        df = spark.createDataFrame([(v if v is None else float(v),) for v in [*values, None, math.nan]], "v double").repartition(3)
        at = [0.0, 0.25, 0.5, 0.9, 1.0]
        linear, lower = quantiles.quantiles(quantiles.of_column(df, "v"), at, at)
        assert np.allclose(linear, np.quantile(values, at), rtol=1e-12) and lower == [sorted(values)[max(0, math.ceil(q * len(values)) - 1)] for q in at]
    assert quantiles.quantiles(quantiles.of_column(df.limit(0), "v"), [0.5], [0.5]) == ([None], [None])
    p = make_points(on(-1.0, 50))
    d = np.array([r.d for r in pairs.all_pairs(p, -1.0).collect()])
    row = quantiles.pair_statistics(p, -1.0).first()
    assert math.isclose(row.std, d.std(ddof=1), rel_tol=1e-12) and row.median == sorted(d)[len(d) // 2 - 1] and math.isclose(row.quarter, np.quantile(d, 0.25), rel_tol=1e-12)


def test_distance_losses(make_points):
    x, e = on(0.0, 30, 4), on(-1.0, 30)
    h, low = space(0.0).distances(x, x)[np.triu_indices(30, 1)], space(-1.0).distances(e, e)[np.triu_indices(30, 1)]
    row = metrics.distance_losses(make_points(x), make_points(e), -1.0).first()
    assert math.isclose(row.gu, ((low / (h + 1e-8) - 1) ** 2).sum(), rel_tol=1e-9) and math.isclose(row.mse, ((low - h) ** 2).sum(), rel_tol=1e-9)


def test_groups_of_neighbours_do_not_grow_with_the_points(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    x = np.random.default_rng(8).normal(size=(600, 3))
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>")
    near = pairs.knn(points, 3)
    assert near.rdd.getNumPartitions() <= 24  # each group is sent all blocks that it may need
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(600, np.inf))
    want = {(i, r + 1, int(j)) for i in range(600) for r, j in enumerate(d[i].argsort(kind="stable")[:3])}
    assert {(r.i, r.rank, r.j) for r in near.collect()} == want
