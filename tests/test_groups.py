"""Blocks that meet in groups, products of matrices with exact results, against plain computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbifold.functions.geometry import space
from orbifold.operators import metrics, pairs


def wide(n=120, d=12, seed=5):
    """Points of many coordinates far from the origin, some of them equal."""
    x = np.random.default_rng(seed).normal(size=(n, d)) + 100
    x[: n // 4] = x[n // 4 : 2 * (n // 4)]
    return x


def test_rows_are_put_together_where_blocks_meet(make_points, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 2)
    monkeypatch.setattr(pairs, "GROUPS", 2)
    p = make_points(np.arange(96.0)[:, None])
    blocks = p.select((F.pmod(F.xxhash64("id"), F.lit(48))).alias("b")).distinct().count()
    work = lambda a, b: pa.table({"i": a.ids, "n": np.ones(len(a.ids), np.int64)})
    rows = pairs.pair_blocks(p, work, "i long, n long", sums={"n": "sum"}).collect()
    assert len(rows) <= 3 * 96  # three groups of 16 blocks; one row for each block before
    assert {r.i: sum(s.n for s in rows if s.i == r.i) for r in rows} == dict.fromkeys(range(96), blocks)
    met = pairs.pair_blocks(p, lambda a, b: pa.table({"a": [a.number], "b": [b.number]}), "a long, b long", halves=True).collect()
    assert len(met) == blocks * (blocks + 1) // 2 == len({frozenset(r) for r in met})


def test_products_give_exact_neighbours_ranks_and_sums(make_points, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    x, at = wide(), space(0.0)
    n, p, d = len(x), make_points(x), at.distances(x, x)
    assert np.allclose(at.fast_distances(x, x), d, rtol=1e-9, atol=0) and at.products(x, x) is not None
    other = d + np.diag(np.full(n, np.inf))
    order = [np.lexsort((np.arange(n), other[i])) for i in range(n)]
    near = {(r.i, r["rank"]): (r.j, r.d) for r in pairs.knn(p, 7).collect()}
    assert all(near[i, k + 1] == (order[i][k], other[i, order[i][k]]) for i in range(n) for k in range(7))
    asked = make_points(x).select(F.col("id").alias("i"), F.pmod(F.col("id") * 7 + 3, F.lit(n)).alias("j")).where("i <> j")
    told = {(r.i, r.j): r["rank"] for r in pairs.ranks(p, asked).collect()}
    assert told and all(order[i][rank - 1] == j for (i, j), rank in told.items())
    assert np.isclose(pairs.mean_distance(p).first()["mean"], d.sum() / (n * (n - 1)), rtol=1e-9)


@pytest.mark.parametrize("k", [0.0, 1.0, -1.0])
def test_both_sides_of_a_pull(k):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(9, 3))
    x = s if k == 0 else s / np.linalg.norm(s, axis=1, keepdims=True) if k > 0 else np.column_stack([np.sqrt(1 + (s**2).sum(1)), s])
    at, (a, b) = space(k), (x[:4], x[4:])
    d, w = at.distances(a, b), rng.normal(size=(4, 5))
    one, two = at.pull_both(a, b, d, w)
    assert np.allclose(one, at.pull(a, b, d, w)) and np.allclose(two, at.pull(b, a, d.T, w.T))


def test_sums_by_label_of_blocks_that_meet_once(make_points, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    x, y = wide(), np.arange(120) % 3
    d = space(0.0).distances(x, x)
    np.fill_diagonal(d, np.nan)
    for r in metrics.label_sums(make_points(x, y)).collect():
        own = d[r.i, y == r.other]
        own = own[~np.isnan(own)]
        assert r.label == y[r.i] and r.n == len(own) and np.allclose([r.s, r.low, r.high], [own.sum(), own.min(), own.max()], rtol=1e-9, atol=1e-12)


def test_given_pairs_are_neither_sorted_nor_shuffled(spark, make_points):
    from orbifold.operators import pair_metrics

    p = make_points(wide(40), np.arange(40) % 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = pairs.all_pairs(p)
        for made in (pair_metrics.trustworthiness(d, d, 4), pair_metrics.davies_bouldin(d, p), pair_metrics.dunn(d, p)):
            assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_given_pairs_are_sorted(make_points, monkeypatch):
    """Rows that are left out before the sort change nothing, with equal distances and such that are no number."""
    p = make_points(wide(200))
    d = pairs.all_pairs(p).coalesce(1).sortWithinPartitions("i", "j")
    whole = {(r.i, r["rank"]): (r.j, r.d) for r in pairs.nearest_of_pairs(d, 3).collect()}
    assert whole == {(r.i, r["rank"]): (r.j, r.d) for r in pairs.knn(p, 3).collect()}
    rows = d.union(d.select("i", "j", F.lit(float("nan")))).coalesce(1).sortWithinPartitions("i", "j")
    assert {(r.i, r["rank"]): (r.j, r.d) for r in pairs.nearest_of_pairs(rows, 3).collect()} == whole
