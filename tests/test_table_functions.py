"""Table functions of SQL against the DataFrame forms, and principal components against a plain decomposition."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from orbifold.operators import affinities as aff
from orbifold.operators import components, pairs, table_functions
from orbifold.plans.fit import initial_points


@pytest.fixture(scope="module")
def registered(spark):
    table_functions.register(spark)
    return spark


def told(df):
    return sorted((r.i, r.rank, r.j, round(r.d, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [0.0, 1.0, -1.0])
def test_nearest_points(registered, make_points, k):
    x = np.random.default_rng(3).normal(size=(300, 3)) * 0.4
    x[:20] = x[20:40]  # repeated vectors
    if k:
        x[:, 0] = 0
        x = x / np.linalg.norm(x[:, 1:], axis=1)[:, None] * np.random.default_rng(4).uniform(0.1, 0.9, (300, 1))
        x[:, 0] = np.sqrt(1 - (x[:, 1:] ** 2).sum(1)) if k > 0 else np.sqrt(1 + (x[:, 1:] ** 2).sum(1))
    p = make_points(x).select("id", "vec")
    got = registered.sql(f"SELECT * FROM nearest_points(TABLE({table_functions.BLOCKS}), 4, {k}D)", points=p)
    assert told(got) == told(pairs.knn(p, 4, k))


def test_nearest_points_over_blocks(registered, make_points):
    """Many blocks, some without own points, rows without a vector, and fewer others than asked for."""
    p = make_points(np.random.default_rng(5).normal(size=(60, 2)))
    rows = p.select("id", "vec").union(registered.createDataFrame([(99, None), (None, [0.0, 0.0])], "id long, vec array<double>"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("own", F.coalesce(F.col("block") == F.col("id") % 7, F.lit(True)))
    got = registered.sql("SELECT * FROM nearest_points(TABLE({rows}), 3, 0D)", rows=rows)
    assert told(got) == told(pairs.knn(p, 3))
    few = registered.sql("SELECT * FROM nearest_points(TABLE(SELECT * FROM {rows} WHERE id < 2), 5, 0D)", rows=rows)
    assert sorted((r.i, r.j) for r in few.collect()) == [(0, 1), (1, 0)]
    assert registered.sql("SELECT * FROM nearest_points(TABLE(SELECT * FROM {rows} WHERE id < 0), 5, 0D)", rows=rows).count() == 0


def test_streamed_candidates(registered, make_points, monkeypatch):
    handler = table_functions.NearestPoints()
    monkeypatch.setattr(handler, "SOME", 7)
    x = np.random.default_rng(6).normal(size=(50, 2))
    for own in (True, False):
        for i in range(50):
            if own == (i < 10):
                list(handler.eval({"block": 0, "own": own, "id": i, "vec": x[i].tolist()}, 3, 0.0))
                assert own or len(handler.some) < 7  # never more than a few others are held
    got = {(i, rank): j for i, rank, j, _ in handler.terminate()}
    d = np.linalg.norm(x[:10, None] - x[None], axis=2)
    np.fill_diagonal(d[:, :10], np.inf)
    assert got == {(i, r + 1): j for i in range(10) for r, j in enumerate(np.argsort(d[i])[:3].tolist())}


def test_points_are_sent_some_at_a_time(registered, make_points):
    """A row for each point and block takes longer than the distances."""
    x = np.random.default_rng(10).normal(size=(2_500, 40))
    x[:50] = x[50:100]
    p = make_points(x).select("id", "vec")
    rows = p.union(registered.createDataFrame([(9_999, None), (None, [0.0] * 40)], "id long, vec array<double>"))
    sent = registered.sql(table_functions.BLOCKS, points=rows).cache()
    blocks = sent.select("block").distinct().count()
    assert blocks == 3 and sent.count() <= 400 < 2_500
    assert sent.select(F.sum(F.size("id"))).first()[0] == 2_500 * blocks and sent.where("own").select(F.explode("id")).distinct().count() == 2_500
    assert sent.select(F.max(F.size("id"))).first()[0] < 60  # a row stays small
    got = registered.sql(f"SELECT * FROM nearest_points(TABLE({table_functions.BLOCKS}), 4, 0D)", points=rows)
    want = pairs.knn(p, 4).cache()
    assert told(got) == told(want)
    lists = registered.sql(f"SELECT * FROM nearest_lists(TABLE({table_functions.BLOCKS}), 4, 0D)", points=rows)
    assert told(lists.selectExpr("i", "posexplode(arrays_zip(j, d)) AS (rank, z)").selectExpr("i", "rank + 1 AS rank", "z.j", "z.d")) == told(want)


def test_affinities_of_lists(registered, make_points):
    near = pairs.knn(make_points(np.random.default_rng(11).normal(size=(90, 4))), 31)
    lists = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d"))).alias("n")).selectExpr("i", "n.j AS j", "n.d AS d")
    odd = registered.createDataFrame([(900, [], []), (901, None, None), (902, [1, None, 3, 4], [1.0, 2.0, None, 2.0])], "i long, j array<long>, d array<double>")
    got = registered.sql("SELECT i, s.j, s.p FROM conditional_affinities(TABLE({near}), 10D) LATERAL VIEW explode(arrays_zip(j, p)) AS s", near=lists.union(odd))
    got = {(r.i, r.j): r.p for r in got.collect()}
    assert {k for k in got if k[0] >= 900} == {(902, 1), (902, 4)}
    want = {(r.i, r.j): r.p for r in aff.conditional(near.select("i", "j", "d"), 10.0).collect()}
    assert {k for k in got if k[0] < 900} == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(AnalysisException):
        registered.sql("SELECT * FROM conditional_affinities(TABLE({near}), 10D)", near=lists.selectExpr("i", "j", "1D AS d")).collect()


def test_bandwidths_are_sought_for_many_points_at_once(monkeypatch):
    rng, rows = np.random.default_rng(12), []
    for i in range(40):
        rows += [{"i": i, "j": j, "d": float(d)} for j, d in enumerate(np.sort(rng.uniform(0.1, 3, 5 + i)))]
    told = []
    for some in (1, 60, 1 << 15):
        handler = table_functions.Affinities()
        monkeypatch.setattr(handler, "SOME", some)
        told.append([t for r in rows for t in handler.eval(r, 4.0)] + list(handler.terminate()))
    assert np.allclose(told[0], told[1]) and np.allclose(told[0], told[2])
    for i in range(40):
        p = np.array([t[3] for t in told[2] if t[0] == i])
        assert len(p) == 5 + i and abs(np.exp(-(p * np.log(p)).sum()) - 4) < 1e-3


def test_conditional_affinities(registered, make_points):
    p = make_points(np.random.default_rng(7).normal(size=(80, 4)))
    near = pairs.knn(p, 31).select("i", "j", "d")
    want = {(r.i, r.j): r.p for r in aff.conditional(near, 10.0).collect()}
    got = {(r.i, r.j): r.p for r in registered.sql("SELECT * FROM conditional_affinities(TABLE({near}), 10D)", near=near).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    named = near.select(F.concat(F.lit("p"), "i").alias("i"), F.concat(F.lit("p"), "j").alias("j"), "d")  # ids keep their type
    text = registered.sql("SELECT * FROM conditional_affinities(TABLE({near}), 10D)", near=named)
    assert [f.dataType.simpleString() for f in text.schema] == ["string", "string", "double", "double"] and text.count() == len(want)


def test_what_analysis_refuses(registered, make_points):
    p = make_points(np.zeros((2, 2))).selectExpr("id AS i", "id AS j", "0D AS d")
    for call in ("conditional_affinities(TABLE(SELECT i, j FROM {p}), 10D)", "conditional_affinities(TABLE({p}), -1D)", "nearest_points(TABLE({p}), 5, 0D)"):
        with pytest.raises(AnalysisException):
            registered.sql(f"SELECT * FROM {call}", p=p).collect()


def test_components_of_wide_vectors(make_points):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 40)) * np.linspace(3, 1, 40) @ rng.normal(size=(40, 2000)) + rng.normal(size=2000)
    loadings, values, mean = components.principal_components(make_points(x), 3)
    c = x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(values, s[:3] ** 2 / 199)
    assert np.allclose(np.abs((loadings * v[:3].T).sum(0)), 1, atol=1e-9)
    assert (loadings[np.abs(loadings).argmax(0), np.arange(3)] > 0).all()
    got = {r.id: r.s for r in components.projected(make_points(x), loadings, mean).collect()}
    assert np.allclose([got[i] for i in range(200)], c @ loadings)


def test_components_of_odd_points(spark, make_points):
    x = np.random.default_rng(9).normal(size=(500, 30))  # no structure: the whole space is searched
    _, values, _ = components.principal_components(make_points(x), 2)
    assert np.allclose(values, np.linalg.svd(x - x.mean(0))[1][:2] ** 2 / 499)
    same = make_points(np.ones((5, 40)))
    loadings, values, mean = components.principal_components(same, 2)
    assert np.allclose(values, 0) and np.allclose(mean, 1) and np.allclose(loadings.T @ loadings, np.eye(2))
    line = make_points(np.outer(np.arange(6.0), np.ones(50)))
    assert np.allclose(components.principal_components(line, 2)[1], [3.5 * 50, 0])
    assert initial_points(same, same, 0.0, 2, "pca").count() == 5
    for bad in (spark.createDataFrame([], "id long, vec array<double>"), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>"), make_points(np.zeros((3, 1)))):
        with pytest.raises(ValueError):
            components.principal_components(bad, 2)
