"""Fits of several spaces at once, the stateful stream of a run's losses, samplers and hulls against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbifold.operators import metrics, samplers
from orbifold.plans.fit import fit_embedding, sweep
from orbifold.plans.sweep import fit_sweep
from orbifold.sources import sinks
from orbifold.streaming import run_log

from .test_core import clusters, coordinates  # noqa: F401


def test_a_sweep_is_its_single_fits(make_points, clusters):  # noqa: F811
    x, y = clusters
    p = make_points(x, y)
    options = {"iterations": 3, "perplexity": 10.0, "rate": 5.0, "early_iterations": 1}
    curvatures, seen = [-1.0, 0.0, 0.5], []
    fitted = fit_sweep(p.select("id", "vec"), curvatures, callback=lambda i, losses, s: seen.append((i, losses, s.points.count())), **options)
    assert [i for i, *_ in seen] == [0, 1, 2] and [list(a) for _, a, _ in seen] == fitted.losses and {n for *_, n in seen} == {60}
    for n, k in enumerate(curvatures):
        one = fit_embedding(p.select("id", "vec"), k, **options)
        assert np.allclose([a[n] for a in fitted.losses], [a for _, a, _ in one.losses], rtol=1e-9)
        assert np.allclose(coordinates(fitted.of(n)), coordinates(one.points), atol=1e-9)
    stopped = fit_sweep(p.select("id", "vec"), [0.0], callback=lambda i, *_: False, **options)
    assert len(stopped.losses) == 1
    with pytest.raises(ValueError):
        sweep(p, [])


def test_progress_goes_on_where_it_ended(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    add = lambda run, *rows: [run_log.append_loss(spark, folder, run, i, loss, "main") for i, loss in rows]
    add("a", (0, 5.0), (1, 3.0), (1, 3.0), (2, 4.0))
    add("b", (0, 9.0))
    first = run_log.tell_progress(spark, folder, out, checkpoint, files=2).collect()
    assert sorted((r.run_id, r.iteration, r.loss, r.best) for r in first) == [("a", 0, 5.0, 5.0), ("a", 1, 3.0, 3.0), ("a", 2, 4.0, 3.0), ("b", 0, 9.0, 9.0)]
    add("a", (2, 4.0), (3, 2.0))  # the last iteration again, then a new one
    second = run_log.tell_progress(spark, folder, out, checkpoint).collect()
    assert sorted((r.run_id, r.iteration, r.loss, r.best) for r in second) == [("a", 0, 5.0, 5.0), ("a", 1, 3.0, 3.0), ("a", 2, 4.0, 3.0), ("a", 3, 2.0, 2.0), ("b", 0, 9.0, 9.0)]
    assert run_log.tell_progress(spark, folder, out, checkpoint).count() == 5


def test_draws_do_not_depend_on_partitions(make_points, clusters, monkeypatch):  # noqa: F811
    p = make_points(*clusters)
    monkeypatch.setattr(samplers, "PART", 16)
    for kind in ("random", "knn", "stratified", "negative"):
        one, two = (sorted(map(tuple, samplers.create_sampler(kind, q, 120).precompute().sample_pairs().collect())) for q in (p, p.repartition(7)))
        assert one == two and len(one) == 120 and all(i != j for i, j in one)
    s = samplers.create_sampler("knn", p, 50).precompute()
    s.release()
    with pytest.raises(RuntimeError):
        s.sample_pairs()
    s = samplers.create_sampler("stratified", p, 400).precompute()
    x = clusters[0]
    place = np.searchsorted(s.edges, [np.linalg.norm(x[r.i] - x[r.j]) for r in s.sample_pairs().collect()], side="right")
    assert (place <= 3).sum() > 1.2 * (place >= 8).sum()  # close bins come more often


def brute_volume(x):
    """Sums of tetrahedra over all triangles that have every point on one side."""
    total, m = 0.0, x.mean(axis=0)
    for a, b, c in itertools.combinations(x, 3):
        n = np.cross(b - a, c - a)
        side = (x - a) @ n
        if np.linalg.norm(n) > 1e-12 and ((side <= 1e-12).all() or (side >= -1e-12).all()):
            total += abs(np.dot(a - m, np.cross(b - m, c - m))) / 6
    return total


def test_hulls_in_space(make_points):
    rng = np.random.default_rng(2)
    ball = rng.normal(size=(40, 3))
    for x in (ball, ball / np.linalg.norm(ball, axis=1, keepdims=True), np.column_stack([np.sqrt(1 + (ball[:, :2] ** 2).sum(1)), ball[:, :2]])):
        want = brute_volume(x) / np.prod(np.ptp(x, axis=0))
        assert math.isclose(metrics.area_utilisation(make_points(x).repartition(5)).first().value, want, rel_tol=1e-9)
    cube = np.array(list(itertools.product((0, 1), repeat=3)) + [(0.5, 0.5, 0.5)], float)
    assert math.isclose(metrics.hull_share(np.repeat(cube, 2, axis=0)), 1.0)
    assert metrics.hull_share(np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (2, 3, 0)], float)) == 0 and metrics.hull_share(cube[:3]) == 0
    with pytest.raises(ValueError):
        metrics.area_utilisation(make_points(np.ones((9, 4))))


def test_drawings_are_written_in_parts(spark, tmp_path):
    plane = spark.range(0, 5000, 1, 4).select("id", (F.col("id") / 5000).alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 3).alias("label"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_svg(plane, str(tmp_path / "svg"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted((tmp_path / "svg").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert len(files) > 1 and lines[0].startswith("<svg") and lines[-1] == "</svg>" and len(lines) == 5002
    at = [float(line.split('"')[1]) for line in lines[1:-1]]
    assert at == sorted(at)
    chart = sinks.loss_chart(spark.createDataFrame([("r", 0, 100.0), ("r", 1, 10.0), ("r", 2, 1.0)], "run_id string, iteration long, loss double"), log_axis=True).first().value
    assert "0.00,0.00 300.00,150.00 600.00,300.00" in chart
