"""Operators of the library against closed forms, brute force and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbifold.functions.geometry import scaling_loss, space
from orbifold.operators import affinities as aff
from orbifold.operators import descent, metrics, pairs, projection, samplers, similarity
from orbifold.plans import config
from orbifold.plans.fit import fit_embedding, initial_points
from orbifold.sources import registry, sinks, synthetic
from orbifold.streaming import run_log


def matrix(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = r[2]
    return out


def coordinates(df, column="vec"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.RandomState(42)
    x = np.vstack([rng.normal(0, 0.5, (30, 3)), rng.normal(5, 0.5, (30, 3))])
    return x, np.repeat([0, 1], 30)


def on(k, n=12, d=2, seed=0):
    s = np.random.default_rng(seed).normal(size=(n, d)) * 0.4
    if k == 0:
        return s
    r2 = 1 / abs(k)
    first = np.sqrt(r2 - (s**2).sum(1)) if k > 0 else np.sqrt(r2 + (s**2).sum(1))
    return np.column_stack([first, s])


def test_triangle_distances(make_points):
    d = matrix(pairs.all_pairs(make_points([(0, 0), (1, 0), (0, 1)])), 3)
    assert np.allclose(d, [[0, 1, 1], [1, 0, math.sqrt(2)], [1, math.sqrt(2), 0]])


@pytest.mark.parametrize("k", [0.0, 1.0, 0.5, -1.0, -2.0])
def test_block_and_column_distances_agree(make_points, k):
    p = make_points(on(k))
    every = pairs.all_pairs(p, k)
    same = pairs.gather_pairs(p, every, k).withColumnRenamed("d", "e").join(every, ["i", "j"])
    assert same.where(F.abs(F.col("d") - F.col("e")) > 1e-12).count() == 0
    assert same.count() == 12 * 11


@pytest.mark.parametrize("k", [1.0, 0.5, -1.0, -2.0])
def test_steps_stay_in_the_space_and_transport_stays_tangent(make_points, k):
    at, p = space(k), make_points(on(k))
    g = F.transform("vec", lambda a, i: F.sin(i + a * 3))
    rows = p.withColumn("t", at.tangent(F.col("vec"), g)).withColumn("y", at.step(F.col("vec"), F.col("t")))
    rows = rows.withColumn("w", at.transport(F.col("vec"), F.col("y"), F.col("t")))
    x, t, y, w = (coordinates(rows, c) for c in ("vec", "t", "y", "w"))
    sign = np.array([np.sign(k), 1, 1])
    assert np.allclose((x * t * sign).sum(1), 0, atol=1e-9)
    assert np.allclose((y * y * sign).sum(1), 1 / k, atol=1e-9)
    assert np.allclose((y * w * sign).sum(1), 0, atol=1e-8)
    assert np.allclose((w * w * sign).sum(1), (t * t * sign).sum(1), atol=1e-8)


def test_guards():
    for kind, k in ((0, 1.0), (1, -1.0), (2, 1.0)):
        from orbifold.functions import geometry as g

        with pytest.raises(ValueError):
            (g.Euclidean, g.Sphere, g.Hyperboloid)[kind](k)
    assert space(1e-11).k == 0.0


def test_lift_keeps_far_points_on_the_sphere(make_points):
    y = coordinates(make_points([(5, 5), (0.1, 0)]).select("id", space(1.0).lift(F.col("vec")).alias("vec")))
    assert np.allclose((y**2).sum(1), 1)


@pytest.mark.parametrize("k", [0.0, -1.0, -2.0])
def test_centring(make_points, k):
    x = on(k) + (0.3 if k == 0 else 0)
    if k:
        x[:, 1:] += 0.3
        x[:, 0] = np.sqrt(1 / abs(k) + (x[:, 1:] ** 2).sum(1))
    y = coordinates(space(k).centred(make_points(x)))
    assert np.allclose(y.mean(0)[(0 if k == 0 else 1) :], 0, atol=1e-9)


def test_knn_ties_go_to_smaller_ids(make_points):
    got = [(r.i, r.j) for r in pairs.knn(make_points([(0, 0), (1, 0), (-1, 0), (0, 1)]), 2).where("i = 0").orderBy("rank").collect()]
    assert got == [(0, 1), (0, 2)]


def test_blocks_do_not_change_results(make_points, clusters, monkeypatch):
    p = make_points(*clusters)
    whole = {(r.i, r.rank, r.j) for r in pairs.knn(p, 5).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 7)
    assert {(r.i, r.rank, r.j) for r in pairs.knn(p, 5).collect()} == whole
    assert abs(pairs.mean_distance(p).first().mean - matrix(pairs.all_pairs(p), 60).sum() / (60 * 59)) < 1e-9


def test_normalized_has_mean_distance_one(make_points, clusters):
    assert abs(pairs.mean_distance(pairs.normalized(make_points(*clusters))).first().mean - 1) < 1e-9


def test_perplexity_and_affinities(make_points):
    x = np.random.default_rng(42).normal(size=(50, 10))
    near = pairs.knn(make_points(x), 46)
    p = aff.conditional(near, 15.0).groupBy("i").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("h")).collect()
    assert all(abs(math.exp(r.h) - 15) < 0.01 for r in p)
    v = matrix(aff.affinities(make_points(x), 15.0), 50)
    assert np.allclose(v, v.T) and abs(v.sum() - 1) < 1e-9 and (v >= 0).all() and (np.diag(v) == 0).all()
    given = matrix(aff.affinities_of_pairs(pairs.all_pairs(make_points(x)), 15.0), 50)
    assert np.allclose(v, given)


def test_kernel(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "d double").select(similarity.student_t(F.col("d")).alias("k"), similarity.student_t_slope(F.col("d")).alias("s")).collect()
    assert np.allclose([r.k for r in rows], [1, 0.5, 0.2, 1 / 101])
    assert np.allclose([r.s for r in rows], [-2 * d / (1 + d * d) ** 2 for d in (0, 1, 2, 10)])


@pytest.mark.parametrize("k", [0.0, 1.0, -1.0, -2.0])
def test_gradient_is_the_derivative_of_the_loss(spark, make_points, k):
    x = on(k, 6)
    v = np.random.default_rng(1).random((6, 6))
    v = (v + v.T) * (1 - np.eye(6))
    v /= v.sum()
    ring = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(6) for j in range(6) if i != j], "i long, j long, v double")
    at = space(k)

    def loss(y):
        d = at.distances(y, y)
        kernel = (1 / (1 + d * d)) * (1 - np.eye(6))
        return -(v * np.log(kernel / kernel.sum() + 1e-12))[~np.eye(6, dtype=bool)].sum()

    got = coordinates(similarity.gradient(make_points(x), ring, k), "grad")
    want = np.zeros_like(x)
    for i, c in np.ndindex(*x.shape):
        up, down = x.copy(), x.copy()
        up[i, c] += 1e-6
        down[i, c] -= 1e-6
        want[i, c] = (loss(up) - loss(down)) / 2e-6
    assert np.allclose(got, want, atol=1e-6)
    assert abs(similarity.kl_loss(make_points(x), ring, k).first().loss - loss(x)) < 1e-9


@pytest.mark.parametrize("kind", config.SCALING)
def test_scaling_gradient(make_points, kind):
    x = on(-1.0, 6) + 0.0
    x[:, 1:] *= 20
    x[:, 0] = np.sqrt(1 + (x[:, 1:] ** 2).sum(1))
    got = coordinates(similarity.scaling_gradient(make_points(x), -1.0, kind), "grad")
    up, down = x.copy(), x.copy()
    up[2, 0] += 1e-6
    down[2, 0] -= 1e-6
    want = (scaling_loss(make_points(up), space(-1.0), kind).first().loss - scaling_loss(make_points(down), space(-1.0), kind).first().loss) / 2e-6
    assert abs(got[2, 0] - want) < 1e-6 and (got[:, 1:] == 0).all()


def test_steps_reject_bad_input(spark, make_points):
    p = make_points(on(-1.0))
    grads = p.select("id", F.col("vec").alias("grad"))
    with pytest.raises(ValueError):
        descent.rsgd_step(p, grads, -1.0, -1.0)
    nan = p.select("id", F.transform("vec", lambda a: F.lit(float("nan"))).alias("grad"))
    with pytest.raises(Exception, match="not finite"):
        descent.momentum_step(p, nan, None, 1.0, 0.5, -1.0).collect()
    moved = descent.momentum_step(p, p.select("id", F.transform("vec", lambda a: a * 1e6).alias("grad")), None, 1.0, 0.5, 0.0)
    assert np.linalg.norm(coordinates(moved, "velocity")) < 10 + 1e-9


def brute_trust(x, y, k):
    n = len(x)
    dx, dy = (np.linalg.norm(z[:, None] - z[None], axis=2) for z in (x, y))
    np.fill_diagonal(dx, np.inf)
    np.fill_diagonal(dy, np.inf)
    rank = dx.argsort(1, kind="stable").argsort(1, kind="stable") + 1
    near = dy.argsort(1, kind="stable")[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])


def test_neighbourhood_metrics(make_points, clusters):
    x, y = clusters
    e = np.random.RandomState(99).normal(size=(60, 2))
    p, q = make_points(x, y), make_points(e, y)
    value = lambda df: df.first().value
    assert abs(value(metrics.trustworthiness(p, q, 5)) - brute_trust(x, e, 5)) < 1e-9
    assert abs(value(metrics.continuity(p, q, 5)) - brute_trust(e, x, 5)) < 1e-9
    assert value(metrics.trustworthiness(p, p, 5)) == 1 and value(metrics.knn_overlap(p, p)) == 1
    assert value(metrics.distortion(p, p)) == 0 and value(metrics.volume_distortion(p, p)) == 0
    flat = make_points(x[:, :2], y)
    assert value(metrics.knn_overlap(p, flat)) > 0.5 and value(metrics.silhouette(flat)) > 0.3
    assert value(metrics.davies_bouldin(flat)) < 1 and value(metrics.dunn(flat)) > 1


def test_degenerate_metrics(make_points):
    value = lambda df: df.first().value
    one = make_points(np.eye(5), [0] * 5)
    assert [value(f(one)) for f in (metrics.silhouette, metrics.davies_bouldin, metrics.dunn, metrics.cluster_density)] == [0] * 4
    assert 0 <= value(metrics.knn_overlap(one, one, 100)) <= 1
    square = make_points([(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0.5)])
    assert abs(value(metrics.area_utilisation(square)) - 1) < 1e-9
    assert value(metrics.area_utilisation(make_points([(0, 0), (1, 1)]))) == 0
    assert value(metrics.radial_distribution(make_points([(0, 0)] * 10))) == 0
    a = np.linspace(0, 2 * math.pi, 100, endpoint=False)
    assert value(metrics.radial_distribution(make_points(np.column_stack([np.cos(a), np.sin(a)])))) < 1e-6


def test_all_metrics_nulls(make_points, clusters):
    x, y = clusters
    row = metrics.all_metrics(None, make_points(x[:, :2], y)).first().asDict()
    assert row["trustworthiness"] is None and row["db_index_ratio"] is None and row["area_utilisation"] > 0
    assert len(row) == 8


@pytest.mark.parametrize("name", list(synthetic.GENERATORS))
def test_generators(spark, name):
    make, k = synthetic.GENERATORS[name]
    for n in (1, 100):
        p = make(spark, n)
        assert p.count() == n and p.where("label < 0 OR label IS NULL").count() == 0
    x = coordinates(p)
    if k == 1.0:
        assert np.allclose((x**2).sum(1), 1, atol=1e-9)
    if k == -1.0:
        assert np.allclose(-(x[:, 0] ** 2) + (x[:, 1:] ** 2).sum(1), -1, atol=1e-6) and (x[:, 0] > 0).all()
    with pytest.raises(ValueError):
        make(spark, -1)


def test_von_mises_fisher_mean(spark):
    mu = (0.6, 0.0, 0.8)
    x = coordinates(synthetic.von_mises_fisher(spark, 20_000, kappa=10.0, mu=mu))
    assert np.allclose(x.mean(0), 0.9 * np.array(mu), atol=0.01)


def test_registry(spark):
    data = registry.load(spark, " Uniform_Sphere ", 40)
    assert data.distances.count() == 40 * 39 and registry.head(data, 10).distances.count() == 90
    assert registry.sample(data, 7).distances.count() == 42
    assert registry.split(data.points, "train").count() + registry.split(data.points, "test").count() == 40
    with pytest.raises(ValueError):
        registry.load(spark, "nothing")


@pytest.mark.parametrize("kind", ["random", "knn", "stratified", "negative"])
def test_samplers(make_points, clusters, kind):
    p = make_points(*clusters)
    sampler = samplers.create_sampler(kind, p, 300)
    if kind != "random":
        with pytest.raises(RuntimeError):
            sampler.sample_pairs()
    got = sampler.precompute().sample_pairs()
    assert got.count() == 300 and got.where("i = j").count() == 0
    if kind == "knn":
        assert got.join(sampler.near, ["i", "j"]).count() == 300
    if kind == "stratified":
        assert sum(sampler.shares()) == 300 and sampler.shares()[0] > sampler.shares()[-1]
    with pytest.raises(ValueError):
        samplers.create_sampler("other", p, 1)


def test_initial_points(make_points):
    x = np.random.default_rng(0).normal(size=(100, 10)) * 100
    p = make_points(x)
    y = coordinates(initial_points(p, p, 0.0, 2, "pca", 0.01))
    assert abs(y.std(ddof=1) - 0.01) < 1e-9
    with pytest.raises(ValueError):
        initial_points(None, p, 0.0, 2, "pca")
    z = coordinates(initial_points(None, p, -1.0, 2, "random"))
    assert np.allclose(-(z[:, 0] ** 2) + (z[:, 1:] ** 2).sum(1), -1)


def test_projections(make_points):
    p = make_points(on(1.0))
    for how in projection.PROJECTIONS:
        xy = np.array([(r.x, r.y) for r in projection.project(p, 1.0, how).collect()])
        assert (np.hypot(*xy.T) <= 1 + 1e-9).all()
    with pytest.raises(ValueError):
        projection.project(p, 1.0, "mercator")
    disc = np.array([(r.x, r.y) for r in projection.project(make_points(on(-1.0)), -1.0).collect()])
    assert (np.hypot(*disc.T) < 1).all()
    y = coordinates(projection.aligned(p)).mean(0)
    assert y[0] < 0 and np.allclose(y[1:], 0, atol=1e-9)


def test_geodesic_arc_ends_on_the_circle(spark):
    rows = projection.geodesic_arc(spark, -0.4).orderBy("step").collect()
    assert abs(math.hypot(rows[0].x, rows[0].y) - 1) < 1e-9 and abs(math.hypot(rows[-1].x, rows[-1].y) - 1) < 1e-9
    assert min(abs(r.x + 0.4) + abs(r.y) for r in rows) < 1e-9


@pytest.mark.parametrize("section,key,value", [
    ("data", "dataset", "unknown"), ("data", "n_samples", -5), ("data", "n_samples", 0), ("embedding", "embed_dim", 0), ("embedding", "n_iterations", -100), ("embedding", "init_method", "bad"),
    ("embedding", "perplexity", -5), ("embedding", "early_exaggeration_iterations", 1000), ("embedding", "early_exaggeration_factor", 0), ("embedding", "momentum_main", 1.5), ("embedding", "centering_weight", -1),
    ("embedding", "scaling_loss_type", "x"), ("hyperparameters", "learning_rates", 100.0), ("hyperparameters", "learning_rates", {"k": -10}), ("experiments", "curvatures", []), ("experiments", "curvatures", [1.0, "x"]),
    ("visualization", "spherical_projection", "x"),
])
def test_invalid_configurations(section, key, value):
    c = config.defaults()
    assert config.validate(c)[0]
    c[section][key] = value
    assert not config.validate(c)[0] and config.validate(config.defaults())[0]


def test_config_round_trip(tmp_path):
    c = config.defaults()
    c["data"]["n_samples"] = 500
    config.save(c, str(tmp_path / "c.toml"))
    assert config.load(str(tmp_path / "c.toml")) == c
    assert config.load(str(tmp_path / "new.toml")) == config.defaults()
    assert config.learning_rate(c, -1.0) == 200.0


def test_sinks(spark, make_points, tmp_path):
    plane = make_points([(0, 0), (1, 0), (0, 1)], [0, 1, 11]).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), "label")
    data = b"".join(r.data for r in sinks.packed_floats(plane).orderBy("first_id").collect())
    assert len(data) == 3 * 5 * 4
    sinks.write_svg(plane, str(tmp_path / "svg"))
    text = "".join(p.read_text() for p in (tmp_path / "svg").glob("part-*"))
    assert text.startswith("<svg") and text.rstrip().endswith("</svg>") and text.count("fill=\"rgb") == 3
    (tmp_path / "e.csv").write_text("Dataset;Curvature;Trust\na;0;0.5\na;1;0.6\nb;0;0.7\n")
    table = registry.experiment_table(registry.experiments(spark, str(tmp_path / "e.csv")), "Trust")
    assert len(table.collect()) == 2
    sinks.write_bars(table, str(tmp_path / "bars"))
    assert sinks.file_name("A b/c") == "a_b_c"


def test_run_log_stream(spark, make_points, tmp_path):
    plane = make_points([(0, 0), (1, 0)]).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    folder = str(tmp_path / "log")
    for i in (0, 1, 2, 2):
        run_log.append(plane, folder, "r", i, 3.0 - i, "main")
    seen = []
    q = run_log.follow(spark, folder, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    log = spark.read.schema(run_log.SCHEMA).parquet(folder)
    assert len(seen) == log.count() == 8
    assert [r.loss for r in run_log.losses(log).orderBy("iteration").collect()] == [3, 2, 1]
    assert run_log.latest(log).count() == 2


def test_fit_lowers_the_loss_and_stops(make_points, clusters):
    p = make_points(clusters[0]).select("id", "vec")
    fitted = fit_embedding(p, -1.0, iterations=6, perplexity=10.0, rate=5.0, early_iterations=0)
    assert fitted.losses[-1][1] < fitted.losses[0][1]
    x = coordinates(fitted.points)
    assert np.isfinite(x).all() and np.allclose(-(x[:, 0] ** 2) + (x[:, 1:] ** 2).sum(1), -1, atol=1e-3)
    stopped = fit_embedding(p, 1.0, iterations=6, perplexity=10.0, rate=5.0, early_iterations=1, callback=lambda i, *_: i < 1)
    assert len(stopped.losses) == 2 and stopped.losses[0][2] == "early"


def test_service(spark):
    from orbifold.plans.service import RunService, Status

    c = config.defaults()
    c["data"] = {"dataset": "uniform_grid", "n_samples": 40}
    c["embedding"] |= {"n_iterations": 2, "early_exaggeration_iterations": 1, "perplexity": 5.0}
    service = RunService(spark)
    assert not service.start(0.0, {})[0] and service.state.status == Status.IDLE
    with pytest.raises(RuntimeError):
        service.reproject()
    assert service.set_config(c)[0] and service.start(0.0)[0]
    assert not service.start(0.0)[0]
    with pytest.raises(RuntimeError):
        service.reset()
    service.wait(300)
    assert service.state.status == Status.COMPLETED, service.state.message
    assert len(service.state.losses) == 2 and len(service.state.metrics) == 8
    assert service.reproject().count() == 40
    assert run_log.losses(spark.read.parquet(service.log)).count() == 2
    service.reset()
    assert service.state.status == Status.IDLE
