"""Places where a query of the core library once did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from orbifold.operators import metrics


def test_evaluate_uses_all_points(spark, make_points, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    high, low = make_points(x), make_points(x[:, :2])
    whole = metrics.evaluate(high, low, 5).first()
    assert whole.trustworthiness == metrics.trustworthiness(high, low, 5).first().value
    assert metrics.evaluate(high, low, 5, most=60).first() != whole
    sampled = []
    monkeypatch.setattr(metrics, "sampled_ids", lambda points, *a: sampled.append(a) or points.select("id"))
    many = spark.range(10_001).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    metrics.evaluate(many, many, 5)
    assert not sampled


def test_area_utilisation_finds_corners_in_parallel(spark, make_points):
    square = make_points(np.array([[0, 0], [0, 1], [1, 0], [1, 1], [0.5, 0.5]])).repartition(4)
    area = metrics.area_utilisation(square)
    assert "Exchange" in area._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert abs(area.first().value - 1) < 1e-12
    assert [r.value for r in metrics.area_utilisation(square.where("id < 0")).collect()] == [0.0]
