"""Riemannian gradient descent as row-wise updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import space
from ..functions.vectors import combined, dot, scaled

#: The norm of the velocities of all points together is kept to this.
MOST_VELOCITY = 10.0


def rsgd_step(points: DataFrame, grads: DataFrame, rate: float, k: float = 0.0) -> DataFrame:
    """``points`` moved along the geodesics against their gradients (id, grad)."""
    if rate < 0:
        raise ValueError(f"invalid learning rate {rate}")
    at = space(k)
    rows = points.join(grads, "id").withColumn("v", scaled(-rate, at.tangent(F.col("vec"), F.col("grad"))))
    return rows.withColumn("vec", at.step(F.col("vec"), F.col("v"))).select(*points.columns)


def momentum_step(points: DataFrame, grads: DataFrame, state: DataFrame | None, rate: float, momentum: float, k: float = 0.0) -> DataFrame:
    """(id, vec, ..., velocity, prev): a step with velocities carried along by parallel transport.

    ``state`` holds (id, velocity, prev) of the step before, None before the first. The clip needs the norm of all
    velocities: one sum, joined to every row. Raises ValueError (in the task) where a gradient is not finite."""
    if rate < 0:
        raise ValueError(f"invalid learning rate {rate}")
    at = space(k)
    rows = points.join(grads, "id")
    bad = F.exists("grad", lambda g: F.isnan(g) | (F.abs(g) == float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("a gradient is not finite")).cast("array<double>")).otherwise(F.col("grad"))
    rows = rows.withColumn("g", at.tangent(F.col("vec"), checked))
    if state is None:
        rows = rows.withColumn("velocity", scaled(-rate, F.col("g")))
    else:
        rows = rows.join(state.select("id", "velocity", "prev"), "id")
        carried = at.transport(F.col("prev"), F.col("vec"), F.col("velocity"))
        rows = rows.withColumn("velocity", combined(momentum, carried, -rate, F.col("g")))
    size = rows.agg(F.sqrt(F.sum(dot(F.col("velocity"), F.col("velocity")))).alias("size"))
    rows = rows.crossJoin(size)
    clip = F.when(F.col("size") > MOST_VELOCITY, MOST_VELOCITY / F.col("size")).otherwise(1.0)
    rows = rows.withColumn("velocity", scaled(clip, F.col("velocity"))).withColumn("prev", F.col("vec"))
    return rows.withColumn("vec", at.step(F.col("vec"), F.col("velocity"))).select(*points.columns, "velocity", "prev")
