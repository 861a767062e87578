"""Embeddings in the plane: projections, colours, grids and curves to draw with them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Euclidean, Sphere, mean_vector, space
from ..functions.vectors import combined, dot, literal, norm

PROJECTIONS = ("stereographic", "azimuthal_equidistant", "orthographic")
#: Ten categorical colours, by rank of label modulo ten. Fixed values.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def aligned(points: DataFrame) -> DataFrame:
    """``points`` reflected so that the centroid lies on the negative first axis.

    Where the centroid is at the origin, the axis of least variance changes places with the first."""
    mean = mean_vector(points)
    if mean is None:
        return points
    c = np.array(mean)
    if np.linalg.norm(c) < 1e-10:
        spread = points.agg(*(F.var_pop(F.col("vec")[k]).alias(f"v{k}") for k in range(len(c)))).first()
        least = int(np.argmin(list(spread)))
        order = list(range(len(c)))
        order[0], order[least] = least, 0
        return points.withColumn("vec", F.array(*(F.col("vec")[k] for k in order)))
    v = c / np.linalg.norm(c)
    v[0] += 1.0
    if v @ v < 1e-15:
        return points
    w = literal(v.tolist())
    return points.withColumn("vec", combined(1.0, F.col("vec"), -2 * dot(F.col("vec"), w) / float(v @ v), w))


def project(points: DataFrame, k: float = 0.0, projection: str = "stereographic", i: int = 0, j: int = 1, pole: int | None = None, scale_info: bool = False) -> DataFrame:
    """(id[, label], x, y[, scale]) of ``points``.

    Sphere: seen from the pole on axis ``pole`` (0 by default) by one of :data:`PROJECTIONS`; i and j choose among the
    other axes. Plane: axes i and j by the greatest radius. Hyperboloid: Poincare disc of spatial axes i and j."""
    at, vec = space(k), F.col("vec")
    keep = [c for c in ("id", "label") if c in points.columns]
    if isinstance(at, Euclidean):
        rows = points.select(*keep, vec[i].alias("x"), vec[j].alias("y"))
        return _by_radius(rows, keep, scale_info)
    if not isinstance(at, Sphere):
        below = F.greatest(vec[0] + at.r, F.lit(1e-12))
        rows = points.select(*keep, (vec[i + 1] / below).alias("x"), (vec[j + 1] / below).alias("y"))
        return rows.withColumn("scale", F.lit(1.0)) if scale_info else rows
    if projection not in PROJECTIONS:
        raise ValueError(f"unknown projection {projection!r}")
    pole = 0 if pole is None else pole
    first = points.select(F.size("vec").alias("d")).first()
    axes = [a for a in range(first.d if first else 3) if a != pole]
    x, y, z = vec[axes[i]], vec[axes[j]], vec[pole]
    if projection == "stereographic":
        below = F.when(F.abs(at.r - z) < 1e-12, 1e-12).otherwise(at.r - z)
        return _by_radius(points.select(*keep, (x / below).alias("x"), (y / below).alias("y")), keep, scale_info)
    if projection == "azimuthal_equidistant":
        theta = F.acos(F.greatest(F.least(-z / at.r, F.lit(1.0)), F.lit(-1.0))) / math.pi
        phi = F.atan2(y, x)
        x, y = theta * F.cos(phi), theta * F.sin(phi)
    else:
        x, y = x / at.r, y / at.r
    rows = points.select(*keep, x.alias("x"), y.alias("y"))
    return rows.withColumn("scale", F.lit(1.0)) if scale_info else rows


def _by_radius(rows: DataFrame, keep: list[str], scale_info: bool) -> DataFrame:
    most = rows.agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("most"))
    most = most.select(F.when(F.col("most") > 0, F.col("most")).otherwise(1.0).alias("most"))
    out = rows.crossJoin(most)
    scale = [(1 / F.col("most")).alias("scale")] if scale_info else []
    return out.select(*keep, (F.col("x") / F.col("most")).alias("x"), (F.col("y") / F.col("most")).alias("y"), *scale)


def label_colors(points: DataFrame) -> DataFrame:
    """(label, red, green, blue), 0 to 1, for each label."""
    labels = points.select("label").distinct()
    rank = (F.dense_rank().over(Window.orderBy("label")) - 1) % len(PALETTE)  # one row per label
    code = F.element_at(F.array(*map(F.lit, PALETTE)), rank + 1)
    part = lambda at: (F.conv(F.substring(code, at, 2), 16, 10).cast("int") / 255.0)
    return labels.select("label", part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"))


def boundary_ring(spark: SparkSession, n: int = 101) -> DataFrame:
    """(step, x, y) around the unit circle, the first point again at the end."""
    a = F.col("id") * (2 * math.pi / (n - 1))
    return spark.range(n).select(F.col("id").alias("step"), F.cos(a).alias("x"), F.sin(a).alias("y"))


def hyperbolic_ticks(spark: SparkSession) -> DataFrame:
    """(n, radius): circles at hyperbolic distance n in the disc, up to radius 0.98."""
    return spark.range(1, 5).select(F.col("id").alias("n"), F.tanh(F.col("id") / 2.0).alias("radius")).where("radius <= 0.98")


def sphere_parallels(spark: SparkSession, projection: str, radius: float = 1.0, step: int = 30) -> DataFrame:
    """(degrees, radius) of the circles of latitude, as far as they show."""
    theta = F.radians(F.col("id").cast("double"))
    how = {"stereographic": radius * F.tan(theta / 2), "azimuthal_equidistant": radius * theta / math.pi, "orthographic": radius * F.sin(theta)}
    if projection not in how:
        raise ValueError(f"unknown projection {projection!r}")
    most = 90 if projection == "orthographic" else 150
    return spark.range(step, most + 1, step).select(F.col("id").alias("degrees"), how[projection].alias("radius")).where("radius <= 1.05")


def geodesic_arc(spark: SparkSession, a: float, segments: int = 64) -> DataFrame:
    """(step, x, y): the geodesic of the disc that crosses the first axis at ``a`` at a right angle."""
    centre, radius = (1 + a * a) / (2 * a), (1 - a * a) / (2 * abs(a))
    half = math.asin(min(1.0, math.sqrt(max(0.0, 1 - 1 / centre**2)) / radius))
    angle = math.pi * (a > 0) - half + F.col("id") * (2 * half / segments)
    return spark.range(segments + 1).select(F.col("id").alias("step"), (centre + radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def centroid_distance(points: DataFrame) -> DataFrame:
    """One row (value): how far the centroid is from the origin."""
    mean = mean_vector(points)
    return points.sparkSession.range(1).select((norm(literal(mean)) if mean else F.lit(0.0)).alias("value"))
