"""Generators of point sets: (id, vec, label), drawn with Spark's seeded random columns, without rejection loops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import space

KAPPA = 10.0


def _rows(spark: SparkSession, n: int) -> DataFrame:
    if n < 1:
        raise ValueError(f"a data set needs at least one point, not {n}")
    return spark.range(n)


def _above_lower_median(rows: DataFrame, value: str) -> DataFrame:
    m = rows.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("m"))
    return rows.crossJoin(m).withColumn("label", (F.col(value) >= F.col("m")).cast("long")).select("id", "vec", "label")


def uniform_grid(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Uniform in the unit square, labelled by quadrant."""
    rows = _rows(spark, n).select("id", F.array(F.rand(seed), F.rand(seed + 1)).alias("vec"))
    return rows.withColumn("label", (2 * (F.col("vec")[0] >= 0.5).cast("long") + (F.col("vec")[1] >= 0.5).cast("long")).cast("long"))


def gaussian_blob(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Standard normal in the plane, labelled by radius from the lower median on."""
    rows = _rows(spark, n).select("id", F.array(F.randn(seed), F.randn(seed + 1)).alias("vec"))
    return _above_lower_median(rows.withColumn("radius", F.hypot(F.col("vec")[0], F.col("vec")[1])), "radius")


def concentric_circles(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Two noisy rings of radius 1 and 2."""
    ring = (F.col("id") >= n // 2).cast("long")
    r = ring + 1 + 0.1 * F.randn(seed)
    a = 2 * math.pi * F.rand(seed + 1)
    rows = _rows(spark, n).select("id", ring.alias("label"), r.alias("r"), a.alias("a"))
    return rows.select("id", F.array(F.col("r") * F.cos("a"), F.col("r") * F.sin("a")).alias("vec"), "label")


def _on_sphere(w: Column, angle: Column) -> Column:
    """The point at height ``w`` and longitude ``angle``."""
    s = F.sqrt(F.greatest(1 - w * w, F.lit(0.0)))
    return F.array(s * F.cos(angle), s * F.sin(angle), w)


def uniform_sphere(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Uniform on the unit sphere (height and longitude are), labelled by hemisphere."""
    rows = _rows(spark, n).select("id", (2 * F.rand(seed) - 1).alias("w"), (2 * math.pi * F.rand(seed + 1)).alias("a"))
    return rows.select("id", _on_sphere(F.col("w"), F.col("a")).alias("vec"), (F.col("w") >= 0).cast("long").alias("label"))


def _fisher_height(u: Column, kappa: float) -> Column:
    """Height of a von Mises-Fisher draw around the north pole, from a uniform one."""
    return 1 + F.log(u + (1 - u) * math.exp(-2 * kappa)) / kappa


def rotated_from_north(vec: Column, mu: tuple[float, float, float]) -> Column:
    """``vec`` turned by the rotation that takes the north pole to the unit vector ``mu``."""
    x, y, z = mu
    if z <= -1 + 1e-12:
        return F.array(vec[0], -vec[1], -vec[2])
    m = ((1 - x * x / (1 + z), -x * y / (1 + z), x), (-x * y / (1 + z), 1 - y * y / (1 + z), y), (-x, -y, z))
    return F.array(*(sum((vec[c] * row[c] for c in range(1, 3)), vec[0] * row[0]) for row in m))


def von_mises_fisher(spark: SparkSession, n: int = 500, seed: int = 42, kappa: float = KAPPA, mu: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Around ``mu`` on the sphere, labelled by angle from the lower median on."""
    rows = _rows(spark, n).select("id", _fisher_height(1 - F.rand(seed), kappa).alias("w"), (2 * math.pi * F.rand(seed + 1)).alias("a"))
    rows = rows.select("id", rotated_from_north(_on_sphere(F.col("w"), F.col("a")), mu).alias("vec"), F.acos(F.greatest(F.least("w", F.lit(1.0)), F.lit(-1.0))).alias("angle"))
    return _above_lower_median(rows, "angle")


def antipodal_clusters(spark: SparkSession, n: int = 500, seed: int = 42, kappa: float = KAPPA) -> DataFrame:
    """Half around each pole."""
    south = (F.col("id") >= n // 2).cast("long")
    rows = _rows(spark, n).select("id", south.alias("label"), _fisher_height(1 - F.rand(seed), kappa).alias("w"), (2 * math.pi * F.rand(seed + 1)).alias("a"))
    return rows.select("id", _on_sphere(F.col("w") * (1 - 2 * F.col("label")), F.col("a")).alias("vec"), "label")


def poincare_to_hyperboloid(p: Column) -> Column:
    """A point of the unit disc on the hyperboloid of curvature -1."""
    s = p[0] * p[0] + p[1] * p[1]
    return F.array((1 + s) / (1 - s), 2 * p[0] / (1 - s), 2 * p[1] / (1 - s))


def uniform_hyperbolic(spark: SparkSession, n: int = 500, seed: int = 42, reach: float = 3.0) -> DataFrame:
    """Uniform by area in a hyperbolic disc, labelled by thirds of its radius."""
    rows = _rows(spark, n).select("id", F.acosh(1 + F.rand(seed) * (math.cosh(reach) - 1)).alias("rho"), (2 * math.pi * F.rand(seed + 1)).alias("a"))
    r = F.tanh(F.col("rho") / 2)
    label = F.least(F.floor(3 * F.col("rho") / reach), F.lit(2)).cast("long")
    return rows.select("id", poincare_to_hyperboloid(F.array(r * F.cos("a"), r * F.sin("a"))).alias("vec"), label.alias("label"))


def tree_structured(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """A binary tree, level by level: depth d at radius tanh(0.4 d), angles 2 pi i / 2^d + 0.3 d; labels are depths up to 4."""
    depth = F.floor(F.log2((F.col("id") + 1).cast("double")) + 1e-12)
    rows = _rows(spark, n).withColumn("depth", depth)
    place = F.col("id") + 1 - F.pow(F.lit(2.0), F.col("depth"))
    a = 2 * math.pi * place / F.pow(F.lit(2.0), F.col("depth")) + 0.3 * F.col("depth")
    r = F.least(F.tanh(0.4 * F.col("depth")), F.lit(0.99))
    rows = rows.select("id", "depth", r.alias("r"), a.alias("a"))
    return rows.select("id", poincare_to_hyperboloid(F.array(F.col("r") * F.cos("a"), F.col("r") * F.sin("a"))).alias("vec"), F.least(F.col("depth"), F.lit(4)).cast("long").alias("label"))


def hyperbolic_shells(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Three noisy shells at hyperbolic radius 0.5, 1.5 and 2.5."""
    third = max(1, n // 3)
    shell = F.least(F.floor(F.col("id") / third), F.lit(2)).cast("long")
    r = F.tanh((shell + 0.5) / 2) + 0.05 * F.randn(seed)
    rows = _rows(spark, n).select("id", shell.alias("label"), F.least(F.greatest(r, F.lit(0.01)), F.lit(0.99)).alias("r"), (2 * math.pi * F.rand(seed + 1)).alias("a"))
    return rows.select("id", poincare_to_hyperboloid(F.array(F.col("r") * F.cos("a"), F.col("r") * F.sin("a"))).alias("vec"), "label")


#: Generators by name, with the curvature in which their distances are geodesic (None: Euclidean, no own distances).
GENERATORS = {
    "uniform_grid": (uniform_grid, None),
    "gaussian_blob": (gaussian_blob, None),
    "concentric_circles": (concentric_circles, None),
    "uniform_sphere": (uniform_sphere, 1.0),
    "von_mises_fisher": (von_mises_fisher, 1.0),
    "antipodal_clusters": (antipodal_clusters, 1.0),
    "uniform_hyperbolic": (uniform_hyperbolic, -1.0),
    "tree_structured": (tree_structured, -1.0),
    "hyperbolic_shells": (hyperbolic_shells, -1.0),
}


def generated_distances(points: DataFrame, curvature: float) -> DataFrame:
    """Geodesic (i, j, d) of a generated set, clamped at the ends of the domain only."""
    from ..operators.pairs import all_pairs

    return all_pairs(points, space(curvature).k, clamp=0.0)
