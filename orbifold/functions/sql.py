"""The distances of the three spaces as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import CLAMP

_DOT = "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, a) -> s + a)"
#: SQL function by name; arguments are two points, and the curvature where it is not 0.
FUNCTIONS = {
    "euclid_distance": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "sqrt(aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, a) -> s + a))"),
    "sphere_distance": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, k DOUBLE", f"acos(greatest(least({_DOT} * k, 1 - {CLAMP}D), -1 + {CLAMP}D)) / sqrt(k)"),
    "hyper_distance": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, k DOUBLE", f"acosh(greatest((2 * x[0] * y[0] - {_DOT}) * -k, 1 + {CLAMP}D)) / sqrt(-k)"),
}


def register(spark: SparkSession) -> None:
    """Makes :data:`FUNCTIONS` callable in the session's SQL."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
