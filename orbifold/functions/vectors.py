"""Columns over ``array<double>`` vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, inside higher-order functions too."""
    return F.transform(F.array(value), use)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda x, y: x * y))


def minkowski(u: Column, v: Column) -> Column:
    """The Lorentz product: the first coordinate counts negatively."""
    return dot(u, v) - 2 * u[0] * v[0]


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(a: Column | float, v: Column) -> Column:
    return F.transform(v, lambda x: x * a)


def combined(a: Column | float, u: Column, b: Column | float, v: Column) -> Column:
    """a u + b v."""
    return F.zip_with(u, v, lambda x, y: a * x + b * y)


def spatial(v: Column) -> Column:
    """All coordinates but the first."""
    return F.slice(v, 2, F.size(v) - 1)


def flipped(v: Column) -> Column:
    """The first coordinate negated."""
    return F.concat(F.array(-v[0]), spatial(v))


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))
