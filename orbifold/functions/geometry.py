"""Spaces of constant curvature k: sphere (k > 0), Euclidean space (k = 0), hyperboloid (k < 0).

A space gives Columns for row-wise maps and array kernels for blocks of pairs. Points are ``array<double>``:
d coordinates where k = 0, else d + 1 with the polar or time-like one first; r = 1 / sqrt(|k|).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import combined, dot, flipped, let, literal, minkowski, norm, scaled, spatial, total

#: |k| up to this counts as 0.
FLAT = 1e-10
#: Sums of pairs that are made together.
SUMS = 1 << 15
#: Points of more coordinates than this are compared by products of matrices.
NARROW = 8
#: Rows whose pairs are worked on at a time, so that they stay in the cache.
STRIP = 32
#: Squared distances are made in single precision where they lie between this and its inverse.
ROUGH = 1e-24
#: How far products stay from the ends of arccos and arcosh.
CLAMP = 1e-7


@dataclass(frozen=True)
class Space:
    """Common part of the three geometries; get one from :func:`space`."""

    k: float

    def __post_init__(self) -> None:
        """Each geometry checks its curvature here."""

    @property
    def r(self) -> float:
        return 1.0 if abs(self.k) <= FLAT else 1 / math.sqrt(abs(self.k))

    @property
    def r2(self) -> float:
        return self.r**2

    def ambient(self, d: int) -> int:
        """Number of coordinates of a point of the d-dimensional space."""
        return d if abs(self.k) <= FLAT else d + 1

    def products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Squared distances by one product of matrices, and how far off those of each row may be; None where there are none."""
        return None

    def rough_products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same in single precision where numbers allow that: for leaving out pairs that lie too far apart."""
        return None

    def fast_distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances to about ten digits, by products of matrices where that is faster."""
        return self.distances(x, y)

    def distances_from(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of the rows of x to one point, to about ten digits."""
        return self.distances(x, y[None])[:, 0]

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`fast_distances`, and what a gradient by distances is weighed by for :meth:`pulled`."""
        raise NotImplementedError

    def pulled(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Gradients at the rows of x and, with ``back``, at those of y, of the sum of a(i, j) d(i, j); w is a by the slopes."""
        raise NotImplementedError

    def pull(self, x: np.ndarray, y: np.ndarray, d: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Gradient at the rows of x of the sum of a(i, j) d(i, j)."""
        return self.pulled(x, y, a * self.slopes(x, y)[1], False)[0]

    def pull_both(self, x: np.ndarray, y: np.ndarray, d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients at the rows of x, and at those of y, of the sum of a(i, j) d(i, j)."""
        return self.pulled(x, y, a * self.slopes(x, y)[1], True)

    def centred(self, points: DataFrame) -> DataFrame:
        """``points`` moved so that their centre lies at the origin, or at the apex of the hyperboloid."""
        mean = mean_vector(points)
        return points if mean is None else points.withColumn("vec", self.recentred(F.col("vec"), mean))


def _sums(x: np.ndarray, y: np.ndarray, term) -> np.ndarray:
    """Sum over coordinates, in order, of ``term`` of each pair: the same for (x, y) and (y, x).

    Some rows at a time, so that their sums stay in the cache."""
    out, columns = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    some = max(1, SUMS // max(1, len(y)))
    for start in range(0, len(x), some):
        rows = out[start : start + some]
        for c in range(x.shape[1]):
            rows += term(x[start : start + some, c, None], columns[None, c], c)
    return out


class Euclidean(Space):
    def __post_init__(self) -> None:
        if abs(self.k) > FLAT:
            raise ValueError("Euclidean space needs curvature 0")

    def distance(self, x: Column, y: Column, clamp: float = CLAMP) -> Column:
        return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))

    def distances(self, x: np.ndarray, y: np.ndarray, clamp: float = CLAMP) -> np.ndarray:
        # a strip at a time, without new arrays for each coordinate
        out, columns, off = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T), np.empty((min(len(x), STRIP), len(y)))
        for s in range(0, len(x), STRIP):
            rows, some = out[s : s + STRIP], x[s : s + STRIP]
            part = off[: len(rows)]
            for c in range(x.shape[1]):
                np.subtract(some[:, c, None], columns[None, c], out=part)
                np.multiply(part, part, out=part)
                rows += part
            np.sqrt(rows, out=rows)
        return out

    def distances_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows of x to the same rows of y, as :meth:`distances` makes them."""
        out = np.zeros(len(x))
        for c in np.subtract(x.T, y.T, order="C") ** 2:  # in order of coordinates
            out += c
        return np.sqrt(out)

    def distances_from(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        off = x - y
        return np.sqrt(np.einsum("ij,ij->i", off, off))

    def products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        return self._products(x, y, np.float64)

    def rough_products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        return self._products(x, y, np.float32) or self.products(x, y)

    def _products(self, x: np.ndarray, y: np.ndarray, of: type) -> tuple[np.ndarray, np.ndarray] | None:
        n = x.shape[1]
        if n <= NARROW or not len(x) or not len(y):
            return None
        middle = x.mean(axis=0)
        x, y = x - middle, y - middle
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        most = xx.max() + yy.max()
        if not np.isfinite(most) or of is np.float32 and not ROUGH < most < 1 / ROUGH:
            return None
        left, right = np.empty((len(x), n + 2), of), np.empty((len(y), n + 2), of)
        left[:, :n], left[:, n], left[:, n + 1] = -2 * x, xx, 1
        right[:, :n], right[:, n], right[:, n + 1] = y, 1, yy
        return left @ right.T, (4 * n + 32) * float(np.finfo(of).eps) / 2 * (xx + yy.max()) + (float(np.finfo(of).tiny) * n * 8 if of is np.float32 else 0.0)

    def fast_distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        told = self.products(x, y)
        if told is None:
            return self.distances(x, y)
        d2, slack = told
        least = slack * 1e9  # smaller ones have lost digits
        if d2.min() < least.max():
            r, c = np.nonzero(d2 < least[:, None])
            for s in range(0, len(r), 1 << 16):
                i, j = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
                d2[i, j] = self.distances_of(x[i], y[j]) ** 2
        return np.sqrt(d2, out=d2)

    def tangent(self, x: Column, g: Column) -> Column:
        return g

    def step(self, x: Column, v: Column) -> Column:
        return combined(1.0, x, 1.0, v)

    def transport(self, x: Column, to: Column, v: Column) -> Column:
        return v

    def lift(self, s: Column) -> Column:
        return s

    def recentred(self, x: Column, mean: list[float]) -> Column:
        """The mean moved to the origin."""
        return combined(1.0, x, -1.0, literal(mean))

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.fast_distances(x, y)
        return d, np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)

    def pulled(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        return w.sum(axis=1)[:, None] * x - w @ y, w.sum(axis=0)[:, None] * y - w.T @ x if back else None

    def pulls(self, x: np.ndarray, y: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Gradient at each row of x of a d, d being its distance to the same row of y."""
        d = np.sqrt(((x - y) ** 2).sum(axis=1))
        return np.divide(a, d, out=np.zeros_like(a), where=d > 0)[:, None] * (x - y)


class Sphere(Space):
    def __post_init__(self) -> None:
        if self.k <= 0:
            raise ValueError("a sphere needs positive curvature")

    def distance(self, x: Column, y: Column, clamp: float = CLAMP) -> Column:
        return F.acos(F.greatest(F.least(dot(x, y) / self.r2, F.lit(1 - clamp)), F.lit(-1 + clamp))) * self.r

    def distances(self, x: np.ndarray, y: np.ndarray, clamp: float = CLAMP) -> np.ndarray:
        return np.arccos(np.clip(_sums(x, y, lambda a, b, c: a * b) / self.r2, -1 + clamp, 1 - clamp)) * self.r

    def tangent(self, x: Column, g: Column) -> Column:
        return let(dot(g, x) / self.r2, lambda p: combined(1.0, g, -p, x))

    def step(self, x: Column, v: Column) -> Column:
        """The exponential map, brought back to the sphere."""

        def moved(n: Column) -> Column:
            y = combined(F.cos(n / self.r), x, F.sin(n / self.r) * self.r / F.greatest(n, F.lit(1e-10)), v)
            return let(y, lambda y: scaled(self.r / norm(y), y))

        return let(norm(v), lambda n: F.when(n < 1e-10, x).otherwise(moved(n)))

    def transport(self, x: Column, to: Column, v: Column) -> Column:
        away = let(dot(to, v) / F.greatest(self.r2 + dot(x, to), F.lit(1e-8)), lambda c: combined(1.0, v, -c, combined(1.0, x, 1.0, to)))
        return let(away, lambda w: combined(1.0, w, -dot(to, w) / self.r2, to))

    def lift(self, s: Column) -> Column:
        """Spatial coordinates (shortened where they would leave the sphere) with the polar one."""
        most = math.sqrt(max(self.r2 - CLAMP, 0.0))
        return let(F.least(F.lit(1.0), most / F.greatest(norm(s), F.lit(1e-300))), lambda f: let(scaled(f, s), lambda t: F.concat(F.array(F.sqrt(self.r2 - dot(t, t))), t)))

    def recentred(self, x: Column, mean: list[float]) -> Column:
        return x

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = np.clip(x @ (y / self.r2).T, -1 + CLAMP, 1 - CLAMP)
        slope = self._weights(u, np.ones(1))
        return np.multiply(np.arccos(u, out=u), self.r, out=u), slope

    def fast_distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u = x @ (y / self.r2).T
        np.clip(u, -1 + CLAMP, 1 - CLAMP, out=u)
        return np.multiply(np.arccos(u, out=u), self.r, out=u)

    def pulled(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        return w @ y, w.T @ x if back else None

    def pulls(self, x: np.ndarray, y: np.ndarray, a: np.ndarray) -> np.ndarray:
        return self._weights((x * y).sum(axis=1) / self.r2, a)[:, None] * y

    def _weights(self, u: np.ndarray, a: np.ndarray) -> np.ndarray:
        free = np.abs(u) < 1 - CLAMP
        return np.where(free, -a * self.r / self.r2 / np.sqrt(np.where(free, 1 - u * u, 1.0)), 0.0)


class Hyperboloid(Space):
    def __post_init__(self) -> None:
        if self.k >= 0:
            raise ValueError("a hyperboloid needs negative curvature")

    def distance(self, x: Column, y: Column, clamp: float = CLAMP) -> Column:
        return F.acosh(F.greatest(-minkowski(x, y) / self.r2, F.lit(1 + clamp))) * self.r

    def _u(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return -(_sums(x, y, lambda a, b, c: a * b) - 2 * x[:, 0, None] * y[None, :, 0]) / self.r2

    def distances(self, x: np.ndarray, y: np.ndarray, clamp: float = CLAMP) -> np.ndarray:
        return np.arccosh(np.maximum(self._u(x, y), 1 + clamp)) * self.r

    def tangent(self, x: Column, g: Column) -> Column:
        return let(flipped(g), lambda h: combined(1.0, h, minkowski(x, h) / self.r2, x))

    def step(self, x: Column, v: Column) -> Column:
        """The exponential map with Lorentz norms up to 10 r, brought back to the hyperboloid."""

        def moved(n2: Column) -> Column:
            n = F.least(F.sqrt(F.greatest(n2, F.lit(1e-15))), F.lit(10 * self.r))
            return let(n, lambda n: combined(F.cosh(n / self.r), x, F.sinh(n / self.r) * self.r / n, v))

        y = let(minkowski(v, v), moved)
        return let(spatial(y), self.lift)

    def transport(self, x: Column, to: Column, v: Column) -> Column:
        away = let(minkowski(to, v) / F.greatest(self.r2 - minkowski(x, to), F.lit(1e-8)), lambda c: combined(1.0, v, c, combined(1.0, x, 1.0, to)))
        return let(away, lambda w: combined(1.0, w, minkowski(to, w) / self.r2, to))

    def lift(self, s: Column) -> Column:
        return F.concat(F.array(F.sqrt(self.r2 + dot(s, s))), s)

    def recentred(self, x: Column, mean: list[float]) -> Column:
        """The boost that takes the normalised Lorentz centroid to the apex."""
        c = np.array(mean)
        square = c[0] ** 2 - (c[1:] ** 2).sum()
        if square <= 0:
            raise ValueError("the centroid is not time-like")
        c *= self.r / math.sqrt(square)
        if np.linalg.norm(c[1:]) <= 1e-10:
            return x
        # x0' = gamma (x0 - b.s); s' = s + ((gamma - 1) (b.s) / b.b - gamma x0) b, with b = c_s / c_0.
        b, gamma = c[1:] / c[0], c[0] / self.r
        along = dot(spatial(x), literal(b.tolist()))
        return let(let(along, lambda p: combined(1.0, spatial(x), (gamma - 1) / float(b @ b) * p - gamma * x[0], literal(b.tolist()))), self.lift)

    def _stretched(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Hyperbolic cosines of distances by r, and their sines; no sines where squares are too large."""
        u = x @ (self._mirrored(y) / -self.r2).T
        np.maximum(u, 1 + CLAMP, out=u)
        if u.size and not u.max() < 1e150:
            return u, None
        root = u * u
        root -= 1
        return u, np.sqrt(root, out=root)

    def _along(self, u: np.ndarray, root: np.ndarray | None) -> np.ndarray:
        """arcosh(u) r, in the place of u."""
        np.log(np.add(u, root, out=u), out=u) if root is not None else np.arccosh(u, out=u)
        return np.multiply(u, self.r, out=u) if self.r != 1 else u

    def fast_distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(y)))
        for s in range(0, len(x), STRIP):
            out[s : s + STRIP] = self._along(*self._stretched(x[s : s + STRIP], y))
        return out

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, root = self._stretched(x, y)
        if root is None:
            slope = self._weights(u, np.ones(1))
        else:
            slope = np.divide(-1 / self.r, root)
            if u.size and u.min() <= 1 + CLAMP:
                slope[u <= 1 + CLAMP] = 0.0
        return self._along(u, root), slope

    def pulled(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        return w @ self._mirrored(y), w.T @ self._mirrored(x) if back else None

    def pulls(self, x: np.ndarray, y: np.ndarray, a: np.ndarray) -> np.ndarray:
        mirrored = self._mirrored(y)
        return self._weights(-(x * mirrored).sum(axis=1) / self.r2, a)[:, None] * mirrored

    def _mirrored(self, y: np.ndarray) -> np.ndarray:
        return y * np.array([-1.0] + [1.0] * (y.shape[1] - 1))

    def _weights(self, u: np.ndarray, a: np.ndarray) -> np.ndarray:
        free = u > 1 + CLAMP
        return np.where(free, -a * self.r / self.r2 / np.sqrt(np.where(free, u * u - 1, 1.0)), 0.0)


def space(k: float) -> Euclidean | Sphere | Hyperboloid:
    """The space of curvature ``k``."""
    if abs(k) <= FLAT:
        return Euclidean(0.0)
    return Sphere(float(k)) if k > 0 else Hyperboloid(float(k))


def mean_vector(points: DataFrame) -> list[float] | None:
    """The mean of ``vec``: one row however many points; null without points."""
    first = points.select(F.size("vec").alias("d")).first()
    if first is None:
        return None
    return list(points.agg(*(F.avg(F.col("vec")[c]).alias(f"c{c}") for c in range(first.d))).first())


def scaling_loss(points: DataFrame, at: Space, kind: str) -> DataFrame:
    """One row (loss): how far the points' spread is from the wanted one. kind: rms, hard_barrier, softplus_barrier, mean_distance."""
    if isinstance(at, Sphere):
        return points.agg(F.lit(0.0).alias("loss"))
    if isinstance(at, Euclidean):
        return points.agg(F.pow(F.sqrt(F.avg(dot(F.col("vec"), F.col("vec")))) - 1, 2).alias("loss"))
    g = F.acosh(F.greatest(F.col("vec")[0] / at.r, F.lit(1 + CLAMP))) * at.r
    over = g - 3 * at.r
    how = {
        "rms": F.pow(F.sqrt(F.avg(g * g)) - 1, 2),
        "hard_barrier": F.avg(F.pow(F.greatest(over, F.lit(0.0)), 2)),
        "softplus_barrier": F.avg(F.when(over > 20, over).otherwise(F.log1p(F.exp(over)))),
        "mean_distance": F.avg(g),
    }
    if kind not in how:
        raise ValueError(f"unknown scaling loss {kind!r}")
    return points.agg(how[kind].alias("loss"))
