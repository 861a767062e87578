"""Fitting an embedding: affinities, initial points, and momentum descent with early exaggeration.

Each iteration is a few jobs over distributed points; the state (coordinates, velocities, previous coordinates) is
written to the shared folder, so lineage stays short and a lost executor costs one iteration's tasks. The driver
holds scalars and, for centring, one mean vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import scaling_loss, space
from ..functions.vectors import combined, scaled
from ..operators.affinities import affinities, affinities_of_pairs
from ..operators.components import principal_components, projected
from ..operators.descent import momentum_step
from ..operators.metrics import all_metrics
from ..operators.pairs import all_pairs
from ..operators.similarity import loss_and_gradient, scaling_gradient
from ..storage import Stored

#: Called after each iteration with (iteration, loss, points, phase); False ends the fit.
Callback = Callable[[int, float, DataFrame, str], bool | None]


def init_scale(d: int) -> float:
    return 1 / math.sqrt(2 * d)


def initial_points(data: DataFrame | None, ids: DataFrame, k: float, d: int = 2, method: str = "random", scale: float | None = None, seed: int = 42) -> DataFrame:
    """(id, vec): small random points, or principal components of ``data`` (id, vec), lifted to the space.

    Components are divided by the standard deviation of all their entries; each component's sign makes the largest
    loading positive."""
    scale = init_scale(d) if scale is None else scale
    if method == "random":
        flat = ids.select("id", F.array(*(F.randn(seed + c) * scale for c in range(d))).alias("s"))
    elif method == "pca":
        if data is None:
            raise ValueError("principal components need data")
        loadings, _, mean = principal_components(data, d)
        parts = projected(data, loadings, mean)
        std = parts.select(F.explode("s").alias("e")).agg(F.stddev_samp("e").alias("std")).first().std or 0.0
        flat = parts.select("id", scaled(scale / std if std > 1e-10 else scale, F.col("s")).alias("s"))
    else:
        raise ValueError(f"unknown initialisation {method!r}")
    return flat.select("id", space(k).lift(F.col("s")).alias("vec"))


@dataclass
class Fit:
    """A fitted embedding."""

    k: float
    points: DataFrame
    losses: list[tuple[int, float, str]] = field(default_factory=list)

    def distances(self) -> DataFrame:
        return all_pairs(self.points, self.k)


def fit_embedding(
    data: DataFrame,
    k: float = -1.0,
    d: int = 2,
    iterations: int = 1000,
    perplexity: float = 30.0,
    rate: float = 200.0,
    early_iterations: int = 250,
    early_factor: float = 12.0,
    momentum_early: float = 0.5,
    momentum_main: float = 0.8,
    scaling_weight: float = 0.0,
    scaling_kind: str = "hard_barrier",
    method: str = "pca",
    scale: float | None = None,
    distances: DataFrame | None = None,
    callback: Callback | None = None,
    seed: int = 42,
    start: DataFrame | None = None,
) -> Fit:
    """An embedding of ``data`` (id, vec) in the space of curvature ``k``.

    Points begin at ``start`` (id, vec: d coordinates, which are lifted) where given. Affinities come from ``distances`` (i, j, d) where given. The loss of an iteration is that before its step, with
    exaggerated affinities in the early phase. Points are centred after each step; velocities are carried from the
    points before it."""
    at = space(k)
    v = Stored(affinities(data, perplexity) if distances is None else affinities_of_pairs(distances, perplexity), "affinities")
    begun = initial_points(data, data.select("id"), k, d, method, scale, seed) if start is None else start.select("id", at.lift(F.col("vec")).alias("vec"))
    current = Stored(begun, "state")
    moving, rows, old = None, current.df, []
    out = Fit(k, current.df)
    for iteration in range(iterations):
        early = iteration < early_iterations
        factor, phase = (early_factor, "early") if early else (1.0, "main")
        points = rows.select("id", "vec")
        loss, grads, used = loss_and_gradient(points, v.df, k, factor)
        if scaling_weight:
            loss += scaling_weight * scaling_loss(points, at, scaling_kind).first().loss
            more = scaling_gradient(points, k, scaling_kind).withColumnRenamed("grad", "more")
            grads = grads.join(more, "id").select("id", combined(1.0, F.col("grad"), scaling_weight, F.col("more")).alias("grad"))
        stepped = Stored(momentum_step(points, grads, moving, rate, momentum_early if early else momentum_main, k), "state")
        old.append(current)
        for table in [*used, *old[:-2]]:  # callbacks may still read the last states
            table.discard()
        old = old[-2:]
        current, rows = stepped, at.centred(stepped.df)  # a map of the stored rows
        moving = rows.select("id", "velocity", "prev")
        out.points = rows.select("id", "vec")
        out.losses.append((iteration, float(loss), phase))
        if callback and callback(iteration, float(loss), out.points, phase) is False:
            break
    return out


def sweep(data: DataFrame, curvatures: list[float], **options: object) -> DataFrame:
    """(curvature, and a column per metric): an embedding fitted in the space of each curvature, and how good it is.

    ``options`` are those of :func:`~orbifold.plans.sweep.fit_sweep`, which fits all at once; ``data`` is (id, vec[, label])."""
    from .sweep import fit_sweep

    if not curvatures:
        raise ValueError("no curvatures are given")
    fitted, out = fit_sweep(data.select("id", "vec"), curvatures, **options), None
    for n, k in enumerate(curvatures):
        low = fitted.of(n)
        if "label" in data.columns:
            low = low.join(data.select("id", "label"), "id")
        row = all_metrics(data, low, k).select(F.lit(float(k)).alias("curvature"), "*")
        out = row if out is None else out.unionByName(row)
    return out
