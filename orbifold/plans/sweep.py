"""Fitting embeddings in spaces of several curvatures in one dataflow.

A point's coordinates in all spaces stand one after another in one array, as do its velocities. The affinities are found
once; an iteration passes over all pairs of blocks once and takes every space's kernel and gradient there, and gathers
the neighbours' coordinates once. So the number of jobs, and what is moved but for the coordinates themselves, are those of
a single fit, whatever the number of curvatures. The driver holds a few sums and a mean vector for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Space, mean_vector, space
from ..functions.vectors import combined, dot, scaled
from ..operators.affinities import affinities, affinities_of_pairs
from ..operators.descent import MOST_VELOCITY
from ..operators.pairs import Block, pair_blocks
from ..operators.similarity import TINY, as_lists, repelled, vector_sum
from ..storage import Stored
from .fit import initial_points


@dataclass
class Sweep:
    """Fits in several spaces: their points (id, vec: the coordinates of all) and the losses of each iteration, a list each."""

    spaces: list[Space]
    d: int
    points: DataFrame
    losses: list[list[float]] = field(default_factory=list)

    @property
    def slices(self) -> list[slice]:
        """Where each space's coordinates stand."""
        ends = np.cumsum([0, *(at.ambient(self.d) for at in self.spaces)]).tolist()
        return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def parts(self, x: Column) -> list[Column]:
        """Each space's coordinates of an array of all."""
        return [F.slice(x, s.start + 1, s.stop - s.start) for s in self.slices]

    def of(self, n: int) -> DataFrame:
        """(id, vec) in the n-th space."""
        return self.points.select("id", self.parts(F.col("vec"))[n].alias("vec"))


def _gradients(sweep: Sweep, points: DataFrame, v: DataFrame, factor: float) -> tuple[list[float], DataFrame, list[Stored]]:
    """The loss in each space, (id, grad) with the gradients of all, and the tables these are read from."""
    spaces, slices, n = sweep.spaces, sweep.slices, len(sweep.spaces)
    width = slices[-1].stop

    def own(block: Block, s: slice) -> Block:
        return Block(block.ids, block.x[:, s], block.labels, {}, number=block.number)

    names = [f"s{c}" for c in range(n + width)]

    def repel(a: Block, b: Block) -> pa.Table:
        z, away = zip(*(repelled(own(a, s), own(b, s), at) for at, s in zip(spaces, slices, strict=True)), strict=True)
        told = np.column_stack([*z, *away])
        return pa.table({"id": a.ids if a.number == b.number else np.concatenate([a.ids, b.ids])} | {c: told[:, k] for k, c in enumerate(names)})

    def attract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, ds = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in (1, 2, 4))
                v = batch.column(3).to_numpy() * factor
                told: list[list[np.ndarray]] = [[], [], []]
                for c, (at, s) in enumerate(zip(spaces, slices, strict=True)):
                    kernel = 1 / (1 + ds[:, c] ** 2)
                    q = kernel / zs[c]
                    w = v * q / (q + TINY)
                    for out, value in zip(told, (w, -v * np.log(q + TINY), at.pulls(x[:, s], y[:, s], 4 * ds[:, c] * kernel * w)), strict=True):
                        out.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(np.column_stack([a for out in told for a in out]))], ["id", "sums"])

    parts = pair_blocks(points, repel, ", ".join(["id long", *(f"{c} double" for c in names)]), sums=dict.fromkeys(names, "sum"), halves=True)
    away = Stored(vector_sum(parts.select("id", F.array(*names).alias("sums")), "id", "sums", n + width, []), "away")
    zs = [z or 1e-10 for z in away.df.agg(*(F.sum(F.col("sums")[c]) for c in range(n))).first()]
    x = points.select(F.col("id").alias("i"), F.col("vec").alias("x"))
    y = points.select(F.col("id").alias("j"), F.col("vec").alias("y"))
    ds = F.array(*(at.distance(a, b) for at, a, b in zip(spaces, sweep.parts(F.col("x")), sweep.parts(F.col("y")), strict=True)))
    near = v.join(x, "i").join(y, "j").select("i", "x", "y", "v", ds.alias("ds"))
    near = Stored(vector_sum(near.mapInArrow(attract, "id long, sums array<double>"), "id", "sums", 2 * n + width, []), "near")
    sums = [s or 0.0 for s in near.df.agg(*(F.sum(F.col("sums")[c]) for c in range(2 * n))).first()]
    out = away.df.select("id", F.slice("sums", n + 1, width).alias("away")).join(near.df.select("id", F.slice("sums", 2 * n + 1, width).alias("pull")), "id", "left")
    pull = F.coalesce("pull", F.transform("away", lambda a: F.lit(0.0)))
    parts = [combined(1.0, p, -sums[c] / zs[c], a) for c, (p, a) in enumerate(zip(sweep.parts(pull), sweep.parts(F.col("away")), strict=True))]
    return sums[n:], out.select("id", F.concat(*parts).alias("grad")), [away, near]


def _moved(sweep: Sweep, rows: DataFrame, rates: list[float], momentum: float) -> DataFrame:
    """(id, vec, velocity, prev) a step on from (id, vec, grad[, velocity, prev]); velocities are kept to a norm in each space."""
    bad = F.exists("grad", lambda g: F.isnan(g) | (F.abs(g) == float("inf")))
    grad = F.when(bad, F.raise_error(F.lit("a gradient is not finite")).cast("array<double>")).otherwise(F.col("grad"))
    rows = rows.withColumn("grad", grad)
    xs = sweep.parts(F.col("vec"))
    turned = [at.tangent(x, g) for at, x, g in zip(sweep.spaces, xs, sweep.parts(F.col("grad")), strict=True)]
    if "velocity" in rows.columns:
        carried = [at.transport(p, x, v) for at, p, x, v in zip(sweep.spaces, sweep.parts(F.col("prev")), xs, sweep.parts(F.col("velocity")), strict=True)]
        new = [combined(momentum, c, -rate, g) for c, rate, g in zip(carried, rates, turned, strict=True)]
    else:
        new = [scaled(-rate, g) for rate, g in zip(rates, turned, strict=True)]
    rows = rows.withColumn("velocity", F.concat(*new))
    vs = sweep.parts(F.col("velocity"))
    sizes = rows.agg(*(F.sqrt(F.sum(dot(v, v))) for v in vs)).first()
    rows = rows.withColumn("velocity", F.concat(*(scaled(MOST_VELOCITY / size if size and size > MOST_VELOCITY else 1.0, v) for size, v in zip(sizes, vs, strict=True))))
    return rows.select("id", F.concat(*(at.step(x, v) for at, x, v in zip(sweep.spaces, xs, vs, strict=True))).alias("vec"), "velocity", F.col("vec").alias("prev"))


def fit_sweep(
    data: DataFrame,
    curvatures: list[float],
    d: int = 2,
    iterations: int = 1000,
    perplexity: float = 30.0,
    rate: float | list[float] = 200.0,
    early_iterations: int = 250,
    early_factor: float = 12.0,
    momentum_early: float = 0.5,
    momentum_main: float = 0.8,
    method: str = "pca",
    scale: float | None = None,
    distances: DataFrame | None = None,
    callback: Callable[[int, list[float], Sweep], bool | None] | None = None,
    seed: int = 42,
    start: DataFrame | None = None,
) -> Sweep:
    """Embeddings of ``data`` (id, vec) in the spaces of all ``curvatures``, each as :func:`~orbifold.plans.fit.fit_embedding`
    makes it; ``rate`` is one for all or a list. All begin at the same d coordinates, lifted to each space."""
    spaces = [space(k) for k in curvatures]
    rates = [float(rate)] * len(spaces) if isinstance(rate, int | float) else [float(r) for r in rate]
    v = Stored(affinities(data, perplexity) if distances is None else affinities_of_pairs(distances, perplexity), "affinities")
    flat = initial_points(data, data.select("id"), 0.0, d, method, scale, seed) if start is None else start
    begun = Stored(flat.select("id", "vec"), "start")
    current = Stored(begun.df.select("id", F.concat(*(at.lift(F.col("vec")) for at in spaces)).alias("vec")), "state")
    begun.discard()
    out, rows, old = Sweep(spaces, d, current.df), current.df, []
    for iteration in range(iterations):
        early = iteration < early_iterations
        losses, grads, used = _gradients(out, rows.select("id", "vec"), v.df, early_factor if early else 1.0)
        stepped = Stored(_moved(out, rows.join(grads, "id"), rates, momentum_early if early else momentum_main), "state")
        old.append(current)
        for table in [*used, *old[:-2]]:  # callbacks may still read the last states
            table.discard()
        old = old[-2:]
        mean = mean_vector(stepped.df)
        current = stepped
        centred = [at.recentred(x, mean[s]) for at, x, s in zip(spaces, out.parts(F.col("vec")), out.slices, strict=True)]
        rows = stepped.df.withColumn("vec", F.concat(*centred))  # a map of the stored rows
        out.points = rows.select("id", "vec")
        out.losses.append(losses)
        if callback and callback(iteration, losses, out) is False:
            break
    v.discard()
    return out
