"""Student-t similarity of embedded points, its divergence from affinities, and the gradient in closed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import NARROW, STRIP, Space, space
from ..functions.vectors import scaled
from ..storage import Stored
from .pairs import BLOCK, Block, _part, all_pairs, pair_blocks

TINY = 1e-12


def student_t(d: Column, dof: float = 1.0) -> Column:
    return F.pow(1 + d * d / dof, -(dof + 1) / 2)


def student_t_slope(d: Column) -> Column:
    """Derivative of the kernel with one degree of freedom."""
    return -2 * d / F.pow(1 + d * d, 2)


def q_matrix(points: DataFrame, k: float = 0.0) -> DataFrame:
    """(i, j, q): kernel of each pair by the sum of all."""
    rows = all_pairs(points, k).withColumn("kernel", student_t(F.col("d")))
    return rows.crossJoin(partition_sum(points, k)).select("i", "j", (F.col("kernel") / F.col("z")).alias("q"))


def partition_sum(points: DataFrame, k: float = 0.0) -> DataFrame:
    """One row (z): the kernel summed over all ordered pairs, from sums per block pair; 1e-10 where it is 0."""
    at = space(k)

    def work(a: Block, b: Block) -> pa.Table:
        total, some = 0.0, STRIP if a.x.shape[1] <= NARROW else BLOCK
        for s in range(0, len(a.ids), some):
            d = at.fast_distances(a.x[s : s + some], b.x)
            _part(d, a.ids[s : s + some], b.ids)
            d *= d
            d += 1
            total += float(np.divide(1.0, d, out=d).sum())
        return pa.table({"z": [total * (1 if a.number == b.number else 2)]})

    z = F.sum("z")
    return pair_blocks(points, work, "z double", halves=True).agg(F.when(z > 0, z).otherwise(1e-10).alias("z"))


def kl_loss(points: DataFrame, v: DataFrame, k: float = 0.0, exaggeration: float = 1.0) -> DataFrame:
    """One row (loss): -sum V ln(Q + 1e-12), over the pairs that V holds."""
    x = points.select(F.col("id").alias("i"), F.col("vec").alias("x"))
    y = points.select(F.col("id").alias("j"), F.col("vec").alias("y"))
    near = v.join(x, "i").join(y, "j").select("v", space(k).distance(F.col("x"), F.col("y")).alias("d"))  # v is made once
    q = student_t(F.col("d")) / F.col("z")
    return near.crossJoin(partition_sum(points, k)).agg(F.sum(-exaggeration * F.col("v") * F.ln(q + TINY)).alias("loss"))


def gradient(points: DataFrame, v: DataFrame, k: float = 0.0, exaggeration: float = 1.0) -> DataFrame:
    """(id, grad): gradient of the divergence in ambient coordinates."""
    return loss_and_gradient(points, v, k, exaggeration)[1]


def loss_and_gradient(points: DataFrame, v: DataFrame, k: float = 0.0, exaggeration: float = 1.0) -> tuple[float, DataFrame, list[Stored]]:
    """The divergence of ``points`` (id, vec) from ``v`` (i, j, v), (id, grad): its gradient in ambient coordinates, and
    the tables that the gradient is read from.

    With kernels K, their sum Z, Q = K / Z and W = V Q / (Q + 1e-12), the derivative by a distance is
    4 d K (W - S Q), S being the sum of W. The part with W lives on V's pairs, gathered by joins; the other is
    summed over blocks, in the one pass over all pairs. Both take the space's chain rule for distances and are
    stored, as the sums Z and S (two numbers on the driver) are needed before they are put together."""
    at = space(k)
    first = points.select(F.size("vec").alias("d")).first()
    d = first.d if first else 0

    names = [f"a{c}" for c in range(d)]

    def repel(a: Block, b: Block) -> pa.Table:
        z, away = repelled(a, b, at)
        ids = a.ids if a.number == b.number else np.concatenate([a.ids, b.ids])
        return pa.table({"id": ids, "z": z} | {n: away[:, c] for c, n in enumerate(names)})

    def attract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in (1, 2))
                v, d = batch.column(3).to_numpy() * exaggeration, batch.column(4).to_numpy()
                kernel = 1 / (1 + d * d)
                q = kernel / z
                w = v * q / (q + TINY)
                pull = at.pulls(x, y, 4 * d * kernel * w)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(-v * np.log(q + TINY)), as_lists(pull)], ["id", "w", "loss", "pull"])

    parts = pair_blocks(points, repel, ", ".join(["id long", "z double", *(f"{n} double" for n in names)]), sums=dict.fromkeys(["z", *names], "sum"), halves=True)
    away = Stored(vector_sum(parts.select("id", "z", F.array(*names).alias("away")), "id", "away", d, ["z"]), "away")
    z = away.df.agg(F.sum("z").alias("z")).first().z or 1e-10
    x = points.select(F.col("id").alias("i"), F.col("vec").alias("x"))
    y = points.select(F.col("id").alias("j"), F.col("vec").alias("y"))
    near = v.join(x, "i").join(y, "j").select("i", "x", "y", "v", at.distance(F.col("x"), F.col("y")).alias("d"))
    near = Stored(vector_sum(near.mapInArrow(attract, "id long, w double, loss double, pull array<double>"), "id", "pull", d, ["w", "loss"]), "near")
    sums = near.df.agg(F.sum("w").alias("w"), F.sum("loss").alias("loss")).first()
    zero = F.transform("away", lambda a: F.lit(0.0))
    share = (sums.w or 0.0) / z
    out = away.df.join(near.df.select("id", "pull"), "id", "left")
    grad = F.zip_with(F.coalesce("pull", zero), "away", lambda p, a: p - a * share)
    return float(sums.loss or 0.0), out.select("id", grad.alias("grad")), [away, near]


def repelled(a: Block, b: Block, at: Space) -> tuple[np.ndarray, np.ndarray]:
    """The kernel summed over the other block, and the gradient that pushes away, of the points of a, then of b if it is another."""
    n, own, met = len(a.ids), a.number == b.number, bool(np.isin(b.ids, a.ids).any())
    z, away = np.zeros(n + (0 if own else len(b.ids))), np.zeros((n + (0 if own else len(b.ids)), a.x.shape[1]))
    some = STRIP if a.x.shape[1] <= NARROW else BLOCK
    for s in range(0, n, some):
        x = a.x[s : s + some]
        d, w = at.slopes(x, b.x)
        kernel = 1 / (1 + d * d)
        if met:
            kernel[a.ids[s : s + some, None] == b.ids[None, :]] = 0.0
        d *= kernel
        d *= kernel
        w *= d
        one, two = at.pulled(x, b.x, w, not own)
        z[s : s + len(x)], away[s : s + len(x)] = kernel.sum(axis=1), one
        if not own:
            z[n:] += kernel.sum(axis=0)
            away[n:] += two
    return z, 4 * away


def as_lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def vector_sum(df: DataFrame, key: str, vec: str, d: int, sums: list[str]) -> DataFrame:
    """Sums of the ``d`` coordinates of ``vec``, and of further columns, per ``key``."""
    by = df.groupBy(key).agg(*(F.sum(F.col(vec)[c]).alias(f"c{c}") for c in range(d)), *(F.sum(s).alias(s) for s in sums))
    return by.select(key, F.array(*(f"c{c}" for c in range(d))).cast("array<double>").alias(vec), *sums)


def scaling_gradient(points: DataFrame, k: float, kind: str) -> DataFrame:
    """(id, grad) of the scaling loss."""
    from ..functions.geometry import CLAMP, Euclidean, Sphere
    from ..functions.vectors import dot

    at, x = space(k), F.col("vec")
    zeros = F.transform(x, lambda a: F.lit(0.0))
    if isinstance(at, Sphere):
        return points.select("id", zeros.alias("grad"))
    if isinstance(at, Euclidean):
        stats = points.agg(F.sqrt(F.avg(dot(x, x))).alias("rms"), F.count("*").alias("n"))
        factor = F.when(F.col("rms") > 0, 2 * (F.col("rms") - 1) / (F.col("n") * F.col("rms"))).otherwise(0.0)
        return points.crossJoin(stats).select("id", scaled(factor, x).alias("grad"))
    c = x[0] / at.r
    g = F.acosh(F.greatest(c, F.lit(1 + CLAMP))) * at.r
    rows = points.withColumns({"g": g, "slope": F.when(c > 1 + CLAMP, 1 / F.sqrt(c * c - 1)).otherwise(0.0)})
    stats = rows.agg(F.sqrt(F.avg(F.col("g") * F.col("g"))).alias("rms"), F.count("*").alias("n"))
    over = F.col("g") - 3 * at.r
    how = {
        "rms": 2 * (F.col("rms") - 1) * F.col("g") / (F.col("n") * F.col("rms")),
        "hard_barrier": 2 * F.greatest(over, F.lit(0.0)) / F.col("n"),
        "softplus_barrier": 1 / (1 + F.exp(-over)) / F.col("n"),
        "mean_distance": 1 / F.col("n"),
    }
    if kind not in how:
        raise ValueError(f"unknown scaling loss {kind!r}")
    first = how[kind] * F.col("slope")
    return rows.crossJoin(stats).select("id", F.transform(x, lambda a, i: F.when(i == 0, first).otherwise(0.0)).alias("grad"))
