"""Principal components of points of any width, by a block Krylov space.

Each pass over the points multiplies their covariance with a narrow block of directions, summed up task by task; the
driver keeps the blocks (width x :data:`WIDTH` numbers each), and never a width x width matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions in a block beyond the wanted components, and the fewest of a block.
MORE, WIDTH = 8, 16
#: A component is found where its residual is below this part of the largest variance.
TOLERANCE = 1e-10
#: Rows that a task turns into a matrix at once.
ROWS = 1_024


def _matrices(batch: pa.RecordBatch, mean: np.ndarray) -> Iterator[np.ndarray]:
    """The centred vectors of a batch, some rows at a time."""
    for start in range(0, batch.num_rows, ROWS):
        some = batch.slice(start, ROWS)
        yield some.column(some.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1) - mean


def _summed(points: DataFrame, columns: int, width: int, mean: np.ndarray, q: np.ndarray | None) -> np.ndarray:
    """The sum over ``points`` (vec) of x (x q), x less the mean, a row per coordinate; without ``q`` the sum of x."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((width, columns))
        for batch in batches:
            for x in _matrices(batch, mean):
                z += x.T @ (np.ones((len(x), 1)) if q is None else x @ q)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *(pa.array(z[:, m]) for m in range(columns))], ["c", *(f"z{m}" for m in range(columns))])

    rows = points.mapInArrow(add, "c long, " + ", ".join(f"z{m} double" for m in range(columns)))
    found = rows.groupBy("c").agg(*(F.sum(f"z{m}").alias(f"z{m}") for m in range(columns))).toPandas().sort_values("c")  # a row per coordinate
    return found.drop(columns="c").to_numpy()


def principal_components(points: DataFrame, d: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loadings (width x d), variances (d) and the mean of the vectors of ``points`` (id, vec), the largest variance first.

    The largest loading of each component is positive. Rows without a vector take no part; all others have to be equally
    wide, and at least ``d``. Beyond the rank of the points variances are 0 and loadings any that are orthonormal to the
    others."""
    rows = points.where("vec IS NOT NULL").select(F.col("vec").cast("array<double>").alias("vec"))
    told = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("width")).first()
    if not told.n:
        raise ValueError("there are no vectors")
    if told.least != told.width:
        raise ValueError("vectors are not equally wide")
    if d > told.width:
        raise ValueError(f"vectors of {told.width} coordinates have no {d} components")
    n, width = told.n, told.width
    mean = _summed(rows, 1, width, np.zeros(width), None)[:, 0] / n
    columns = min(width, max(WIDTH, d + MORE))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, columns)))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    while True:
        z = _summed(rows, q.shape[1], width, mean, q) / max(1, n - 1)
        basis, image = np.hstack([basis, q]), np.hstack([image, z])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:d], turn[:, ::-1][:, :d]
        residual = np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)
        if basis.shape[1] >= width or residual.max() <= TOLERANCE * max(values[0], np.finfo(float).tiny):
            break
        left = z / max(np.linalg.norm(z), np.finfo(float).tiny)
        for _ in range(2):  # twice, as one pass leaves rounding errors
            left = left - basis @ (basis.T @ left)
        u, s, _ = np.linalg.svd(left, full_matrices=False)
        q = u[:, s > 1e-13][:, : width - basis.shape[1]]
        if not q.shape[1]:
            break
        q = q - basis @ (basis.T @ q)
        q = np.linalg.qr(q)[0]
    loadings = basis @ turn
    loadings *= np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(d)] > 0, 1.0, -1.0)
    return loadings, np.maximum(values, 0.0), mean


def projected(points: DataFrame, loadings: np.ndarray, mean: np.ndarray) -> DataFrame:
    """(id, s): the coordinates of the vectors of ``points`` (id, vec) along the components."""
    d = loadings.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.vstack([x @ loadings for x in _matrices(batch, mean)] or [np.zeros((0, d))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(s), pa.list_(pa.float64()))], ["id", "s"])

    rows = points.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(project, f"id {rows.schema['id'].dataType.simpleString()}, s array<double>")
