"""Centroid clustering of whole numbers, screened by block norms.

Components x become floor(256 x). A vector is stored with its compressed form, the norms of its :data:`SEGMENTS` equal
segments. By Cauchy and Schwarz a segment's part of ``x.c`` is at most the product of the two norms, so that
``|x|^2 + |c|^2 - 2 sum(|x_s| |c_s|)`` is a lower bound of the squared distance. A task takes the bounds of a batch to
all centroids as one small matrix product, the exact distance to the centroid of least bound as an upper bound, and then
exact integer distances to those centroids alone whose bound does not exceed it. How many that are depends on the data;
the result does not.

The first centroids are the k vectors of least sha256 of ``seed:<vec_id>``. A round assigns all vectors, and tasks send
a count and sums for each centroid, which Spark adds up; means are rounded down exactly. The driver holds k centroids.

Kept are vectors of the wanted length without null or non-finite components. Components are cut to :data:`LARGEST` in
size, so that distances fit 64 bits; sums of distances beyond 64 bits count as the greatest number of 64 bits. Rows with
a null vec_id are clustered, but are first centroids only where other rows are too few. Repeated rows are rows like any
other; among equal hashes the smaller vector comes first. With fewer than k vectors there are as many centroids. Ties
go to the smaller number. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

SCALE, SEGMENTS = 256, 16
#: Components are cut to this size: 64 squares of differences stay below 2^63.
LARGEST = 1 << 26
#: Products of whole numbers in doubles are exact below this.
_EXACT = 1 << 53
_MOST = (1 << 63) - 1


def segment_norms(x: np.ndarray) -> np.ndarray:
    """The norms of the segments of each row."""
    parts = np.array_split(x.astype(float), min(SEGMENTS, max(1, x.shape[1])), axis=1)
    return np.stack([np.sqrt((p * p).sum(axis=1)) for p in parts], axis=1)


def lower_bounds(norms: np.ndarray, centre_norms: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances, rounding included, from the segment norms of vectors and centroids."""
    squares = (norms * norms).sum(axis=1)[:, None] + (centre_norms * centre_norms).sum(axis=1)
    return squares - 2 * (norms @ centre_norms.T) - 1e-6 * squares - 1e-6


def nearest(x: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, the exact squared distance, and how many exact distances were taken.

    ``x`` and ``centres`` hold whole numbers (int64), ``norms`` the rows' segment norms."""
    narrow = x.size and 2 * x.shape[1] * float(np.abs(x).max()) * float(np.abs(centres).max()) < _EXACT
    rows, own = (x.astype(float), centres.astype(float)) if narrow else (x, centres)
    squares, own_squares = (x * x).sum(axis=1), (centres * centres).sum(axis=1)

    def distance(at: np.ndarray, c: int) -> np.ndarray:
        return squares[at] + own_squares[c] - 2 * (rows[at] @ own[c]).astype(np.int64)

    bounds = lower_bounds(norms, segment_norms(centres))
    first = bounds.argmin(axis=1)
    best, cluster = np.zeros(len(x), np.int64), first.astype(np.int32)
    for c in np.unique(first):
        at = np.flatnonzero(first == c)
        best[at] = distance(at, c)
    taken = len(x)
    for c in range(len(centres)):
        at = np.flatnonzero((bounds[:, c] <= best) & (first != c))
        d = distance(at, c)
        taken += len(at)
        better = (d < best[at]) | (d == best[at]) & (c < cluster[at])
        best[at[better]], cluster[at[better]] = d[better], c
    return cluster, best, taken


def compressed(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v, norms) of the vectors (vec_id, embedding) that are kept: whole numbers and segment norms."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False)).clip(-LARGEST, LARGEST).reshape(-1, dim)
            norms = segment_norms(x)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(kind)) for a, kind in ((x.astype(np.int32), pa.int32()), (norms, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["vec_id", "v", "norms"])

    return kept.mapInArrow(compress, "vec_id long, v array<int>, norms array<double>")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _sums(rows: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors of each centroid and the sums of their components: a row for each centroid and task is sent."""
    dim = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                cluster, _, _ = nearest(x, _matrix(batch.column(1), float), centres)
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(cluster, minlength=len(centres))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sent = rows.select("v", "norms").mapInArrow(assign, "cluster int, n long, total array<long>")
    added = sent.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)))
    return {r.cluster: (r.n, [r[f"t{i}"] for i in range(dim)]) for r in added.collect()}  # a row for each centroid


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    held = Stored(compressed(vectors, dim), "compressed")
    rows = held.df
    first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, total) in _sums(rows, centres).items():
            centres[c] = [t // n for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = nearest(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), float), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = Stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters").df
    held.discard()
    told = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each centroid
    inertia = min(_MOST, sum(told.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = [(c, min(_MOST, total), inertia, names[c]) for c, total in told.items()]
    return out.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
