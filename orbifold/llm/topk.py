"""Exact top-k by integer inner product: ball-tree branch and bound per shard, with shared k-th scores.

Components x become floor(1024 x). The splits of a ball tree over a bounded sample deal all vectors into cells, whose
centres and exact radii the tasks get; cells of more than :data:`SHARD` rows are cut into shards. Queries go out in
:data:`WAVES`: first to the cell of greatest upper bound ``q.c + |q| r``, then to the next few, then to all others, and
only to cells whose bound reaches the query's k-th score so far. A task holds one shard and the queries sent there (at
most a block of :data:`QUERIES`), builds a ball tree over the shard and bounds its nodes for some queries at a time; each
query takes leaves in the order of its own bounds, in :data:`TURNS`, and none whose bound does not reach its k-th score.
The queries that take a leaf in the same turn are multiplied with its vectors together.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; components of
:data:`LARGEST` or more in size count as non-finite. Empty vectors score 0 with one another. Vectors are compared with
those of their own length. A query's own id is no candidate for it, however often it occurs; of rows that repeat a
query's id the one with the least vector asks. Other repeated rows are candidates each, listed in order of score and
id. Ties go to the smaller id. Scores beyond 64 bits count as the nearest number of 64 bits. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, in_task

SHARD, QUERIES, LEAF = 16_384, 65_536, 64
#: Rows of a cell aimed at, cells of vectors of one length at most, and sampled rows that the splits are taken from.
CELL, CELLS, SAMPLE = 4_096, 1_024, 8_192
#: Lengths of vectors that have cells of their own, the most frequent ones; others are always searched, in so many shards.
LENGTHS, OTHER_SHARDS = 8, 64
#: Places in the order of bounds at which the waves of cells end.
WAVES = (1, 8, None)
#: Queries that a task bounds at once, and places in a query's order of leaves at which turns end.
TOGETHER, TURNS = 512, (1, 4, 16, None)
SCALE, LARGEST = 1024, 1e150
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Ball:
    """A node of the tree: its rows, centre and radius, and either two children or none."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: tuple[Ball, Ball] | None = None


def spread(own: np.ndarray) -> np.ndarray:
    """The direction between two far-apart rows."""
    a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    return own[((own - a) ** 2).sum(axis=1).argmax()] - a


def ball_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Ball:
    """Splits at the median along the direction between two far-apart rows until leaves are small."""
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows]
    centre = own.mean(axis=0)
    far = float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max())
    ball = Ball(rows, centre, far * (1 + 1e-12))
    if len(rows) > LEAF and far > 0:
        order = np.argsort(own @ spread(own), kind="stable")
        half = len(rows) // 2
        ball.children = (ball_tree(x, rows[order[:half]]), ball_tree(x, rows[order[half:]]))
    return ball


def upper_bounds(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of ``q`` with points of balls, rounding included."""
    norm = math.sqrt(float(q @ q))
    u = centres @ q
    return u + norm * radii + 1e-9 * (np.abs(u) + norm * radii) + 1e-11 * norm * np.sqrt((centres * centres).sum(axis=-1)) + 1e-3


def products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of rows of whole numbers, cut to 64 bits."""
    if not x.size or x.shape[1] * np.abs(x).max() * np.abs(q).max() < 2.0**53:
        return [int(s) for s in (x @ q).tolist()]
    whole = [int(v) for v in q.tolist()]
    return [max(_LOW, min(_HIGH, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x.tolist()]


def leaf_bounds(tree: Ball, q: np.ndarray) -> tuple[list[Ball], np.ndarray]:
    """The leaves, and for each query (a row of ``q``) upper bounds of its products with them: a leaf has no more than the
    nodes above it."""
    norm, leaves, bounds = np.sqrt((q * q).sum(axis=1)), [], []

    def go(ball: Ball, above: np.ndarray) -> None:
        u = q @ ball.centre
        far = norm * ball.radius
        u = np.minimum(above, u + far + 1e-9 * (np.abs(u) + far) + 1e-11 * norm * math.sqrt(float(ball.centre @ ball.centre)) + 1e-3)
        for child in ball.children or ():
            go(child, u)
        if not ball.children:
            leaves.append(ball)
            bounds.append(u)

    go(tree, np.full(len(q), np.inf))
    return leaves, np.stack(bounds, axis=1)


def search(tree: Ball, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``q``, ids, scores) of the k best vectors of the tree for each query; those below ``least`` may be missing."""
    leaves, bounds = leaf_bounds(tree, q)
    place = np.empty(bounds.shape, np.int64)
    np.put_along_axis(place, np.argsort(-bounds, axis=1, kind="stable"), np.broadcast_to(np.arange(len(leaves)), bounds.shape), axis=1)
    reach = least.copy()
    score, found, has = np.full((len(q), k), _LOW), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), bool)
    narrow = x.size and x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) < 2.0**53
    first = 0
    for last in TURNS:
        for n, leaf in enumerate(leaves):
            rows = np.flatnonzero((place[:, n] >= first) & (place[:, n] < (last or len(leaves))) & (bounds[:, n] >= reach.astype(float)))
            if not len(rows):
                continue
            members, points = ids[leaf.rows], x[leaf.rows]
            s = (q[rows] @ points.T).astype(np.int64) if narrow else np.array([products(points, q[r]) for r in rows], np.int64)
            counts = (s >= reach[rows, None]) & (members != own[rows, None])
            better = counts.any(axis=1)
            rows, s, counts = rows[better], s[better], counts[better]
            if len(rows):
                every = np.concatenate([score[rows], s], axis=1), np.concatenate([found[rows], np.broadcast_to(members, s.shape)], axis=1), np.concatenate([has[rows], counts], axis=1)
                order = np.lexsort((every[1], ~every[0], ~every[2]), axis=1)[:, :k]  # what counts, by falling score and rising id
                score[rows], found[rows], has[rows] = (np.take_along_axis(e, order, axis=1) for e in every)
                full = rows[has[rows, k - 1]]
                reach[full] = np.maximum(reach[full], score[full, k - 1])
        first = last or first
    rows, at = np.nonzero(has)
    return rows, found[rows, at], score[rows, at]


def matrix(column: pa.Array) -> np.ndarray:
    """floor(1024 x) of a column of arrays of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).reshape(len(column), -1)


class Cells:
    """The splits of a complete tree over sampled vectors of one length, and the cells' centres."""

    def __init__(self, x: np.ndarray, depth: int) -> None:
        self.depth, inner = depth, (1 << depth) - 1
        self.directions, self.cuts = np.zeros((inner, x.shape[1])), np.zeros(inner)
        self.centres = np.zeros((1 << depth, x.shape[1]))
        self._split(x, x.mean(axis=0), 0)

    def _split(self, x: np.ndarray, centre: np.ndarray, node: int) -> None:
        centre = x.mean(axis=0) if len(x) else centre
        if node >= len(self.cuts):
            self.centres[node - len(self.cuts)] = centre
            return
        right = np.zeros(len(x), bool)
        if len(x):
            self.directions[node] = spread(x)
            along = x @ self.directions[node]
            self.cuts[node] = np.median(along)
            right = along > self.cuts[node]
        self._split(x[~right], centre, 2 * node + 1)
        self._split(x[right], centre, 2 * node + 2)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.directions[node]).sum(axis=1) > self.cuts[node])
        return node - len(self.cuts)


def placed(base: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """``base`` (vec_id, v, dim) with its cell and its distance to the cell's centre."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d, c in cells.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    x = matrix(batch.column(1).take(pa.array(at)))
                    cell[at] = own = c.of(x)
                    far[at] = np.sqrt(((x - c.centres[own]) ** 2).sum(axis=1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["vec_id", "v", "dim", "cell", "far"])

    return base.mapInArrow(place, "vec_id long, v array<double>, dim int, cell int, far double")


def routed(asked: DataFrame, cells: dict[int, Cells], sizes: dict[tuple[int, int], tuple[int, float]], first: int, last: int | None) -> DataFrame:
    """``asked`` (vec_id, v, dim, block, least) once for each shard (cell, shard) of the cells whose places in the order
    of bounds are ``first`` to ``last`` and whose bounds reach ``least``."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: [c for c in range(len(t.centres)) if (d, c) in sizes] for d, t in cells.items()}
        for batch in batches:
            dims, least = batch.column(2).to_numpy(), batch.column(4).to_pylist()
            rows, cell, shard = [], [], []
            for k, d in enumerate(dims.tolist()):
                if d not in cells:
                    wanted = [(0, OTHER_SHARDS)] if first == 0 else []
                else:
                    own = known[d]
                    u = upper_bounds(cells[d].centres[own], np.array([sizes[d, c][1] for c in own]), matrix(batch.column(1).slice(k, 1))[0])
                    order = np.argsort(-u, kind="stable")[first:last].tolist()
                    wanted = [(own[j], sizes[d, own[j]][0]) for j in order if least[k] is None or u[j] >= least[k]]
                for c, shards in wanted:
                    rows += [k] * shards
                    cell += [c] * shards
                    shard += range(shards)
                if len(rows) > 50_000 or k + 1 == len(dims):
                    some = batch.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(shard, pa.int32())], [*batch.schema.names, "cell", "shard"])
                    rows, cell, shard = [], [], []

    return asked.mapInArrow(route, "vec_id long, v array<double>, dim int, block int, least long, cell int, shard int")


def _searched(k: int):
    def task(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if queries.num_rows and shard.num_rows:
            x, ids = matrix(shard["v"].combine_chunks()), shard["vec_id"].to_numpy()
            tree = ball_tree(x)
            q, own, least = matrix(queries["v"].combine_chunks()), queries["vec_id"].to_numpy(), queries["least"].fill_null(_LOW).to_numpy()
            for at in range(0, len(q), TOGETHER):
                s = slice(at, at + TOGETHER)
                rows, others, scores = search(tree, x, ids, q[s], own[s], k, least[s])
                found.append((own[s][rows], others, scores))
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    return task


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors`` for each row of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
        return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)

    base = usable(vectors).withColumn("dim", F.size("v"))
    counts = {r.dim: r["count"] for r in base.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()}
    n = sum(counts.values())
    sample = base.where(F.col("dim").isin(list(counts))).orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").toArrow()
    dims, by = sample["dim"].to_numpy(), sample["v"].combine_chunks()

    def splits() -> dict[int, Cells]:
        found = {}
        for d, m in counts.items():
            at = np.flatnonzero(dims == d)
            if len(at) and d:
                found[d] = Cells(matrix(by.take(pa.array(at))), max(0, math.ceil(math.log2(min(CELLS, m / CELL, len(at))))))
        return found

    cells = in_task(spark, splits) if n else {}
    base = Stored(placed(base, cells).withColumn("row", F.monotonically_increasing_id()), "cells")
    told = base.df.where(F.col("dim").isin(list(cells))).groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # LENGTHS x CELLS rows at most
    sizes = {(r.dim, r.cell): (-(-r.n // SHARD), r.far) for r in told}
    parts = spark.createDataFrame([(d, c, s) for (d, c), (s, _) in sizes.items()], "dim int, cell int, shards int")
    shard = F.pmod(F.col("row"), F.coalesce("shards", F.lit(OTHER_SHARDS))).cast("int")
    shards = base.df.join(F.broadcast(parts), ["dim", "cell"], "left").select("vec_id", "v", "dim", "cell", shard.alias("shard"))

    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = Stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")

    keys = ["dim", "cell", "shard", "block"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top, first = None, 0
    for last in WAVES:
        if top is None:
            now = asked.df.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = top.df.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
            now = asked.df.join(kth.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
        sent = Stored(routed(now.select("vec_id", "v", "dim", "block", "least"), cells, sizes, first, last), "sent")
        asking = spark.read.schema(sent.df.schema).parquet(sent.path).select(*keys).distinct()
        here = shards.join(asking, ["dim", "cell", "shard"]).select("vec_id", "v", *keys)  # a shard once for each block that asks it
        found = sent.df.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
        if top is not None:
            found = found.union(top.df.select("query_id", "vec_id", "score"))
        better = Stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
        sent.discard()
        if top is not None:
            top.discard()
        top, first = better, last
    base.discard()
    asked.discard()
    return top.df
