"""Neighbours and affinities as table functions of SQL.

Each takes a table and asks for its rows by the key that it needs, so callers write ``nearest_points(TABLE(t), 5, 0D)``
without PARTITION BY. Analysis checks the columns and gives the schema: affinities keep the type of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.geometry import space
from .affinities import HIGH, LOW, START, STEPS, TOLERANCE
from .pairs import BLOCK, Nearest

#: Coordinates of the points that are sent as one row, about.
SENT = 1_024
#: Partitions of neighbours by the hash of their point, for ``conditional_affinities``.
SHARES = 1_024
#: Deals the points of a table {points} (id, vec) into blocks and every point to each block, for ``nearest_points``: few
#: blocks, as every point is sent to each, but enough for many tasks. Points are sent some at a time, as arrays.
BLOCKS = f"""
  SELECT block, block = pmod(piece, blocks) AS own, p.id AS id, p.vec AS vec
  FROM (
    SELECT blocks, piece, collect_list(struct(id, vec)) AS p
    FROM (
      SELECT id, vec, blocks, pmod(xxhash64(id), blocks * (greatest(n * width - 1, 0) DIV ({SENT} * blocks) + 1)) AS piece
      FROM (
        SELECT id, vec, s.n, s.width, greatest((s.n - 1) DIV {16 * BLOCK} + 1, least((s.n - 1) DIV {BLOCK} + 1, 32)) AS blocks
        FROM (SELECT id, vec, (SELECT struct(count(*) AS n, max(size(vec)) AS width) FROM {{points}}) AS s FROM {{points}} WHERE id IS NOT NULL AND vec IS NOT NULL)))
    GROUP BY blocks, piece)
  LATERAL VIEW explode(sequence(CAST(0 AS BIGINT), blocks - 1)) AS block
"""


def _columns(table: AnalyzeArgument, *names: str) -> T.StructType:
    """The schema of a table argument, which has to have the columns ``names``."""
    if not table.isTable:
        raise ValueError("the first argument has to be a table")
    missing = [n for n in names if n not in table.dataType.names]
    if missing:
        raise ValueError(f"the table lacks the columns {', '.join(missing)}")
    return table.dataType


def _number(argument: AnalyzeArgument, name: str, least: float | None = None) -> None:
    """Fails unless an argument is a constant number, above ``least`` where that is given."""
    if argument.isTable or not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} has to be a constant number")
    if least is not None and not float(argument.value) > least:
        raise ValueError(f"{name} has to be above {least:g}")


def _by_block(table: AnalyzeArgument, k: AnalyzeArgument, curvature: AnalyzeArgument, schema: T.StructType) -> AnalyzeResult:
    """What is told of the neighbours of blocks, whose own points come first."""
    _columns(table, "block", "own", "id", "vec")
    _number(k, "k", 0)
    _number(curvature, "curvature")
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn("block")], orderBy=[OrderingColumn("own", ascending=False)])


class NearestPoints:
    """(i, rank, j, d) from (block, own, id, vec), k and the curvature: the k nearest others of each of a block's own
    points among all points that come with the block; ties go to the smaller id.

    A row is one point, or some of them: an array of ids and one of vectors. A task holds the own points of one block and
    streams the others, some at a time. Points with a null id or vector take no part. Of points with the same id none is
    another's neighbour."""

    #: Others that are looked at together, fewer where they have so many coordinates together.
    SOME, NUMBERS = 4_096, 1 << 18

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, curvature: AnalyzeArgument) -> AnalyzeResult:
        return _by_block(table, k, curvature, T.StructType().add("i", T.LongType()).add("rank", T.LongType()).add("j", T.LongType()).add("d", T.DoubleType()))

    def __init__(self) -> None:
        self.own: Nearest | None = None
        self.some: list[tuple[int, list[float]]] = []
        self.started = False

    def _take(self, k: int, curvature: float) -> None:
        """Looks at the rows read last; the first ones of a block are its own points."""
        if not self.some:
            return
        ids, x = np.array([r[0] for r in self.some], np.int64), np.array([r[1] for r in self.some], float)
        if self.own is None:
            self.own = Nearest(ids, x, k, space(curvature))
        self.own.take(ids, x)
        self.some = []

    def eval(self, row: Row, k: int, curvature: float) -> Iterator[tuple]:
        self.k, self.curvature = int(k), float(curvature)
        if row["id"] is None or row["vec"] is None or row["own"] is None:
            return
        if not row["own"] and not self.started:  # all own points have come
            self.started = True
            self._take(self.k, self.curvature)
        if row["own"] or self.own is not None:
            if isinstance(row["id"], list):
                self.some.extend((i, x) for i, x in zip(row["id"], row["vec"], strict=True) if i is not None and x is not None)
            else:
                self.some.append((row["id"], row["vec"]))
        if self.started and self.some and len(self.some) >= min(self.SOME, max(BLOCK, self.NUMBERS // max(1, len(self.some[-1][1])))):
            self._take(self.k, self.curvature)
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if self.some:
            self._take(self.k, self.curvature)
        if self.own is not None:
            yield from self._told(self.own)

    def _told(self, own: Nearest) -> Iterator[tuple]:
        yield from zip(*(c.to_pylist() for c in own.told(None).columns), strict=True)


class NearestLists(NearestPoints):
    """The same as one row (i, j, d) a point, with arrays of its neighbours and of their distances, nearest first."""

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, curvature: AnalyzeArgument) -> AnalyzeResult:
        return _by_block(table, k, curvature, T.StructType().add("i", T.LongType()).add("j", T.ArrayType(T.LongType())).add("d", T.ArrayType(T.DoubleType())))

    def _told(self, own: Nearest) -> Iterator[tuple]:
        for i, j, d, n in zip(own.ids.tolist(), own.j, own.d, np.isfinite(own.d).sum(axis=1).tolist(), strict=True):
            yield i, j[:n].tolist(), d[:n].tolist()


def _weights(d2: np.ndarray, starts: np.ndarray, goal: float) -> tuple[np.ndarray, np.ndarray]:
    """Bandwidths of the points whose squared distances begin at ``starts``, and the weights of all distances; ``goal`` is the entropy."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d2))))
    d2 = d2 - np.minimum.reduceat(d2, starts)[of]

    def weights(sigma: np.ndarray) -> np.ndarray:
        e = np.exp(-d2 / (2 * sigma * sigma)[of])
        return e / np.add.reduceat(e, starts)[of]

    low, high, sigma = (np.full(len(starts), x) for x in (LOW, HIGH, START))
    met = np.zeros(len(starts), bool)
    for _ in range(STEPS):
        p = weights(sigma)
        entropy = -np.add.reduceat(p * np.log(p + 1e-10), starts)
        met |= np.abs(entropy - goal) < TOLERANCE
        if met.all():
            break
        wide = entropy > goal
        low, high = np.where(met | wide, low, sigma), np.where(met | ~wide, high, sigma)
        sigma = np.where(met, sigma, (low + high) / 2)
    return sigma, weights(sigma)


class Affinities:
    """(i, j, sigma, p) from neighbours (i, j, d) and a perplexity: the Gaussian p(j | i) whose bandwidth sigma gives each i's
    neighbours that perplexity. Nulls take no part.

    A row is one neighbour, or all of a point: then j, d and p are arrays and rows need not be sent by point. A task bisects
    for many points at a time."""

    SOME = 1 << 15

    @staticmethod
    def analyze(table: AnalyzeArgument, perplexity: AnalyzeArgument) -> AnalyzeResult:
        given = _columns(table, "i", "j", "d")
        _number(perplexity, "perplexity", 0)
        lists = isinstance(given["j"].dataType, T.ArrayType)
        if lists != isinstance(given["d"].dataType, T.ArrayType):
            raise ValueError("j and d have to be both arrays, or none of them")
        schema = T.StructType().add("i", given["i"].dataType).add("j", given["j"].dataType).add("sigma", T.DoubleType()).add("p", T.ArrayType(T.DoubleType()) if lists else T.DoubleType())
        if lists:
            return AnalyzeResult(schema)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"pmod(xxhash64(i), {SHARES})")], orderBy=[OrderingColumn("i"), OrderingColumn("d"), OrderingColumn("j")])

    def __init__(self) -> None:
        self.points: list[tuple] = []
        self.n, self.lists = 0, False

    def eval(self, row: Row, perplexity: float) -> Iterator[tuple]:
        self.goal = float(np.log(float(perplexity)))
        i, j, d = row["i"], row["j"], row["d"]
        if i is None or j is None or d is None:
            return
        self.lists = isinstance(d, list)
        if self.lists or not self.points or self.points[-1][0] != i:
            if self.n >= self.SOME:
                yield from self._told()
            self.points.append((i, [], []))
        for other, far in zip(j, d, strict=True) if self.lists else ((j, d),):
            if other is not None and far is not None:
                self.points[-1][1].append(other)
                self.points[-1][2].append(float(far))
                self.n += 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()

    def _told(self) -> Iterator[tuple]:
        """What has been read, with the bandwidths of all its points."""
        points, self.points, self.n = [p for p in self.points if p[1]], [], 0
        if not points:
            return
        starts = np.cumsum([0, *(len(j) for _, j, _ in points)])
        sigma, p = _weights(np.array([x for *_, d in points for x in d]) ** 2, starts[:-1], self.goal)
        for (i, j, _), s, a, b in zip(points, sigma.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if self.lists:
                yield i, j, s, p[a:b].tolist()
            else:
                yield from ((i, other, s, x) for other, x in zip(j, p[a:b].tolist(), strict=True))


#: Table function by its name in SQL.
FUNCTIONS = {"nearest_points": NearestPoints, "nearest_lists": NearestLists, "conditional_affinities": Affinities}


def register(spark: SparkSession) -> None:
    """Makes :data:`FUNCTIONS` callable in the session's SQL."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
