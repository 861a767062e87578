"""All-pairs operators in blocks: points are dealt into blocks, and a task works on two blocks at a time.

A block is one row, and blocks are put into groups. A task holds one group and streams another, so what crosses the network
grows with the number of points times the number of groups, memory stays that of two groups, and reductions (nearest
neighbours, sums, counts) are put together in the task and leave it as a few rows per point. Only :func:`all_pairs`, whose
result is the pairs, emits them.

Nearest neighbours (:func:`knn`) need no pass over all pairs of blocks: points are dealt to pivots, a block holds points of
one, and the triangle inequality rules out blocks that lie too far away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import CLAMP, Euclidean, Hyperboloid, Space, Sphere, space
from ..storage import Stored

#: Points in a block.
BLOCK = 1024
#: Pairs of a point that follow one another in a table of all pairs, before the same pairs the other way round.
RUN = 24
#: Blocks that a task holds at most, and groups of them that blocks are dealt to where there are enough.
HOLD, GROUPS = 16, 12
#: Groups of blocks whose neighbours are looked for, at most as long as none has more blocks than this.
SEARCHES, SEARCHED = 24, 128
#: New neighbours of a point that are put in one by one.
SINGLE = 6
#: Targets of a point up to which what is nearer is counted for each, without sorting.
COUNTED = 12
#: Rows of a task that wait before those with the same keys are put together.
WAIT = 1 << 19
#: Pivots that points are dealt to at most, and coordinates that they have together.
PIVOTS, PIVOT_NUMBERS = 1_024, 1 << 22
#: Blocks that one task takes for a block, and up to which all are taken without looking for a bound first.
PARTNERS, FEW = 4_096, 8
#: Given distances that a task holds before it keeps the nearest only.
HELD = 1 << 20

__all__ = ["BLOCK", "Block", "Euclidean", "Hyperboloid", "Sphere", "all_pairs", "block_partners", "gather_pairs", "knn", "kth_distance", "mean_distance", "mutual_knn", "nearest_of_pairs", "normalized", "pair_blocks", "pairs_by_norms", "ranks", "within_halves"]


@dataclass
class Block:
    """Points of a block: ids, coordinates, labels and further columns of arrays by name, flat, with where each begins, and
    rows that are sent along."""

    ids: np.ndarray
    x: np.ndarray
    labels: np.ndarray
    more: dict[str, np.ndarray]
    starts: np.ndarray | None = None
    number: int = -1
    along: pa.RecordBatch | None = None


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, p) with the points of each as the bytes of an Arrow table, which are copied, sent and read as one value."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows, sink = pa.RecordBatch.from_struct_array(batch.column(1)[k].values), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "p"])


def of_bytes(p: pa.BinaryScalar) -> pa.RecordBatch:
    """The points that :func:`as_bytes` packed."""
    return pa.ipc.open_stream(p.as_buffer()).read_next_batch()


def put_together(tables: list[pa.Table], sums: dict[str, str]) -> pa.Table:
    """The rows of ``tables``, one for each set of equal keys; ``sums`` tells how (sum, min, max) the other columns are made."""
    names = tables[0].column_names
    made = pa.concat_tables(tables).group_by([n for n in names if n not in sums], use_threads=False).aggregate(list(sums.items()))
    return made.rename_columns([n if n in names else n[: n.rindex("_")] for n in made.column_names]).select(names)


def block_of(n: int) -> Column:
    """The block that a point (id), one of ``n``, is dealt to by :func:`pair_blocks`."""
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK))))


def pair_blocks(
    points: DataFrame, work: Callable[[Block, Block], pa.Table] | Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]], schema: str, more: tuple[str, ...] = (), other: DataFrame | None = None, sums: dict[str, str] | None = None, halves: bool = False, along: DataFrame | None = None
) -> DataFrame:
    """``work`` on every ordered pair of blocks of ``points`` (id, vec[, label], more...) and ``other`` (the same if None).

    With ``halves`` each two blocks of ``points`` meet once, and a block meets itself. With ``sums`` (how by column: sum, min,
    max) a task's rows are put together by their other columns. With ``along``, rows (block, p) that go with the blocks, ``work``
    gets all pairs of blocks of a task, one after the other, instead of one."""

    def packed(df: DataFrame, n: int) -> DataFrame:
        columns = ["id", "vec", F.col("label") if "label" in df.columns else F.lit(None).cast("long").alias("label")]
        columns += [F.col(c) if c in df.columns else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in more]
        return df.select(block_of(n).alias("block"), F.struct(*columns).alias("p")).groupBy("block").agg(F.collect_list("p").alias("p")).mapInArrow(as_bytes, "block long, p binary")

    def unpack(rows: pa.RecordBatch, names: tuple[str, ...], number: int) -> Block:
        ids, flat = rows["id"].to_numpy(), rows["vec"].flatten().to_numpy()
        found = Block(ids.copy(), flat.reshape(len(ids), -1).copy(), rows["label"].to_numpy(zero_copy_only=False), {n: rows[n].flatten().to_numpy() for n in names}, number=number)
        if names:
            found.starts = np.append(0, np.cumsum(pc.list_value_length(rows[names[0]]).to_numpy()))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for a, b in met(batches):
            waiting.append(work(a, b))
            if sums is None:
                yield from waiting.pop().to_batches()
            elif sum(t.num_rows for t in waiting) > WAIT:
                waiting[:] = [put_together(waiting, sums)]
        if waiting:
            yield from put_together(waiting, sums).to_batches()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block]]:
        task, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                of, side, number = (batch.column(c)[k].as_py() for c in range(3))
                if of != task:
                    task, held = of, []
                block = unpack(of_bytes(batch.column(3)[k]), more if side < 2 else (), number)
                if batch.num_columns > 4 and batch.column(4)[k].is_valid:
                    block.along = of_bytes(batch.column(4)[k])
                if side < 2:
                    held.append(block)
                for own in held if side else ():
                    yield own, block

    n, m = points.count(), 0 if other is None else other.count()
    left = -(-max(n, 1) // BLOCK)
    right = left if other is None else -(-max(m, 1) // BLOCK)
    hold = max(1, min(HOLD, -(-max(left, right) // GROUPS)))
    rows, columns = -(-left // hold), -(-right // hold)
    group = F.floor(F.col("block") / hold)
    each = lambda first, last, step=1: F.sequence(F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last, F.lit(step).cast("long"))

    def meet(tasks: Column, side: int) -> Column:
        return F.transform(tasks, lambda t: F.struct(t.cast("long").alias("task"), F.lit(side).alias("side")))

    # Sides: 0 is held, 1 is held and meets what is held, 2 streams by.
    if halves:  # groups g <= h meet in task h (h + 1) / 2 + g
        tasks = rows * (rows + 1) // 2
        place = lambda g, h: (h * (h + 1) / 2).cast("long") + g
        later = F.filter(F.transform(each(0, rows - 1), lambda h: F.when(h > group, place(group, h))), lambda t: t.isNotNull())
        before = F.filter(F.transform(each(0, rows - 1), lambda g: F.when(g < group, place(g, group))), lambda t: t.isNotNull())
        sent = packed(points, n).select("block", "p", F.explode(F.concat(meet(later, 0), meet(F.array(place(group, group)), 1), meet(before, 2))).alias("to"))
    else:
        tasks = rows * columns
        first = F.transform(each(0, columns - 1), lambda h: group * columns + h)
        second = F.transform(each(0, rows - 1), lambda g: g * columns + group)
        if other is None:
            sent = packed(points, n).select("block", "p", F.explode(F.concat(meet(first, 0), meet(second, 2))).alias("to"))
        else:
            sent = packed(points, n).select("block", "p", F.explode(meet(first, 0)).alias("to")).union(packed(other, m).select("block", "p", F.explode(meet(second, 2)).alias("to")))
    sent = sent.select("to.task", "to.side", "block", "p")
    if along is not None:
        sent = sent.join(F.broadcast(along.toDF("block", "along")), "block", "left").select("task", "side", "block", "p", "along")
    sent = sent.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("task", "side", "block")
    return sent.mapInArrow(run if along is None else lambda batches: work(met(batches)), schema)


def within_halves(a: Block, b: Block) -> np.ndarray | None:
    """Which pairs of two blocks count where each pair counts once: None for all, those of ascending ids within a block."""
    return a.ids[:, None] < b.ids[None, :] if a.number == b.number else None


def _between(a: Block, b: Block, at: Space, clamp: float = CLAMP, exact: bool = True) -> np.ndarray:
    """Distances, infinite between a point and itself."""
    d = at.distances(a.x, b.x, clamp) if exact else at.fast_distances(a.x, b.x)
    _part(d, a.ids, b.ids)
    return d


def _part(d: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts rows and columns of the same id infinitely far apart."""
    if np.isin(j, i).any():
        d[i[:, None] == j[None, :]] = np.inf


def _mirrored(a: Block, b: Block, d: np.ndarray) -> pa.Table:
    """(i, j, d) of the pairs of two blocks that meet once, both ways: some of a row of the matrix, then the same as a column.

    A distance is as many random bytes as it has, and twice in the result; where its two rows lie close together, files that
    are compressed hold it once."""
    if a.number == b.number:
        i, j = np.nonzero(a.ids[:, None] != b.ids[None, :])
        return pa.table({"i": a.ids[i], "j": b.ids[j], "d": d[i, j]})
    parts = []
    for s in range(0, len(b.ids), RUN):
        some = b.ids[s : s + RUN]
        i, j, both = np.empty((len(a.ids), 2, len(some)), np.int64), np.empty((len(a.ids), 2, len(some)), np.int64), np.empty((len(a.ids), 2, len(some)))
        i[:, 0], i[:, 1], j[:, 0], j[:, 1] = a.ids[:, None], some, some, a.ids[:, None]
        both[:] = d[:, None, s : s + RUN]
        parts.append(pa.table({"i": i.ravel(), "j": j.ravel(), "d": both.ravel()}))
    return pa.concat_tables(parts)


def all_pairs(points: DataFrame, k: float = 0.0, clamp: float = CLAMP) -> DataFrame:
    """(i, j, d) for all ordered pairs of different points, whose distances are made once for both orders."""
    at = space(k)
    return pair_blocks(points, lambda a, b: _mirrored(a, b, at.distances(a.x, b.x, clamp)), "i long, j long, d double", halves=True)


def pairs_by_norms(points: DataFrame) -> DataFrame:
    """(i, j, d) of Euclidean points by norms and one matrix product per block pair: |x|^2 + |y|^2 - 2 x.y.

    Faster than :func:`all_pairs` for points of many coordinates, and less exact for points close to one another."""

    def work(a: Block, b: Block) -> pa.Table:
        d2 = (a.x**2).sum(axis=1)[:, None] + (b.x**2).sum(axis=1)[None, :] - 2 * (a.x @ b.x.T)
        return _mirrored(a, b, np.sqrt(np.maximum(d2, 0.0)))

    return pair_blocks(points, work, "i long, j long, d double", halves=True)


def gather_pairs(points: DataFrame, pairs: DataFrame, k: float = 0.0) -> DataFrame:
    """(i, j, d) of the pairs (i, j) asked for."""
    x = points.select(F.col("id").alias("i"), F.col("vec").alias("x"))
    y = points.select(F.col("id").alias("j"), F.col("vec").alias("y"))
    return pairs.select("i", "j").join(x, "i").join(y, "j").select("i", "j", space(k).distance(F.col("x"), F.col("y")).alias("d"))


class Nearest:
    """The k nearest others so far of the points of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray | None, k: int, at: Space | None) -> None:
        self.ids, self.x, self.k, self.at = ids, x, k, at
        self.d, self.j = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    @property
    def reach(self) -> float:
        """Points further away than this are nobody's neighbour."""
        return float(self.d[:, -1].max())

    def take(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Looks for neighbours of ``rows`` (all if None) among other points; ties go to the smaller id."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        for start in range(0, len(rows), BLOCK):
            self._take(ids, x, rows[start : start + BLOCK])

    def _take(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray) -> None:
        own, most = self.x[rows], self.d[rows, -1]
        told = self.at.rough_products(own, x)
        if told is None:
            d, slack = self.at.distances(own, x), 0.0
            limit = most
        else:  # squares of distances, and how far off they may be
            d, slack = told
            limit = most * most * (1 + 1e-12) + slack
        _part(d, self.ids[rows], ids)
        if d.shape[1] > self.k and not np.isfinite(most).all():
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
        if told is not None:
            with np.errstate(over="ignore"):
                limit = np.nextafter(limit.astype(d.dtype), np.array(np.inf, d.dtype))
        some = np.flatnonzero(~(d.min(axis=1, initial=np.inf) > limit))  # rows that find anything
        few = d if len(some) == len(d) else d[some]
        r, c = np.divmod(np.flatnonzero(few <= limit[some, None]), max(1, d.shape[1]))
        r = some[r]
        d = d[r, c] if told is None else np.where(np.isfinite(d[r, c]), self.at.distances_of(own[r], x[c]), np.inf)
        keep = (d <= most[r]) & np.isfinite(d)
        r, c, d = r[keep], c[keep], d[keep]
        self._put(rows, r, ids[c], d)

    def give(self, ids: np.ndarray, d: np.ndarray, across: bool = False) -> None:
        """Looks for neighbours among other points at given distances ``d``, a row (with ``across`` a column) for each own point."""
        most, axis = self.d[:, -1], 0 if across else 1
        limit = most
        if d.shape[axis] > self.k and not np.isfinite(most).all():
            limit = np.minimum(most, np.partition(d, self.k - 1, axis=axis).take(self.k - 1, axis=axis))
        at = np.flatnonzero(d <= (limit[None, :] if across else limit[:, None]))
        at = at[np.isfinite(d.ravel()[at])]
        r, c = np.divmod(at, max(1, d.shape[1]))
        self._put(np.arange(len(self.ids)), c if across else r, ids[r if across else c], d.ravel()[at])

    def _put(self, rows: np.ndarray, r: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Keeps those of new neighbours j, at distances d, of the points ``rows[r]`` that are among the nearest."""
        if len(r):
            order = np.lexsort((j, d, r))
            r, j, d = r[order], j[order], d[order]
            found, first, new = np.unique(r, return_index=True, return_counts=True)
            if new.max() > SINGLE:
                self._merge(rows[found], np.repeat(np.arange(len(found)), new), j, d)
            else:  # the first new ones of all rows, then the second ones
                for m in range(int(new.max())):
                    one = first[new > m] + m
                    self._insert(rows[r[one]], j[one], d[one])

    def _merge(self, at: np.ndarray, row: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Keeps the nearest of what the rows ``at`` have and of what is new; ``row`` counts them."""
        of = np.concatenate([np.repeat(np.arange(len(at)), self.k), row])
        every, other = np.concatenate([self.d[at].ravel(), d]), np.concatenate([self.j[at].ravel(), j])
        order = np.lexsort((other, every, of))
        starts = np.searchsorted(of[order], np.arange(len(at)))
        best = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.d[at], self.j[at] = every[best].reshape(len(at), -1), other[best].reshape(len(at), -1)

    def _insert(self, at: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Puts one new neighbour into each of the rows ``at``, where it is nearer than the last."""
        near, other, j, d = self.d[at], self.j[at], j[:, None], d[:, None]
        place = ((near < d) | ((near == d) & (other <= j))).sum(axis=1)[:, None]
        later, here = np.arange(self.k) > place, np.arange(self.k) == place
        moved = np.maximum(np.arange(self.k) - 1, 0)
        self.d[at] = np.where(here, d, np.where(later, near[:, moved], near))
        self.j[at] = np.where(here, j, np.where(later, other[:, moved], other))

    def told(self, but: np.ndarray | None) -> pa.RecordBatch:
        """(i, rank, j, d), without neighbours of the ids ``but`` where given."""
        found = np.isfinite(self.d)
        row, place = np.nonzero(found if but is None else found & ~np.isin(self.j, but))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(place + 1), pa.array(self.j[row, place]), pa.array(self.d[row, place])], ["i", "rank", "j", "d"])


@dataclass
class Pivots:
    """Some of the points, their distances from one another, how far the points dealt to each lie, and its blocks."""

    x: np.ndarray
    between: np.ndarray
    far: np.ndarray
    first: np.ndarray
    slack: float

    def of(self, block: int) -> int:
        """The pivot of a block."""
        return int(np.searchsorted(self.first, block, side="right")) - 1

    def bounds(self, a: int) -> np.ndarray:
        """What points of pivot ``a`` are at least away from points of each pivot."""
        d = self.between[a]
        return d - self.far[a] - self.far - self.slack - 1e-9 * (1 + d)


def _chained(x: np.ndarray, at: Space) -> np.ndarray:
    """Points in an order in which each is followed by the nearest one left, so that blocks of a group lie close together."""
    if len(x) < 3:
        return x
    d, order = at.distances(x, x), [0]
    d[:, 0] = np.inf
    for _ in range(len(x) - 1):
        order.append(int(d[order[-1]].argmin()))
        d[:, order[-1]] = np.inf
    return x[order]


def _dealt(points: DataFrame, at: Space) -> tuple[DataFrame, Pivots]:
    """``points`` packed into blocks (block, p) of one pivot each, and the pivots. Pivots, whose number is bounded, are
    points whose ids have the least hashes; each pivot's points are cut into blocks by hash."""
    n = points.count()
    first = points.select(F.size("vec").alias("d")).first()
    wanted = max(1, min(PIVOTS, PIVOT_NUMBERS // max(1, first.d if first else 1), -(-n // max(1, BLOCK // 2))))
    x = np.array([r.vec for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()], float)
    x = _chained(x, at)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_024):
                some = batch.slice(start, 1_024)
                d = at.fast_distances(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1), x)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], ["id", "vec", "pivot", "far"])

    rows = points.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(deal, "id long, vec array<double>, pivot int, far double")
    told = {r.pivot: (r.n, r.far) for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
    blocks = [-(-told.get(p, (0, 0.0))[0] // BLOCK) for p in range(len(x))]
    starts = np.cumsum([0, *blocks])
    curved = 0.0 if isinstance(at, Euclidean) else 1e-3 * at.r  # distances of curved spaces are cut at both ends
    pivots = Pivots(x, at.distances(x, x) if len(x) else np.zeros((0, 0)), np.array([told.get(p, (0, 0.0))[1] for p in range(len(x))]) * (1 + 1e-8), starts, curved)
    of = points.sparkSession.createDataFrame([(p, int(starts[p]), m) for p, m in enumerate(blocks) if m], "pivot int, first long, blocks long")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))
    return rows.join(F.broadcast(of), "pivot").groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("p")), pivots


def _unpacked(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = rows["id"].to_numpy()
    return ids, rows["vec"].flatten().to_numpy().reshape(len(ids), -1)


def block_partners(blocks: DataFrame, pivots: Pivots, k: int, at: Space) -> DataFrame:
    """(a, b, bound): the blocks b that block a has to look at, itself among them, and what their points are at least away.

    Where there are more than a few blocks, the neighbours within a block bound how far others may lie."""

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                near = Nearest(*_unpacked(pa.RecordBatch.from_struct_array(batch.column(1)[r].values)), k, at)
                near.take(near.ids, near.x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([near.reach])], ["block", "reach"])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, reach in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bounds = pivots.bounds(pivots.of(a))
                near = [p for p in np.argsort(bounds, kind="stable").tolist() if bounds[p] <= reach]
                b = np.concatenate([np.arange(pivots.first[p], pivots.first[p + 1]) for p in near])
                bound = np.repeat(bounds[near], [pivots.first[p + 1] - pivots.first[p] for p in near])
                bound[b == a] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b), pa.array(bound)], ["a", "b", "bound"])

    total = int(pivots.first[-1])
    rows = blocks.mapInArrow(reaches, "block long, reach double") if total > FEW else blocks.sparkSession.range(total).select(F.col("id").alias("block"), F.lit(float("inf")).alias("reach"))
    return rows.mapInArrow(partners, "a long, b long, bound double")


def knn(points: DataFrame, k: int, curvature: float = 0.0) -> DataFrame:
    """(i, rank, j, d): the k nearest others of each point, ties to the smaller id.

    A task holds a group of blocks and their k nearest so far, and streams the blocks that may have nearer ones, the nearest
    blocks first; whole blocks, and for others single points, are skipped where the triangle inequality leaves nothing
    to find. It tells k rows for each of its points. A block is sent once to a group, so that what is shuffled grows with
    the number of groups."""
    spark, at = points.sparkSession, space(curvature)
    blocks, pivots = _dealt(points, at)
    if not len(pivots.x) or k < 1:
        return spark.createDataFrame([], "i long, rank long, j long, d double")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        held: list[tuple[int, Nearest]] = []

        def look(near: Nearest, pivot: int, other: int, ids: np.ndarray, x: np.ndarray) -> None:
            if pivots.bounds(pivot)[other] <= near.reach:
                d = at.distances_from(near.x, pivots.x[other])
                rows = np.flatnonzero(d - pivots.far[other] - pivots.slack - 1e-9 * (1 + d) <= near.d[:, -1])
                if len(rows):
                    near.take(ids, x, rows)

        def told() -> Iterator[pa.RecordBatch]:
            but = np.concatenate([near.ids for _, near in held]) if held and key[1] else None  # the first part tells of the group itself
            for _, near in held:
                yield near.told(but)

        for batch in batches:
            for r in range(batch.num_rows):
                group, part, b, bound = (batch.column(c)[r].as_py() for c in range(4))
                if (group, part) != key:
                    yield from told()
                    key, held = (group, part), []
                (ids, x), other = _unpacked(of_bytes(batch.column(4)[r])), pivots.of(b)
                for pivot, near in held:
                    look(near, pivot, other, ids, x)
                if bound == -np.inf:  # the group's own blocks come first
                    own = Nearest(ids.copy(), x.copy(), k, at)
                    own.take(own.ids, own.x)
                    for pivot, near in held:
                        look(own, other, pivot, near.ids, near.x)
                    held.append((other, own))
        yield from told()

    total = int(pivots.first[-1])
    hold, parts = max(1, min(SEARCHED, -(-total // SEARCHES))), -(-total // PARTNERS)
    groups = -(-total // hold)
    asked = block_partners(blocks, pivots, k, at).groupBy(F.floor(F.col("a") / hold).alias("a"), "b").agg(F.min("bound").alias("bound"))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.explode(F.when(F.col("bound") == float("-inf"), every).otherwise(F.array((F.col("b") % parts).cast("int")))) if parts > 1 else F.lit(0)
    asked = asked.select("a", part.alias("part"), "b", "bound")
    sent = asked.join(blocks.mapInArrow(as_bytes, "block long, p binary").withColumnRenamed("block", "b"), "b").repartitionById(groups * parts, (F.col("a") * parts + F.col("part")).cast("int")).sortWithinPartitions("a", "part", "bound", "b")
    near = sent.select("a", "part", "b", "bound", "p").mapInArrow(stream, "i long, rank long, j long, d double")
    if parts == 1:
        return near
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest_of_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(i, rank, j, d): the k nearest others of each i among given distances (i, j, d), ties to the smaller id.

    A task keeps k of each i among the rows it reads, so that no more are shuffled."""

    def best(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((j, d, i))
        own = i[order]
        start = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1])[: len(own)], np.arange(len(own)), 0))
        order = order[np.arange(len(own)) - start < k]
        return i[order], j[order], d[order]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        known, least = np.zeros(0, np.int64), np.zeros(0)  # points of which k are held, and how far these lie

        def near(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            """Rows that may be among the nearest."""
            if not len(known) or not len(rows[0]):
                return rows
            at = np.minimum(np.searchsorted(known, rows[0]), len(known) - 1)
            may = (known[at] != rows[0]) | ~(rows[2] > least[at])
            return tuple(r[may] for r in rows)

        def thinned(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
            """Without what is too far among rows of the same i that follow one another, as in tables made by blocks."""
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
            lengths, stay = np.diff(np.append(starts, len(i))), np.ones(len(i), bool)
            for length in np.unique(lengths[lengths > 2 * k]).tolist():
                at = starts[lengths == length][:, None] + np.arange(length)
                own = d[at]
                stay[at] = ~(own > np.partition(own, k - 1, axis=1)[:, k - 1 : k])
            return i[stay], j[stay], d[stay]

        for batch in batches:
            rows = near(thinned(*(c.to_numpy() for c in batch.columns)))
            waiting.append(rows)
            n += len(rows[0])
            if n > max(HELD, len(held[0])):
                held, waiting, n = best(*(np.concatenate(c) for c in zip(held, *waiting, strict=True))), [], 0
                last = np.append(held[0][1:] != held[0][:-1], True)
                ends = np.flatnonzero(last)
                full = np.diff(np.append(-1, ends)) == k
                known, least = held[0][ends[full]], held[2][ends[full]]
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in best(*(np.concatenate(c) for c in zip(held, *waiting, strict=True)))], ["i", "j", "d"])

    rows = pairs.where("i <> j AND d IS NOT NULL").select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("d").cast("double"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j")).cast("long")
    return rows.mapInArrow(keep, "i long, j long, d double").withColumn("rank", rank).where(F.col("rank") <= k).select("i", "rank", "j", "d")


def kth_distance(points: DataFrame, k: int, curvature: float = 0.0) -> DataFrame:
    """(i, d): distance to the k-th nearest other point (the farthest where there are fewer)."""
    return knn(points, k, curvature).groupBy("i").agg(F.max("d").alias("d"))


def mutual_knn(points: DataFrame, k: int, curvature: float = 0.0) -> DataFrame:
    """(i, j) with i < j, each among the other's k nearest."""
    near = knn(points, k, curvature).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return near.groupBy("i", "j").agg(F.count("*").alias("n")).where("n = 2").select("i", "j")


def _below(d: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers of each row are below its bounds ``low`` and ``high``, which begin at ``starts``."""
    wanted, ends = np.diff(starts), np.zeros((2, len(low)), np.int64)
    if wanted.max(initial=0) > COUNTED:
        near, both = np.sort(d, axis=1), np.stack([low, high])
        for row, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            ends[:, s:e] = near[row].searchsorted(both[:, s:e])
        return ends[0], ends[1]
    for m in range(int(wanted.max(initial=0))):  # the first bounds of all rows, then the second ones
        rows = np.flatnonzero(wanted > m)
        own, of = d if len(rows) == len(d) else d[rows], starts[:-1][rows] + m
        for k, bounds in enumerate((low, high)):
            ends[k, of] = (own < bounds[of, None]).view(np.uint8).sum(axis=1, dtype=np.uint32)
    return ends[0], ends[1]


def ranks(points: DataFrame, targets: DataFrame, curvature: float = 0.0) -> DataFrame:
    """(i, j, rank): place of j among all others by distance from i, for the (i, j) of ``targets``; ties by id.

    Each block pair counts what is nearer than the targets, so no full ranking is ever sorted. Targets are stored, as they are
    read more than once and may be neighbours that have to be looked for."""
    at = space(curvature)
    measured = gather_pairs(points, targets, curvature)
    wanted = Stored(measured.groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("t")), "targets").df

    def work(a: Block, b: Block) -> pa.Table:
        goal, of = a.more["goal"], a.more["of"].astype(np.int64)
        rows = np.repeat(np.arange(len(a.ids)), np.diff(a.starts))
        told = at.rough_products(a.x, b.x)
        if told is None:
            d, low, high = at.distances(a.x, b.x), goal * (1 - 1e-13), np.nextafter(goal * (1 + 1e-13), np.inf)
        else:  # squares of distances, and how far off they may be
            d, slack = told
            with np.errstate(over="ignore"):
                low = np.nextafter((goal * goal * (1 - 3e-13) - slack[rows]).astype(d.dtype), np.array(-np.inf, d.dtype))
                high = np.nextafter((goal * goal * (1 + 3e-13) + slack[rows]).astype(d.dtype), np.array(np.inf, d.dtype))
        _part(d, a.ids, b.ids)
        n, upto = _below(d, a.starts, low, high)
        near = np.flatnonzero(upto > n)  # what is as far counts where its id is smaller
        for s in range(0, len(near), BLOCK):
            t = near[s : s + BLOCK]
            some = d[rows[t]]
            u, c = np.divmod(np.flatnonzero((some >= low[t, None]) & (some < high[t, None])), d.shape[1])
            own = t[u]
            exact = some[u, c] if told is None else at.distances_of(a.x[rows[own]], b.x[c])
            same = np.abs(exact - goal[own]) <= goal[own] * 1e-13
            np.add.at(n, own, (exact < goal[own]) & ~same | same & (b.ids[c] < of[own]))
        return pa.table({"i": a.ids[rows], "j": of, "n": n})

    asked = points.join(wanted, "id").withColumns({"goal": F.col("t.d"), "of": F.col("t.j")})
    counted = pair_blocks(asked, work, "i long, j long, n long", more=("goal", "of"), other=points, sums={"n": "sum"})
    return counted.groupBy("i", "j").agg((F.sum("n") + 1).alias("rank"))


def mean_distance(points: DataFrame, k: float = 0.0) -> DataFrame:
    """One row (mean): the mean distance of all pairs, from sums per block pair."""
    at = space(k)

    def work(a: Block, b: Block) -> pa.Table:
        d, own = at.fast_distances(a.x, b.x), within_halves(a, b)
        d = d if own is None else d[own]
        return pa.table({"s": [float(d.sum())], "n": [d.size]})

    return pair_blocks(points, work, "s double, n long", halves=True).agg((F.sum("s") / F.sum("n")).alias("mean"))


def normalized(points: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """``points`` divided by their mean distance: of all pairs, or of about ``sample`` random pairs."""
    if sample is None:
        mean = mean_distance(points)
    else:
        from .samplers import RandomSampler

        mean = gather_pairs(points, RandomSampler(points, sample, seed).sample_pairs()).agg(F.avg("d").alias("mean"))
    m = mean.first()
    return points if m is None or not m.mean else points.withColumn("vec", F.transform("vec", lambda x: x / m.mean))


def normalized_pairs(pairs: DataFrame) -> DataFrame:
    """Given distances (i, j, d) divided by their mean off the diagonal."""
    mean = pairs.where("i <> j").agg(F.avg("d").alias("m"))
    return pairs.crossJoin(mean).select("i", "j", (F.col("d") / F.col("m")).alias("d"))
