"""Embedding quality: how well neighbourhoods, distances and classes survive, and how space is used.

Every metric is a one-row DataFrame (value double). ``high`` and ``low`` are points (id, vec[, label]) with the
same ids; ``pairs`` are distances (i, j, d). Fewer than two classes, points too few for a formula and vanishing
denominators give 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import space
from ..functions.vectors import dot
from ..sources.registry import drawn
from ..storage import Stored
from .pairs import Block, _between, knn, kth_distance, pair_blocks, ranks, within_halves
from .tiles import Tiles

SMALL, FLOOR = 1e-12, 1e-10
GRID = 100
#: Points that a task reads before it reduces them to the corners of their hull.
HULL = 10_000


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def trustworthiness(high: DataFrame, low: DataFrame, k: int = 10, curvature: float = 0.0, near: DataFrame | None = None) -> DataFrame:
    """1 less the normalised ranks in ``high`` beyond k of the k nearest in ``low`` (by distance of ``curvature``, or given)."""
    near = (knn(low, k, curvature) if near is None else near).select("i", "j")
    n = high.agg(F.count("*").alias("n"))
    over = ranks(high, near).select(F.greatest(F.col("rank") - k, F.lit(0)).alias("over")).crossJoin(n)
    factor = 2 / (F.max("n") * k * (2 * F.max("n") - 3 * k - 1))
    return _value(over, 1 - factor * F.sum("over"))


def continuity(high: DataFrame, low: DataFrame, k: int = 10, near: DataFrame | None = None) -> DataFrame:
    """Trustworthiness with the roles of the spaces exchanged; ``near`` are the k nearest in ``high``, if known."""
    return trustworthiness(low, high, k, near=near)


def knn_overlap(high: DataFrame, low: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of the k nearest that both spaces have in common."""
    n = high.count()
    k = min(k, n - 1)
    if k < 1:
        return _value(high, F.lit(0.0))
    return overlap_of(knn(high, k), knn(low, k), n, k)


def overlap_of(high: DataFrame, low: DataFrame, n: int, k: int) -> DataFrame:
    """Mean share that two tables (i, j) of the k nearest of n points have in common."""
    both = high.select("i", "j").join(low.select("i", "j"), ["i", "j"])
    return _value(both, F.count("*") / F.lit(float(n * k)))


def _both_distances(high: DataFrame, low: DataFrame, curvature: float, use: Callable[[np.ndarray, np.ndarray], dict[str, float]], names: str) -> DataFrame:
    """(names..., n): what ``use`` makes of the distances in ``high`` and in ``low`` of the pairs of two blocks, each pair once,
    and their number.

    Points carry both coordinates, so each pair's two distances are computed in the same task."""
    at, flat = space(curvature), space(0.0)
    wide = high.select("id", "vec").join(low.select("id", F.col("vec").alias("e")), "id")
    split = wide.select("id", F.concat("vec", "e").alias("vec"))
    first = high.select(F.size("vec").alias("d")).first()
    d = first.d if first else 0

    def work(a: Block, b: Block) -> pa.Table:
        own = within_halves(a, b)
        h, e = flat.fast_distances(a.x[:, :d], b.x[:, :d]), at.fast_distances(a.x[:, d:], b.x[:, d:])
        h, e = (h, e) if own is None else (h[own], e[own])
        with np.errstate(divide="ignore", invalid="ignore"):
            return pa.table({name: [value] for name, value in use(h, e).items()} | {"n": [h.size]})

    return pair_blocks(split, work, f"{names}, n long", halves=True)


def distortion(high: DataFrame, low: DataFrame, kind: str = "gu", curvature: float = 0.0) -> DataFrame:
    """Mean over pairs of |(e / h)^2 - 1| (gu) or (e - h)^2 (mse), e being distances in ``low``."""
    if kind not in ("gu", "mse"):
        raise ValueError(f"unknown distortion {kind!r}")
    use = (lambda h, e: {"s": float(np.abs((e / h) ** 2 - 1).sum())}) if kind == "gu" else (lambda h, e: {"s": float(((e - h) ** 2).sum())})
    return _value(_both_distances(high, low, curvature, use, "s double"), F.try_divide(F.sum("s"), F.sum("n")))


def distance_losses(high: DataFrame, low: DataFrame, curvature: float = 0.0) -> DataFrame:
    """One row (gu, mse): over all pairs i < j, the sums of (e / (h + 1e-8) - 1)^2 and of (e - h)^2."""
    use = lambda h, e: {"gu": float(((e / (h + 1e-8) - 1) ** 2).sum()), "mse": float(((e - h) ** 2).sum())}
    parts = _both_distances(high, low, curvature, use, "gu double, mse double")
    return parts.agg(F.coalesce(F.sum("gu"), F.lit(0.0)).alias("gu"), F.coalesce(F.sum("mse"), F.lit(0.0)).alias("mse"))


def volume_distortion(high: DataFrame, low: DataFrame, k: int = 10, curvature: float = 0.0) -> DataFrame:
    """Mean |ln| of the ratio of distances to the k-th neighbour."""
    h, e = kth_distance(high, k).withColumnRenamed("d", "h"), kth_distance(low, k, curvature).withColumnRenamed("d", "e")
    return _value(h.join(e, "i"), F.avg(F.abs(F.ln(F.greatest("e", F.lit(FLOOR)) / F.greatest("h", F.lit(FLOOR))))))


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of plane points, by monotone chains."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def hull_facets(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points without repeats, triples of them): the triangles around points in space, turned outwards; none if they lie flat.

    Points are added one at a time: the triangles that see a new one give way to those between it and their rim. A point waits
    with one triangle that it sees and is only compared with those that replace it, so that work grows little faster than
    the number of points (quickhull), also where all of them are corners."""
    pts = np.unique(xyz, axis=0)
    none = np.zeros((0, 3), np.int64)
    if len(pts) < 4:
        return pts, none
    size = float(np.abs(pts - pts.mean(axis=0)).max())
    a = 0
    b = int(((pts - pts[a]) ** 2).sum(axis=1).argmax())
    away = np.cross(pts - pts[a], pts[b] - pts[a])
    c = int((away**2).sum(axis=1).argmax())
    normal = np.cross(pts[b] - pts[a], pts[c] - pts[a])
    off = (pts - pts[a]) @ normal
    e = int(np.abs(off).argmax())
    if abs(off[e]) <= 1e-12 * size**3:
        return pts, none
    if off[e] > 0:
        b, c = c, b
    tri = np.array([(a, b, c), (a, c, e), (c, b, e), (b, a, e)])

    def planes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.cross(pts[t[:, 1]] - pts[t[:, 0]], pts[t[:, 2]] - pts[t[:, 0]])
        n /= np.maximum(np.sqrt((n * n).sum(axis=1, keepdims=True)), 1e-300)
        return n, (n * pts[t[:, 0]]).sum(axis=1)

    least = 1e-12 * size
    made = [0]  # triangles so far
    corners: dict[int, tuple[int, int, int]] = {}
    normals: dict[int, tuple[float, float, float, float]] = {}
    sides: dict[tuple[int, int], int] = {}  # the triangle to the left of an edge
    outside: dict[int, np.ndarray] = {}  # points that see a triangle, each kept with one; the first is the farthest

    def add(t: np.ndarray, left: np.ndarray) -> list[int]:
        """Adds triangles, and deals them the points that are left; those that see none are inside."""
        n, o = planes(t)
        first = made[0]
        made[0] += len(t)
        for k, (p, q, r) in enumerate(t.tolist()):
            corners[first + k], normals[first + k] = (p, q, r), (*n[k].tolist(), float(o[k]))
            sides[p, q] = sides[q, r] = sides[r, p] = first + k
        if not len(left):
            return []
        off = pts[left] @ n.T - o
        best = off.argmax(axis=1)
        high = off[np.arange(len(left)), best]
        found = []
        for k in np.unique(best[high > least]).tolist():
            own = np.flatnonzero((best == k) & (high > least))
            top = own[high[own].argmax()]
            outside[first + k] = np.concatenate([left[[top]], left[own[own != top]]])
            found.append(first + k)
        return found

    todo = add(tri, np.setdiff1d(np.arange(len(pts)), tri))
    while todo:
        start = todo.pop()
        if start not in outside:
            continue
        p = int(outside[start][0])
        x, y, z = pts[p].tolist()
        seen, rim, look = {start}, [], [start]
        while look:  # triangles that see p lie side by side
            i, j, k = corners[look.pop()]
            for u, v in ((i, j), (j, k), (k, i)):
                near = sides[v, u]
                if near not in seen:
                    a, b, c, o = normals[near]
                    if a * x + b * y + c * z - o > least:
                        seen.add(near)
                        look.append(near)
                    else:
                        rim.append((u, v))
        left = [outside.pop(t) for t in seen if t in outside]
        for t in seen:
            i, j, k = corners.pop(t)
            del normals[t], sides[i, j], sides[j, k], sides[k, i]
        left = np.concatenate(left)
        todo += add(np.array([(u, v, p) for u, v in rim]), left[left != p])
    return pts, np.array(list(corners.values()), np.int64).reshape(-1, 3)


def hull_corners(x: np.ndarray) -> np.ndarray:
    """Points on the hull of points of two or three dimensions; flat ones in space all count."""
    if x.shape[1] == 2:
        return convex_hull(x)
    pts, tri = hull_facets(x)
    return pts[np.unique(tri)] if len(tri) else pts


def hull_share(x: np.ndarray) -> float:
    """Area or volume of the hull by that of the bounding box."""
    if len(x) <= x.shape[1]:
        return 0.0
    box = float(np.prod(np.ptp(x, axis=0)))
    if box < SMALL:
        return 0.0
    if x.shape[1] == 2:
        u, v = convex_hull(x).T
        return float(abs((u * np.roll(v, -1) - np.roll(u, -1) * v).sum()) / 2 / box)
    pts, tri = hull_facets(x)
    a, b, c = (pts[tri[:, k]] - pts.mean(axis=0) for k in range(3))
    return float(abs((a * np.cross(b, c)).sum()) / 6 / box)


def area_utilisation(low: DataFrame) -> DataFrame:
    """Area (in space: volume) of the convex hull by that of the bounding box, for points of two or three coordinates.

    Tasks reduce their points to hull corners, which are then few, unless all points lie on a curved surface."""
    first = low.select(F.size("vec").alias("d")).first()
    d = first.d if first else 2
    if d not in (2, 3):
        raise ValueError(f"no hull of {d} coordinates")
    names = [f"x{k}" for k in range(d)]

    def read(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Points of a task, reduced to hull corners whenever there are twice as many as were left the last time."""
        held, n, limit = [np.empty((0, d))], 0, HULL
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            n += batch.num_rows
            if n >= limit:
                held = [hull_corners(np.concatenate(held))]
                n = len(held[0])
                limit = max(HULL, 2 * n)
        return np.concatenate(held)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = hull_corners(read(batches))
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(d)], names)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([hull_share(read(batches))])], ["value"])

    rows = low.select(*(F.col("vec")[k].cast("double").alias(n) for k, n in enumerate(names)))
    # a shuffle, so that the corners are found where the points are and only they meet in one task
    return _value(rows.mapInArrow(corners, ", ".join(f"{n} double" for n in names)).repartition(1).mapInArrow(share, "value double"), F.max("value"))


def radial_distribution(low: DataFrame) -> DataFrame:
    """Spread of the distances to the centroid by their mean."""
    rows = low.crossJoin(_centroid(low)).withColumn("r", F.sqrt(F.aggregate(F.zip_with("vec", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    return _value(rows, F.when(F.avg("r") >= SMALL, F.stddev_pop("r") / F.avg("r")))


def _centroid(points: DataFrame, *keys: str) -> DataFrame:
    """(keys..., c): mean vectors, by coordinate."""
    by = points.select(*keys, F.posexplode("vec").alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    return by.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("c"))


def label_sums(points: DataFrame, curvature: float = 0.0) -> DataFrame:
    """(i, label, other, s, n, low, high): sum, count, least and greatest distance from i to the others of each label."""
    at = space(curvature)

    def told(a: Block, labels: np.ndarray, d: np.ndarray, axis: int) -> pa.Table:
        """Of the distances of each point of a, along ``axis``, to points of ``labels``, which are in order."""
        names, starts = np.unique(labels, return_index=True)
        there = np.isfinite(d)
        high, s, n = d, d, np.broadcast_to(np.diff(np.append(starts, len(labels))), (len(a.ids), len(names)))
        by = lambda how, x, **more: (how.reduceat(x, starts, axis=axis, **more) if axis else how.reduceat(x, starts, axis=axis, **more).T).ravel()
        if not there.all():
            high, s, n = np.where(there, d, -np.inf), np.where(there, d, 0), by(np.add, there, dtype=np.int64)
        ids = np.repeat(a.ids, len(names))
        return pa.table(
            {
                "i": ids, "label": pa.array(np.repeat(a.labels.astype(np.int64), len(names))), "other": np.tile(names.astype(np.int64), len(a.ids)), "s": by(np.add, s), "n": n.ravel(),
                "low": by(np.minimum, d), "high": by(np.maximum, high),
            }
        )

    def work(a: Block, b: Block) -> pa.Table:
        p, q = np.argsort(a.labels, kind="stable"), np.argsort(b.labels, kind="stable")
        a, b = Block(a.ids[p], a.x[p], a.labels[p], {}, number=a.number), Block(b.ids[q], b.x[q], b.labels[q], {}, number=b.number)
        d = _between(a, b, at, exact=False)
        one = told(a, b.labels, d, 1)
        return one if a.number == b.number else pa.concat_tables([one, told(b, a.labels, d, 0)])

    how = {"s": "sum", "n": "sum", "low": "min", "high": "max"}
    rows = pair_blocks(points.where("label IS NOT NULL"), work, "i long, label long, other long, s double, n long, low double, high double", sums=how, halves=True)
    return rows.groupBy("i", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def silhouette(points: DataFrame, curvature: float = 0.0) -> DataFrame:
    """Mean silhouette; points alone in their class count 0."""
    return silhouette_of(label_sums(points, curvature))


def silhouette_of(sums: DataFrame) -> DataFrame:
    """Mean silhouette from :func:`label_sums`."""
    same = F.col("label") == F.col("other")
    by = sums.groupBy("i").agg(
        F.max(F.when(same & (F.col("n") > 0), F.col("s") / F.col("n"))).alias("a"),
        F.min(F.when(~same & (F.col("n") > 0), F.col("s") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return _value(by, F.avg(s))


def davies_bouldin(points: DataFrame, curvature: float = 0.0) -> DataFrame:
    """Mean over classes of the worst ratio of scatters to medoid distance; scatters include the medoid itself."""
    x = Stored(medoids_of(label_sums(points, curvature)).join(points.select("id", "vec"), "id"), "medoids").df  # a row per class, read twice
    a, b = x.select(F.col("label").alias("la"), F.col("scatter").alias("sa"), F.col("vec").alias("x")), x.select(F.col("label").alias("lb"), F.col("scatter").alias("sb"), F.col("vec").alias("y"))
    d = space(curvature).distance(F.col("x"), F.col("y"))
    return worst_ratios(a.join(b, F.col("la") != F.col("lb")).withColumn("d", d))  # one row per pair of classes


def medoids_of(sums: DataFrame) -> DataFrame:
    """(label, id, scatter): each class's member of least total distance to the others, and its mean, the member included."""
    own = sums.where("label = other")
    return own.groupBy("label").agg(F.min_by("i", F.struct("s", "i")).alias("id"), (F.min("s") / F.count("*")).alias("scatter"))


def worst_ratios(both: DataFrame) -> DataFrame:
    """The mean over classes of the greatest ratio, from scatters and medoid distances (la, sa, sb, d) of pairs of classes."""
    worst = both.groupBy("la").agg(F.max(F.when(F.col("d") >= SMALL, (F.col("sa") + F.col("sb")) / F.col("d"))).alias("w"))
    return _value(worst, F.sum(F.coalesce("w", F.lit(0.0))) / F.count("*"))


def db_ratio(high: DataFrame, low: DataFrame, curvature: float = 0.0) -> DataFrame:
    """Davies-Bouldin of ``high`` by that of ``low``."""
    return ratio(davies_bouldin(high), davies_bouldin(low, curvature))


def ratio(high: DataFrame, low: DataFrame) -> DataFrame:
    """One value by another, 0 where that vanishes."""
    h, e = high.withColumnRenamed("value", "h"), low.withColumnRenamed("value", "e")
    return h.crossJoin(e).select(F.when(F.col("e") >= SMALL, F.col("h") / F.col("e")).otherwise(0.0).alias("value"))


def dunn(points: DataFrame, curvature: float = 0.0) -> DataFrame:
    """Least distance between classes by the greatest diameter of one."""
    return dunn_of(label_sums(points, curvature))


def dunn_of(sums: DataFrame) -> DataFrame:
    """Dunn's index from :func:`label_sums`."""
    same = F.col("label") == F.col("other")
    between, wide = F.min(F.when(~same, F.col("low"))), F.max(F.when(same & (F.col("n") > 0), F.col("high")))
    return _value(sums, F.when(wide >= SMALL, between / wide))


def cluster_density(low: DataFrame) -> DataFrame:
    """Sum over pairs of classes of squared centroid distance by the product of mean radii, by the number of classes."""
    c = _centroid(low.where("label IS NOT NULL"), "label")
    r = low.join(c, "label").withColumn("r", F.sqrt(F.aggregate(F.zip_with("vec", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    classes = r.groupBy("label").agg(F.greatest(F.avg("r"), F.lit(SMALL)).alias("r")).join(c, "label")
    a, b = classes.toDF("la", "ra", "ca"), classes.toDF("lb", "rb", "cb")
    gap = F.zip_with("ca", "cb", lambda x, y: x - y)
    both = a.join(b, F.col("la") < F.col("lb")).select((dot(gap, gap) / (F.col("ra") * F.col("rb"))).alias("x"))
    k = classes.agg(F.count("*").alias("k"))
    return _value(both.crossJoin(k), F.sum("x") / F.max("k"))


def class_density(low: DataFrame) -> DataFrame:
    """Overlap of classes in the plane: mean absolute difference of their density images, summed over pairs of classes.

    Images are Gaussian estimates with Scott's bandwidth on a grid over the bounding box widened by a twentieth,
    each divided by its maximum. Classes of fewer than two points or with singular covariance are blank."""
    rows = low.where("label IS NOT NULL").select("label", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    box = rows.agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))
    stats = rows.groupBy("label").agg(F.count("*").alias("n"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    h = F.pow("n", F.lit(-1 / 3))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    good = (F.col("n") >= 2) & (det > 1e-15 * F.col("sxx") * F.col("syy"))
    stats = stats.where(good).select("label", (F.col("syy") / det / h).alias("a"), (-F.col("sxy") / det / h).alias("b"), (F.col("sxx") / det / h).alias("c"))
    edges = box.first()  # four numbers
    gx, gy = (np.linspace(lo - 0.05 * (hi - lo), hi + 0.05 * (hi - lo), GRID) if lo is not None else np.zeros(GRID) for lo, hi in ((edges.x0, edges.x1), (edges.y0, edges.y1)))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The images of a task's points: GRID x GRID sums for each class in it."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy()
            x, y, a, b, c = (batch.column(k).to_numpy() for k in range(1, 6))
            for start in range(0, len(labels), 256):
                s = slice(start, start + 256)
                dx, dy = gx[None, None, :] - x[s, None, None], gy[None, :, None] - y[s, None, None]
                image = np.exp(-(a[s, None, None] * dx * dx + 2 * b[s, None, None] * dx * dy + c[s, None, None] * dy * dy) / 2)
                for label in np.unique(labels[s]).tolist():
                    sums[label] = sums.get(label, 0.0) + image[labels[s] == label].sum(axis=0)
        for label, image in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(GRID * GRID, label, np.int64)), pa.array(np.arange(GRID * GRID)), pa.array(image.ravel())], ["label", "cell", "p"])

    parts = rows.join(stats, "label").select(F.col("label").cast("long"), "x", "y", "a", "b", "c").mapInArrow(drawn, "label long, cell long, p double")
    images = parts.groupBy("label", "cell").agg(F.sum("p").alias("p"))
    peaks = images.groupBy("label").agg(F.max("p").alias("peak"))
    images = images.join(peaks, "label").select("cell", "label", (F.col("p") / F.col("peak")).alias("p"))
    # Blank classes differ from each other class by its image.
    of_cell = images.groupBy("cell").agg(F.collect_list("p").alias("ps"), F.sum("p").alias("s"))
    pairs = F.aggregate("ps", F.lit(0.0), lambda s, p: s + F.aggregate("ps", F.lit(0.0), lambda t, q: t + F.abs(p - q)) / 2)
    count = rows.agg(F.count_distinct("label").alias("k")).crossJoin(stats.agg(F.count("*").alias("m")))
    per = of_cell.crossJoin(count).select((pairs + (F.col("k") - F.col("m")) * F.col("s")).alias("x"))
    return _value(per, F.sum("x") / (GRID * GRID))


def sampled_ids(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(id) of all points, or of ``most`` of them in the order of what their ids draw."""
    return points.select("id").orderBy(drawn(seed), "id").limit(most)


def evaluate(high: DataFrame, low: DataFrame, k: int = 5, most: int | None = None) -> DataFrame:
    """One row (trustworthiness, continuity) of all points, or of ``most`` of them if that is given."""
    if most is not None and high.count() > most:
        ids = sampled_ids(high, most)
        high, low = high.join(ids, "id"), low.join(ids, "id")
    return trustworthiness(high, low, k).toDF("trustworthiness").crossJoin(continuity(high, low, k).toDF("continuity"))


def all_metrics(high: DataFrame | None, low: DataFrame, curvature: float = 0.0, k: int = 10, projection: str = "stereographic", distances: DataFrame | Tiles | None = None) -> DataFrame:
    """One row of eight metrics; those whose inputs (``high`` or ``distances``, rows (i, j, d) or tiles, labels) are missing are null.

    Overlap and the ratio of Davies-Bouldin indices take given distances where there are any, and then those of the
    embedding's space. The neighbours in both spaces are found once for all that use them."""
    from . import pair_metrics
    from .projection import project

    near_high = Stored(knn(high, k), "near").df if high is not None else None
    near_low = Stored(knn(low, k), "near").df if high is not None else None
    n = low.count()
    most = min(k, n - 1)
    plane = project(low, curvature, projection).select("id", F.array("x", "y").alias("vec"), *(["label"] if "label" in low.columns else []))
    labelled = "label" in low.columns
    parts = {
        "trustworthiness": trustworthiness(high, low, k, near=near_low) if high is not None else None,
        "continuity": continuity(high, low, k, near=near_high) if high is not None else None,
        "knn_overlap": overlap_of(pair_metrics.nearest(distances, most), knn(low, most, curvature), n, most) if distances is not None and most > 0 else overlap_of(near_high, near_low, n, most) if high is not None and most > 0 else None,
        "area_utilisation": area_utilisation(plane),
        "radial_distribution": radial_distribution(plane),
        "class_density_measure": class_density(plane) if labelled else None,
        "cluster_density_measure": cluster_density(plane) if labelled else None,
        "db_index_ratio": ratio(pair_metrics.davies_bouldin(distances, low), davies_bouldin(low, curvature)) if labelled and distances is not None else db_ratio(high if "label" in high.columns else high.join(low.select("id", "label"), "id"), low, curvature) if labelled and high is not None else None,
    }
    out = None
    for name, part in parts.items():
        part = part.toDF(name) if part is not None else low.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))
        out = part if out is None else out.crossJoin(part)
    return out
