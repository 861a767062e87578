"""Embedding quality from given distances alone: relations (i, j, d) of both directions or :class:`Tiles`, and labels (id, label).

No coordinates are needed, so these take the distances of curved data sets, of graphs, or of anything else that has some.
Tables of many points are given in tiles, of which a row holds a million distances.
Every metric is a one-row DataFrame (value double). Rows of a pair are read where they lie: tasks reduce them to the k
nearest of a point, or to sums by point and label, before anything is shuffled. What is joined to them has a few rows a point,
of which there are as many as the root of the pairs, and is broadcast, so that pairs are never shuffled or sorted. Pairs of a point with itself are left
out, as are null distances and points without a label. Fewer than two classes, points too few and vanishing denominators
give 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Stored
from . import metrics
from .metrics import _value
from .pairs import nearest_of_pairs
from .tiles import Tiles, distances_asked, ends_by_label, nearest_of_tiles, pairs_of, ranks_of_tiles, sums_by_label

Given = DataFrame | Tiles


def _points(pairs: Given) -> int:
    return pairs.points.count() if isinstance(pairs, Tiles) else pairs.select("i").distinct().count()


def nearest(pairs: Given, k: int) -> DataFrame:
    """(i, rank, j, d): the k nearest others of each point, ties to the smaller id."""
    return nearest_of_tiles(pairs, k) if isinstance(pairs, Tiles) else nearest_of_pairs(pairs, k)


def knn_overlap(high: Given, low: Given, k: int = 10) -> DataFrame:
    """Mean share of the k nearest that both tables of distances have in common."""
    n = _points(high)
    k = min(k, n - 1)
    if k < 1:
        return _value(high.points if isinstance(high, Tiles) else high, F.lit(0.0))
    return metrics.overlap_of(nearest(high, k), nearest(low, k), n, k)


def trustworthiness(high: Given, low: Given, k: int = 10) -> DataFrame:
    """1 less the normalised ranks by ``high`` beyond k of the k nearest by ``low``.

    The distances of these neighbours in ``high`` are looked up, put together by point (k to each), and every row of
    ``high`` then counts for the neighbours it is nearer than: k numbers a point are shuffled by a task, and no ranking
    is made. Both are stored before they are broadcast, so that no broadcast waits for a pass over all pairs."""
    near = Stored(nearest(low, k).select("i", "j"), "near").df
    n = _points(high)
    most = n * k * (2 * n - 3 * k - 1)  # a whole number that 32 bits do not hold from 10,370 points on
    value = lambda over: 1 - F.lit(2 / most) * F.sum(over) if most else F.lit(None)
    if isinstance(high, Tiles):
        found = ranks_of_tiles(high, Stored(distances_asked(high, near), "goals").df)
        return _value(found, value(F.greatest(F.col("rank") - k, F.lit(0))))
    goals = Stored(high.join(F.broadcast(near), ["i", "j"]).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("t")), "goals").df
    nearer = lambda t: F.when(t.isNull(), None).when((F.col("d") < t["d"]) | ((F.col("d") == t["d"]) & (F.col("j") < t["j"])), 1).otherwise(0)
    counted = high.where("i <> j").join(F.broadcast(goals), "i").groupBy("i").agg(*(F.sum(nearer(F.get("t", F.lit(c)))).alias(f"n{c}") for c in range(k)))
    over = sum((F.greatest(F.coalesce(F.col(f"n{c}"), F.lit(0)) + 1 - k, F.lit(0)) for c in range(k)), F.lit(0))
    return _value(counted, value(over))


def continuity(high: Given, low: Given, k: int = 10) -> DataFrame:
    """Trustworthiness with the roles of the distances exchanged."""
    return trustworthiness(low, high, k)


def label_sums(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, label, other, s, n, low, high): sum, count, least and greatest distance from i to the others of each label."""
    known = labels.where("label IS NOT NULL")
    of, other = known.select(F.col("id").alias("i"), "label"), known.select(F.col("id").alias("j"), F.col("label").alias("other"))
    rows = pairs.where("i <> j AND d IS NOT NULL").join(F.broadcast(of), "i").join(F.broadcast(other), "j")
    rows = rows.select("i", "label", "other", F.col("d").alias("s"), F.lit(1).alias("n"), F.col("d").alias("low"), F.col("d").alias("high"))
    alone = known.select(F.col("id").alias("i"), "label", F.col("label").alias("other"), F.lit(0.0), F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return rows.union(alone).groupBy("i", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def silhouette(pairs: Given, labels: DataFrame) -> DataFrame:
    """Mean silhouette; points alone in their class count 0."""
    return metrics.silhouette_of(sums_by_label(pairs, labels) if isinstance(pairs, Tiles) else label_sums(pairs, labels))


def davies_bouldin(pairs: Given, labels: DataFrame) -> DataFrame:
    """Mean over classes of the worst ratio of scatters to medoid distance, which is looked up among the pairs."""
    medoids = Stored(metrics.medoids_of(sums_by_label(pairs, labels) if isinstance(pairs, Tiles) else label_sums(pairs, labels)), "medoids").df
    rows = pairs_of(pairs.among(medoids.select("id"))) if isinstance(pairs, Tiles) else pairs
    a = medoids.select(F.col("id").alias("i"), F.col("label").alias("la"), F.col("scatter").alias("sa"))
    b = medoids.select(F.col("id").alias("j"), F.col("label").alias("lb"), F.col("scatter").alias("sb"))
    return metrics.worst_ratios(rows.join(F.broadcast(a), "i").join(F.broadcast(b), "j").where("la <> lb"))


def db_ratio(high: Given, low: Given, labels: DataFrame) -> DataFrame:
    """Davies-Bouldin by ``high`` by that by ``low``."""
    return metrics.ratio(davies_bouldin(high, labels), davies_bouldin(low, labels))


def dunn(pairs: Given, labels: DataFrame) -> DataFrame:
    """Least distance between classes by the greatest diameter of one."""
    if isinstance(pairs, Tiles):
        return _value(ends_by_label(pairs, labels), F.when(F.max("wide") >= metrics.SMALL, F.min("between") / F.max("wide")))
    return metrics.dunn_of(label_sums(pairs, labels))
