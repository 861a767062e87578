"""Perplexity-calibrated affinities over nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let, total
from ..storage import Stored
from .pairs import knn, nearest_of_pairs
from .tiles import Tiles, nearest_of_tiles

#: Bracket, start, tolerance and steps of the bandwidth bisection.
LOW, HIGH, START, TOLERANCE, STEPS = 1e-10, 1e4, 1.0, 1e-5, 50


def neighbours(n: int, perplexity: float) -> int:
    """How many neighbours count: 3 perplexity + 1, all others at most."""
    return min(n - 1, int(3 * perplexity + 1))


def _weights(d2: Column, sigma: Column) -> Column:
    """exp(-(d2 - min) / 2 sigma^2), normalised."""
    raw = let(F.array_min(d2), lambda low: F.transform(d2, lambda x: F.exp(-(x - low) / (2 * sigma * sigma))))
    return let(raw, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def sigma_of(d2: Column, perplexity: float) -> Column:
    """The Gaussian bandwidth whose distribution over squared distances ``d2`` has the perplexity, by bisection."""
    goal = math.log(perplexity)
    start = F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), F.lit(START).alias("s"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        entropy = let(_weights(d2, state["s"]), lambda p: -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(x + 1e-10)))

        def moved(h: Column) -> Column:
            met = state["done"] | (F.abs(h - goal) < TOLERANCE)
            hi = F.when(~met & (h > goal), state["s"]).otherwise(state["hi"])
            lo = F.when(~met & (h <= goal), state["s"]).otherwise(state["lo"])
            s = F.when(met, state["s"]).otherwise(F.when(h > goal, (state["lo"] + state["s"]) / 2).otherwise((state["s"] + state["hi"]) / 2))
            return F.struct(lo.alias("lo"), hi.alias("hi"), s.alias("s"), met.alias("done"))

        return F.when(state["done"], state).otherwise(let(entropy, moved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["s"])


def sigmas(near: DataFrame, perplexity: float) -> DataFrame:
    """(i, js, d2, sigma) of neighbours (i, j, d), nearest first."""
    rows = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct((F.col("d") * F.col("d")).alias("d2"), "j"))).alias("n"))
    rows = rows.select("i", F.col("n.j").alias("js"), F.col("n.d2").alias("d2"))
    return rows.withColumn("sigma", sigma_of(F.col("d2"), perplexity))


def conditional(near: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, p): p(j | i) over the neighbours of i."""
    rows = sigmas(near, perplexity).withColumn("p", _weights(F.col("d2"), F.col("sigma")))
    return rows.select("i", F.explode(F.arrays_zip("js", "p")).alias("z")).select("i", F.col("z.js").alias("j"), F.col("z.p").alias("p"))


def symmetric(p: DataFrame) -> DataFrame:
    """(i, j, v): p(j | i) + p(i | j), normalised to a sum of 1."""
    p = Stored(p, "conditional").df  # read for its sum and for its rows, and made from neighbours that have to be looked for
    both = p.select("i", "j", F.col("p").alias("v")).union(p.select("j", "i", "p"))
    v = both.groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = p.agg((2 * F.sum("p")).alias("whole"))
    return v.crossJoin(whole).select("i", "j", (F.col("v") / F.col("whole")).alias("v"))


def affinities(points: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """(i, j, v): symmetric affinities of Euclidean points; 2 n (3 perplexity + 1) rows at most."""
    return symmetric(conditional(knn(points, neighbours(points.count(), perplexity)), perplexity))


def affinities_of_pairs(pairs: DataFrame | Tiles, perplexity: float = 30.0) -> DataFrame:
    """The same for given distances, rows (i, j, d) or tiles."""
    if isinstance(pairs, Tiles):
        near = nearest_of_tiles(pairs, neighbours(pairs.points.count(), perplexity))
    else:
        near = nearest_of_pairs(pairs, neighbours(pairs.select("i").distinct().count(), perplexity))
    return symmetric(conditional(near, perplexity))
