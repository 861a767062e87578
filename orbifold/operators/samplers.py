"""Samplers of pairs of points; each returns a DataFrame (i, j) with i different from j.

A draw is a hash of its number and a seed, so that samples are the same whatever the partitions are, and a task that runs
again draws the same."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.registry import drawn, share_drawn
from ..storage import Stored
from .pairs import gather_pairs, knn

#: Points, or candidates, that are numbered together.
PART = 1 << 16


class PairSampler(ABC):
    """Draws ``batch`` pairs of ``points``; ids may be any, they are numbered for the draw."""

    def __init__(self, points: DataFrame, batch: int, seed: int = 42) -> None:
        self.points, self.batch, self.seed = points, batch, seed
        self._n: int | None = None

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.points.count()
        return self._n

    def precompute(self) -> PairSampler:
        return self

    @abstractmethod
    def sample_pairs(self) -> DataFrame:
        """The pairs drawn."""

    def _numbered(self) -> DataFrame:
        """(number, id): numbers from 0, by ranking within hash parts on top of the parts' counts."""
        rows = self.points.select("id").withColumn("part", drawn(64) % max(1, -(-self.n // PART)))
        counts = rows.groupBy("part").count()
        before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
        return rows.withColumn("own", own).join(counts.select("part", before.alias("before")), "part").select((F.col("own") + F.col("before")).alias("number"), "id")

    def _drawn_pairs(self, batch: int, seed: int) -> DataFrame:
        """(draw, i, j): uniform pairs by the number of their draw."""
        spark, n = self.points.sparkSession, self.n
        if n < 2:
            return spark.range(0).select(F.col("id").alias("draw"), F.col("id").alias("i"), F.col("id").alias("j"))
        draws = spark.range(batch).select(F.col("id").alias("draw"), F.floor(share_drawn(seed) * n).alias("a"), F.floor(share_drawn(seed + 1) * (n - 1)).alias("o"))
        draws = draws.select("draw", "a", ((F.col("a") + 1 + F.col("o")) % n).alias("b"))
        numbered = self._numbered()
        return draws.join(numbered.toDF("a", "i"), "a").join(numbered.toDF("b", "j"), "b").select("draw", "i", "j")

    def _uniform(self, batch: int, seed: int) -> DataFrame:
        return self._drawn_pairs(batch, seed).select("i", "j")


class RandomSampler(PairSampler):
    """Uniform pairs."""

    def sample_pairs(self) -> DataFrame:
        return self._uniform(self.batch, self.seed)


class KNNSampler(PairSampler):
    """A uniform point and one of its k nearest."""

    def __init__(self, points: DataFrame, batch: int, seed: int = 42, k: int = 15) -> None:
        super().__init__(points, batch, seed)
        self.k, self.near = k, None

    def precompute(self) -> PairSampler:
        self._held = Stored(knn(self.points, self.k).select("i", "rank", "j"), "neighbours")
        self.near = self._held.df
        return self

    def release(self) -> None:
        """Removes the table of neighbours, which is then no longer known."""
        if self.near is not None:
            self._held.discard()
            self.near = None

    def _near(self, batch: int) -> DataFrame:
        if self.near is None:
            raise RuntimeError("precompute() comes first")
        n, k = self.n, min(self.k, self.n - 1)
        draws = self.points.sparkSession.range(batch).select(F.floor(share_drawn(self.seed) * n).alias("number"), (F.floor(share_drawn(self.seed + 1) * k) + 1).alias("rank"))
        return draws.join(self._numbered(), "number").select(F.col("id").alias("i"), "rank").join(self.near, ["i", "rank"]).select("i", "j")

    def sample_pairs(self) -> DataFrame:
        return self._near(self.batch)


class NegativeSampler(KNNSampler):
    """Pairs of neighbours first, uniform pairs for the rest."""

    def __init__(self, points: DataFrame, batch: int, seed: int = 42, k: int = 15, positive_ratio: float = 0.7) -> None:
        super().__init__(points, batch, seed, k)
        self.positives = int(batch * positive_ratio)

    def sample_pairs(self) -> DataFrame:
        return self._near(self.positives).union(self._uniform(self.batch - self.positives, self.seed + 2))


class StratifiedSampler(PairSampler):
    """Pairs by bins of distance, close bins more often.

    Bin edges are quantiles of a sample of distances. As many bins as pairs are drawn, with probabilities that fall
    linearly from ``close_weight`` to 1; four times as many candidates are drawn, and each bin takes the first it
    wants of those within its edges. Uniform pairs make up for bins that run short. Draws and candidates meet their bins
    in range joins with the table of bins, which is as long as there are bins; places within a bin are counted by
    parts of candidates, so that no bin is sorted in one task."""

    def __init__(self, points: DataFrame, batch: int, seed: int = 42, n_bins: int = 10, close_weight: float = 3.0, n_percentile_samples: int = 100_000) -> None:
        super().__init__(points, batch, seed)
        self.bins, self.close, self.samples = n_bins, close_weight, n_percentile_samples
        self.edges: list[float] | None = None

    def precompute(self) -> PairSampler:
        d = gather_pairs(self.points, self._uniform(min(self.samples, self.n * (self.n - 1)), self.seed + 3))
        at = [b / self.bins for b in range(self.bins + 1)]
        self.edges = d.agg(F.percentile("d", F.array(*map(F.lit, at))).alias("e")).first().e
        return self

    def ends(self) -> list[float]:
        """Where the probabilities of the bins, one after another, end."""
        w = [self.close + (1 - self.close) * b / max(1, self.bins - 1) for b in range(self.bins)]
        return [*(sum(w[: b + 1]) / sum(w) for b in range(self.bins - 1)), 1.0]

    def shares(self) -> list[int]:
        """Pairs wanted of each bin, as drawn."""
        spark, ends = self.points.sparkSession, self.ends()
        bins = spark.createDataFrame([(b, low, high) for b, (low, high) in enumerate(zip([0.0, *ends], ends, strict=False))], "bin int, low double, high double")
        draws = spark.range(self.batch).select(share_drawn(self.seed + 7).alias("u"))
        found = draws.join(F.broadcast(bins), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).groupBy("bin").count().collect()
        counts = {r.bin: r["count"] for r in found}
        return [counts.get(b, 0) for b in range(self.bins)]

    def sample_pairs(self) -> DataFrame:
        if self.edges is None:
            raise RuntimeError("precompute() comes first")
        spark, wanted = self.points.sparkSession, self.shares()
        bins = spark.createDataFrame([(b, low, high, b == self.bins - 1, n) for b, (low, high, n) in enumerate(zip(self.edges, self.edges[1:], wanted, strict=False))], "bin int, low double, high double, last boolean, wanted long")
        drawn = self._drawn_pairs(4 * self.batch, self.seed)
        d = gather_pairs(self.points, drawn.select("i", "j").distinct())
        inside = (F.col("d") >= F.col("low")) & ((F.col("d") < F.col("high")) | F.col("last") & (F.col("d") == F.col("high")))
        found = drawn.join(d, ["i", "j"]).join(F.broadcast(bins), inside).withColumn("part", F.floor(F.col("draw") / PART))
        counts = found.groupBy("bin", "part").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = F.row_number().over(Window.partitionBy("bin", "part").orderBy("draw"))
        taken = found.withColumn("place", place).join(counts.select("bin", "part", before.alias("before")), ["bin", "part"]).where(F.col("place") + F.col("before") <= F.col("wanted"))
        have = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("count").alias("n")).collect()}  # a row for each bin
        short = self.batch - sum(min(n, have.get(b, 0)) for b, n in enumerate(wanted))
        return taken.select("i", "j").union(self._uniform(short, self.seed + 5))


def create_sampler(kind: str, points: DataFrame, batch: int, seed: int = 42, **options: float) -> PairSampler:
    """A sampler by name: random, knn, stratified, negative."""
    kinds = {"random": RandomSampler, "knn": KNNSampler, "stratified": StratifiedSampler, "negative": NegativeSampler}
    if kind not in kinds:
        raise ValueError(f"unknown sampler {kind!r}")
    return kinds[kind](points, batch, seed, **options)
