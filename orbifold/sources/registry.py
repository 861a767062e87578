"""Data sets by name: generated ones, and embeddings in Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .synthetic import GENERATORS, generated_distances

KINDS = ("all", "train", "test")


@dataclass(frozen=True)
class Dataset:
    """Points (id, vec, label) and, for curved sets, their own distances (i, j, d)."""

    points: DataFrame
    distances: DataFrame | None = None


def names() -> list[str]:
    return ["embeddings", *GENERATORS]


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec, label) of a Parquet table (vec_id, embedding, label)."""
    return spark.read.parquet(path).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def drawn(seed: int, of: str = "id") -> Column:
    """A number below 2^32 that an id (or another whole number) draws: the first eight digits of the MD5 of ``id:seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(of).cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def share_drawn(seed: int, of: str = "id") -> Column:
    """A number from 0 to below 1 that an id draws."""
    return drawn(seed, of) / F.lit(float(2**32))


def split(points: DataFrame, kind: str = "all", seed: int = 42) -> DataFrame:
    """All points, or the six sevenths of training and one of test points that a hash of the id makes."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    test = drawn(seed) % 7 == 0
    return points if kind == "all" else points.where(test if kind == "test" else ~test)


def load(spark: SparkSession, name: str, n: int = 500, kind: str = "all", path: str | None = None, seed: int = 42) -> Dataset:
    """A data set by (case-insensitive, trimmed) name."""
    name = name.lower().strip()
    if name == "embeddings":
        if path is None:
            raise ValueError("embeddings need a path")
        return Dataset(split(embeddings(spark, path), kind, seed))
    if name not in GENERATORS:
        raise ValueError(f"unknown data set {name!r}")
    make, curvature = GENERATORS[name]
    points = make(spark, n, seed)
    return Dataset(points, generated_distances(points, curvature) if curvature is not None else None)


def head(data: Dataset, n: int) -> Dataset:
    """The points with ids below ``n``, and their distances."""
    d = data.distances
    return Dataset(data.points.where(F.col("id") < n), d.where((F.col("i") < n) & (F.col("j") < n)) if d is not None else None)


def sample(data: Dataset, n: int, seed: int = 42) -> Dataset:
    """``n`` points in the order of a hash of their ids, and their distances."""
    chosen = data.points.orderBy(drawn(seed), "id").limit(n)
    d = data.distances
    if d is not None:
        ids = chosen.select("id")
        d = d.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi").select("i", "j", "d")
    return Dataset(chosen, d)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results: a semicolon-separated file with Dataset, Curvature and metric columns."""
    return spark.read.csv(path, sep=";", header=True, inferSchema=True)


def experiment_table(results: DataFrame, metric: str) -> DataFrame:
    """A metric by data set (rows) and curvature (columns)."""
    return results.groupBy("Dataset").pivot("Curvature").agg(F.first(metric)).orderBy("Dataset")


#: How data sets are called in tables of results. Fixed values.
TITLES = {"mnist": "MNIST", "embeddings": "Embeddings"}


def results_of(results: DataFrame, curvatures: list[float] | None = None, datasets: list[str] | None = None) -> DataFrame:
    """The results of some curvatures and data sets, all by default, with a ``Title`` for each data set."""
    if curvatures is not None:
        results = results.where(F.col("Curvature").isin([float(k) for k in curvatures]))
    if datasets is not None:
        results = results.where(F.col("Dataset").isin(datasets))
    known = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    return results.withColumn("Title", F.coalesce(known[F.col("Dataset")], F.initcap(F.regexp_replace("Dataset", "_", " "))))
