"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Rows of texts that Spark and a worker exchange at once while tables are stored.
ROWS_AT_ONCE = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it the session's Arrow batches have :data:`ROWS_AT_ONCE` rows at most, as texts may be long; afterwards as before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), ROWS_AT_ONCE) if int(before) > 0 else ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Stored(storage.Stored):
    """A table in the shared folder, written with :func:`small_batches`."""

    def __init__(self, df: DataFrame, name: str) -> None:
        with small_batches(df.sparkSession):
            super().__init__(df, name)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; what it has freed goes back to the system, as Spark keeps workers for later tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    return Stored(df, name).df


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened until ``columns`` has none like it, so that helper columns clash with none of the input's."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def in_task(spark: SparkSession, work: Callable[[], Any]) -> Any:
    """What ``work`` returns, computed in one task from the bounded data that it closes over.

    Fits on bounded samples run there: on the driver a matrix inverse with threaded BLAS was seen not to end in a test
    run, and with one thread, as Spark gives its workers, it ended. Why is not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work())], pa.binary())], ["result"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "result binary").first().result)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled(labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """At most ``most`` training rows (doc_id, y): one per doc_id outside the held-out fold, in an
    order fixed by a hash of the id. Null ids and labels other than 0 and 1 are left out; a doc_id
    labelled twice has label 1 if any row says so. The result has at most ``most`` rows of 16 bytes."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(id_crc("doc_id") % modulus != held)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return rows.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(most)
