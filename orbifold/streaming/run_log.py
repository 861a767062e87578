"""The log of runs: snapshots appended as Parquet, followed as a stream."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run_id string, iteration long, loss double, phase string, id long, x double, y double"

#: A row an iteration, and what the stream of them tells and keeps of each run.
LOSSES = "run_id string, iteration long, loss double, phase string"
PROGRESS, STATE = "run_id string, iteration long, loss double, best double, phase string", "iteration long, best double"


def append_loss(spark: SparkSession, folder: str, run_id: str, iteration: int, loss: float, phase: str) -> None:
    """Appends an iteration's loss."""
    spark.createDataFrame([(run_id, iteration, float(loss), phase)], LOSSES).coalesce(1).write.mode("append").parquet(folder)


def _progress(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New iterations of a run, in order, each with the least loss so far; what was told before is left out."""
    last, best = state.get if state.exists else (-1, math.inf)
    out = []
    for r in pd.concat(parts).sort_values("iteration").itertuples():
        if r.iteration > last:
            last, best = int(r.iteration), min(best, float(r.loss))
            out.append((key[0], last, float(r.loss), best, r.phase))
    state.update((last, best))
    yield pd.DataFrame(out, columns=["run_id", "iteration", "loss", "best", "phase"])


def tell_progress(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int = 1) -> DataFrame:
    """The progress of all runs in a log of losses, told once for each iteration however often that was logged.

    What is new since the last call with this ``checkpoint`` is read, some files at a time, and added to the table ``out``.
    The state of a run, its last iteration and least loss, lives in the checkpoint, so calls go on where others ended."""
    stream = spark.readStream.schema(LOSSES).option("maxFilesPerTrigger", files).parquet(folder)
    told = stream.groupBy("run_id").applyInPandasWithState(_progress, PROGRESS, STATE, "append", GroupStateTimeout.NoTimeout)
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PROGRESS).parquet(out)


def append(plane: DataFrame, folder: str, run_id: str, iteration: int, loss: float, phase: str) -> None:
    """Appends a snapshot: projected points (id, x, y) with the iteration's loss."""
    rows = plane.select(F.lit(run_id).alias("run_id"), F.lit(iteration).cast("long").alias("iteration"), F.lit(float(loss)).alias("loss"), F.lit(phase).alias("phase"), "id", "x", "y")
    rows.write.mode("append").parquet(folder)


def losses(log: DataFrame) -> DataFrame:
    """(run_id, iteration, loss, phase): one row per iteration, however often it was logged."""
    return log.groupBy("run_id", "iteration").agg(F.max("loss").alias("loss"), F.max("phase").alias("phase"))


def latest(log: DataFrame) -> DataFrame:
    """The points of each run's last iteration."""
    last = log.groupBy("run_id").agg(F.max("iteration").alias("iteration"))
    return log.join(last, ["run_id", "iteration"]).dropDuplicates(["run_id", "iteration", "id"])


def follow(spark: SparkSession, folder: str, use: Callable[[DataFrame, int], None], checkpoint: str, files: int = 1) -> StreamingQuery:
    """Calls ``use(batch, number)`` for new files of the log, a few at a time."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).start()


def running_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (run_id, iteration, loss): to be written in complete mode."""
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return stream.groupBy("run_id", "iteration").agg(F.max("loss").alias("loss"))
