"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that names the shared folder.
SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The configured folder. Only in local mode, where one machine is all there is, a new one stands in for it."""
    found = spark.conf.get(SHARED_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_DIR} has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='orbifold-')}"
        spark.conf.set(SHARED_DIR, found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/orbifold/{name}-{uuid.uuid4().hex}"
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


class Stored:
    """A DataFrame written to the shared folder; ``discard`` removes its files once nothing reads them."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        files, where = _hadoop(self.spark, self.path)
        files.delete(where, True)
