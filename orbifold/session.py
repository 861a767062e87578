"""Spark sessions with the settings this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "orbifold", **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` overrides (underscores stand for dots)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
