"""Outputs: packed coordinates and colours, JSON messages, SVG drawings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import label_colors


def colored(plane: DataFrame) -> DataFrame:
    """(id, x, y, red, green, blue) of (id, x, y, label)."""
    colors = label_colors(plane)
    return plane.join(colors, plane["label"].eqNullSafe(colors["label"])).select("id", "x", "y", "red", "green", "blue")


def packed_floats(plane: DataFrame) -> DataFrame:
    """(first_id, data): little-endian float32 x, y, red, green, blue of each point, by id within a part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.stack([batch.column(k).to_numpy() for k in range(1, 6)], axis=1).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([data], pa.binary())], ["first_id", "data"])

    return colored(plane).sortWithinPartitions("id").mapInArrow(pack, "first_id long, data binary")


def messages(df: DataFrame, kind: str) -> DataFrame:
    """(value): a JSON message of the kind for each row."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns)).alias("value"))


def state_messages(log: DataFrame, total: int) -> DataFrame:
    """(value): a JSON status message for each run of a log (run_id, iteration, loss): how far it is and its last loss."""
    last = log.groupBy("run_id").agg(F.max(F.struct("iteration", "loss")).alias("last"))
    done = (F.col("last.iteration") + 1).alias("done")
    return messages(last.select("run_id", done, F.lit(total).alias("total"), F.col("last.loss").alias("loss"), (F.col("last.iteration") + 1 < total).alias("running")), "status")


def loss_chart(log: DataFrame, width: int = 600, height: int = 300, log_axis: bool = False) -> DataFrame:
    """(run_id, value): an SVG polyline of the losses (run_id, iteration, loss) of each run, or their logarithms, scaled to
    the drawing.

    A run's losses, one number an iteration, are put together in one row."""
    log = log.withColumn("loss", F.log10(F.greatest("loss", F.lit(1e-12)))) if log_axis else log
    ends = log.groupBy("run_id").agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"), F.max("iteration").alias("last"))
    x = F.when(F.col("last") > 0, F.col("iteration") / F.col("last") * width).otherwise(0.0)
    y = F.when(F.col("hi") > F.col("lo"), height - (F.col("loss") - F.col("lo")) / (F.col("hi") - F.col("lo")) * height).otherwise(height / 2)
    rows = log.join(ends, "run_id").select("run_id", "iteration", F.format_string("%.2f,%.2f", x, y).alias("p"))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("iteration", "p"))), lambda r: r["p"]), " ")
    return rows.groupBy("run_id").agg(F.concat(F.lit('<polyline fill="none" stroke="steelblue" points="'), path, F.lit('"/>')).alias("value"))


def grid_lines(spark: SparkSession, size: int = 600, steps: int = 4) -> DataFrame:
    """(line, value): SVG lines of a square grid with ``steps`` cells to each side of the axes, which are drawn darker."""
    at = F.col("id") * (size / (2.0 * steps))
    colour = F.when(F.col("id") == steps, "gray").otherwise("lightgray")
    flat = F.format_string('<line x1="0.00" y1="%.2f" x2="%.2f" y2="%.2f" stroke="%s"/>', at, F.lit(float(size)), at, colour)
    tall = F.format_string('<line x1="%.2f" y1="0.00" x2="%.2f" y2="%.2f" stroke="%s"/>', at, at, F.lit(float(size)), colour)
    return spark.range(2 * steps + 1).select(F.posexplode(F.array(flat, tall)).alias("way", "value"), "id").select((F.col("id") * 2 + F.col("way")).alias("line"), "value")


def file_name(title: str) -> str:
    """A title as a file name."""
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in title.lower())


def write_svg(plane: DataFrame, path: str, size: int = 600, ring: bool = True) -> None:
    """Writes a scatter plot of (id, x, y, label) as text lines of one SVG in the folder ``path``; rows are written in order by Spark."""
    half = size / 2
    points = colored(plane).select(
        (F.col("id") + 2).alias("line"),
        F.format_string('<circle cx="%.2f" cy="%.2f" r="3" fill="rgb(%d,%d,%d)"/>', half + F.col("x") * half * 0.9, half - F.col("y") * half * 0.9, *(F.round(F.col(c) * 255).cast("int") for c in ("red", "green", "blue"))).alias("value"),
    )
    _write_lines(points, f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">' + (f'<circle cx="{half}" cy="{half}" r="{half * 0.9}" fill="none" stroke="gray"/>' if ring else ""), path)


def write_bars(table: DataFrame, path: str, width: int = 600, height: int = 300, log_axis: bool = False) -> None:
    """Writes a bar chart of a table (name, one column per series) as an SVG, a bar per value."""
    name, *series = table.columns
    rows = table.select(F.col(name).alias("name"), F.posexplode(F.array(*(F.col(f"`{s}`").cast("double") for s in series))).alias("s", "v"))
    v = F.log10(F.greatest("v", F.lit(1e-12))) - F.log10(F.lit(1e-12)) if log_axis else F.greatest("v", F.lit(0.0))
    rows = rows.where("v IS NOT NULL").withColumn("v", v)
    most = rows.agg(F.max("v").alias("m"), F.count_distinct("name").alias("n"))
    place = rows.select("name").distinct().agg(F.sort_array(F.collect_set("name")).alias("names"))
    rows = rows.crossJoin(most).crossJoin(place).withColumn("at", F.array_position("names", F.col("name")) - 1)
    wide = width / (F.col("n") * (len(series) + 1))
    x = (F.col("at") * (len(series) + 1) + F.col("s")) * wide
    tall = F.when(F.col("m") > 0, F.col("v") / F.col("m") * height).otherwise(0.0)
    bars = rows.select((F.col("at") * len(series) + F.col("s") + 2).cast("long").alias("line"), F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f"/>', x, height - tall, wide * 0.9, tall).alias("value"))
    _write_lines(bars, f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', path)


def _write_lines(lines: DataFrame, opening: str, path: str) -> None:
    """Writes lines by their numbers: tasks write a range each, and the files join in the order of their names."""
    spark: SparkSession = lines.sparkSession
    ends = spark.createDataFrame([(0, opening), (2**62, "</svg>")], "line long, value string")
    lines.union(ends).repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def metric_panel(metrics: DataFrame) -> DataFrame:
    """(metric, value): a one-row table of metrics as text with four decimals, N/A for null."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.format_number(F.col(c), 4), F.lit("N/A")).alias("value")) for c in metrics.columns))
    return metrics.select(F.explode(pairs).alias("p")).select("p.*")
