"""A daily panel kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, by ascending modification time; naive times become timestamps, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(asset, date, nav) by day of event time; state of days older than the watermark is dropped.

    Rows that arrive more than ``late`` behind the latest one seen are lost, so
    files must come in about the order of their rows.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("asset"))
    return grouped.agg(F.sum("value").alias("nav"), F.count("*").alias("n")).select("asset", F.to_date("window.start").alias("date"), "nav", "n")


def write_panel(panel: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each finished day to a Parquet table, once, and stop when the input is read."""
    return panel.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
