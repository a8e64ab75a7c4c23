"""Extension: event logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, read as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events by window and keys; windows close once the watermark has passed them. Works on batches too."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def daily_log(events: DataFrame, path: str, checkpoint: str):
    """Append log records to JSON lines, a folder for each UTC day, and stop when all that is there has been read."""
    day = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return day.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
