"""Incremental labelling: a file stream whose new rows are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, keys: list[str], files_per_batch: int = 1) -> None:
    """Read parquet files as they come, drop rows whose key was written before, append the rest; stops when all is read.

    Keys are unique within the stream by a stateful deduplication, so a file that is delivered again adds nothing; offsets and state
    live in ``checkpoint`` and a restart goes on where it stopped.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = rows.dropDuplicates(keys)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 day") -> None:
    """Counts by event-time window and kind; a window is written when the watermark has passed it."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    told = rows.groupBy(F.window("__t", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
    told.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended(spark: SparkSession, out: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(out)
