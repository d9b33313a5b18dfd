"""Running counts of a labelling run: keyed state of a stream, a snapshot of the changed groups for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_progress(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, group: str, probs: str = "probs", label: str = "label", files_per_batch: int = 1) -> None:
    """Follow Parquet files of labelled rows; write how many each group has labelled, failed and got right so far.

    Counts are summed in each task before they meet their group's state, so a group with most rows is no hot task.  A micro-batch's snapshot
    is one folder, named by its number and overwritten if the batch is run again, and offsets and state are in ``checkpoint``:
    a restart counts nothing twice.  Stops when all is read.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    told = F.col(probs).isNotNull()
    best = F.array_position(F.col(probs), F.array_max(probs)) - 1
    counts = rows.groupBy(group).agg(F.count_if(told).alias("labelled"), F.count_if(~told).alias("failed"), F.count_if(told & (best == F.col(label))).alias("right"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_progress(spark: SparkSession, out: str, group: str) -> DataFrame:
    """The last snapshot of each group, with the share of labelled rows whose likeliest option is the label."""
    seen = spark.read.parquet(out)
    last = seen.groupBy(group).agg(F.max_by(F.struct("labelled", "failed", "right"), "batch").alias("x")).select(group, "x.*")
    return last.withColumn("accuracy", F.round(F.col("right") / F.greatest(F.lit(1), F.col("labelled")), 6))
