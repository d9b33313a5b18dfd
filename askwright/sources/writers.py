"""Writers: JSON lines, one stream a kind, media by content, append with resume, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import not_yet_done


def write_rows(rows: DataFrame, path: str, default_split: str = "test") -> int:
    """Question rows as JSON lines; the count comes from the write itself."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.withColumn("split", F.coalesce("split", F.lit(default_split))).observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def write_by_kind(rows: DataFrame, path: str, kind: str = "kind") -> None:
    """A folder of JSON lines for each kind."""
    rows.write.partitionBy(kind).json(path)


def media_by_content(media: DataFrame, data: str = "data", ext: str = "ext", order: str | None = None, digest: str = "sha1") -> DataFrame:
    """Each distinct content once, named by 16 digits of its SHA-1 (or `md5`), with its number of rows and the least ``order`` of them.

    Rows of one name are merged within each task before they are shuffled.
    """
    named = media.withColumn("file", F.concat(F.substring({"sha1": F.sha1, "md5": F.md5}[digest](data), 1, 16), F.col(ext)))
    first = [F.min(order).alias("first")] if order else []
    return named.groupBy("file").agg(F.first(data).alias(data), *first, F.count(F.lit(1)).alias("n"))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows that ``path`` has not yet; a first run writes all."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = not_yet_done(rows, spark.read.schema(rows.schema).parquet(path), keys)
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_report(metrics: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def update_report(spark: SparkSession, path: str, **values) -> None:
    """Set keys of a small JSON document in place; it is written beside and renamed, so a reader never sees half of one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = where.getFileSystem(conf)
    told = json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(where) else {}
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps({**told, **values}, indent=2, ensure_ascii=False).encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(where), options)


def write_features(frames: DataFrame, path: str, store: str) -> DataFrame:
    """Write the frames (path, frame, vec) of a store sorted by path and frame, and its spans (path, lo, hi, width) beside; returns these.

    Files are cut by range of (path, frame), so a path of very many frames is many files, and a path is sought by its files' statistics.
    """
    spark = frames.sparkSession
    frames.select("path", "frame", "vec").repartitionByRange("path", "frame").sortWithinPartitions("path", "frame").write.parquet(f"{path}/{store}")
    kept = spark.read.parquet(f"{path}/{store}")
    spans = kept.groupBy("path").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"), F.max(F.size("vec")).alias("width"))
    spans.write.parquet(f"{path}/{store}.spans")
    return spark.read.parquet(f"{path}/{store}.spans")
