"""Readers of raw inputs: parquet folders, JSON lines and documents, CSV, label folders, tar shards, Arrow streams."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import TQ_ROW


def parquet_tree(spark: SparkSession, path: str, columns: list[str] | None = None, position: bool = False) -> DataFrame:
    """All parquet files below ``path``, with the split their names tell (val and test are test).

    ``position`` adds the columns file and row: rows sorted by them are those of a reader that goes through the sorted paths.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    split = F.when(F.col("_metadata.file_name").rlike("(val|test)"), "test").otherwise("train").alias("split")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if position else []
    return df.select(*(columns or df.columns), split, *place)


def parquet_tree_until(spark: SparkSession, path: str, enough: dict[str, int], columns: list[str] | None = None, growth: int = 2) -> DataFrame:
    """The first rows of each split below ``path``, ``enough`` of each, in the order of sorted paths; files behind those are not opened.

    Files are listed, and read in rounds, ``growth`` times as many each time, until every split has its rows: a split's count comes from the
    files' footers.  Splits that are not named give no rows; a split with too few gives all.  File and row are columns of the result.
    """
    if any(n < 0 for n in enough.values()):
        raise ValueError("a number of rows is not negative")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    files = sorted(r[0] for r in listed.collect())
    split = {f: "test" if re.search("(val|test)", f.rsplit("/", 1)[-1]) else "train" for f in files}
    files = [f for f in files if enough.get(split[f], 0)]
    have, taken, size = dict.fromkeys(enough, 0), [], 1
    while wanted := [f for f in files if f not in taken and have[split[f]] < enough[split[f]]][:size]:
        told = spark.read.parquet(*wanted).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        counts = {r["file"]: r["n"] for r in told.collect()}  # a row a file of the round
        for f in wanted:
            have[split[f]] += counts.get(f, 0)
        taken, size = taken + wanted, size * growth
    if not taken:
        return parquet_tree(spark, path, columns, position=True).limit(0)
    df = spark.read.parquet(*sorted(taken))
    name = F.when(F.col("_metadata.file_name").rlike("(val|test)"), "test").otherwise("train")
    rows = df.select(*(columns or df.columns), name.alias("split"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    quota = F.element_at(F.create_map(*[x for k, n in enough.items() for x in (F.lit(k), F.lit(n))]), F.col("split"))
    rank = F.row_number().over(Window.partitionBy("split").orderBy("file", "row"))
    return rows.withColumn("__rank", rank).where((F.col("__rank") <= max(enough.values())) & (F.col("__rank") <= quota)).drop("__rank")


def footer_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value metadata in the footer of the first parquet file (by path) below ``path``; no rows are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()
    if not files:
        return {}
    parquet = jvm.org.apache.parquet.hadoop
    first = parquet.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(min(files))), conf)
    reader = parquet.ParquetFileReader.open(first)
    try:
        return dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()


def class_names(spark: SparkSession, path: str, column: str) -> list[str]:
    """Names of a column's classes, in the order of their numbers, as the footer's data-set card has them; none without a card."""
    card = json.loads(footer_metadata(spark, path).get("huggingface", "{}"))
    return card.get("info", {}).get("features", {}).get(column, {}).get("names", [])


def question_rows(spark: SparkSession, path: str, split: str | None = None, default: str | None = "train") -> DataFrame:
    """Question rows of JSON lines; rows without a split get ``default``, or match no split if that is None."""
    df = spark.read.schema(TQ_ROW).json(path)
    if default is not None:
        df = df.withColumns({"split": F.coalesce("split", F.lit(default)), "state": F.coalesce("state", F.lit(""))})
    return df.where(F.col("split") == split) if split else df


def json_document(spark: SparkSession, path: str, list_field: str | None = None) -> DataFrame:
    """One JSON document; ``list_field`` makes its elements rows."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.inline(list_field)) if list_field else df


def annotated_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of a document with images, annotations and categories, joined on their ids."""
    doc = spark.read.option("multiLine", "true").json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height", "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name", "c.supercategory")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", F.col("a.bbox").alias("b"), "a.area", F.coalesce(F.col("a.iscrowd").cast("int") == 1, F.lit(False)).alias("iscrowd"))
    told = boxes.join(images, "image_id").join(names, "category_id")
    return told.select("image_id", "name", "supercategory", *[F.col("b")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "w", "h"))], F.col("width").cast("double"), F.col("height").cast("double"), "iscrowd", F.col("area").cast("double"), "file_name")


def csv_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def label_folders(spark: SparkSession, root: str) -> DataFrame:
    """(file, label): the label is the first folder below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_replace("path", "^.*?" + r"\Q" + root.rstrip("/") + r"\E/", "")
    return files.select(F.col("path").alias("file"), F.get(F.split(below, "/"), 0).alias("label"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files; content is null where the path is a mounted one, which a task opens itself and reads as a stream."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    mounted = where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    content = F.lit(None).cast("binary") if mounted else F.col("content")
    return spark.read.format("binaryFile").load(path).select("path", content.alias("content"))


def _mounted(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def tar_members(spark: SparkSession, path: str, pattern: str = ".*", limit_bytes: int | None = None) -> DataFrame:
    """(shard, at, member, data) of tar files, compressed or not, in archive order; one task reads one shard as a stream.

    Members that do not match are passed over, and so are those larger than ``limit_bytes`` where that is given.  Without it a member
    that no cell can hold (2 GB) is an error.  A shard on a mounted path may be of any size; one elsewhere comes as one cell.
    """
    wanted = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["path"], batch["content"], strict=True):
                with open(_mounted(shard), "rb") if content is None else io.BytesIO(content) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for at, m in enumerate(tar):
                        if not m.isfile() or not wanted.search(m.name) or (limit_bytes is not None and m.size > limit_bytes):
                            continue
                        if m.size >= 1 << 31:
                            raise ValueError(f"{m.name} in {shard} has {m.size} bytes, more than a cell holds")
                        yield pd.DataFrame({"shard": [shard], "at": [at], "member": [m.name], "data": [tar.extractfile(m).read()]})

    return _files(spark, path).mapInPandas(run, "shard string, at int, member string, data binary")


def paired_members(members: DataFrame, left: str = "jpg", right: str = "txt") -> DataFrame:
    """(shard, stem, left, right): members of a shard that share a stem and have both extensions."""
    ext = F.lower(F.regexp_extract("member", r"\.([^./]+)$", 1))
    stem = F.regexp_replace("member", r"\.[^./]+$", "")
    told = members.withColumns({"ext": ext, "stem": stem}).groupBy("shard", "stem").agg(F.max(F.when(F.col("ext") == left, F.col("data"))).alias(left), F.max(F.when(F.col("ext") == right, F.col("data"))).alias(right))
    return told.where(F.col(left).isNotNull() & F.col(right).isNotNull())


def arrow_streams(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow IPC stream files; a file is a task, and one on a mounted path is memory-mapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                source = content.as_buffer() if content.is_valid else pa.memory_map(_mounted(file.as_py()))
                with pa.ipc.open_stream(source) as stream:
                    yield from stream

    return _files(spark, path).mapInArrow(run, schema)


def feature_frames(spark: SparkSession, path: str, stores: list[str]) -> DataFrame:
    """Frames (store, path, frame, vec) of several feature stores; a path in an earlier store hides it in later ones."""
    rows = None
    for i, s in enumerate(stores):
        df = spark.read.parquet(f"{path}/{s}").withColumn("__i", F.lit(i))
        rows = df if rows is None else rows.unionByName(df)
    first = rows.groupBy("path").agg(F.min("__i").alias("__first"))
    return rows.join(first, "path").where(F.col("__i") == F.col("__first")).drop("__i", "__first")
