"""Sessions, table loading and the canonical schemas."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Schemas of question rows and what is derived from them.
TQ_ROW = "id string, source string, split string, state string, context string, question struct<type:string,instructions:string,criteria:array<struct<key:string,value:string>>>, label int, images array<string>, audios array<string>, category string, grp string, rot int"
TEACHER = "images array<string>, audios array<string>, instructions string, criteria array<struct<key:string,value:string>>, probs array<double>, mass double, model string"
RESULT = "set string, id string, label int, pred int, correct boolean, ms double, category string, grp string, rot int"


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; a cluster's own settings win over these."""
    builder = SparkSession.builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; on a local master a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.gettempdir() + f"/askwright-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def settled(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps neither repeat its work nor lose it with an executor.

    The files go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/askwright/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
