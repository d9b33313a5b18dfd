"""What the operators of this subpackage share: tables, the shared folder, text rules, folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Byte table for the same rule on UTF-8: A-Z only, every other byte as it is.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.  Without one a temporary folder serves a local master (tests); a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="askwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/askwright/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def settle(df: DataFrame, kind: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Unlike cached blocks the files outlive lost executors, and their real size is known to the planner.
    """
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_process(name: str, build: Callable):
    """One object for a Python process, kept between tasks: tables whose content follows from their keys alone."""
    import sys
    import types

    held = sys.modules.setdefault("_askwright_process", types.ModuleType("_askwright_process"))
    if not hasattr(held, name):
        setattr(held, name, build())
    return getattr(held, name)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let at most ``rows`` rows go to Python at once: whole texts are long, and a batch is held by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give free memory of this Python process back: Spark keeps the process for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A batch function that, when its own frame is gone, gives its memory back."""

    def outer(batches):
        yield from run(batches)
        release()

    return outer


def portions(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = (np.flatnonzero(np.diff((size - 1) // limit)) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, len(size)], strict=True) if len(size) else ():
            yield batch.slice(a, b - a)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """The remainder of crc32 of the id as text; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
