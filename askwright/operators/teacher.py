"""Labelling by a teacher from end to end: bounded requests in flight, retries, rows appended as they are done, restarts that go on.

The client is any function of a row (a dictionary) that returns the likeliest next tokens as (token, log-probability) pairs, or raises.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .joins import not_yet_done
from .questions import option_probabilities

Client = Callable[[dict], list[tuple[str, float]]]
TOP = "array<struct<token:string,logprob:double>>"


def asked(rows: DataFrame, client: Client, in_flight: int = 8, attempts: int = 3, pause: float = 0.2, slowest: float = 30.0) -> DataFrame:
    """``rows`` with ``top`` (what the client returned) and ``failure`` (its last exception, after ``attempts`` of them).

    A task has at most ``in_flight`` requests open.  Between attempts it waits ``pause`` seconds, twice as long each time, up to
    ``slowest``, with a random share taken off so that tasks do not return together.
    """

    def one(row: dict) -> tuple[list | None, str | None]:
        for k in range(attempts):
            try:
                return [(str(t), float(p)) for t, p in client(row)], None
            except Exception as e:  # noqa: BLE001  whatever a client raises is that row's failure, not the task's
                last = f"{type(e).__name__}: {e}"[:500]
                if k + 1 < attempts:
                    time.sleep(min(slowest, pause * 2**k) * random.uniform(0.5, 1))
        return None, last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                told = list(pool.map(one, batch.to_dict("records")))
                yield batch.assign(top=[t and [{"token": a, "logprob": b} for a, b in t] for t, _ in told], failure=[e for _, e in told])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", top {TOP}, failure string"
    return rows.mapInPandas(run, schema)


def label_rows(rows: DataFrame, client: Client, path: str, keys: list[str], variants: Column, model: str = "teacher", tasks: int = 8, portions: int = 8, **options) -> dict[str, int]:
    """Ask for every row that ``path`` has not yet and append it with ``teacher`` (probs, mass, model); counts of this run.

    Rows go in ``portions`` by a hash of their keys, each appended by one job when it is done, so a run that is killed loses one
    portion at most, and the next run asks for what is missing: rows that failed or named no option are not written, as are none twice.  At
    most ``tasks`` times ``in_flight`` requests are open.  Rows with equal keys (nulls are equal) are asked for once.  ``variants`` are each option's spellings.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    counts = {"labelled": 0, "failed": 0, "unanswered": 0}
    once = rows.dropDuplicates(keys)
    for i in range(portions):
        todo = once.where(F.pmod(F.xxhash64(*keys), F.lit(portions)) == i)
        if fs.exists(where):
            todo = not_yet_done(todo, spark.read.parquet(path), keys)
        told = asked(todo.repartition(tasks), client, **options).withColumn("told", option_probabilities(F.col("top"), variants))
        probs = F.transform("told.probs", lambda p: F.round(p, 5))
        told = told.withColumn("teacher", F.when(F.col("told.probs").isNotNull(), F.struct(probs.alias("probs"), F.round("told.mass", 4).alias("mass"), F.lit(model).alias("model"))))
        seen = Observation()
        failed, answered = F.col("failure").isNotNull(), F.col("teacher").isNotNull()
        told = told.observe(seen, F.count_if(answered).alias("labelled"), F.count_if(failed).alias("failed"), F.count_if(~failed & ~answered).alias("unanswered"))
        told.where(answered).drop("top", "failure", "told").write.mode("append").parquet(path)
        counts = {k: n + (seen.get[k] or 0) for k, n in counts.items()}
    return counts
