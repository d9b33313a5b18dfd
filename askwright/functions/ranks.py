"""Places of rows within groups of any size: a range-partitioned sort and the counts of its partitions, a distributed prefix sum.

A window over a group puts the group's rows in one task.  Here rows are dealt by ranges of (group, order), so a group that holds most rows
spans many partitions; a partition knows where a group begins in it, and the numbers of rows that earlier partitions have
of the group are added.  Those numbers are a row for each partition and group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def places(rows: DataFrame, group: list[str], order: list[Column | str], at: str = "at", of: str = "of") -> DataFrame:
    """``rows`` with their place from 0 in the order of their group, and the number of rows in it.

    Null group values are a group, null order values come first.  Rows that agree in group and order are placed by a hash of all
    columns, and are interchangeable where that agrees too.  The sorted rows are written once to the shared folder.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order] + [F.xxhash64(*[F.col(c) for c in rows.columns])]
    named = {f"__by{i}": k for i, k in enumerate(keys)}
    by = list(named)
    sort = rows.withColumns(named).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    sort = settled(sort.withColumn("__place", F.monotonically_increasing_id()).drop(*by), "places")
    part = F.shiftright("__place", 33)
    heads = sort.groupBy(part.alias("__part"), *group).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part") if group else Window.orderBy("__part")
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    heads = heads.withColumns({"__before": F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__of": F.sum("__n").over(whole)})
    heads = heads.select("__part", (F.col("__before") - F.col("__first")).alias("__shift"), F.col("__of"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)])
    sort = sort.withColumn("__in", part)
    on = sort["__in"] == heads["__part"]
    for i, c in enumerate(group):
        on = on & sort[c].eqNullSafe(heads[f"__g{i}"])
    told = sort.join(heads, on)
    return told.select(*[sort[c] for c in rows.columns], (F.col("__place") + F.col("__shift")).alias(at), F.col("__of").alias(of))
