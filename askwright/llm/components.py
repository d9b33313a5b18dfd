"""Connected components of a graph given as edges between BIGINT nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours.  Minima are partial sums first, so a hot node is no hot task."""
    least = settle(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v), root being the least node it is connected to.

    Alternates large-star and small-star steps; both keep connectivity, and edges never grow in number.  The state between
    rounds is a table in the shared folder, so a lost executor costs one step.  Rounds grow with the logarithm of the longest path;
    a graph that is not settled after ``rounds`` of them is an error, never a result.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        small = _least_neighbour(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
