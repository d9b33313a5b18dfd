"""Deterministic draws: md5 of seed, key and draw number orders rows, picks elements and flips coins.

The draws depend on the data alone, so any partitioning gives the same sample, and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import places


def draw(seed: str, *keys: Column | str) -> Column:
    """32 hex digits."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def uniform(seed: str, *keys: Column | str) -> Column:
    """In [0, 1), from the first 8 digits."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def whole(seed: str, n: Column | int, *keys: Column | str) -> Column:
    """In 0 .. n-1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("long"), n).cast("int")


def shuffled(seed: str, items: Column, key: Column) -> Column:
    """The items in the order of their draws."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), x.cast("string"))).alias("d"), x.alias("x")))), lambda s: s["x"])


def pick(seed: str, items: Column, key: Column, k: Column | int) -> Column:
    """k items without replacement (all, if there are fewer)."""
    return F.slice(shuffled(seed, items, key), F.lit(1), F.lit(k) if isinstance(k, int) else k)


def md5_mod20(hex_digest: Column) -> Column:
    """The digest as one number modulo 20, without wide integers: 16**k is 16 modulo 20 for every k above 0."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(hex_digest, i, F.lit(1)), 16, 10).cast("int"))
    sum_of = F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.element_at(digits, 32) + 16 * sum_of, F.lit(20))


def stratified_split(rows: DataFrame, label: str, fraction: float, seed: str, key: str, out: str = "split") -> DataFrame:
    """At least one and a rounded (half to even) ``fraction`` of each label to test."""
    told = places(rows, [label], [draw(seed, key), key], "__at", "__of")
    want = F.greatest(F.lit(1), F.bround(F.col("__of") * fraction).cast("int"))
    return told.withColumn(out, F.when(F.col("__at") < want, "test").otherwise("train")).drop("__at", "__of")


def halves(rows: DataFrame, group: list[str], order: list[str], out: str = "half") -> DataFrame:
    """Even and odd positions in each group."""
    told = places(rows, group, order, "__at", "__of")
    return told.withColumn(out, F.when(F.col("__at") % 2 == 0, "even").otherwise("odd")).drop("__at", "__of")


def cap_each(rows: DataFrame, group: str, cap: int, seed: str, key: str) -> DataFrame:
    """At most ``cap`` rows of each group, by draw.  The window limit drops rows before the shuffle."""
    by = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return rows.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= cap).drop("__rank")


def mix(rows: DataFrame, source: str, key: str, weights: dict[str, float], cap: int | None, seed: str) -> DataFrame:
    """One epoch: each source drawn by its weight and cap, with the pass number and a global order.

    Weight w makes max(1, floor(w + 0.999)) passes, of which floor(n / passes * w) rows are kept, at most floor(cap * w).
    """
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col(source) == name, F.lit(float(value))).otherwise(w)
    passes = F.greatest(F.lit(1), F.floor(w + 0.999).cast("int"))
    drawn = rows.withColumn("weight", w).withColumn("passes", passes).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    drawn = places(drawn, [source], [draw(seed, key, "pass"), key], "__at", "__of")
    want = F.floor(F.col("__of") / F.col("passes") * F.col("weight"))
    if cap is not None:
        want = F.least(want, F.floor(F.lit(cap) * F.col("weight")))
    drawn = drawn.where(F.col("__at") < want)
    return drawn.withColumn("order_key", draw(seed + "-order", key, "pass")).drop("__at", "__of", "passes", "weight")
