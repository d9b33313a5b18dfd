"""Shards by a Feistel permutation of global row numbers.

Rows get global numbers in the order of their id (a range-partitioned sort of narrow rows and one offset for
each partition).  A balanced Feistel network over the smallest even-width domain that holds n numbers permutes
them; a number that falls outside [0, n) is sent through the network again (cycle walking) until it is inside,
so the map is a permutation of [0, n).  Shard and slot are the remainder and the quotient by the shard count:
any row's place can be computed from its number, the key and n alone, in either direction.

Defined cases: null texts count as empty, null ids come first, rows that agree in id, text and size are
interchangeable, an empty table gives no rows.  Law: `rows`, shard counts are at most one apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser keyed by the round."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_key(seed: int, i: int) -> int:
    return ((seed + 1) * 0x9E3779B97F4A7C15 + i * 0xD1342543DE82EF95) % (1 << 64)


def _half(n: int) -> int:
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    return half


def permute(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The place in [0, n) of each number in [0, n); ``back`` gives the number at each place."""
    half = _half(n)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            key = _round_key(seed, i)
            left, right = (right ^ (_mix(left, key) & mask), left) if back else (right, left ^ (_mix(right, key) & mask))
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with a global number from 0 in ``order``, and their count.

    Equal keys are dealt to several partitions by a running id, so a hot key does not fill one of them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(rows.withColumn("__aw_row", F.monotonically_increasing_id()), "unnumbered")
    by = [*order, "__aw_row"]
    placed = settle(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__aw_at", F.monotonically_increasing_id()).drop("__aw_row"), "ordered")
    part = F.shiftright("__aw_at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())  # a row for each partition
    offsets, n = {}, 0
    for p, c in counts:
        offsets[p], n = n, n + c
    if not offsets:
        return placed.withColumn(name, F.col("__aw_at")).drop("__aw_at"), 0
    first = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), part) if len(offsets) <= 256 else None
    if first is None:
        starts = F.broadcast(spark.createDataFrame(list(offsets.items()), "p long, __aw_first long"))
        placed = placed.withColumn("p", part).join(starts, "p").drop("p")
        first = F.col("__aw_first")
    return placed.withColumn(name, first + F.col("__aw_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__aw_at", "__aw_first"), n


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (null under this law) for each row."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"], "number")

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    return rows.withColumn("place", place("number")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_feistel_shards(spark, sf_dir: str) -> DataFrame:
    return shuffle_shards(table(spark, sf_dir, "documents"))


# CRC-32 a byte at a time, and the network a round at a time in numbers modulo 2^64; a number is done when it is inside after a whole pass
_WIDE = lambda x, by: f"CAST(CAST({x} AS UHUGEINT) * {by} % 18446744073709551616 AS UBIGINT)"
ORACLE: dict[str, str] = {
    "op8_feistel_shards": f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) END AS text_crc32 FROM raw, crc),
docs AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number FROM sized),
net AS (SELECT count(*) AS n, greatest(1, CAST(ceil(log2(greatest(1, count(*))) / 2) AS INT)) AS half, {[_round_key(0, i) for i in range(ROUNDS)]}::UBIGINT[] AS keys FROM docs),
walk(number, l, r, i, n, half, keys) AS (SELECT number, CAST(number >> half AS UBIGINT), CAST(number & ((1 << half) - 1) AS UBIGINT), 0, n, half, keys FROM docs, net
UNION ALL SELECT number, r, xor(l, xor(z, z >> 31) & CAST((1 << half) - 1 AS UBIGINT)), i + 1, n, half, keys
FROM (SELECT *, {_WIDE('xor(y, y >> 27)', 0x94D049BB133111EB)} AS z FROM (SELECT *, {_WIDE('xor(x, x >> 30)', 0xBF58476D1CE4E5B9)} AS y
FROM (SELECT *, CAST((CAST(r AS UHUGEINT) + keys[i % {ROUNDS} + 1]) % 18446744073709551616 AS UBIGINT) AS x FROM walk WHERE i = 0 OR i % {ROUNDS} > 0 OR l * CAST(1 << half AS UBIGINT) + r >= n)))),
placed AS (SELECT number, CAST(l * CAST(1 << half AS UBIGINT) + r AS BIGINT) AS place FROM walk WHERE i > 0 AND i % {ROUNDS} = 0 AND l * CAST(1 << half AS UBIGINT) + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 8 AS INT) AS shard, place // 8 AS slot, CAST(NULL AS INT) AS grown_shard FROM docs JOIN placed USING (number)""",
}
QUERIES = {"op8_feistel_shards": op8_feistel_shards}
