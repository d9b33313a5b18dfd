"""Exact duplicates by two passes with a Bloom filter.

Pass 1 counts, in each cell of a Bloom filter, whether one or several rows fell on it: every task sends the
cells it met (2 bytes each, by block of 65,536 cells) and blocks are merged in two levels.  The cells met at
least twice are the filter.  Pass 2 tests every row against it.  A row with a cell that nobody else met is the
only one of its text and passes straight through; only the others, the possibly repeated ones, are shuffled,
and grouping them by SHA-256 decides.  A false positive costs a shuffle of that row and nothing else.

The filter has ``bits_per_row`` cells a row, up to ``max_cells`` (one bit a cell is broadcast, 64 MB at the
bound).  Beyond that it fills up and more rows are shuffled: slower, with the same result.

Defined cases: null texts are empty texts; empty texts are equal to each other; a null id is smaller than any
other; of rows with equal text *and* id exactly one is kept; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table

BLOCK = 16  # cells of a block, as a power of two
_SHA, _HASH, _ROW, _FLAG, _TOP = "__aw_sha", "__aw_hash", "__aw_row", "__aw_flag", "__aw_top"


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Both cells of each hash: its low and its high half, cut to the filter."""
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(cells - 1)
    return np.concatenate([h & mask, (h >> np.uint64(32)) & mask])


def _met(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        parts = [_cells(b.column(0).to_numpy(zero_copy_only=False), cells) for b in batches if b.num_rows]
        if not parts:
            return
        at, count = np.unique(np.concatenate(parts), return_counts=True)
        yield _blocks(at, count >= 2, part // 256)

    return run


def _blocks(at: np.ndarray, twice: np.ndarray, level: int) -> pa.RecordBatch:
    block = (at >> np.uint64(BLOCK)).astype(np.int64)
    cell = (at & np.uint64((1 << BLOCK) - 1)).astype("<u2")
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(starts[1:], len(block))
    rows = [(int(block[s]), level, cell[s:e][~twice[s:e]].tobytes(), cell[s:e][twice[s:e]].tobytes()) for s, e in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "level", "once", "twice"])


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: cells met by one of the rows, cells met twice or by two of them."""
    of = lambda c: np.frombuffer(b"".join(bytes(x) for x in group[c]), dtype="<u2")
    met = np.bincount(of("once"), minlength=1 << BLOCK)
    met[of("twice")] = 2
    return pd.DataFrame({"block": [group["block"].iloc[0]], "level": [0], "once": [np.flatnonzero(met == 1).astype("<u2").tobytes()], "twice": [np.flatnonzero(met >= 2).astype("<u2").tobytes()]})


def repeat_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, max_cells: int = 1 << 29) -> tuple[np.ndarray, int]:
    """(bits, cells): the cells that two rows of ``hashes`` (one BIGINT column) met, one bit each."""
    cells = 1 << BLOCK
    while cells < min(rows * bits_per_row, max_cells):
        cells *= 2
    schema = "block long, level long, once binary, twice binary"
    met = hashes.mapInArrow(_met(cells), schema)
    merged = met.groupBy("block", "level").applyInPandas(_merge, schema).groupBy("block").applyInPandas(_merge, schema)
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.select("block", "twice").toLocalIterator():
        one = np.zeros(1 << BLOCK, np.uint8)
        one[np.frombuffer(row["twice"], dtype="<u2")] = 1
        at = row["block"] << (BLOCK - 3)
        bits[at : at + (1 << (BLOCK - 3))] = np.packbits(one, bitorder="little")
    return bits, cells


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, narrow: Sequence[str] | None = None, least: bool = False, bits_per_row: int = 16, max_cells: int = 1 << 29) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 for each row; the largest id stays, or the ``least``.

    ``narrow`` names columns to keep (the id and other short ones); they are first written with their digests to the shared
    folder, so that texts are read once.  Without it all columns pass through, and of the texts only the possibly repeated ones are
    shuffled.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.coalesce(docs[text_col], F.lit(""))) if key is None else key
    names = list(narrow) if narrow else list(docs.columns)
    columns = [docs[c] for c in names]
    keyed = docs.select(*columns, F.unhex(F.sha2(text.cast("binary"), 256)).alias(_SHA), F.xxhash64(text).alias(_HASH))
    if narrow:
        keyed = settle(keyed, "digests")
    bits, cells = repeat_filter(keyed.select(_HASH), keyed.count() if narrow else docs.count(), bits_per_row, max_cells)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def met_twice(h: pd.Series) -> pd.Series:
        at = _cells(h.to_numpy(), cells)
        hit = (shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series((hit[: len(h)] & hit[len(h) :]).astype(bool))

    flagged = keyed.withColumn(_FLAG, met_twice(F.col(_HASH)))
    alone = flagged.where(~F.col(_FLAG)).select(*names, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex(_SHA)).alias("text_sha256"))
    maybe = settle(flagged.where(F.col(_FLAG)).select(*names, _SHA).withColumn(_ROW, F.monotonically_increasing_id()), "possibly-repeated")
    groups = settle(maybe.groupBy(_SHA).agg(F.count(F.lit(1)).alias("group_size"), (F.min if least else F.max)(F.struct(F.col(id_col).alias("keep_id"), F.col(_ROW).alias("row"))).alias(_TOP)), "groups")
    told = maybe.join(groups, _SHA).select(*[maybe[c] for c in names], F.col(f"{_TOP}.keep_id").alias("keep_id"), "group_size", (F.col(f"{_TOP}.row") == F.col(_ROW)).alias("kept"), F.lower(F.hex(_SHA)).alias("text_sha256"))
    return alone.unionByName(told)


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    names = list(docs.columns)
    inner = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    of = {c: f"c{i}" for i, c in enumerate(names)}
    kept = exact_duplicates(inner, of[options.pop("id_col", "doc_id")], of[options.pop("text_col", "text")], **options).where("kept")
    return kept.select(*[F.col(of[c]).alias(c) for c in names])


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), narrow=["doc_id"])


ORACLE = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
