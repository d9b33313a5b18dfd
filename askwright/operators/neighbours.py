"""Similar vectors through an inverted file: cells around centroids, several cells looked at for each vector, exact similarities inside.

The index is fitted on at most ``sample`` vectors, drawn by a hash of their values, and holds every vector.  How many cells a vector looks at
follows from a target for the recall, measured on the sample against all of it (where neighbours are farther away than among all vectors, so
the number errs upwards).  Vectors with clusters need few cells; vectors in all directions alike need a share of the cells that no index can
make small.  With no more vectors than one cell holds the search is exact.

A recall of 1 takes no index: all vectors are one cell, whose blocks are larger, so that what is shuffled (each vector once for every block of
the other side) stays small beside the products.  It is exact at any size, in bounded memory, and its products grow with asking times asked vectors.

Equal vectors are searched once, and are found once: of their ids only the least ``wide * k`` can be among anybody's most similar, ties being
settled by the id.  Cells are dealt out in blocks of asking and of asked vectors, so a crowded cell is many tasks, none larger than two blocks.
A block gives one row for each vector that asks, with its best as an array; what is merged is a row for each vector and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..session import settled

#: Draws of the sample, and centroids of the index, whatever the input: 65,536 vectors of 64 numbers are 32 MB.
SAMPLE, MOST_CELLS, CELL, BLOCK = 65_536, 4_096, 2_048, 4_096
#: Side of a block of the exact search, in blocks of the index.
WHOLE = 4


def centroids(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means, begun at vectors spread over the sample; an empty cell keeps its centroid."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    found = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(part @ found.T).argmax(1) for part in np.array_split(unit, -(-len(unit) // BLOCK))])
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(unit[order], starts, axis=0)
        found[own[order][starts]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


def probes_for(sample: np.ndarray, cells: np.ndarray, k: int, recall: float, asked: int = 512) -> int:
    """The least number of cells that hold a share ``recall`` of the ``k`` most similar of the sample, by ``asked`` of its vectors."""
    if len(cells) == 1:
        return 1
    own = np.concatenate([(part @ cells.T).argmax(1) for part in np.array_split(sample, -(-len(sample) // BLOCK))])
    places = []
    for part in np.array_split(sample[np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)], 16):
        if not len(part):
            continue
        sims = part @ sample.T
        best = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, : k + 1]
        rank = np.argsort(np.argsort(-(part @ cells.T), axis=1), axis=1)
        places.append(np.take_along_axis(rank, own[best], axis=1).ravel())
    at = np.sort(np.concatenate(places))
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def best_of_block(asks: np.ndarray, base: np.ndarray, order: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``asks`` the ``best`` most similar of ``base`` by (similarity to six places, ``order``), one row's after the other's:
    how many each has, their places in ``base``, their similarities.

    Single precision finds those that can be among them, with a margin above its error; they are computed anew in double precision.
    """
    counts, places, similarities = [], [], []
    short = base.astype(np.float32)
    n, longest = len(base), float(np.sqrt((base * base).sum(1).max()))
    for at in range(0, len(asks), 1024):
        part = asks[at : at + 1024]
        near = part.astype(np.float32) @ short.T
        if n > best:
            tops = near
            if (wide := n // 16) >= 2 * best:  # the best of 16th parts: their best-th bounds that of all from below
                tops = near[:, : 16 * wide].reshape(len(near), 16, wide).max(axis=1)
            least = np.partition(tops, tops.shape[1] - best, axis=1)[:, tops.shape[1] - best]
            margin = 4e-6 + 2.0**-22 * base.shape[1] * longest * np.sqrt((part * part).sum(1))
            rows, cols = np.divmod(np.flatnonzero(near >= (least - margin)[:, None].astype(np.float32)), n)
        else:
            rows, cols = np.divmod(np.arange(near.size), n)
        sims = np.round(np.einsum("ij,ij->i", part[rows], base[cols]), 6)
        by = np.lexsort((order[cols], -sims, rows))
        first = np.searchsorted(rows, np.arange(len(part)))  # rows ascend already
        kept = by[np.arange(len(by)) - first[rows] < best]
        counts.append(np.bincount(rows[kept], minlength=len(part)))
        places.append(cols[kept])
        similarities.append(sims[kept])
    return np.concatenate(counts), np.concatenate(places), np.concatenate(similarities)


def _key(vector: Column) -> list[Column]:
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2")]


def similar(vectors: DataFrame, k: int = 5, max_sim: float = 0.9, wide: int = 3, asks: DataFrame | None = None, recall: float = 0.95, cell: int = CELL, most_cells: int = MOST_CELLS, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding", text: str | None = None) -> DataFrame:
    """(key, rank, other, sim): the k most similar others below ``max_sim`` among the ``wide`` * k most similar, for each row of ``asks``
    (all of ``vectors``, where not given), by the index described above; exact with a ``recall`` of 1.

    With ``text``, a column of both, others of the same normalised text are no neighbours.  Similarities are inner products, rounded to six
    places.  Rows without a vector or key have no neighbours and are none; repeated rows of one key are one; an empty table gives no rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    best = wide * k
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # shuffled as they are
    wanted = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")).where("id is not null and v is not null")
    rows = wanted(vectors)
    first = Window.partitionBy("h1", "h2").orderBy("id")
    base = rows.select("id", "v", *_key(F.col("v"))).distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= best)
    asking = rows if asks is None else wanted(asks)
    # one of each vector asks
    base = settled(base, "vectors")
    once = base.where("n = 1").select("h1", "h2", "v") if asks is None else asking.select(*_key(F.col("v")), "v").dropDuplicates(["h1", "h2"])

    total = base.count()
    cells = 1 if recall >= 1 else int(min(most_cells, max(1, -(-total // cell))))
    block = BLOCK if cells > 1 else WHOLE * BLOCK
    if cells == 1:
        found, probes = None, 1
    else:
        drawn = np.array([r[0] for r in base.select("v", "h1", "h2").orderBy("h1", "h2").limit(sample).collect()], float)
        found = centroids(drawn, cells)
        probes = probes_for(drawn, found, best, recall)

    def nearest_cells(count: int):
        @F.pandas_udf("array<int>")
        def of(v: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(v), 1024):
                near = np.stack(v[at : at + 1024]).astype(float) @ found.T
                near = near.argmax(1)[:, None] if count == 1 else np.argpartition(-near, count - 1, axis=1)[:, :count] if count < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
                out += list(near.astype(np.int32))
            return pd.Series(out)

        return of("v") if found is not None else F.array(F.lit(0))

    base = base.withColumn("cell", nearest_cells(1)[0])
    once = once.withColumn("cell", F.explode(nearest_cells(probes)))
    sizes = {side: {r[0]: -(-r[1] // block) for r in df.groupBy("cell").count().collect()} for side, df in (("asked", base), ("asks", once))}  # a row a cell
    blocks = lambda side: F.element_at(F.create_map(*[F.lit(int(x)) for kv in sizes[side].items() for x in kv]), F.col("cell")) if sizes[side] else F.lit(1)
    part = lambda side, *by: F.pmod(F.xxhash64(*by), F.coalesce(blocks(side), F.lit(1))).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(blocks(side), F.lit(1)) - 1))
    # no nulls: whole numbers with nulls would be read as floats
    zero = F.lit(0).cast("long")
    left = once.select("cell", part("asks", "h1", "h2").alias("i"), every("asked").alias("j"), F.lit(True).alias("asks"), "h1", "h2", F.lit("0").cast(kind).alias("id"), "v")
    right = base.select("cell", every("asks").alias("i"), part("asked", "id").alias("j"), F.lit(False).alias("asks"), zero.alias("h1"), zero.alias("h2"), "id", "v")

    def search(group: pa.Table) -> pa.Table:
        side = group["asks"].to_numpy()
        a, b = group.filter(pa.array(side)), group.filter(pa.array(~side))
        if not len(a) or not len(b):
            return none
        matrix = lambda t: (v := t["v"].combine_chunks()).flatten().to_numpy().astype(float).reshape(len(v), -1)
        ids = b["id"].combine_chunks()
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        counts, places, sims = best_of_block(matrix(a), matrix(b), by_id, best)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(places)), pa.array(sims))]
        return pa.Table.from_arrays([a["h1"], a["h2"], *lists], ["h1", "h2", "others", "sims"])

    arrow = to_arrow_type(vectors.schema[key].dataType)
    none = pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "others": pa.array([], pa.list_(arrow)), "sims": pa.array([], pa.list_(pa.float64()))})
    told = left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(search, f"h1 long, h2 long, others array<{kind}>, sims array<double>")
    pairs = F.arrays_zip(F.transform("sims", lambda s: -s).alias("less"), F.col("others").alias("other"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, best)  # no more than a row for each block that was looked at
    told = told.groupBy("h1", "h2").agg(merged.alias("found"))
    ids = asking.select("id", *_key(F.col("v"))).distinct()
    near = F.filter("found", lambda x: (x["other"] != F.col("id")) & (-x["less"] < max_sim))
    if text is None:
        told = ids.join(told, ["h1", "h2"]).select("id", F.posexplode(F.slice(near, 1, k)).alias("at", "x"))
        return told.select(F.col("id").alias(key), (F.col("at") + 1).alias("rank"), F.col("x.other").alias("other"), (-F.col("x.less")).alias("sim"))
    norm = lambda df: df.select(F.col(key).alias("id"), F.md5(T.normalise(F.col(text))).alias("norm")).dropDuplicates(["id"])
    told = ids.join(told, ["h1", "h2"]).select("id", F.explode(near).alias("x")).select("id", F.col("x.other").alias("other"), (-F.col("x.less")).alias("sim"))
    told = told.join(norm(vectors if asks is None else asks), "id").join(norm(vectors).select(F.col("id").alias("other"), F.col("norm").alias("its")), "other").where("norm <> its")
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(F.col("rank") <= k)
    return told.select(F.col("id").alias(key), "rank", "other", "sim")
