"""Jaccard join on word n-grams by MinHash banding.

A text is the set of its runs of ``n`` words (a shorter text is one run); words are maximal runs of digits, a-z and non-ASCII
characters after lower-casing A-Z, as in the decontamination, so punctuation and line breaks make no difference.
Texts of equal words form one representative.  Its MinHash signature is cut into bands; representatives that share a band's hash
are shuffled to it and tied to the least of them, so a bucket of any size gives one edge a member and never pairs.  Inside the
connected candidates every pair of representatives is verified on the full sets, in blocks: a component of many members is cut
into hashed blocks, and each pair of blocks is one task's intersection counts.  Links at or above the threshold are counted,
not listed; their spanning forests give the classes.

Bands and rows: the most rows a band for which ``recall`` at the threshold needs no more than ``hashes`` MinHashes (30 bands of
7 for 0.999 at 0.8).  Chained candidates are verified too, so recall is never less than that of the bands.

Hashes only find candidates: inside a block runs of words are numbered by their words, so a link is one of full n-gram sets, and
the threshold is compared in whole numbers.

Defined cases: null and empty texts have no n-grams and no links, each is alone in its class; a null id is smallest, and of equal
least ids the first row stays; copies count as links of each other; rows equal in id and text are two documents; a very long text is
one set and its block holds it whole; empty tables give no rows; only id and text are read, so extra columns of any name are left as
they are by ``drop_near_duplicates`` and not read by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, table, tidy
from .components import components
from .exact_dedup import _cells, repeat_filter

GOLD = 0x9E3779B97F4A7C15


def bands_and_rows(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


#: Bytes that are part of no word become blanks, A-Z small letters.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) < 100:
            self[word] = h
        return h


def gram_hashes(words: list[bytes], n: int, cache: WordHashes) -> np.ndarray:
    """A 64-bit hash of each run of n words; of all words if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        x = (x ^ h[j : len(h) - k + 1 + j]) * np.uint64(GOLD | 1)
        x ^= x >> np.uint64(29)
    return x


def gram_sets(texts: list[list[bytes]], n: int) -> list[np.ndarray]:
    """The set of runs of n words of each text, as numbers that two runs share only if their words are equal.

    Words are numbered by their bytes, then runs of two by their pair of numbers, of three by the number of two and the third word, and
    so on, so nothing is hashed.  A text of fewer words is one run, filled up with the number 0.
    """
    numbers: dict[bytes, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in t] + [0] * (n - len(t) if t else 0), np.int64) for t in texts]
    runs = [max(0, len(w) - n + 1) for w in words]
    column = lambda j: np.concatenate([w[j : j + k] for w, k in zip(words, runs, strict=True)])
    x = column(0)
    for j in range(1, n):
        _, x = np.unique(x * (len(numbers) + 1) + column(j), return_inverse=True)
    end = np.cumsum(runs)
    return [np.unique(x[e - k : e]) for e, k in zip(end.tolist(), runs, strict=True)]


def _signer(n: int, bands: int, rows: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    factors = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    weights = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
    schema = pa.schema([("n", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(x: np.ndarray) -> np.ndarray:
        low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
        short = (x >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 512):
            low = np.minimum(low, (factors[:, None] * short[None, at : at + 512]).min(axis=1))
        h = (low.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * weights
        h ^= h >> np.uint64(31)
        h = h.sum(axis=1, dtype=np.uint64) ^ salt
        h *= np.uint64(GOLD)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            size, keys, signed = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                x = gram_hashes(words, n, cache)
                size.append(len(x))
                keys.append(blake2b(b" ".join(words), digest_size=16).digest())
                signed.append(sign(x) if len(x) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in signed])]), pa.int32()), pa.array(np.concatenate([*signed, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), lists], ["id", "mark", *schema.names])

    return run


def _verify(n: int, threshold: float):
    """Groups of rows (comp, left, right, node, block, copies, text), in order: links and a spanning forest of each."""

    part = Fraction(str(threshold))

    def links(first: list[np.ndarray], second: list[np.ndarray] | None) -> np.ndarray:
        """Which sets of ``first`` and ``second`` (or of ``first`` alone) are similar enough, in whole numbers."""
        sets = first + (second or [])
        sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        times = np.bincount(values)
        shared = times > 1  # the others are in no intersection
        place = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), sizes)
        of = shared[values]
        row, col = row[of], place[values[of]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        a = len(first)
        common = np.zeros((a, len(second) if second else a), np.int64)
        step = min(max(64, (1 << 23) // len(sets)), 1 << 23)  # sums of so many ones are exact in float32
        for at in range(0, int(shared.sum()), step):
            lo, hi = np.searchsorted(col, [at, at + step])
            x = np.zeros((len(sets), min(step, int(shared.sum()) - at)), np.float32)
            x[row[lo:hi], col[lo:hi] - at] = 1
            common += (x[:a] @ (x[a:] if second else x).T).astype(np.int64)
        left, right = sizes[:a], sizes[a:] if second else sizes
        # common / (left + right - common) >= p / q
        return common * (part.numerator + part.denominator) >= part.numerator * (left[:, None] + right[None, :])

    def forest(hit: np.ndarray, same: bool) -> np.ndarray:
        """Least index each row (and column) is connected to."""
        a, b = hit.shape
        rows, cols = np.nonzero(hit)
        if not same:
            cols = cols + a
        label = np.arange(a if same else a + b)
        while True:
            new = label.copy()
            np.minimum.at(new, rows, label[cols])
            np.minimum.at(new, cols, label[rows])
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def one(group: pd.DataFrame) -> pd.DataFrame | None:
        same = group["left"].iloc[0] == group["right"].iloc[0]
        if not same:
            group = group.sort_values("block", kind="stable")
        nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        sets = gram_sets([words_of(t) for t in group["text"]], n)
        if same:
            hit = links(sets, None)
            np.fill_diagonal(hit, False)
            texts, docs = hit.sum(1), hit @ copies
            label = forest(hit, True)
        else:
            a = int((group["block"] == group["left"]).sum())
            if a in (0, len(group)):
                return None
            hit = links(sets[:a], sets[a:])
            texts = np.concatenate([hit.sum(1), hit.sum(0)])
            docs = np.concatenate([hit @ copies[a:], copies[:a] @ hit])
            label = forest(hit, False)
        some = texts > 0
        return pd.DataFrame({"u": nodes[some], "v": nodes[label[some]], "texts": texts[some], "docs": docs[some]}) if some.any() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = [], ["comp", "left", "right"]
        for batch in batches:
            if not len(batch):
                continue
            cut = np.flatnonzero((batch[of].to_numpy()[1:] != batch[of].to_numpy()[:-1]).any(1)) + 1
            parts = [batch.iloc[s:e] for s, e in zip([0, *cut], [*cut, len(batch)], strict=True)]
            out = []
            for part in parts:
                if held and (held[0][of].iloc[0] != part[of].iloc[0]).any():
                    out.append(one(pd.concat(held)) if len(held) > 1 else one(held[0]))
                    held = []
                held.append(part)
            if out := [x for x in out if x is not None]:
                yield pd.concat(out)
        if held and (last := one(pd.concat(held))) is not None:
            yield last

    return run


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, hashes: int = 256, block: int = 512, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, mark (hash of its text), text_id, class_id, n_copies, n_links, n_text_links, keep.

    text_id and class_id are the least ids among equal texts and in the class; n_links counts other documents at or above the
    threshold, n_text_links other texts; keep marks the one document of its class that stays, the one of least id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = bands_and_rows(threshold, recall, hashes)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    signed = settle(source.mapInArrow(tidy(_signer(n, bands, rows)), f"id {kind}, mark long, n int, key binary, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "signed")
    # texts without words are no copies of each other
    key = F.when(F.col("n") > 0, F.col("key")).otherwise(F.concat(F.lit("row ").cast("binary"), F.col("row").cast("string").cast("binary")))
    signed = signed.withColumn("key", key)
    texts = signed.groupBy("key").agg(F.min(F.struct("id", "mark", "row")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    texts = settle(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    banded = texts.select("node", F.explode("bands").alias("band"))
    buckets = settle(banded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "least"), "buckets")
    tied = banded.join(buckets, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    found = settle(components(tied).select("node", F.col("root").alias("comp")), "candidates")

    members = texts.join(found, "node").select("node", "comp", "copies", F.col("rep.id").alias("id"), F.col("rep.mark").alias("mark"))
    members = settle(members, "members")
    bits, cells = repeat_filter(members.select("mark").unionByName(members.select("mark")), members.count())
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def wanted(h: pd.Series) -> pd.Series:
        at = _cells(h.to_numpy(), cells)
        hit = (shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series((hit[: len(h)] & hit[len(h) :]).astype(bool))

    whole = source.where(wanted("mark")).dropDuplicates(["id", "mark"])
    whole = members.alias("m").join(whole.alias("w"), F.col("m.id").eqNullSafe(F.col("w.id")) & (F.col("m.mark") == F.col("w.mark"))).select("m.node", "m.comp", "m.copies", "w.text")
    whole = settle(whole, "member-texts")
    sizes = settle(whole.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("blocks")), "blocks")
    dealt = whole.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("comp", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "block", "copies", "text")
    dealt = dealt.repartition("comp", "left", "right").sortWithinPartitions("comp", "left", "right")
    linked = settle(dealt.mapInPandas(tidy(_verify(n, threshold)), "u long, v long, texts long, docs long"), "links")

    counts = linked.groupBy(F.col("u").alias("node")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = settle(components(linked.select("u", "v")), "classes")
    nodes = settle(texts.select("node", "key", "copies", "rep").join(classes, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    heads = settle(nodes.groupBy("root").agg(F.min("rep").alias("head")), "heads")
    nodes = settle(nodes.join(heads, "root").select("key", "copies", "rep", "head", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs")), "texts-told")
    return signed.join(nodes, "key").select(F.col("id").alias("doc_id"), "mark", F.col("rep.id").alias("text_id"), F.col("head.id").alias("class_id"), F.col("copies").alias("n_copies"), (F.col("docs") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("texts").cast("long").alias("n_text_links"), (F.col("head.row") == F.col("row")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each class; rows equal in id and text go or stay together."""
    told = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = settle(told.groupBy("doc_id", "mark").agg(F.bool_or("keep").alias("keep")).where("not keep").select(F.col("doc_id").alias("__aw_id"), F.col("mark").alias("__aw_mark")), "dropped")
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__aw_id"]) & (mark == gone["__aw_mark"]), "left_anti")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


ORACLE = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rep AS (SELECT w, min(doc_id) AS text_id, count(*) AS copies FROM t WHERE len(w) > 0 GROUP BY w),
g AS (SELECT DISTINCT text_id, array_to_string(w[s:s + least(len(w), 5) - 1], ' ') AS x FROM (SELECT text_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM rep)),
sz AS (SELECT text_id, count(*) AS n FROM g GROUP BY 1),
ln AS (SELECT u, v FROM (SELECT a.text_id AS u, b.text_id AS v, count(*) AS c FROM g a JOIN g b USING (x) WHERE a.text_id <> b.text_id GROUP BY 1, 2) JOIN sz p ON p.text_id = u JOIN sz q ON q.text_id = v WHERE 5 * c >= 4 * (p.n + q.n - c)),
cc(node, root) AS (SELECT text_id, text_id FROM rep UNION SELECT ln.v, cc.root FROM cc JOIN ln ON ln.u = cc.node),
cl AS (SELECT node, min(root) AS class_id FROM cc GROUP BY 1),
lk AS (SELECT u, count(*) AS texts, sum(copies) AS docs FROM ln JOIN rep ON rep.text_id = v GROUP BY 1)
SELECT t.doc_id, coalesce(rep.text_id, t.doc_id) AS text_id, coalesce(class_id, t.doc_id) AS class_id, CAST(coalesce(copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(docs, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links,
       CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links, t.doc_id = coalesce(class_id, t.doc_id) AS keep
FROM t LEFT JOIN rep ON rep.w = t.w LEFT JOIN cl ON cl.node = rep.text_id LEFT JOIN lk ON lk.u = rep.text_id"""
}
QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
