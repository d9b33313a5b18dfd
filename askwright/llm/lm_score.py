"""Scores under an n-gram language model in an Elias-Fano trie.

Counting: tasks count their n-grams and send them, sorted and compressed, to the shard of the first word; a shard adds them up and
writes its part of a level to the shared folder.  Level 1 has every word (a 64-bit hash that orders it, and a second one that tells it
from others) with its exact count; two training words of one first hash make the fit start anew with another base, and a word that only
agrees in the first hash is unknown.  Deeper levels keep n-grams
seen ``min_count`` times and more, all of them by default, under contexts that the level above keeps.  When all shards of
a level are counted its discount is known, and probabilities are written beside each shard.

A level is a file for each shard.  Children of all contexts stand in one sequence; a monotone Elias-Fano sequence of
pointers gives a context's range [lo, hi).  Word ids are ranks of hashes, so ids under a context are spread evenly: an id is
scaled to the context, its bucket being lo + id * (hi - lo) // V, and the sequence of (bucket, rest) is again monotone with about
one element a bucket.  A query finds the bucket's start by a select over its unary part and looks at the successors there.

Probabilities are interpolated absolute discounts.  A child holds (c - D) / c(context), a context what is left for the level below; both as
one byte of a log scale, rounded down, so probabilities never sum to more than 1.  Counts of words are exact.

The shared folder has to be a mounted path (``file:`` or plain), as files are mapped from it.  Defined cases: null texts are empty and
have the end token alone; equal rows are each counted and get equal scores; a very long text is read whole; without training tokens
every score is the base score of unknown tokens; an empty table gives no rows; only id and text are read, so extra columns of any name
change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, held_out, per_process, portions, scratch, settle, small_batches, table, tidy
from .elias_fano import Sequence, map_arrays, monotone, write_arrays

PORTION = 4 << 20  # bytes of text worked on at once
STEP = 8 / 255  # of the log10 scale of one byte

def _code(p: np.ndarray) -> np.ndarray:
    """log10 of p as one byte, rounded down in probability; the least code that stands for p = 0 is 255."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log10(p) / STEP - 1e-9), 255).astype(np.uint8)


def _decode(code: np.ndarray) -> np.ndarray:
    return np.where(code == 255, 0.0, 10 ** (-STEP * code.astype(np.float64)))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(16, n.bit_length())
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


def _odd(seed: int) -> int:
    """5 modulo 8, so powers take longest to come back to 1."""
    return int.from_bytes(blake2b(b"base %d" % seed, digest_size=8).digest(), "little") & ~7 | 5


class Hasher:
    """Two hashes of words: polynomials over the bytes in two bases; of long words, where polynomials modulo 2**64 are weak, a digest."""

    LONG = 256  # the shortest texts known to collide for every base have 1,024 bytes

    def __init__(self, seed: int):
        self.salt = seed.to_bytes(4, "little")
        self.powers = [Powers(_odd(2 * seed)), Powers(_odd(2 * seed + 1))]

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        out = []
        for powers in self.powers:
            powers.upto(len(data) + 1)
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.multiply(_LOWER[data], powers.up[: len(data)], out=prefix[1:])
            np.cumsum(prefix[1:], out=prefix[1:])
            h = (prefix[end] - prefix[begin]) * powers.down[begin]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            out.append(h ^ (h >> np.uint64(32)))
        for i in np.flatnonzero(end - begin >= self.LONG).tolist():
            told = blake2b(data[begin[i] : end[i]].tobytes().translate(LOWER_BYTES), digest_size=16, salt=self.salt).digest()
            out[0][i], out[1][i] = (int.from_bytes(told[k : k + 8], "little") for k in (0, 8))
        return out


_LOWER = np.frombuffer(LOWER_BYTES, np.uint8).astype(np.uint64) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Stands for the end of a text, in both hashes; words hash elsewhere but by chance.
END = np.uint64(0xE7037ED1A0B428DB)


def hasher(seed: int) -> Hasher:
    return per_process(f"lm_hasher_{seed}", lambda: Hasher(seed))


def token_hashes(texts: pa.Array, hashing: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(both hashes of the words and an end of each text, number of tokens of each text), from the bytes of all texts at once."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    text_start = np.zeros(len(data) + 1, bool)
    text_start[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    begin = np.flatnonzero(inside & (~before | text_start[:-1]))
    end = np.flatnonzero(inside & (~after | text_start[1:])) + 1
    words = np.diff(np.searchsorted(begin, offsets))
    place = np.arange(len(begin)) + np.repeat(np.arange(len(words)), words)
    out = []
    for h in hashing(data, begin, end):
        out.append(np.full(len(h) + len(words), END))
        out[-1][place] = h
    return out[0], out[1], words + 1


class Model:
    """The levels that exist so far, mapped from ``folder``."""

    def __init__(self, folder: str, bits: int, bases: np.ndarray, total: int, distinct: int, discount: float, order: int, seed: int):
        self.seed = seed
        self.folder, self.bits, self.bases, self.total, self.distinct, self.discount, self.order = folder, bits, bases, total, distinct, discount, order
        self.files: dict[tuple[int, int], dict] = {}

    def __getstate__(self):
        return self.__dict__ | {"files": {}}

    def level(self, k: int, shard: int) -> dict | None:
        if (k, shard) not in self.files:
            path = f"{self.folder}/{k}-{shard}"
            got = None
            if os.path.exists(path):
                got = map_arrays(path)
                got["items"] = Sequence(got, "items")
                if k > 1:
                    got["pointers"] = Sequence(got, "pointers")
                    got |= map_arrays(f"{path}.p")
            self.files[k, shard] = got
        return self.files[k, shard]

    def shards(self, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(of):
            return
        by = np.argsort(of, kind="stable")
        s = of[by]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
            yield int(s[a]), by[a:b]

    def words(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, shard, count) of each word."""
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        check = checks[first]
        if (check[back] != checks).any():  # two words of one first hash
            both, back = np.unique(np.stack([hashes, checks], 1), axis=0, return_inverse=True)
            unique, check = both.T.copy()
        shard = (unique >> np.uint64(64 - self.bits)).astype(np.int64)
        ids, count = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        for s, at in self.shards(shard):
            level = self.level(1, s)
            if level is None:
                continue
            width = np.uint64(level["items"].width)
            rest = unique[at] & np.uint64((1 << (64 - self.bits)) - 1)
            i = level["items"].find((rest >> width).astype(np.int64), rest & ((np.uint64(1) << width) - np.uint64(1)))
            got = np.flatnonzero(i >= 0)
            got = got[level["check"][i[got]] == check[at[got]]]
            ids[at[got]] = self.bases[s] + i[got]
            count[at[got]] = level["values"][level["codes"][i[got]]]
        return ids[back], shard[back], count[back]

    def children(self, k: int, shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in the shard's level k or -1, discounted probability, what the context leaves to the level below).

        A context or word of -1 has no child; without a context everything is left.
        """
        index, p, left = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        known = np.flatnonzero(context >= 0)
        for s, at in self.shards(shard[known]):
            level, at = self.level(k, s), known[at]
            if level is None:
                continue
            left[at] = _decode(level["left"][context[at]])
            unique, back = np.unique(context[at], return_inverse=True)
            both = level["pointers"].value(np.concatenate([unique, unique + 1]))
            lo = both[: len(unique)][back]
            many = both[len(unique) :][back] - lo
            some = np.flatnonzero((many > 0) & (word[at] >= 0))
            at, lo, many = at[some], lo[some], many[some]
            i = level["items"].find(*_scaled(word[at], lo, many, self.distinct, level["items"].width))
            got = i >= 0
            index[at[got]] = i[got]
            p[at[got]] = _decode(level["codes"][i[got]])
        return index, p, left

    def first(self, count: np.ndarray) -> np.ndarray:
        """Smoothed probability of a word by its count, on the scale of one byte below that of an unknown word."""
        n, v = max(self.total, 1), self.distinct
        spread = (self.discount * v / n if self.total else 1.0) / (v + 1)
        return np.maximum(count - self.discount, 0) / n + spread


def _scaled(word: np.ndarray, lo: np.ndarray, many: np.ndarray, distinct: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rest) of a word id under a context with children [lo, lo + many)."""
    wide = word * many
    return lo + wide // distinct, ((wide % distinct).astype(np.uint64) << np.uint64(width)) // np.uint64(distinct)


def contexts(model: Model, hashes: np.ndarray, checks: np.ndarray, sizes: np.ndarray, upto: int):
    """ids, counts and, for each level from 2 to ``upto``, (shard, context) of every token; with the probability by the levels met."""
    ids, shard, count = model.words(hashes, checks)
    begin = np.zeros(len(ids), bool)
    begin[np.cumsum(sizes) - sizes] = True
    end_id, end_shard, _ = model.words(*np.full((2, 1), END))
    context = np.concatenate([[-1], ids[:-1]]) if len(ids) else ids
    at = np.concatenate([[0], shard[:-1]]) if len(ids) else shard
    context, at = np.where(begin, end_id[0], context), np.where(begin, end_shard[0], at)  # a text starts after an end
    context = np.where(context >= 0, context - model.bases[at], -1)
    p = model.first(count)
    for k in range(2, upto + 1):
        if k == upto:
            break
        index, own, left = model.children(k, at, context, ids)
        p = own + left * p
        nxt = np.concatenate([[-1], index[:-1]])
        context, at = np.where(begin, -1, nxt), np.concatenate([[0], at[:-1]])
    return ids, count, at, context, p


def _pack(keys: np.ndarray, counts: np.ndarray, checks: np.ndarray | None = None) -> bytes:
    d = np.diff(keys, prepend=np.uint64(0))
    planes = d.view(np.uint8).reshape(-1, 8).T.copy() if len(d) else d
    told = b"" if checks is None else checks.astype("<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(d).to_bytes(8, "little") + planes.tobytes() + counts.astype("<u4").tobytes() + told)


def _unpack(blob: bytes, checked: bool = False) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(bytes(blob))
    n = int.from_bytes(data[:8], "little")
    d = np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view("<u8").ravel()
    out = (np.cumsum(d, dtype=np.uint64), np.frombuffer(data, "<u4", n, 8 + 8 * n))
    return (*out, np.frombuffer(data, "<u8", n, 8 + 12 * n)) if checked else out


def _add_up(blobs, checked: bool = False) -> tuple[np.ndarray, ...]:
    """Keys in order with the sum of their counts; with the check of each if there are any, and whether a key had two."""
    keys, counts, *checks = (np.concatenate(x) for x in zip(*(_unpack(b, checked) for b in blobs), strict=True))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by].astype(np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    out = (keys[first], np.add.reduceat(counts, first))
    if not checked:
        return out
    check = checks[0][by]
    return (*out, check[first], bool((check[1:][~new[1:]] != check[:-1][~new[1:]]).any()))


def _send(shard: np.ndarray, key: np.ndarray, check: np.ndarray | None = None) -> pa.RecordBatch:
    by = np.argsort(shard.astype(np.int16), kind="stable")
    shard, key = shard[by], key[by]
    check = check if check is None else check[by]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
    blobs = []
    for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
        if check is None:
            k = np.sort(key[a:b])
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            blobs.append(_pack(k[first], np.diff(np.append(first, len(k)))))
        else:
            by = np.argsort(key[a:b], kind="stable")
            k, c = key[a:b][by], check[a:b][by]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
            blobs.append(_pack(k[first], np.diff(np.append(first, len(k))), c[first]))
    return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int64)), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _count_words(bits: int, seed: int, flush: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, held, n = hasher(seed), [], 0

        def out() -> pa.RecordBatch:
            h, check = (np.concatenate(x) for x in zip(*held, strict=True))
            return _send((h >> np.uint64(64 - bits)).astype(np.int64), h & np.uint64((1 << (64 - bits)) - 1), check)

        for part in portions(batches, PORTION):
            held.append(token_hashes(part.column("text"), hashing)[:2])
            n += len(held[-1][0])
            if n >= flush:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def _write_words(folder: str, bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        keys, counts, check, clash = _add_up(group["blob"], checked=True)
        values, codes = np.unique(counts, return_inverse=True)
        width = max(0, 64 - bits - len(keys).bit_length())
        arrays = Sequence.build("items", (keys >> np.uint64(width)).astype(np.int64), keys & np.uint64((1 << width) - 1), width, 1 << (64 - bits - width))
        size = write_arrays(f"{folder}/1-{shard}", arrays | {"check": check, "values": values, "codes": codes.astype("<u2" if len(values) < 1 << 16 else "<u4")})
        return pd.DataFrame([(shard, len(keys), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()), size, clash)], columns=["shard", "n", "total", "once", "twice", "bytes", "clash"])

    return run


def _count_grams(model: Model, k: int, flush: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, shards, keys, n = hasher(model.seed), [], [], 0
        for part in portions(batches, PORTION):
            hashes, checks, sizes = token_hashes(part.column("text"), hashing)
            ids, _, at, context, _ = contexts(model, hashes, checks, sizes, k)
            of = np.flatnonzero((context >= 0) & (ids >= 0))
            shards.append(at[of])
            keys.append(context[of].astype(np.uint64) * np.uint64(model.distinct) + ids[of].astype(np.uint64))
            n += len(of)
            if n >= flush:
                yield _send(np.concatenate(shards), np.concatenate(keys))
                shards, keys, n = [], [], 0
        if n:
            yield _send(np.concatenate(shards), np.concatenate(keys))

    return run


def _write_grams(model: Model, k: int, min_count: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        keys, counts = _add_up(group["blob"])
        above = model.level(k - 1, shard)["items"].n
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        context = (keys // np.uint64(model.distinct)).astype(np.int64)
        total = np.bincount(context, counts, minlength=above).astype(np.int64)
        if min_count > 1:
            keep = counts >= min_count
            keys, context, counts = keys[keep], context[keep], counts[keep]
        word = (keys % np.uint64(model.distinct)).astype(np.int64)
        many = np.bincount(context, minlength=above)
        pointers = np.concatenate([[0], np.cumsum(many)])
        width = max(1, int(model.distinct).bit_length())
        bucket, rest = _scaled(word, pointers[context], many[context], model.distinct, width)
        arrays = Sequence.build("items", bucket, rest, width, len(word) + 1) | monotone("pointers", pointers, len(word) + 1)
        size = write_arrays(f"{model.folder}/{k}-{shard}", arrays)
        size += write_arrays(f"{model.folder}/{k}-{shard}.counts", {"counts": _narrow(counts), "total": _narrow(total), "many": _narrow(many)})
        return pd.DataFrame([(shard, len(word), int(total.sum()), once, twice, size)], columns=["shard", "n", "total", "once", "twice", "bytes"])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _write_probabilities(folder: str, k: int, discount: float):
    """One byte for each child and for what its context leaves, by the discount of the whole level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for shard in batch.column("shard").to_pylist():
                path = f"{folder}/{k}-{shard}"
                if not os.path.exists(path):
                    continue
                told = map_arrays(f"{path}.counts")
                context = np.repeat(np.arange(len(told["many"])), told["many"])
                p = (told["counts"] - discount) / told["total"][context]
                got = np.bincount(context, p, minlength=len(told["many"]))
                left = np.where(got > 0, 1 - got, 1.0)
                sizes.append(write_arrays(f"{path}.p", {"codes": _code(p), "left": _code(np.maximum(left, 1e-7))}))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["bytes"])

    return run


def _discount(rows: list) -> float:
    once, twice = (sum(r[c] for r in rows) for c in ("once", "twice"))
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)


_STATS = "shard long, n long, total long, once long, twice long, bytes long"


def fit(docs: DataFrame, order: int = 3, min_count: int = 1, shard_bytes: int = 32 << 20, max_shards: int = 4096, text_col: str = "text", seed: int = 0) -> Model:
    """The model of ``docs``.  The driver gets a row of sums for each shard, never n-grams."""
    spark = docs.sparkSession
    small_batches(spark)
    place = urlparse(scratch(spark, "lm"))
    if place.scheme not in ("", "file"):
        raise ValueError(f"language models are mapped from a mounted folder; spark.checkpoint.dir is on {place.scheme}:")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(int(total // shard_bytes).bit_length(), 2), max_shards.bit_length() - 1)
    words = texts.mapInArrow(tidy(_count_words(bits, seed)), "shard long, blob binary").groupBy("shard")
    rows = {r["shard"]: r for r in settle(words.applyInPandas(_write_words(place.path, bits), f"{_STATS}, clash boolean"), "lm-words").collect()}
    if any(r["clash"] for r in rows.values()):
        return fit(docs, order, min_count, shard_bytes, max_shards, text_col, seed + 1)
    sizes = np.array([rows[s]["n"] if s in rows else 0 for s in range(1 << bits)], np.int64)
    model = Model(place.path, bits, np.cumsum(sizes) - sizes, sum(r["total"] for r in rows.values()), int(sizes.sum()), _discount(list(rows.values())), 1, seed)
    for k in range(2, order + 1):
        if model.total:
            stats = settle(texts.mapInArrow(tidy(_count_grams(model, k)), "shard long, blob binary").groupBy("shard").applyInPandas(_write_grams(model, k, min_count), _STATS), f"lm-{k}-grams")
            write = _write_probabilities(place.path, k, _discount(stats.select("once", "twice").collect()))
            spark.range(0, 1 << bits, 1, 1 << bits).select(F.col("id").alias("shard")).mapInArrow(tidy(write), "bytes long").agg(F.sum("bytes")).collect()
            model.order = k
    return model


def log_scores(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = hasher(model.seed)
        for part in portions(batches, PORTION):
            hashes, checks, sizes = token_hashes(part.column("text"), hashing)
            _, count, _, _, p = contexts(model, hashes, checks, sizes, model.order + 1)
            first = np.cumsum(sizes) - sizes
            base = np.log10((count + 1) / (model.total + model.distinct + 1))
            add = lambda x: np.add.reduceat(x, first)
            told = [pa.array(sizes), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))]
            yield pa.RecordBatch.from_arrays([part.column("id"), *told], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op9_trie_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lambda c: held_out(c, folds=7)
    model = fit(docs.where(~out(F.col("doc_id"))), min_count=1)
    scored = log_scores(model, docs)
    return scored.select("doc_id", out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_trie_lm": op9_trie_lm}
