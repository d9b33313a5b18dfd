"""Repeated passages by a hash-compared suffix sort.

A byte goes when a run of ``SPAN`` bytes that covers it also starts in a document of smaller id.  Runs are judged as windows: the
suffixes cut at SPAN bytes.  Sorting every suffix of a corpus would shuffle it many times over, so winnowing chooses which:

1. Of each text's windows the least hash of the 26-byte grams inside is its anchor; equal windows have equal anchors, at
   the same place in the window.  Tasks send anchors (about one in 13 bytes, 4 bytes and a compressed id each) to hash buckets.
2. A bucket tells which anchors occur in several documents.  Only windows on those can repeat.
3. The runs of such windows (up to 74 bytes) go to a bucket by anchor, once for each chunk of documents.  An anchor with very many
   occurrences is cut into single windows that are dealt by their own hash, so it fills no task.
4. A bucket leaves out the suffixes whose hash none other has, which nothing can equal, takes one of those that are the same byte by
   byte, however many, and sorts these by a mergesort whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes (6 steps for 50 bytes) and then look at one byte.  Neighbours of equal hash are compared byte by
   byte, and a group in which hashes collided is sorted by its bytes, so a collision neither removes nor hides a repeat.  Equal windows
   take the least id among them.
5. One bit for each window goes back to the chunk: whether a smaller id outside has it.  Documents are cut.

Texts that equal one of a smaller id are wholly covered and take no part.

Defined cases: null texts are empty; texts under SPAN bytes stay whole; a null id is smaller than any other; rows of equal id do not
remove from each other; ids that are no whole numbers are ordered as their type is; a very long text is one document of its chunk and
is read whole; an empty table gives no rows; only id and text are read, so extra columns of any name change nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import per_process, portions, settle, small_batches, table, tidy
from .exact_dedup import exact_duplicates
from .sharding import numbered

SPAN, GRAM = 50, 26
WINDOW = SPAN - GRAM + 1
BASE = 0x9E3779B97F4A7C15
NONE_FIRST = -(1 << 63)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(16, n.bit_length())
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


class PrefixHashes:
    """Hashes of any substrings of ``data`` from prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, powers: Powers):
        powers.upto(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * powers.up[: len(data)] + powers.up[: len(data)], out=self.prefix[1:])
        self.down = powers.down

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def grams(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, PrefixHashes]:
    """(anchor position of each window, hash of each gram, prefix hashes); the anchor is the leftmost gram of least hash."""
    ph = PrefixHashes(data, powers)
    h = _mixed(ph.grams(GRAM))
    m = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64), h, ph


def suffix_classes(data: np.ndarray, start: np.ndarray, group: np.ndarray, powers: Powers, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes sorted by group and by their first ``span`` bytes, and where a new (group, bytes) begins.

    A bottom-up mergesort inside each group, all groups in step; an element's place in a merge is its own rank and its
    rank in the other run, found by binary search with hash-compared suffixes.  Where neighbours of one hash differ in bytes, or equal
    hashes of a group do not lie together, hashes have collided: those groups are sorted by their bytes.
    """
    ph = PrefixHashes(data, powers)
    whole = ph.of(start, span)
    at = np.argsort(group, kind="stable")
    sorted_group = group[at]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(at)))
    begin, size = np.repeat(first, size), np.repeat(size, size)
    steps = [1 << i for i in reversed(range((span - 1).bit_length()))]

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes a and b."""
        out = np.zeros(len(a), np.int8)
        apart = np.flatnonzero(whole[a] != whole[b])
        sa, sb = start[a[apart]], start[b[apart]]
        common = np.zeros(len(apart), np.int64)
        for s in steps:
            more = np.flatnonzero(common + s < span)
            longer = common[more] + s
            common[more[ph.of(sa[more], longer) == ph.of(sb[more], longer)]] += s
        out[apart] = np.where(data[sa + common] < data[sb + common], -1, 1)
        return out

    run = 1
    while len(size) and run < size.max():
        slots = np.flatnonzero(size > run)
        g, rank = begin[slots], slots - begin[slots]
        mine = rank // run
        low = np.minimum(g + (mine ^ 1) * run, g + size[slots])
        high = np.minimum(low + run, g + size[slots])
        lo, hi, me = low.copy(), high, at[slots]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            c = compare(at[mid], me[todo])
            right = (c < 0) | ((c == 0) & (mine[todo] % 2 == 1))
            lo[todo[right]] = mid[right] + 1
            hi[todo[~right]] = mid[~right]
            todo = todo[lo[todo] < hi[todo]]
        to = g + (mine // 2) * 2 * run + (rank - mine * run) + (lo - low)
        moved = at.copy()
        moved[to] = me
        at, run = moved, 2 * run
    new = np.ones(len(at), bool)
    if len(at):
        lost = bool((np.bincount(at, minlength=len(at)) != 1).any())  # contradictory comparisons put two in one place
        if lost:
            at = np.argsort(group, kind="stable")
        apart = sorted_group[1:] != sorted_group[:-1]
        new[1:] = apart | (whole[at[1:]] != whole[at[:-1]])
        wide = np.arange(span)
        same, broken = np.flatnonzero(~new), []
        for i in range(0, len(same), 1 << 17):  # collision verification
            j = same[i : i + (1 << 17)]
            broken.append(j[(data[start[at[j]][:, None] + wide] != data[start[at[j - 1]][:, None] + wide]).any(1)])
        number = np.cumsum(np.concatenate([[0], apart]))
        mixed = whole[at].astype(np.uint64) ^ (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if lost or len(np.unique(mixed)) < new.sum():  # a hash of a group in two places, or one number for two of them
            again = np.ones(len(at), bool)
        else:
            again = np.isin(number, number[np.concatenate(broken)]) if any(map(len, broken)) else np.zeros(len(at), bool)
        if again.any():
            place = np.flatnonzero(again)
            members = at[place]
            rows = np.zeros((len(members), -(-span // 8) * 8), np.uint8)
            rows[:, :span] = data[start[members][:, None] + wide]
            order = np.lexsort((*rows.view(">u8").T[::-1], number[place]))
            at[place], rows = members[order], rows[order]
            new[place] = np.concatenate([[True], (np.diff(number[place]) != 0) | (rows[1:] != rows[:-1]).any(1)])
    return at, new


def _squeeze(*arrays: np.ndarray) -> bytes:
    parts = [x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def _expand(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(bytes(blob))
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", data), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for s, e in zip([0, *cut], [*cut, len(keys)], strict=True) if len(keys) else ():
        yield int(keys[s]), int(s), int(e)


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text if isinstance(text, (bytes, bytearray)) else text.encode("utf-8", "surrogatepass"), np.uint8)


def _send_anchors(bits: int, flush: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, codes, ids, held = per_process("powers", Powers), [], [], 0

        def out() -> pa.RecordBatch:
            code, order = np.concatenate(codes), np.concatenate(ids)
            by = np.lexsort((order, code >> np.uint64(32)))
            code, order = code[by], order[by]
            rows = []
            for b, s, e in _slices((code >> np.uint64(32)).astype(np.int64)):
                rows.append((b, _squeeze((code[s:e] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.diff(order[s:e], prepend=np.int64(0)))))
            bucket, blob = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "blob"])

        for batch in portions(batches, 8 << 20):
            # of equal texts one is sent: the others are copies of it or of a text with a still smaller id
            for order, text in batch.to_pandas().sort_values("ord", kind="stable").drop_duplicates("text")[["ord", "text"]].itertuples(index=False):
                data = _bytes(text)
                if len(data) < SPAN:
                    continue
                at, h, _ = anchors(data, powers)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                code = np.unique(h[at] >> np.uint64(32 - bits))
                codes.append(code)
                ids.append(np.full(len(code), order, np.int64))
                held += len(code)
                if held >= flush:
                    yield out()
                    codes, ids, held = [], [], 0
        if codes:
            yield out()

    return run


def _repeated_anchors(chunks: int, hot: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, order = [], []
        for blob in group["blob"]:
            a, d = _expand(blob, "<u4", "<i8")
            low.append(a)
            order.append(np.cumsum(d))
        low, order = np.concatenate(low), np.concatenate(order)
        by = np.argsort(low, kind="stable")
        low, order = low[by], order[by]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(first, len(low)))
        repeated = np.minimum.reduceat(order, first) < np.maximum.reduceat(order, first)
        keep = np.repeat(repeated, size)
        low, order, many = low[keep], order[keep], np.repeat(size > hot, size)[keep]
        chunk = np.mod(order, chunks)
        by = np.lexsort((order, chunk))
        low, order, many, chunk = low[by], order[by], many[by], chunk[by]
        code = (np.uint64(group["bucket"].iloc[0]) << np.uint64(32)) | low.astype(np.uint64)
        rows = [(c, 0, int(group["bucket"].iloc[0]), _squeeze(order[s:e], code[s:e], many[s:e].astype(np.uint8))) for c, s, e in _slices(chunk)]
        return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "blob"])

    return run


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` (8 at least) bytes of ``data`` at ``a`` and at ``b`` are the same, by words of eight bytes."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,))
    same = np.ones(len(a), bool)
    for i in range(0, int(length.max(initial=0)), 8):
        step = np.minimum(i, length - 8)
        same &= words[a + step] == words[b + step]
    return same


class Chunk:
    """The candidate runs of a chunk of documents, each content once: a pure function of the documents and the anchors told."""

    def __init__(self, docs: pd.DataFrame, told: list[bytes], bits: int):
        self.docs = docs.sort_values("ord", kind="stable")
        parts = [_expand(b, "<i8", "<u8", "u1") for b in told]
        order, code, many = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        by = np.lexsort((code, order))
        order, code, many = order[by], code[by], many[by]
        powers = per_process("powers", Powers)
        self.data: list[np.ndarray] = []
        held: list[tuple[np.ndarray, ...]] = []  # begin, windows, place of the anchor, anchor, bucket, hash of the content
        sizes, shift, none = [], np.uint64(64 - bits), np.zeros(0, np.int64)
        for i, text in zip(self.docs["ord"], self.docs["text"], strict=True):
            data = _bytes(text)
            self.data.append(data)
            s, e = np.searchsorted(order, i, "left"), np.searchsorted(order, i, "right")
            if len(data) < SPAN or s == e:
                sizes.append(0)
                continue
            at, h, ph = anchors(data, powers)
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            end = np.append(begin[1:], len(at))
            anchor = h[at[begin]]
            codes = anchor >> np.uint64(32 - bits)
            j = np.minimum(np.searchsorted(code[s:e], codes), e - s - 1)
            hit = code[s:e][j] == codes
            begin, end, anchor, rel = begin[hit], end[hit], anchor[hit], (at[begin] - begin)[hit]
            cut = many[s:e][j][hit].astype(bool)
            where = anchor >> shift
            if cut.any():  # windows of their own, dealt by their own hash
                n = np.where(cut, end - begin, 1)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(np.arange(len(n)), n)
                begin, rel = begin[of] + k, rel[of] - k
                end = np.where(cut[of], begin + 1, end[of])
                anchor = anchor[of]
                where = np.where(cut[of], _mixed(ph.of(begin, SPAN)), anchor) >> shift
            sizes.append(len(begin))
            held.append((begin, end - begin, rel, anchor, where.astype(np.int64), ph.of(begin, end - begin + SPAN - 1)))
        begin, windows, rel, anchor, where, whole = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (none, none, none, none.astype(np.uint64), none, none.astype(np.uint64))
        self.text = np.concatenate([*self.data, np.zeros(0, np.uint8)])
        lengths = np.array([len(x) for x in self.data], np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        start = begin + (np.cumsum(lengths) - lengths)[of]
        first, content = self._contents(start, windows, rel, whole)
        #: Of each content: least id, anchor, bucket, place of the anchor, windows, where it starts in ``text``.
        self.least, self.hash, self.bucket = self.docs["ord"].to_numpy()[of][first], anchor[first], where[first]
        self.rel, self.windows, self.start = rel[first], windows[first], start[first]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.runs = [(begin[e - n : e], windows[e - n : e], content[e - n : e]) if n else () for n, e in zip(sizes, ends, strict=True)]

    def _contents(self, start: np.ndarray, windows: np.ndarray, rel: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first run of each content, content of each run): runs of one hash are compared with the first of them, byte by byte."""
        key = whole ^ _mixed((rel * 256 + windows).astype(np.uint64))
        _, first, content = np.unique(key, return_index=True, return_inverse=True)
        again = np.flatnonzero(first[content] != np.arange(len(content)))
        to = first[content[again]]
        same = (rel[again] == rel[to]) & (windows[again] == windows[to])
        length = np.minimum(windows[again], windows[to]) + SPAN - 1
        same &= _same(self.text, start[again], start[to], length)
        more: dict[tuple[int, bytes], int] = {}
        for r in again[~same].tolist():  # of equal hash
            k = (int(rel[r]), self.text[start[r] : start[r] + windows[r] + SPAN - 1].tobytes())
            if k not in more:
                more[k] = len(first)
                first = np.append(first, r)
            content[r] = more[k]
        return first, content

    def sent(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, contents in the order in which they are sent)."""
        order = np.argsort(self.bucket, kind="stable")
        for b, s, e in _slices(self.bucket[order]):
            yield b, order[s:e]


def _own(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The documents without the copies: rows of kind 2 name them by id and hash of the text."""
    copies = set(zip(told["ord"][told["kind"] == 2], told["bucket"][told["kind"] == 2], strict=True))
    if not copies:
        return docs
    return docs[[k not in copies for k in zip(docs["ord"], docs["mark"], strict=True)]]


def _send_runs(bits: int):
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and (told["kind"] == 0).any():
            chunk = Chunk(_own(docs, told), list(told["blob"][told["kind"] == 0]), bits)
            for b, which in chunk.sent():
                length = chunk.windows[which] + SPAN - 1
                at = np.repeat(chunk.start[which] - np.cumsum(length) + length, length) + np.arange(length.sum())
                rows.append((b, int(key[0]), _squeeze(chunk.hash[which].astype("<u8"), chunk.least[which].astype("<i8"), chunk.rel[which].astype("u1"), length.astype("u1"), chunk.text[at])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "blob"])

    return run


def _one_of_each(data: np.ndarray, start: np.ndarray, kin: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of windows whose key another has, places of one of each, which of these each is like).

    Windows of one key are compared with the first of them; those that differ from it stand for themselves.
    """
    by = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[by[1:]] != keys[by[:-1]]]) if len(by) else np.zeros(0, bool)
    several = ~(new & np.concatenate([new[1:], [True]])) if len(by) else new
    at, new = by[several], new[several]
    one = at[new]
    like = np.cumsum(new) - 1
    to = one[like]
    apart = np.zeros(len(at), bool)
    for i in range(0, len(at), 1 << 17):
        j = slice(i, i + (1 << 17))
        apart[j] = (kin[at[j]] != kin[to[j]]) | ~_same(data, start[at[j]], start[to[j]], np.full(len(at[j]), SPAN))
    like[apart] = len(one) + np.arange(np.count_nonzero(apart))
    return at, np.concatenate([one, at[apart]]), like


def _sort_bucket(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk", kind="stable")
    parts = [_expand(b, "<u8", "<i8", "u1", "u1", "u1") for b in group["blob"]]
    anchor, least, rel, length, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    length = length.astype(np.int64)
    offset = np.cumsum(length) - length
    windows = length - SPAN + 1
    of = np.repeat(np.arange(len(length)), windows)
    k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offset[of] + k
    place = rel[of].astype(np.int64) - k  # of the anchor in the window
    _, which = np.unique(anchor, return_inverse=True)
    powers = per_process("powers", Powers)
    kin = which[of] * SPAN + place
    at, one, like = _one_of_each(data, start, kin, PrefixHashes(data, powers).of(start, SPAN) ^ _mixed(kin.astype(np.uint64)))
    order, new = suffix_classes(data, start[one], kin[one], powers)
    number = np.empty(len(one), np.int64)
    number[order] = np.cumsum(new) - 1
    least = least[of]
    owner, lowest = least.copy(), np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(lowest, number[like], least[at])
    owner[at] = lowest[number[like]]
    outside = owner < least
    ends = np.cumsum([int((p[3].astype(np.int64) - SPAN + 1).sum()) for p in parts])
    rows = [(int(c), 1, int(group["bucket"].iloc[0]), zstandard.ZstdCompressor(level=1).compress(np.packbits(outside[s:e]).tobytes())) for c, s, e in zip(group["chunk"], [0, *ends[:-1]], ends, strict=True)]
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "blob"])


def _cut(bits: int):
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(_own(docs, told), list(told["blob"][told["kind"] == 0]), bits)
        answers = {b: np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(x)), np.uint8)) for b, x in zip(told["bucket"][told["kind"] == 1], told["blob"][told["kind"] == 1], strict=True)}
        size = chunk.windows
        first = np.zeros(len(size), np.int64)  # of each content's bits in the row below
        row, base = [np.zeros(0, np.uint8)], 0
        for b, which in chunk.sent():
            n = size[which]
            first[which] = base + np.cumsum(n) - n
            row.append(answers[b][: int(n.sum())])
            base += int(n.sum())
        outside, least = np.concatenate(row).astype(bool), chunk.least
        out = []
        for i, order, data, runs in zip(chunk.docs["doc_id"], chunk.docs["ord"], chunk.data, chunk.runs, strict=True):
            kept, spans = data, 0
            if runs:
                begin, windows, content = runs
                k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                c = np.repeat(content, windows)
                at = (np.repeat(begin, windows) + k)[outside[first[c] + k] | (least[c] < order)]
                if len(at):
                    begun = np.zeros(len(data) + SPAN, np.int32)
                    begun[at + SPAN] = 1
                    np.cumsum(begun, out=begun)
                    gone = begun[SPAN:] > begun[:-SPAN]  # of each byte: whether one of the SPAN windows over it goes
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(gone[0]))
                    kept = data[~gone]
            out.append((i, len(data), len(data) - len(kept), spans, sha256(kept.tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_anchors: int = 250_000, chunk_bytes: int = 8 << 20, hot: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    whole = isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType))
    if not whole:  # ids of another type are known by their place among all ids
        ids, _ = numbered(texts.select("doc_id").where("doc_id IS NOT NULL").distinct(), ["doc_id"], "__place")
        texts = texts.join(ids, "doc_id", "left")
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(31, max(4, int(total / 13 / bucket_anchors).bit_length()))
    chunks = int(total / chunk_bytes) | 1
    while any(chunks % d == 0 for d in range(3, int(chunks**0.5) + 1, 2)):
        chunks += 2  # a prime, so ids in steps are dealt evenly
    order = F.coalesce(F.col("doc_id" if whole else "__place").cast("long"), F.lit(NONE_FIRST))
    chunk = F.pmod("ord", F.lit(chunks))
    texts = texts.select("doc_id", order.alias("ord"), F.xxhash64("text").alias("mark"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    told = exact_duplicates(texts, key=F.col("text"), narrow=["doc_id", "ord", "mark", "n_bytes"], least=True)
    copies = settle(told.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("keep_id", "group_size", "kept"), "copies")
    named = copies.select(F.pmod("ord", F.lit(chunks)).alias("chunk"), F.lit(2).alias("kind"), F.col("mark").alias("bucket"), F.lit(None).cast("binary").alias("blob"), "ord").distinct()
    removed = F.col("n_bytes") >= SPAN
    copies = copies.select("doc_id", "n_bytes", F.when(removed, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), removed.cast("long").alias("n_spans"), F.when(removed, F.lit(sha256(b"").hexdigest())).otherwise(F.col("text_sha256")).alias("kept_sha256"))
    chunked = texts.select("doc_id", "ord", "mark", "text", chunk.alias("chunk")).groupBy("chunk")
    blobs = texts.select("ord", "text").mapInArrow(tidy(_send_anchors(bits)), "bucket long, blob binary")
    repeated = settle(blobs.groupBy("bucket").applyInPandas(_repeated_anchors(chunks, hot), "chunk long, kind int, bucket long, blob binary"), "anchors")
    repeated = repeated.withColumn("ord", F.lit(None).cast("long")).unionByName(named)
    runs = chunked.cogroup(repeated.groupBy("chunk")).applyInPandas(_send_runs(bits), "bucket long, chunk long, blob binary")
    answers = settle(runs.groupBy("bucket").applyInPandas(_sort_bucket, "chunk long, kind int, bucket long, blob binary"), "answers")
    told = repeated.unionByName(answers.withColumn("ord", F.lit(None).cast("long")))
    cut = chunked.cogroup(told.groupBy("chunk")).applyInPandas(_cut(bits), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.unionByName(copies)


def op6_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = {
    "op6_suffix_repeats": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, b[s:s + 49] AS x FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d WHERE octet_length(b) >= 50)),
o AS (SELECT x, min(doc_id) AS m FROM w GROUP BY x),
hit AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS fresh FROM w JOIN o USING (x) WHERE m < doc_id),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 49 AS z FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM hit) GROUP BY doc_id, g),
sums AS (SELECT doc_id, sum(z - a + 1) AS gone, count(*) AS n FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, p, lead(q) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM (SELECT doc_id, 1 AS p, 0 AS q FROM sums UNION ALL SELECT doc_id, z + 1, a - 1 FROM runs)),
left_over AS (SELECT doc_id, string_agg(hex(b[p:coalesce(q, octet_length(b))]), '' ORDER BY p) AS h FROM kept JOIN d USING (doc_id) WHERE p <= coalesce(q, octet_length(b)) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)"""
}
QUERIES = {"op6_suffix_repeats": op6_suffix_repeats}
