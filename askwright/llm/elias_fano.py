"""Elias-Fano sequences over plain numpy arrays, and files of arrays that are mapped into memory."""

from __future__ import annotations

import json
import os

import numpy as np

_ONE = np.uint64(1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (0 or 1 each) as 64-bit words, with one word more for reads across the end."""
    padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<u8")


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from each bit position."""
    w, s = at >> 6, (at & 63).astype(np.uint64)
    high = np.where(s > 0, words[np.minimum(w + 1, len(words) - 1)] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
    return (words[w] >> s) | high


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word."""
    at, k = np.zeros(len(x), np.int64), k.copy()
    for half in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= c
        k -= np.where(up, c, 0)
        at += np.where(up, half, 0)
        x = np.where(up, x >> np.uint64(half), x)
    return at


class Sequence:
    """A monotone sequence, split in buckets (high parts, in unary) and packed low parts."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.high, self.ones, self.low = (arrays[f"{name}.{k}"] for k in ("high", "ones", "low"))
        self.width, self.n = (int(x) for x in arrays[f"{name}.shape"])
        self.zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones

    @staticmethod
    def build(name: str, bucket: np.ndarray, low: np.ndarray, width: int, buckets: int) -> dict[str, np.ndarray]:
        """Arrays of the sequence whose elements have ascending ``bucket`` < ``buckets`` and ``low`` < 2**width."""
        n = len(bucket)
        bits = np.zeros(n + buckets + 1, np.uint8)
        bits[bucket.astype(np.int64) + np.arange(n)] = 1
        high = _words(bits)
        ones = np.bitwise_count(high).astype(np.int64)
        ones = np.cumsum(ones) - ones
        if width:
            bits = np.empty((n, width), np.uint8)
            for i in range(0, n, 1 << 16):
                bits[i : i + (1 << 16)] = (low[i : i + (1 << 16)].astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & _ONE
            packed = _words(bits.ravel())
        else:
            packed = np.zeros(1, "<u8")
        return {f"{name}.high": high, f"{name}.ones": ones, f"{name}.low": packed, f"{name}.shape": np.array([width, n], np.int64)}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        counts = self.ones if ones else self.zeros
        w = np.searchsorted(counts, k, side="right") - 1
        x = self.high[w] if ones else ~self.high[w]
        return (w << 6) + _in_word(x, k - counts[w])

    def bounds(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, end) of the elements of each bucket."""
        at = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False) + 1, 0)
        x = _window(self.high, at)
        many = np.bitwise_count(x ^ (x + _ONE)).astype(np.int64) - 1
        long = np.flatnonzero(many >= 63)
        if len(long):
            many[long] = self._select(bucket[long], False) - at[long]
        return at - bucket, at - bucket + many

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        return _window(self.low, i * self.width) & np.uint64((1 << self.width) - 1)

    def value(self, i: np.ndarray) -> np.ndarray:
        """Element i: its bucket and low part put together."""
        return (((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)).astype(np.int64)

    def find(self, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of the element with this bucket and low part, -1 if there is none: its successor is looked at."""
        at, end = self.bounds(bucket)
        out = np.full(len(bucket), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            got = self.lows(at[todo])
            hit = got == low[todo]
            out[todo[hit]] = at[todo[hit]]
            at[todo] += 1
            todo = todo[(got < low[todo]) & (at[todo] < end[todo])]
        return out


def monotone(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A sequence of ascending values below ``universe`` for ``Sequence.value``."""
    width = max(0, (max(universe, 1) // max(len(values), 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    return Sequence.build(name, (v >> np.uint64(width)).astype(np.int64), v & np.uint64((1 << width) - 1), width, (universe >> width) + 1)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> int:
    """One file, whole or not there at all; a second attempt of the task writes the same bytes."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        data = np.ascontiguousarray(x)
        head[name] = (data.dtype.str, at, len(data))
        parts.append(data.tobytes() + b"\0" * (-data.nbytes % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(temporary, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b"".join(parts))
    os.replace(temporary, path)
    return at


def map_arrays(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    base, out = 8 + size, {}
    for name, (kind, at, n) in json.loads(data[8:base].tobytes()).items():
        out[name] = np.asarray(data[base + at : base + at + n * np.dtype(kind).itemsize]).view(kind)
    return out
