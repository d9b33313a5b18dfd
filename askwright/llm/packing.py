"""Packing token sequences by bin completion.

Pieces of equal length are interchangeable, so the search runs on a histogram of lengths: at most ``capacity`` entries, whatever
the number of documents.  The best-fit-decreasing plan is the first incumbent, so no plan is worse than that.  Where it is above the lower
bound, walks through the same fillings without steps back follow, which differ in the length up to which a piece takes the filling
of least waste and not the one of fewest pieces; the best is the next incumbent.  Branch and bound then looks for one with fewer sequences: the largest piece left opens a sequence, and its completions, sets of smaller pieces, are
enumerated with the least waste first.  A filling in which a piece could be swapped for a longer one that fits is dominated and left
out; so is one that wastes more than a plan better than the incumbent can afford.  A filling is used as often as its pieces last,
which uses up at least one length.  The search ends at a lower bound or after ``nodes`` steps, with the incumbent.

Documents are tokenised where they are read.  Each piece gets a rank among those of its length (its rank within the task and an
offset for each task and length), and rank and length give sequence and offset by a lookup in the plan.

Defined cases: null texts are empty; an empty text is the end token alone; equal rows are separate pieces, and so are rows of one
id; a very long text is tokenised whole and cut into pieces; ties in length are broken by task and place in it; empty tables give no
rows; only id and text are read, so extra columns of any name change nothing; white space other than blank and newline is left to
the tokenizer.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, settle, small_batches, table, tidy

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


class Histogram:
    """Counts by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {int(k): int(v) for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.counts)
        self.total = sum(k * v for k, v in self.counts.items())

    def take(self, pattern: Pattern, times: int) -> None:
        for x, m in pattern:
            self.counts[x] -= m * times
            self.total -= x * m * times
            if not self.counts[x]:
                del self.counts[x]
                self.lengths.pop(bisect_left(self.lengths, x))

    def put(self, pattern: Pattern, times: int) -> None:
        for x, m in pattern:
            if x not in self.counts:
                self.counts[x] = 0
                self.lengths.insert(bisect_left(self.lengths, x), x)
            self.counts[x] += m * times
            self.total += x * m * times


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on a histogram: sequences of equal content are one group (pattern, how many).

    A piece goes to the fullest sequence that has room, so all pieces of a length that a sequence takes go there together.  A length
    splits two groups at most, hence the groups number no more than about three a length.
    """
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by the room left
    rooms: list[int] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, times))

    for x in sorted(counts, reverse=True):
        n, at, made = counts[x], bisect_left(rooms, x), []
        while n and at < len(rooms):
            room = rooms[at]
            many = room // x
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            full = min(times, n // many)
            rest = min(n - full * many, many) if full < times else 0
            n -= full * many + rest
            for k, of in ((many, full), (rest, int(rest > 0))):
                if of:
                    made.append((room - k * x, (*pattern, (x, k)), of))
            if untouched := times - full - (rest > 0):
                put(room, pattern, untouched)
        many = capacity // x
        for k, of in ((many, n // many), (n % many, int(n % many > 0))):
            if of:
                made.append((capacity - k * x, ((x, k),), of))
        for m in made:
            put(*m)
    return [g for held in groups.values() for g in held]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer: all pieces over the capacity, and, for each least length that is looked at, pieces over half a sequence are
    in sequences of their own and the shorter ones fill what is left there before they need more."""
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    pieces, size = (np.concatenate([[0], np.cumsum(v)]) for v in (n, n * x))  # of the first lengths
    upto = lambda y: np.searchsorted(x, y, side="right")
    half, least = upto(capacity // 2), x[2 * x <= capacity]
    alone = upto(capacity - least)  # from here on a sequence has no room for a piece of the least length
    between = pieces[alone] - pieces[half]
    over = size[half] - size[np.searchsorted(x, least)] - (between * capacity - size[alone] + size[half])
    found = pieces[-1] - pieces[alone] + between + np.maximum(0, -(-over // capacity))
    return int(max(-(-size[-1] // capacity), pieces[-1] - pieces[half], found.max(initial=0), by_number(x, n, capacity)))


def by_number(x: np.ndarray, n: np.ndarray, capacity: int) -> int:
    """No plan has fewer, by how many pieces a sequence can hold: of the pieces from some length on at most K fit in one, and no more than T
    sequences can hold K of them (their K * T shortest must fit in T sequences), so all but T hold K - 1."""
    found = 0
    for i in range(len(x)):
        count, held = np.concatenate([[0], np.cumsum(n[i:])]), np.concatenate([[0], np.cumsum(n[i:] * x[i:])])

        def shortest(m: int, count=count, held=held, i=i) -> int:
            j = min(int(np.searchsorted(count, m, side="right")) - 1, len(x) - i - 1)
            return int(held[j]) + (m - int(count[j])) * int(x[i + j])

        total, k = int(count[-1]), 1
        while k < total and k < 64 and shortest(k + 1) <= capacity:
            k += 1
        if k == 1 or k >= 64:
            found = max(found, total if k == 1 and total else 0)
            continue
        low, high = 0, total // k
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shortest(k * mid) <= capacity * mid else (low, mid - 1)
        found = max(found, -(-(total - low) // (k - 1)))
    return found


def completions(h: Histogram, room: int, allowed: int, effort: int, spent: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` as (waste, pieces), those of less waste first, none that wastes more than ``allowed``.

    A depth-first walk, longest pieces first, for ever wider bands of waste; a branch ends where all pieces that are left and fit could
    not bring the waste into the band.  A band costs ``effort`` nodes at most (``spent[0]`` counts them all), so on dense
    histograms a walk moves on to the next band instead of searching one without end.
    """
    held = [0, *accumulate(x * h.counts[x] for x in h.lengths)]  # what all pieces up to a length hold
    yielded = False

    def dominated(room: int, chosen: tuple[int, ...]) -> bool:
        for x in set(chosen):
            i = bisect_right(h.lengths, x + room) - 1
            if h.lengths[i] > x and h.counts[h.lengths[i]] > chosen.count(h.lengths[i]):
                return True  # x could be swapped for a longer piece
        return False

    def go(room: int, limit: int, chosen: tuple[int, ...], low: int, high: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        top = bisect_right(h.lengths, min(room, limit)) - 1
        grown = False
        for j in range(top, -1, -1):
            x = h.lengths[j]
            if room - held[j + 1] > high:
                return  # the waste bound: the rest is too little
            if h.counts[x] <= chosen.count(x):
                continue
            spent[0] += 1
            left[0] -= 1
            if left[0] < 0:
                return
            grown = True
            yield from go(room - x, x, (*chosen, x), low, high)
        # a filling that a further piece fits in is dominated
        if not grown and low <= room <= high and not dominated(room, chosen):
            yield room, chosen

    low, high = 0, 0
    while low <= min(room, allowed):
        left = [effort]
        for filling in go(room, room, (), low, min(high, allowed)):
            yielded = True
            yield filling
        low, high = high + 1, 2 * high + 1
    if not yielded:  # the effort was spent before a leaf: best fit
        chosen, rest = (), room
        for j in range(bisect_right(h.lengths, room) - 1, -1, -1):
            x = h.lengths[j]
            many = min(rest // x, h.counts[x])
            chosen, rest = chosen + (x,) * many, rest - many * x
        if rest <= allowed:
            yield rest, chosen


def walk(counts: dict[int, int], capacity: int, cut: int, effort: int, spent: list[int], most: int) -> list[tuple[Pattern, int]] | None:
    """One walk without steps back: a piece longer than ``cut`` is completed with the longest pieces that fit, so by few, and one up to it with
    the least waste.  On dense lengths the long ones would else use up the short pieces of sequences that could hold one piece more.
    None where it takes more than ``most`` steps.
    """
    h, made = Histogram(counts), []
    while h.lengths:
        big = h.lengths[-1]
        h.counts[big] -= 1
        if big <= cut:
            _, chosen = next(completions(h, capacity - big, capacity, effort, spent))
        else:
            chosen, rest = (), capacity - big
            for x in h.lengths[bisect_right(h.lengths, rest) - 1 :: -1] if h.lengths[0] <= rest else ():
                many = min(rest // x, h.counts[x])
                chosen, rest = chosen + (x,) * many, rest - many * x
        h.counts[big] += 1
        pattern = tuple(sorted(Counter((big, *chosen)).items(), reverse=True))
        times = min(h.counts[x] // m for x, m in pattern)
        h.take(pattern, times)
        made.append((pattern, times))
        spent[0] += 1
        if spent[0] > most:
            return None
    return made


def walks(counts: dict[int, int], capacity: int, effort: int, most: int) -> list[tuple[Pattern, int]] | None:
    """The best of walks with cuts at evenly spaced lengths, then ever nearer to the best of those."""
    lengths, spent, told = sorted(counts), [0], {}

    def at(i: int) -> int:
        if i not in told:
            told[i] = walk(counts, capacity, lengths[i], effort, spent, most)
        return sum(t for _, t in told[i]) if told[i] is not None else 1 << 62

    step = max(1, len(lengths) // 12)
    best = min(range(len(lengths) - 1, -1, -step), key=at)
    while step > 1:
        step = -(-step // 2) if step > 2 else 1
        best = min((i for i in (best, best - step, best + step) if 0 <= i < len(lengths)), key=at)
    return told[best]


def plan(counts: dict[int, int], capacity: int, nodes: int = 100_000, effort: int = 400, walk_steps: int = 3_000_000) -> list[tuple[Pattern, int]]:
    """[(pattern, times)]: best fit decreasing, or a walk or what the search finds that takes fewer sequences.

    Depth-first branch and bound.  To beat an incumbent of F sequences a plan may waste (F - 1) * capacity less all pieces; each
    pattern takes its waste from that, and a filling that takes more is not enumerated.  A filling is tried as often as
    its pieces last and then once, so no plan is out of reach.  ``nodes`` bounds the steps of the whole search.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    best = best_fit(counts, capacity)
    fewest = sum(t for _, t in best)
    h = Histogram(counts)
    total = h.total
    lower = least_sequences(counts, capacity)
    if fewest > lower and (other := walks(counts, capacity, effort, walk_steps)) and sum(t for _, t in other) < fewest:
        best, fewest = other, sum(t for _, t in other)
    stack: list[list] = []  # [fillings, their largest piece, pattern, times, waste of the pattern, tried once]
    wasted, spent = 0, [0]

    def allowance() -> int:
        return (fewest - 1) * capacity - total - wasted

    def advance(entry: list) -> bool:
        """Take the next choice of an entry whose last one was put back."""
        nonlocal wasted
        spent[0] += 1
        if entry[2] is not None and entry[3] > 1 and not entry[5]:
            pattern, times, waste, entry[5] = entry[2], 1, entry[4], True
        else:
            big = entry[1]
            h.counts[big] -= 1  # it is in the sequence already
            found = next(entry[0], None)
            h.counts[big] += 1
            if found is None:
                return False
            waste = found[0]
            pattern = tuple(sorted(Counter((big, *found[1])).items(), reverse=True))
            times = min(h.counts[x] // m for x, m in pattern)
            entry[5] = False
        if waste and waste * times > allowance():
            times = allowance() // waste
            if times <= 0:
                return advance(entry) if not entry[5] else False
        entry[2:5] = [pattern, times, waste]
        h.take(pattern, times)
        wasted += waste * times
        return True

    def undo(entry: list) -> None:
        nonlocal wasted
        h.put(entry[2], entry[3])
        wasted -= entry[4] * entry[3]

    forward = True
    while fewest > lower and spent[0] <= nodes:
        if forward and h.lengths:
            big = h.lengths[-1]
            spent[0] += 1
            h.counts[big] -= 1
            fillings = completions(h, capacity - big, allowance(), effort, spent)
            h.counts[big] += 1
            stack.append([fillings, big, None, 0, 0, False])
            forward = advance(stack[-1])
            if not forward:
                stack.pop()
            continue
        if forward:  # all is placed, in fewer sequences than before
            best, fewest = [(e[2], e[3]) for e in stack], sum(e[3] for e in stack)
        if not stack:
            break
        entry = stack[-1]
        undo(entry)
        forward = advance(entry)
        if not forward:
            stack.pop()
    return best


class Lookup:
    """(sequence, offset) of a piece from its length and its rank among those of that length."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows, given, first = [], Counter(), 0
        for pattern, times in patterns:
            offset = 0
            for x, m in pattern:
                rows.append((x, given[x], first, m, offset))
                given[x] += m * times
                offset += x * m
            first += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.low, self.first, self.many, self.offset = table.T
        self.key = (self.length << 48) + self.low

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        over = rank - self.low[at]
        return self.first[at] + over // self.many[at], self.offset[at] + (over % self.many[at]) * length


class WordCache(dict):
    """Bytes of the little-endian 32-bit ids of a run of characters without blanks and newlines.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its runs in turn.  It also
    lower-cases and splits between a letter or digit and the punctuation after it, so A-Z are lower-cased here, and a run with such
    a tail is read as two runs, where the letter is an ASCII or Latin-1 one.  Beyond ``limit`` runs the cache starts anew.
    """

    # other letters are no letters any more, or end in a mark, once the tokenizer has composed and lower-cased them (U+0130, U+0958)
    TAIL = r"(?s)^(?P<core>.*[a-zA-Z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])(?P<tail>[.,;:!?%$&*#|]+)$"
    CAPITAL_AND_MARK = r"[A-Z][^\x00-\x{FF}]"

    def __init__(self, tokenizer, limit: int = 700_000):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit
        vocabulary = tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _words(self, runs: list[str]) -> None:
        """Runs of letters only: one word each, and a word has one last token."""
        for i in range(0, len(runs), 1000):
            part = runs[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.tobytes(), (4 * ends).tolist()
                self.update(zip(part, (data[s:e] for s, e in zip([0, *at], at, strict=False)), strict=True))
            else:
                self._others(part)

    def _others(self, runs: list[str]) -> None:
        """Any runs; token offsets tell them apart."""
        for i in range(0, len(runs), 1000):
            part = runs[i : i + 1000]
            got = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            data = np.array(got.ids, "<u4").tobytes()
            begin = np.array([b for b, _ in got.offsets], np.int64)
            at = (4 * np.searchsorted(begin, np.cumsum([0, *(len(r) + 1 for r in part)]))).tolist()
            self.update((r, data[s:e]) for r, s, e in zip(part, at, at[1:], strict=False))

    def ids(self, runs: list[str]) -> list[bytes]:
        """The bytes of each of the distinct ``runs``."""
        if len(self) > self.limit:
            self.clear()
        self[""] = b""
        unknown = [r for r in runs if r not in self]
        letters = [r for r in unknown if r.isalpha()]
        self._words(letters)
        if len(letters) < len(unknown):
            self._others([r for r in unknown if not r.isalpha()])
        return list(map(self.__getitem__, runs))

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text.  Arrow cuts a portion of texts into runs, cores and tails and numbers the distinct ones."""
        # a special token's string is one in small letters only, and some marks compose with a small letter only (y and U+030A)
        plain = pc.invert(pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, self.CAPITAL_AND_MARK)))
        low = pc.if_else(plain, pc.ascii_lower(texts), texts)
        lists = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        runs = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(runs.dictionary, self.TAIL)
        core = pc.if_else(pc.is_valid(parts), parts.field(0), runs.dictionary)
        tail = pc.if_else(pc.is_valid(parts), parts.field(1), "")
        first, size, found = [], [], []
        for side in (core.dictionary_encode(), tail.dictionary_encode()):
            got = self.ids(side.dictionary.to_pylist())
            n = np.fromiter(map(len, got), np.int64, len(got)) // 4
            which = side.indices.to_numpy()
            first.append((np.cumsum(n) - n + sum(map(len, found)) // 4)[which])
            size.append(n[which])
            found.append(b"".join(got))
        data = np.frombuffer(b"".join(found), "<u4")
        first, size = np.stack(first, 1), np.stack(size, 1)
        which = runs.indices.to_numpy()
        end = np.cumsum(lists.value_lengths().to_numpy())
        for a, b in zip([0, *end[:-1]], end, strict=True):
            of = which[a:b]
            yield data[_ranges(first[of].ravel(), size[of].ravel())]


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] of them, then those from first[1], and so on."""
    end = np.cumsum(many)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + many, many)


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and its part and rank for the plan."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        cache = WordCache(Tokenizer.from_str(tokenizer_json))
        part, ranks = TaskContext.get().partitionId(), Counter()
        for some in portions(batches, 4 << 20):
            rows = []
            for i, ids in enumerate(cache.texts(some.column("text"))):
                ids = np.concatenate([ids, end])
                for p, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((i, p, at, len(piece), zlib.crc32(piece.tobytes()), part, ranks[len(piece)]))
                    ranks[len(piece)] += 1
            row, *rest = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = settle(token_pieces(docs, f.read(), capacity, end_id, **columns), "pieces")
    counts = settle(pieces.groupBy("part", "length").count(), "counts")
    lookup = Lookup(plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in parts:
            sequence, offset = lookup(length.to_numpy(), rank.to_numpy())
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # the table of offsets grows with the number of tasks, so it is merged, never broadcast
    placed = pieces.join(offsets.hint("merge"), ["part", "length"]).withColumn("at", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def default_tokenizer() -> str:
    from public_tokenizers import path

    return str(path("word_bpe_49k.json"))


def op7_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


ORACLE: dict[str, str] = {}
QUERIES = {"op7_bin_completion": op7_bin_completion}
