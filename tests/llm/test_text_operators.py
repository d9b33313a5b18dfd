import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwright.llm import components, decontaminate, near_dup, suffix_dedup

from ..conftest import DATA

WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from their old oak tree and hum".split()


def near_rows():
    base = " ".join(WORDS * 3)
    rows = [(i, " ".join(w if k != i % 60 else f"w{i}" for k, w in enumerate(base.split()))) for i in range(40)]
    rows += [(100, base), (101, base.upper()), (102, None), (103, ""), (104, "  "), (105, "two words"), (106, "Two,  Words!"), (107, "x " * 30_000), (100, base), (None, "nobody here"), (108, "completely other words in this one text")]
    return rows


def brute_links(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [{j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / len(a | b) >= threshold} for i, a in enumerate(sets)]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates_against_all_pairs(spark, block):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, keep string").repartition(3)
    told = near_dup.near_duplicates(df, block=block).collect()
    links = brute_links(rows)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    least = defaultdict(list)
    for i, c in enumerate(label):
        least[c].append(rows[i][0])
    first = lambda ids: min(ids, key=lambda x: (x is not None, x))
    want = sorted((repr(rows[i][0]), repr(first(least[label[i]])), len(links[i])) for i in range(len(rows)))
    assert sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in told) == want
    assert sum(r.keep for r in told) == len(least)


def test_near_duplicates_of_the_fixture(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    told = {r.doc_id: r for r in near_dup.near_duplicates(d).collect()}
    rows = [(r.doc_id, r.text) for r in d.collect()]
    for (i, _), l in zip(rows, brute_links(rows), strict=True):
        assert told[i].n_links == len(l)


def test_dropping_near_duplicates(spark):
    df = spark.createDataFrame([(i, t, "e") for i, t in near_rows() if i is not None][:-3], "doc_id long, text string, class_id string")
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 102, 103, 104, 105} and not {r.doc_id for r in kept.collect()} & {100, 101, 106}
    assert near_dup.drop_near_duplicates(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        b, r = near_dup.bands_and_rows(0.8, recall, 256)
        assert b * r <= 256 and 1 - (1 - 0.8**r) ** b >= recall


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    told = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert told == label


def brute_repeats(rows, span=50):
    owner, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: -1 if i is None else i
    for i, b in data:
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            owner[w] = min(owner.get(w, order(i)), order(i))
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if owner[b[s : s + span]] < order(i):
                gone[s : s + span] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows():
    a, b = "".join(chr(97 + (i * i * 7 + i * 3) % 26) for i in range(90)), "".join(chr(97 + (i * i * 11 + i) % 26) for i in range(70))
    rows = [(5, "x" + a + "y"), (3, a[:60] + b), (9, "é" * 10 + a[10:80] + b + "z"), (1, "a" * 400), (2, "b" + "a" * 120 + "c"), (7, "ab" * 100), (8, "ba" * 90), (11, a + a), (12, a + b + a), (13, None), (14, ""), (15, "short"), (16, "short"), (17, "x" + a + "y"), (5, "other " + b), (None, b + "!"), (18, b[:49]), (19, b[:50]), (20, b[1:50] + "?"), (5, "x" + a + "y")]
    return rows + [(100 + i, f"{i} " + "common header line that every one of these documents has in its text" + f" {i * 7919}") for i in range(30)]


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"chunk_bytes": 300, "bucket_anchors": 4}])
def test_repeats_against_all_windows(spark, options):
    rows = repeat_rows()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(4)
    told = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **options).collect()), key=repr)
    assert told == brute_repeats(rows)


def test_repeats_by_ids_of_other_types(spark):
    base = " ".join(WORDS)
    rows = [("b", base), ("a", "x " + base), ("c", base + " y"), (None, base[:60]), ("d", "short"), ("b", base)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    place = {i: k for k, i in enumerate([None, "a", "b", "c", "d"])}
    numbered = spark.createDataFrame([(place[i], t) for i, t in rows], "doc_id long, text string")
    told = sorted((place[r.doc_id], r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    assert told == sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(numbered).collect())
    assert sum(n for _, n, _, _ in told) > 300


def test_repeats_of_the_fixture_and_of_nothing(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    told = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect()), key=repr)
    assert told == brute_repeats([(r.doc_id, r.text) for r in d.collect()])
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 700)
    group = rng.integers(0, 5, 700)
    order, new = suffix_dedup.suffix_classes(data, start, group, suffix_dedup.Powers(), span=12)
    keys = [(group[i], data[start[i] : start[i] + 12].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert new.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


@pytest.mark.parametrize("keep", [0x0, 0x1, 0x7, 0xFF])
def test_colliding_hashes_lose_no_repeat(monkeypatch, keep):
    """Hashes with few bits left: equal windows are one class each all the same."""
    plain = suffix_dedup.PrefixHashes.of
    monkeypatch.setattr(suffix_dedup.PrefixHashes, "of", lambda self, start, length: plain(self, start, length) & np.uint64(keep))
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 2000).astype(np.uint8)
    start, group = rng.integers(0, 1900, 500), rng.integers(0, 4, 500)
    order, new = suffix_dedup.suffix_classes(data, start, group, suffix_dedup.Powers(), span=11)
    keys = [(group[i], data[start[i] : start[i] + 11].tobytes()) for i in order]
    assert sorted(order) == list(range(500))
    assert new.sum() == len(set(keys)) and new.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


def brute_contamination(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - span + 1) if w else 0):
            windows[tuple(w[s : s + span])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s : s + n]))
                if got:
                    found |= got
                    hit |= set(range(s, s + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination_against_all_windows(spark, limit):
    item = " ".join(WORDS)
    items = [(1, item), (10, item.upper()), (2, "Short, item!"), (3, ""), (4, None), (5, "one"), (6, "é1 " * 12), (7, " ".join(WORDS[5:15]))]
    docs = [(1, "pre " + item.replace(" ", " -- ") + " post"), (2, " ".join(WORDS[:9])), (3, None), (4, ""), (5, "a short item here; another SHORT item"), (6, " ".join(WORDS[3:14]) + " x " + " ".join(WORDS[3:14])), (7, "é1 é1 é1 é1 é1 é1 é1 é1 é1 é1 É1"), (8, "nothing to see"), (5, item), (None, item), (9, ("word " * 9 + ". ") * 4000 + item)]
    df = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id long, text string, contaminated string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, length int")
    told = decontaminate.contamination(df, bench, max_literals=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in told), key=repr) == brute_contamination(docs, items)
    if limit:
        kept = decontaminate.drop_contaminated(df, bench)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8]
        assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
        assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_decontamination_runs_no_python(spark):
    d, b = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.contamination(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_crc_folds_match_python(spark):
    from askwright.llm.common import held_out

    for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)
