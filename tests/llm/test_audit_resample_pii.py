"""Source divergence, importance resampling and personal data against brute force, and the bounded sample of labelled rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from askwright.llm import divergence, labelled, pii, resample

from ..conftest import DATA

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "The", "cat", "été", "ÉTÉ", "x1y", "über", "日本", "dog's", "a"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocab, [9, 2, 5, 2, 1, 2, 1, 2, 1, 4], k=rng.randrange(0, 30)))
        rows.append((i if i % 11 else None, text if i % 7 else None, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", None, "ß"]), "clash"))
    rows += [rows[5], rows[5], (900, "long Word " * 30_000, "en", "s1", "clash"), (901, "lonely", "xx", "s9", "clash")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, term string"


def divergence_by_hand(rows, min_docs, top):
    docs = [(la or "", so or "", TERM.findall(lower(t))) for _, t, la, so, _ in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        of_docs = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in of_docs.items() if n >= min_docs]
        groups = {s: Counter(w for d in mine if d[1] == s for w in d[2] if w in set(kept)) for s in {d[1] for d in mine}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if groups[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 10, 10_000])
@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, min_docs, small):
    if small:  # many slices of text and of counts
        monkeypatch.setattr(divergence, "TEXT_BYTES", 100)
        monkeypatch.setattr(divergence, "COUNT_ROWS", 3)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    told = sorted(map(tuple, divergence.source_divergence(df, min_docs, 3).collect()))
    assert told == divergence_by_hand(rows, min_docs, 3)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def resampled_by_hand(rows, target, orders, buckets, min_words, percent, seed):
    def features(t):
        w = WORD.findall(lower(t))
        return [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(bucket(x) for r in rows for x in features(r[1])), Counter(bucket(x) for r in target for x in features(r[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text, *_ in rows:
        got = [gain(bucket(x)) for x in features(text)]
        weight = sum(got) // len(got) if got else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(WORD.findall(lower(text)))))
    drawn = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    k = len(drawn) * percent // 100
    ranks = Counter()
    told = [(*x[:4], n + 1 if n < k else None) for n, x in enumerate(drawn)] + [(*x[:4], None) for x in out if x[4] < min_words]
    assert not ranks
    return sorted(told, key=repr)


@pytest.mark.parametrize("orders,percent", [(1, 10), (3, 50), (2, 100)])
def test_resample(spark, orders, percent):
    rows = corpus(120, 2)
    target = [(1, "the cat été the dog"), (2, None), (3, "THE cat a a a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    goal = spark.createDataFrame(target, "item_id long, text string")
    told = resample.resample(df, goal, orders, 50, 8, percent).collect()
    assert sorted(map(tuple, told), key=repr) == resampled_by_hand(rows, target, orders, 50, 8, percent, 2024)
    assert resample.resample(df.limit(0), goal).count() == 0
    empty = resample.resample(df, goal.limit(0), orders, 50, 8, percent).collect()
    assert sorted(map(tuple, empty), key=repr) == resampled_by_hand(rows, [], orders, 50, 8, percent, 2024)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, span):
    d = [int(c) for c in span if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        twice = [v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def strict_by_hand(text):
    return [(i, m.start(), m.end()) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if right(kind, m[0])]


PIECES = ["a", "B", "_", "@", ".", "-", "1", "2", "55", "256", "+", " ", "(", ")", "é", "%", " at ", "[at]", " dot ", "[.]", "\n", "4111111111111111", "4111 1111 1111 1111", "+1 (743) 555-3824", "+49 30 123456", "ip "]


def test_strict_spans_are_the_patterns_leftmost_matches():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25)))
        found = pii.candidates(text)
        assert [x[:3] for x in found if x[3]] == strict_by_hand(text), text
        for kind in range(4):
            spans = [x[1:3] for x in found if x[0] == kind]
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), text
        assert all(0 <= x[4] < pii.MOST_KEYS for x in found)


@pytest.mark.parametrize("text", ["a" * 200_000 + "@" + "b" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "ab[at]c " * 20_000, "1 " * 100_000, " at a dot b" * 20_000])
def test_odd_long_texts_take_linear_time(text):
    assert isinstance(pii.candidates(text), list)


def test_query_against_patterns(spark):
    """Counts and digest are those of the strict patterns over whole texts; the other spans come on top."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    told = {r.doc_id: r for r in pii.op13_pii(spark, DATA).collect()}
    assert len(told) == len(rows)
    for r in rows:
        spans = strict_by_hand(r.text or "")
        listed = [f"{list(PATTERNS)[k]}:{a}:{b}" for k, a, b in spans]
        got = told[r.doc_id]
        assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == tuple(sum(k == i for k, _, _ in spans) for i in range(4))
        assert got.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got.spans.split(",")) | {""}


PLANTED = [
    ("write to jo.doe [at] example [dot] com please", ["jo.doe [at] example [dot] com"]),
    ("jane at mail dot example dot org", ["jane at mail dot example dot org"]),
    ("call (743) 555-3824 today", ["(743) 555-3824"]),
    ("server 10[.]0[.]0[.]1 is down", ["10[.]0[.]0[.]1"]),
    ("card 4111.1111.1111.1111 was used", ["4111.1111.1111.1111"]),
    ("look at example.com, it was on 2023-01-15 12:30", []),
    ("order 4111 1111 1111 1112, page 1. 2. 3. 4, pi is 3.14159265358979", []),
    ("nothing here, not even 12 345 678 or a dot", []),
]


def test_planted_spans(spark):
    rows = [(i, t, "spans") for i, (t, _) in enumerate(PLANTED)] + [(100 + i, f"mail x{i}@example.com or +1 (743) 555-38{i:02d} from 8.8.8.{i}, 4111111111111111 or 4111111111111112", "spans") for i in range(60)]
    rows += [(None, None, "spans"), (7, "", "spans"), (8, "é 👍 a@b.de", "spans"), (8, "é 👍 a@b.de", "spans")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = [(r.doc_id, r.spans) for r in pii.personal_spans(df).collect()]
    assert len(got) == len(rows)
    spans = dict(got)
    for i, (text, want) in enumerate(PLANTED[:7]):
        if i != 7:
            assert [text[s.start : s.end] for s in spans[i] if not s.strict] == want, text
    assert [(s.start, s.end) for s in spans[8]] == [(4, 10)]
    assert all(len(s) == 4 and all(x.strict for x in s) for i, s in got if i is not None and i >= 100)
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[0] == "write to <EMAIL> please" and out[8] == "é 👍 <EMAIL>" and out[None] is None and out[5] == PLANTED[5][0]
    assert pii.personal_spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).columns == df.columns


def test_model_finds_reliabilities():
    """Votes drawn from known reliabilities: the estimates come near, and the classes keep their meaning."""
    rng = np.random.default_rng(4)
    want = np.array([[0.95, 0.9, 0.8, 0.85, 0.7], [0.9, 0.95, 0.75, 0.8, 0.9]])
    counts = Counter()
    for y in (rng.random(20_000) < 0.4).astype(int):
        agree = rng.random(5) < want[1 - y]
        votes = tuple(int(x) for x in np.where(agree == (y == 1), pii.YES, pii.NO))
        counts[pii._key(0, votes, "a@b.de", " ", " ")] += 1
    model = pii.SpanModel(dict(counts))
    assert np.abs(model.reliability["email"] - want).max() < 0.05
    assert pii.SpanModel({}).accepted() == []


def test_labelled_sample_collects_a_row_for_each_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2, f"text {i % 2}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    sizes, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(got := collect(self))) or got)
    sample = labelled.labelled_sample(docs, labels, "quality")
    assert sorted(sample.texts) == ["text 0", "text 1"] and max(sizes) <= 2
