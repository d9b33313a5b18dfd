import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwright.llm import exact_dedup, sharding, url_filter

from ..conftest import DATA

ROWS = [(1, "Same Text", "x"), (2, "same text", "y"), (3, None, "z"), (4, "", "z"), (5, "É", "z"), (6, "é", "z"), (7, "long " * 60_000, "z"), (8, "LONG " * 60_000, "z"), (2, "same text", "y"), (None, "lonely", None), (9, "é", "z")]
SCHEMA = "doc_id long, text string, kept string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("cells", [1 << 29, 1 << 16])
def test_exact_duplicates_against_groups(spark, cells):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("kept", "extra").repartition(3)
    told = exact_dedup.exact_duplicates(df, max_cells=cells).collect()
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    assert len(told) == len(ROWS)
    for r in told:
        ids = groups[lower(r.text)]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert r.text_sha256 == hashlib.sha256(lower(r.text).encode()).hexdigest()
    kept = [lower(r.text) for r in told if r.kept]
    assert sorted(kept) == sorted(groups)


def test_exact_dedup_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == ["doc_id", "text", "kept"] and out.count() == len({lower(t) for _, t, _ in ROWS})
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0
    assert exact_dedup.exact_duplicates(df.limit(0), narrow=["doc_id"]).count() == 0


def test_filter_misses_no_repeat(spark):
    df = spark.range(3000).select(F.xxhash64(F.col("id") % 2000).alias("h")).repartition(5)
    bits, cells = exact_dedup.repeat_filter(df, 3000)
    h = np.array([r.h for r in df.distinct().collect()])
    repeated = {r.h for r in df.groupBy("h").count().where("count > 1").collect()}
    at = exact_dedup._cells(h, cells)
    hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    flagged = set(h[(hit[: len(h)] & hit[len(h) :]).astype(bool)].tolist())
    assert repeated <= flagged and len(flagged) < len(h)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_feistel_is_a_permutation_and_turns_back(n):
    x = np.arange(n)
    y = sharding.permute(x, n, seed=3)
    assert sorted(y) == list(range(n)) and (sharding.permute(y, n, seed=3, back=True) == x).all()


def test_shards(spark):
    rows = [(i // 2 if i % 9 else None, None if i % 5 == 0 else "t" * (i % 4)) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = [sharding.shuffle_shards(df.repartition(n), 8).collect() for n in (1, 6)]
    key = lambda rs: sorted(map(repr, rs))
    assert key(told[0]) == key(told[1])
    sizes = [sorted(r.slot for r in told[0] if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert sorted(r.size for r in told[0]) == sorted(len(t or "") + 1 for _, t in rows)
    assert sharding.shuffle_shards(df.limit(0)).count() == 0


URLS = ["http://example.org/es/1", "https://a.EXAMPLE.org/en/12", "http://org/", "http://org", "http://notorg/x", "http://x.com/fr/9?q", "http://com/de/", "ftp://y.com/de", None, "no scheme", "http://a.com/x.org/", "://b.net", "http://x.org#/f", "http://" + "a." * 40_000 + "org/" + "p" * 50_000, "", "http://e.example.org/en/2", "http://xcom/de/1", "http://example.org/en/1"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id int, url string, extra string")
    told = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1].split("#")[0].split("?")[0]
            host, slash, path = rest.partition("/")
            host, path = lower(host), slash + path
        fits = [(len(r), r, v) for v, r in url_filter.RULES if path.startswith("/" + r.partition("/")[2]) and (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))]
        assert told[i] == (max(fits)[1:] if fits else (None, "allow")), u
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_globs_match_like_regular_expressions():
    import random
    import re

    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "?", "**"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)]
    hit = url_filter.GlobAutomaton([g.encode() for g in globs]).matches(texts)
    for k, g in enumerate(globs):
        pattern = re.compile(re.sub(r"\*\*|\*|\?|.", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])), g).replace("[^/]*.*", ".*"))
        for i, t in enumerate(texts):
            assert hit[i, k] == bool(pattern.fullmatch(t.decode())), (g, t)


def test_blocking_globs_decide_where_no_rule_fits(spark):
    df = spark.createDataFrame([("http://spam.net/x/y",), ("http://fine.net/x",), ("http://spam.org/x",)], "url string")
    told = {r.url: r.verdict for r in url_filter.judge_urls(df, block_globs=["spam.*/**"]).collect()}
    assert told == {"http://spam.net/x/y": "block", "http://fine.net/x": "allow", "http://spam.org/x": "allow"}


def test_url_columns_of_clashing_names(spark):
    rows = [(1, "http://A.casino-win.net/en/1", "x", "y"), (2, "HTTP://ads.example.org/es/9?q#f", None, "z"), (3, None, "", ""), (4, "http://q.net/a/b.exe?x", "h", "p"), (5, "http://q.net", "h", "p")]
    df = spark.createDataFrame(rows, "page_id int, url string, path string, Verdict string")
    want = {1: ("a.casino-win.net", "/en/1", None, "block"), 2: ("ads.example.org", "/es/9", "example.org/es/", "block"), 3: ("", "", None, "allow"), 4: ("q.net", "/a/b.exe", None, "block"), 5: ("q.net", "", None, "allow")}
    told = url_filter.judge_urls(df, block_globs=url_filter.BLOCK_GLOBS)
    assert told.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in told.collect()} == want
    held = url_filter.judge_urls(df.select("page_id", df.url.alias("host")), block_globs=url_filter.BLOCK_GLOBS, url_col="host")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in held.collect()} == want


def test_the_query_has_globs_in_several_words():
    globs = [g for _, r in url_filter.RULES for g in url_filter.rule_globs(r)] + [g.encode() for g in url_filter.BLOCK_GLOBS]
    assert url_filter.GlobAutomaton(globs).words > 2


def plain_place(number, n, seed):
    """The Feistel network on Python integers."""
    half = 1
    while 4**half < n:
        half += 1
    x = number
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for i in range(6):
            y = (right + ((seed + 1) * 0x9E3779B97F4A7C15 + i * 0xD1342543DE82EF95) % 2**64) % 2**64
            y = ((y ^ y >> 30) * 0xBF58476D1CE4E5B9) % 2**64
            y = ((y ^ y >> 27) * 0x94D049BB133111EB) % 2**64
            left, right = right, left ^ ((y ^ y >> 31) & (1 << half) - 1)
        x = left << half | right
        if x < n:
            return x


def test_shards_against_plain_integers(spark):
    """The whole query: every row's size, crc, shard and slot from its place in the order of ids."""
    told = {r.doc_id: r for r in sharding.op8_feistel_shards(spark, DATA).collect()}
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert len(told) == len(docs)
    for number, (i, data) in enumerate(docs):
        place = plain_place(number, len(docs), 0)
        r = told[i]
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", place % 8, place // 8, None)
