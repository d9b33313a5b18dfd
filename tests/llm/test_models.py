import bisect
import math
import os
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwright.llm import elias_fano, lm_score, packing, quality, toxicity
from askwright.llm.labelled import Sample, labelled_sample, logistic, probability

BIG = "/root/testdata/sf0.01"
LABELLED = "/root/testdata/sf0.1"  # some thousand labelled rows, for accuracies


def accuracy(spark, query, label, threshold):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    rows = query(spark, LABELLED).join(labels, "doc_id").select("held_out", "score", "predicted", F.col(label).alias("y")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    held = [r for r in rows if r.held_out]
    return sum(r.predicted == r.y for r in held) / len(held), held


def test_quality_on_held_out_rows(spark):
    right, held = accuracy(spark, quality.op1_nb_svm_quality, "quality", 0.7)
    most = sum(r.y for r in held) / len(held)
    # on these rows 0.11 above the majority is reached
    assert right > most + 0.09 and sum(r.predicted == r.y for r in held if not r.y) >= 0.75 * (1 - most) * len(held)


def test_toxicity_on_held_out_rows(spark):
    right, held = accuracy(spark, toxicity.op4_crf_toxicity, "toxic", 0.3)
    toxic = [r for r in held if r.y]
    # always answering the majority is right for 1 - len(toxic) / len(held)
    assert right > 1 - len(toxic) / len(held) + 0.08 and sum(r.predicted for r in toxic) >= 0.8 * len(toxic)


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "scum " * 30_000), (5, "fine words here"), (5, "fine words here")]


def test_scores_of_edge_cases(spark):
    texts = [f"a calm text number {i} about rivers" for i in range(60)] + [f"you are scum number {i} and more" for i in range(60)]
    sample = Sample(texts, np.array([0] * 60 + [1] * 60), (600, 60))
    order = np.random.default_rng(0).permutation(120)
    sample = Sample([texts[i] for i in order], sample.labels[order], sample.rates)
    df = spark.createDataFrame([(i, t, "e") for i, t in EDGES], "doc_id long, text string, score string")
    field = toxicity.ToxicField(sample)
    told = {r.doc_id: r.t for r in df.select("doc_id", toxicity.toxicity(field, F.col("text")).alias("t")).collect()}
    assert told[4].score > 0.5 > told[5].score and told[1].score == told[2].score < 0.3
    assert told[4].spans and all("scum " * 30_000 and s.end - s.start == 4 for s in told[4].spans)
    model = quality.QualityModel(sample)
    scores = {r.doc_id: r.s for r in df.select("doc_id", quality.quality_score(model, F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2] and scores[4] > scores[5]


def test_without_labels_every_score_is_the_rate(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "toxic")
    assert sample.texts == [] and sample.rates == (0, 0)
    assert toxicity.drop_toxic(docs, labels, 0.6).count() == 2
    assert np.allclose(quality.QualityModel(sample).scores(["x", ""], quality.Indicators()), 0.5)
    assert toxicity.drop_toxic(docs.limit(0), labels, 0.6).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7) * 10) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    full = labelled_sample(docs, labels, "quality")
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(full.texts) == len(kept) and sum(full.rates) == len(kept)
    small = labelled_sample(docs, labels, "quality", per_class=20, max_bytes=500)
    assert len(small.texts) <= 40 and sum(map(len, small.texts)) <= 500


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=(2, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, _ = toxicity._forward_backward(e, trans, start)
    for w in range(2):
        total, on = 0.0, np.zeros(5)
        for bits in range(32):
            tags = [(bits >> i) & 1 for i in range(5)]
            s = start[tags[0]] + sum(e[w, i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False))
            total += math.exp(s)
            on += math.exp(s) * np.array(tags)
        assert np.allclose(p[w], on / total)


def test_gaps_are_exact():
    """Reading by matrix powers gives the marginals of the whole chain."""
    field = toxicity.ToxicField.__new__(toxicity.ToxicField)
    field.weights, field.bias, field.trans, field.start = {"scum": (3.0, 0.0, 0.0), " idio": (2.0, 0.7, -0.4), "n ": (0.1, 0.0, 0.0)}, -1.5, np.array([[0.4, -0.6], [-0.2, 0.9]]), np.zeros(2)
    field._prepare()
    for text, told in (("one two scum three four five idiot scum six seven", ["scum", "five", "idiot", "scum", "seven"]), ("IDIOT, scumscum", ["IDIOT", "scumscum"]), ("noidiot ten", ["ten"])):
        tokens = re.findall(r"[^\W_]+", text.lower())
        has = [[f in f" {t} " for f in field.weights] for t in ["", *tokens, ""]]
        own, before, after = np.array(list(field.weights.values())).T
        e = np.array([[field.bias + own @ has[j] + before @ has[j - 1] + after @ has[j + 1] for j in range(1, len(tokens) + 1)]])
        want, _ = toxicity._forward_backward(e, field.trans, field.start)
        spans = field.read(text)[1]
        assert [text[b:s] for b, s, _ in spans] == told
        at = [len(re.findall(r"[^\W_]+", text[:b])) for b, _, _ in spans]
        assert np.allclose([m for _, _, m in spans], want[0][at])


def scum_field():
    field = toxicity.ToxicField.__new__(toxicity.ToxicField)
    field.weights, field.bias, field.trans, field.start = {" scum ": (9.0, 0.0, 0.0), "scu": (1.0, 0.0, 0.0)}, -4.0, np.zeros((2, 2)), np.zeros(2)
    field._prepare()
    return field


@pytest.mark.parametrize("blank", [*"\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000", ", ", "_"])
def test_tokens_end_at_every_blank(blank):
    for text in (f"scum{blank}nice", f"nice{blank}scum{blank}end", f"İ{blank}SCUM"):
        (begin, end, marginal) = scum_field().read(text)[1][0]
        assert text[begin:end].lower() == "scum" and marginal > 0.9


def test_very_long_tokens_are_read_in_linear_time():
    started = time.monotonic()
    spans = scum_field().read("scum" * 2_500_000 + " scum")[1]
    assert len(spans) == 2 and spans[1][:2] == (10_000_001, 10_000_005) and time.monotonic() - started < 30


def test_token_labels_come_from_the_other_half():
    """A word that only one half has is no evidence there, whatever the field's features."""
    calm = [f"a calm text number {i} about rivers" for i in range(80)]
    bad = [f"you are {'scum' if i % 2 else 'vermin'} number {i}" for i in range(80)]
    texts = [t for pair in zip(calm, bad, strict=True) for t in pair]
    fit = [(toxicity._spaced(t)[0].split(), int(i % 2)) for i, t in enumerate(texts)]
    both, *halves = toxicity._frequent(fit, 4, [((0, 1, 2, 3), 5.0), ((1,), 5.0), ((3,), 5.0)])
    assert " scum " in both and " vermin " in both
    assert all(not halves[0].count(w) or not halves[1].count(w) for w in (" scum ", " vermin "))


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4))
    y = (x @ np.array([1, -2, 0.5, 0]) > 0).astype(int)
    w = quality.dual_coordinate_descent([(np.arange(4), r) for r in x], y, 4, c=10, epochs=200)
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.97


def test_logistic_follows_the_rates():
    x = np.array([[-2.0], [-1], [1], [2]] * 20)
    y = np.array([0, 0, 1, 1] * 20)
    assert (probability(x, logistic(x, y, (90, 10))) < probability(x, logistic(x, y, (50, 50)))).all()


# ---- packing ----


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


ODD = [(1, None), (2, ""), (3, "<|endoftext|>. Hi It's ain't x)., a%%%. don't. 5%. abc'. ''s ."), (4, "a\tb\r\n c d. İstanbul ΣΑΣ. ﬁ."), (5, "<|ENDOFTEXT|> A"), (6, "word, " * 9000), (6, "word, " * 9000), (7, "..., ,a .b. '"), (8, "x" * 5000)]
ODD += [(9, "TR İ. ok İ, ı."), (10, "Y\u030a. y\u030a; \u0958. \u05e9\u05c1: \ufb2a!"), (11, "é. É, e\u0301. \u2126. ª. ½. \u1680x.")]


def test_pieces_are_the_tokenizers(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, length int").repartition(3)
    told = packing.pack(df, packing.default_tokenizer()).collect()
    tk = tokenizer()
    want = []
    for i, t in ODD:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in told) == sorted(want)
    filled = defaultdict(list)
    for r in told:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(df.limit(0), packing.default_tokenizer()).count() == 0


def test_runs_give_the_ids_of_whole_texts():
    """Characters that composing or lower-casing changes, beside marks, punctuation and blanks of all kinds."""
    import pyarrow as pa

    def changed(c):
        return c.lower() != c or c.upper() != c or unicodedata.normalize("NFC", c) != c or (ord(c) < 0x3000 and unicodedata.category(c) in ("Mn", "Lm", "Nl", "No", "Lo"))

    odd = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and changed(c)]
    plain = [*"abcXYZ019.,;:!?%$&*#|'\"()<>[]{}-_ \n\t\r\x0b\x0c\x85\xa0\u2028", "'s", "'RE", "<|endoftext|>", "<|", "|>", "<|EndOfText|>", "the", ". "]
    rng, tk = random.Random(5), tokenizer()
    cache = packing.WordCache(tk, limit=5_000)
    for _ in range(20):
        texts = ["".join(rng.choice(odd) if (r := rng.random()) < 0.25 else chr(rng.randrange(0x300, 0x36F)) if r < 0.32 else rng.choice(plain) for _ in range(rng.randint(0, 14))) for _ in range(1000)]
        for text, got, want in zip(texts, cache.texts(pa.array(texts)), tk.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids, text


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, x)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - x)
    return len(rooms)


def sequences(plan, items, capacity):
    used = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(x * m for x, m in pattern) <= capacity
        for x, m in pattern:
            used[x] += m * times
    assert used == Counter(items)
    return sum(t for _, t in plan)


def test_no_plan_is_worse_than_best_fit():
    rng, better = random.Random(1), 0
    for _ in range(100):
        capacity = rng.choice([20, 100, 4096])
        low = rng.randint(1, capacity // 2)
        items = [rng.randint(low, rng.randint(low, capacity)) for _ in range(rng.randint(1, 800))]
        plain = plain_best_fit(items, capacity)
        assert sequences(packing.best_fit(Counter(items), capacity), items, capacity) == plain
        told = sequences(packing.plan(Counter(items), capacity, 5_000), items, capacity)
        assert packing.least_sequences(Counter(items), capacity) <= told <= plain
        better += told < plain
    assert better > 5


def best_bins(items, capacity):
    """Fewest bins, by trying every bin for every item."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in sorted(set(range(len(bins))), key=lambda b: bins[b]):
            if bins[k] + items[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plans_reach_the_optimum_of_small_cases(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
    plan = packing.plan(Counter(items), 20)
    used = Counter()
    for pattern, times in plan:
        assert sum(x * m for x, m in pattern) <= 20
        for x, m in pattern:
            used[x] += m * times
    assert used == Counter(items)
    assert sum(t for _, t in plan) == best_bins(items, 20)


def test_the_search_goes_on_to_the_bound():
    rng = random.Random(65)
    counts = Counter(rng.randint(5, 60) for _ in range(24))
    first, told = packing.plan(counts, 100, 0), packing.plan(counts, 100)
    assert sum(t for _, t in told) == -(-sum(x * n for x, n in counts.items()) // 100) < sum(t for _, t in first)


def test_the_search_beats_best_fit_where_it_can():
    rng = random.Random(65)
    items = [rng.randint(17, 69) for _ in range(1_500)]
    assert sequences(packing.plan(Counter(items), 100), items, 100) < plain_best_fit(items, 100)


def test_a_hot_length_is_one_pattern():
    plan = packing.plan({300: 1_000_000, 4096: 7, 1: 3}, 4096)
    assert len(plan) <= 4 and sum(t for _, t in plan) == 7 + -(-1_000_000 // 13)


# ---- Elias-Fano and language model ----


def test_sequences_give_back_what_they_hold():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (500, 600), (500, 1 << 40)):
        v = np.sort(rng.integers(0, universe, n))
        s = elias_fano.Sequence(elias_fano.monotone("x", v, universe), "x")
        assert (s.value(np.arange(n)) == v).all()
        if n:
            u = np.unique(v)
            s = elias_fano.Sequence(elias_fano.monotone("x", u, universe), "x")
            width = np.uint64(s.width)
            ask = np.concatenate([u, rng.integers(0, universe, 300)])
            got = s.find((ask.astype(np.uint64) >> width).astype(np.int64), ask.astype(np.uint64) & ((np.uint64(1) << width) - np.uint64(1)))
            for a, g in zip(ask.tolist(), got.tolist(), strict=True):
                assert (u[g] == a) if g >= 0 else a not in u


def test_long_buckets():
    bucket = np.repeat([3, 4], [200, 5])
    s = elias_fano.Sequence(elias_fano.Sequence.build("x", bucket, np.concatenate([np.arange(200), np.arange(5)]), 8, 9), "x")
    assert [b.tolist() for b in s.bounds(np.array([2, 3, 4, 5]))] == [[0, 0, 200, 205], [0, 200, 205, 205]]


TEXTS = [(1, "The cat sat. the cat ran"), (2, None), (3, ""), (4, "the\x0bcat\x0csat\ton\r the mat"), (5, "É é x"), (5, "the cat sat on the mat"), (7, "word " * 20_000), (8, " the cat sat "), (9, "unseen things")]


def plain_scores(rows, train, order_discounts):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lm_score.LOWER_BYTES)) + [b"\n"]
    c1 = Counter(w for t in train for w in words(t))
    return c1, sum(c1.values()), words


def test_model_counts_and_probabilities(spark):
    df = spark.createDataFrame([(i, t, "e") for i, t in TEXTS], "doc_id long, text string, score string").repartition(2)
    train = [t for i, t in TEXTS if i < 9]
    model = lm_score.fit(df.where("doc_id < 9"), min_count=2)
    told = lm_score.log_scores(model, df).collect()
    c1, n, words = plain_scores(TEXTS, train, None)
    assert (model.total, model.distinct) == (n, len(c1))
    for i, t in TEXTS:
        w = words(t)
        base = sum(math.log10((c1[x] + 1) / (n + len(c1) + 1)) for x in w)
        assert any(r.doc_id == i and r.n_tokens == len(w) and r.n_known == sum(c1[x] > 0 for x in w) and math.isclose(r.base_score, base) and r.score < 0 for r in told)
    by = {r.doc_id: r.score / r.n_tokens for r in told}
    assert by[8] > by[9]
    # all continuations of a context sum to no more than 1, and nearly to 1
    vocab = [x for x in c1 if x != b"\n"]
    ask = spark.createDataFrame([(k, "the cat " + x.decode()) for k, x in enumerate(vocab)], "doc_id long, text string")
    prefix = lm_score.log_scores(model, spark.createDataFrame([(0, "the cat")], "doc_id long, text string")).first().score
    both = {r.doc_id: r.score for r in lm_score.log_scores(model, ask).collect()}
    ends = 0.0
    for k in both:
        ends += 10 ** both[k]
    assert ends < 10**prefix * 40
    assert lm_score.log_scores(model, df.limit(0)).count() == 0
    empty = lm_score.fit(df.limit(0), min_count=2)
    assert empty.total == 0 and all(r.score == r.base_score == 0 and r.n_known == 0 for r in lm_score.log_scores(empty, df).collect())


def test_n_grams_seen_once_count_under_one_discount(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 12) if x < 400) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm_score.fit(df, min_count=1)
    grams = {k: Counter() for k in (1, 2, 3)}
    for t in texts:
        w = ["\n", *t.split(), "\n"]
        grams[1].update((x,) for x in w[1:])
        for k in (2, 3):
            grams[k].update(zip(*(w[i:] for i in range(k)), strict=False))
    for k in (2, 3):
        assert sum(level["items"].n for s in range(1 << model.bits) if (level := model.level(k, s))) == len(grams[k])
    d = {k: min(max((one := sum(c == 1 for c in g.values())) / (one + 2 * sum(c == 2 for c in g.values())), 0.1), 0.95) for k, g in grams.items()}
    total, many = ({k: Counter() for k in (2, 3)} for _ in range(2))
    for k in (2, 3):
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            many[k][g[:-1]] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    ask = [*texts[:20], "w1 w2 w399 w1 unseen w1 w2", "w3 w1"]
    told = {r.doc_id: r.score for r in lm_score.log_scores(model, spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string")).collect()}
    for i, t in enumerate(ask):
        w, score = ["\n", *t.split(), "\n"], 0.0
        for j in range(1, len(w)):
            p = max(grams[1][w[j],] - d[1], 0) / n + d[1] * v / n / (v + 1)
            for k in (2, 3):
                if j >= k - 1 and (of := total[k][tuple(w[j - k + 1 : j])]):
                    c = tuple(w[j - k + 1 : j])
                    p = max(grams[k][*c, w[j]] - d[k], 0) / of + d[k] * many[k][c] / of * p
            score += math.log10(p)
        assert -1e-6 <= score - told[i] <= 2.01 * lm_score.STEP * (len(w) - 1)


def test_the_query_keeps_n_grams_seen_once(spark, monkeypatch):
    models, fit = [], lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    lm_score.op9_trie_lm(spark, BIG).count()
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(lm_score.LOWER_BYTES)), b"\n"]
    train = [words(r.text or "") for r in lm_score.table(spark, BIG, "documents").where(~lm_score.held_out(F.col("doc_id"), folds=7)).select("text").collect()]
    for k in (2, 3):
        kept = sum(level["items"].n for s in range(1 << models[0].bits) if (level := models[0].level(k, s)))
        assert kept == len({g for w in train for g in zip(*([b"\n", *w][i:] for i in range(k)), strict=False)})


def thue_morse(n):
    return bytes(b"ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("size", [128, 255, 256, 1024, 4096])
def test_words_that_polynomials_confuse_are_told_apart(spark, size):
    a = thue_morse(size).decode()
    b = a.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, f"{a} {a} x"), (2, f"{b} x"), (3, f"{a.upper()} {b}")], "doc_id long, text string")
    model = lm_score.fit(df.where("doc_id < 2"))
    told = {r.doc_id: r for r in lm_score.log_scores(model, df).collect()}
    assert (model.total, model.distinct) == (4, 3)
    assert [told[i].n_known for i in (1, 2, 3)] == [4, 2, 2]
    want = [math.log10((c + 1) / (4 + 3 + 1)) for c in (2, 0, 1)]
    assert math.isclose(told[3].base_score, sum(want))
    assert lm_score.fit(df).distinct == 4


def test_a_second_hash_tells_words_of_one_first_hash_apart(spark, monkeypatch):
    """With a first hash that keeps four bits only, the fit starts anew, and a word that only agrees there is unknown."""
    whole = lm_score.Hasher.__call__

    def weak(self, data, begin, end):
        first, second = whole(self, data, begin, end)
        return [first >> np.uint64(60) << np.uint64(60) if self.salt == bytes(4) else first, second]

    monkeypatch.setattr(lm_score.Hasher, "__call__", weak)
    hashing = lm_score.Hasher(0)
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(40))]
    first, second, _ = lm_score.token_hashes(pa.array([t.encode() for t in texts], pa.binary()), hashing)
    keys, counts, _, clash = lm_score._add_up([lm_score._pack(np.sort(first), np.ones(len(first)), second[np.argsort(first)])], checked=True)
    assert clash and len(keys) <= 17 and counts.sum() == 41
    assert not lm_score._add_up([lm_score._pack(np.arange(3, dtype=np.uint64), np.ones(3), np.arange(3, dtype=np.uint64))] * 2, checked=True)[3]


def test_held_out_texts_score_above_the_base(spark):
    rows = lm_score.op9_trie_lm(spark, BIG).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_files_are_whole(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint16), "b": np.zeros(0), "c": np.arange(3.0)}
    elias_fano.write_arrays(str(tmp_path / "x"), arrays)
    assert os.listdir(tmp_path) == ["x"]
    back = elias_fano.map_arrays(str(tmp_path / "x"))
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())


def by_trying_all(items, capacity):
    """The least number of sequences, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            j = bins.index(room)
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plans_of_few_pieces_are_optimal_and_bounds_hold():
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.choice([10, 20, 41])
        items = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(max(1, capacity // 3 - 2), capacity // 3 + 3) for _ in range(rng.randint(1, 9))]
        least = by_trying_all(items, capacity)
        assert packing.least_sequences(Counter(items), capacity) <= least
        assert sequences(packing.plan(Counter(items), capacity), items, capacity) == least


@pytest.mark.parametrize("seed", range(3))
def test_dense_lengths_take_fewer_sequences_than_best_fit(seed):
    """Two or three pieces a sequence: best fit uses up the short ones beside long ones."""
    rng = random.Random(seed)
    items = [rng.randint(1300, 1500) for _ in range(3000)]
    counts = Counter(items)
    told = sequences(packing.plan(counts, 4096), items, 4096)
    assert told <= 1210 and told <= 1.02 * packing.least_sequences(counts, 4096)
    assert told < sum(t for _, t in packing.best_fit(counts, 4096))
