"""Captions drawn for captions against the definition, for clips with one caption and with several."""

import hashlib
import random
import re

import pytest

from askwright.functions import text as T
from askwright.operators import convert as C
from askwright.operators import joins as J


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def by_hand(rows, seed):
    told = {(c, t) for c, t in rows if c is not None and t is not None}
    words = {t: {w for w in re.findall("[a-z]+", t.lower()) if len(w) > 3 and w not in T.STOP_WORDS} for _, t in told}
    place = lambda t: (int(md5(md5(t))[:4], 16) % 64, md5(t))
    pool = {}
    for t, ws in words.items():
        for w in ws:
            pool.setdefault(w, []).append(t)
    out = []
    for clip, text in told:
        own = {t for c, t in told if c == clip}
        for w in sorted(words[text], key=lambda w: md5(f"{seed}-word", clip, md5(text), w)):
            others = sorted((t for t in pool[w] if t not in own), key=place)
            if others:
                out.append((clip, text, others[int(md5(seed, 0, clip, md5(text))[:12], 16) % len(others)]))
                break
    return sorted(out)


@pytest.mark.parametrize("several", [0.0, 0.3])
def test_word_negatives(spark, several):
    rng = random.Random(4)
    vocab = ["water", "rain", "birds", "singing", "loudly", "the", "a", "Über", "traffic", "engine", "unique"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(vocab, k=rng.randrange(0, 5))) + (f" only{chr(97 + i % 26) * 4}" if i % 9 == 0 else "")
        rows.append((i if rng.random() >= several else i // 4, text))
    rows += [rows[0], (None, "water rain"), (500, None), (501, "water " * 20_000)]
    df = spark.createDataFrame([(*r, "word") for r in rows], "clip int, caption string, word string").repartition(4)
    told = sorted(map(tuple, J.word_negatives(df, "s").collect()))
    assert told == by_hand(rows, "s")
    assert all(t != n for _, t, n in told)


def test_no_captions(spark):
    df = spark.createDataFrame([], "clip int, caption string")
    assert J.word_negatives(df, "s").count() == 0


def test_words_are_looked_up_in_parts_of_few_texts(spark, monkeypatch):
    """Parts of one text or two: the place of a word's caption goes on over parts."""
    plain = J.drawn_by_word
    monkeypatch.setattr(J, "drawn_by_word", lambda *a, **kw: plain(*a, most=1, **kw))
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["water", "rain", "birds", "engine", "the"], k=3)) + f" {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "clip int, caption string").repartition(3)
    assert sorted(map(tuple, J.word_negatives(df, "s").collect())) == by_hand(rows, "s")


def test_words_are_drawn_for_near_negatives_only(spark, monkeypatch):
    """Words are drawn for the draws that a row needs and that a coin makes near, not for four of each row."""
    plain, kept = J.settled, []
    monkeypatch.setattr(J, "settled", lambda df, kind="table": (kept.append((kind, plain(df, kind))), kept[-1][1])[1])
    rows = [(f"c{i}", f"the dog barks at thing {chr(97 + i % 26) * 4}{i}", "train") for i in range(60)]
    told = C.captioned(spark.createDataFrame(rows, "id string, caption string, split string"), "s", "split", "x")
    assert told.where("type = 'choice'").count() == 60
    whole = lambda seed, row, n: int(md5(seed, row)[:8], 16) % n
    near = set()
    for clip, text, split in rows:
        own = md5(split, " ".join(re.findall("[a-z0-9]+", text.lower())))
        row = f"{clip}:{own}"
        needed = ([] if int(md5("x-coin", row)[:8], 16) < 2**31 else [0]) + list(range(1, whole("x-many", row, 3) + 2))
        near |= {(clip, own, i) for i in needed if whole("x-near", f"{i}:{row}", 2) == 0}
    drawn = [tuple(r) for k, df in kept if k == "drawn-words" for r in df.select("clip", "__own", "draw").collect()]
    assert sorted(drawn) == sorted(near)


def test_texts_are_whole_after_they_were_small(spark):
    rows = [(i, [(d, f"Über {'x' * i} {d}") for d in range(i % 4)]) for i in range(300)]
    df = spark.createDataFrame([(i, d, t) for i, x in rows for d, t in x], "id int, draw int, text string")
    lists = C._told_small(df, "text").groupBy("id").agg(C.F.array_sort(C.F.collect_list(C.F.struct("draw", "text"))).alias("x"))
    assert sorted((r.id, [tuple(y) for y in r.x]) for r in C._told_whole(lists, "x", "text").collect()) == [r for r in rows if r[1]]
