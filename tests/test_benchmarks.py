"""Converters of benchmarks on rows whose outcome was worked out by hand, one for each branch."""

import pytest
from pyspark.sql import functions as F

from askwright.operators import convert as C

from .conftest import canonical


def _told(rows):
    return rows.select("id", "type", "state", "instructions", F.coalesce(F.array_join("criteria", "|"), F.lit("")).alias("criteria"), "label", "split")


def convert_mmbench(spark):
    rows = [(1, "What is it?", "nan", "a", "b", "c", None, "B"), (2, "Where? ", "Look up.", "x", "y", "nan", "", "A"), (3, "Who?", None, "only", None, None, None, "A"), (4, "Bad", None, "a", "b", None, None, "E")]
    df = spark.createDataFrame(rows, "index int, question string, hint string, A string, B string, C string, D string, answer string")
    return _told(C.mmbench(df))


def convert_mmstar(spark):
    rows = [(1, "What is it?\nOptions: A: a cat, B: a dog, C: a bird", "B"), (2, "Pick.\nChoices:\n(A) one\n(B) two", "A"), (3, "None here", "A"), (4, "Odd.\nOptions: B: x, C: y", "B")]
    return _told(C.mmstar(spark.createDataFrame(rows, "index int, question string, answer string")))


def convert_mme(spark):
    rows = [("q1", "Is it red? Please answer yes or no.", "Yes", "color", "i1"), ("q2", "Is it blue? Please answer yes or no.", "No", "color", "i1"), ("q3", "How many?", "3", "count", "i2")]
    df = spark.createDataFrame(rows, "question_id string, question string, answer string, category string, image string")
    return C.mme(df).select("id", "instructions", "label", "grp")


def convert_options(spark):
    """Converters of listed options: a row of each."""
    s = spark.createDataFrame
    out = C.seed_bench(s([("s1", "Q1", "a", "b", "c", "d", "C"), ("s2", "Q2", "a", "a", "c", "d", "C")], "id string, question string, choice_a string, choice_b string, choice_c string, choice_d string, answer string"))
    out = out.unionByName(C.airbench(s([("a1", "Q3", "x", "y", None, None, "y"), ("a2", "Q4", "x", "y", None, None, "z")], "id string, question string, choice_a string, choice_b string, choice_c string, choice_d string, answer_gt string")))
    out = out.unionByName(C.omnibench(s([("o1", "Q5", ["l", "m", "n"], "n")], "id string, question string, options array<string>, answer string")))
    out = out.unionByName(C.mmau(s([("m1", "Q6", '["p", "q"]', "q"), ("m2", "Q7", "p, q", "q")], "id string, question string, choices string, answer string")))
    out = out.unionByName(C.aokvqa(s([("k1", "Q8", ["u", "v"], 0, "train")], "id string, question string, choices array<string>, correct_choice_idx int, split string")))
    out = out.unionByName(C.scienceqa(s([("n1", "Q9", ["u", "v"], 1, " a hint ", "test")], "id string, question string, choices array<string>, answer int, hint string, split string")))
    out = out.unionByName(C.chat_targets(s([("v1", '[{"content": [{"text": "Q10"}]}]', '{"no": 0.2, "yes": 0.8}')], "id string, messages string, targets string")))
    return _told(out)


def convert_yes_no(spark):
    s = spark.createDataFrame
    out = C.pope(s([("p1", "Is there a cup?", "yes"), ("p2", "Is there a cat?", " No "), ("p3", "Is it?", "maybe")], "id string, question string, answer string"))
    return _told(out.unionByName(C.clothoaqa(s([("c1", "Is it loud?", "YES", "train")], "id string, question string, answer string, split string"))))


WANT = {
    convert_mmbench: """SELECT * FROM (VALUES ('1', 'choice', 'Image.', 'What is it?', 'a|b|c', 1, 'test'), ('1', 'choice', 'Image.', 'What is it?', 'b|c|a', 0, 'test'), ('1', 'choice', 'Image.', 'What is it?', 'c|a|b', 2, 'test'),
('2', 'choice', 'Image. Look up.', 'Where?', 'x|y', 0, 'test'), ('2', 'choice', 'Image. Look up.', 'Where?', 'y|x', 1, 'test')) v(id, type, state, instructions, criteria, label, split)""",
    convert_mmstar: "SELECT * FROM (VALUES ('1', 'choice', 'Image.', 'What is it?', 'a cat|a dog|a bird', 1, 'test'), ('2', 'choice', 'Image.', 'Pick.', 'one|two', 0, 'test')) v(id, type, state, instructions, criteria, label, split)",
    convert_mme: "SELECT * FROM (VALUES ('q1', 'Is it red?', 1, 'color/i1'), ('q2', 'Is it blue?', 0, 'color/i1')) v(id, instructions, label, grp)",
    convert_options: """SELECT id, 'choice' AS type, state, 'Q' || q AS instructions, criteria, label, split FROM (VALUES ('s1', 'Image.', 1, 'a|b|c|d', 2, 'test'), ('a1', 'Audio clip.', 3, 'x|y', 1, 'test'), ('o1', 'Image and audio clip.', 5, 'l|m|n', 2, 'test'),
('m1', 'Audio clip.', 6, 'p|q', 1, 'test'), ('k1', 'Photo.', 8, 'u|v', 0, 'train'), ('n1', 'a hint', 9, 'u|v', 1, 'test'), ('v1', 'Image.', 10, 'no|yes', 1, 'test')) v(id, state, q, criteria, label, split)""",
    convert_yes_no: "SELECT id, 'noul' AS type, state, q AS instructions, '' AS criteria, label, split FROM (VALUES ('p1', 'Image.', 'Is there a cup?', 1, 'test'), ('p2', 'Image.', 'Is there a cat?', 0, 'test'), ('c1', 'Audio clip.', 'Is it loud?', 1, 'train')) v(id, state, q, label, split)",
}


@pytest.mark.parametrize("convert", WANT, ids=lambda f: f.__name__)
def test_rows(spark, duck, convert):
    df, want = convert(spark), duck.sql(WANT[convert])
    assert canonical(df.columns, df.collect()) == canonical(want.columns, want.fetchall())
