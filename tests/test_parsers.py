"""The parsers and the rule cascade on turns whose outcome was worked out by hand, one for each branch."""

import pytest
from pyspark.sql import functions as F

from askwright.functions import text as T
from askwright.operators import questions as Q

from .conftest import canonical

#: id, user, assistant: a turn for each branch of the rules.
TURNS = [
    (1, "Which animal is it?\nChoices:\nA. A cat.\nB. A dog\nC. A bird.\nAnswer with the letter.", "Answer: B"),
    (2, "Question: What melts?\nHint: Ice is cold.\nChoices:\nA. ice\nB. rock\n", "A"),
    (3, "Lecture: Things fall.\nQuestion: Is it heavy?\nChoices:\nA. no\nB. yes\nPick one.", "b"),
    (4, "What colour is the sky?\nOptions: Blue, red , green.", "Answer: blue."),
    (5, "Is the cat asleep?\nAnswer yes or no.", "Yes."),
    (6, "How many birds are there?\nKeep it brief.", "3"),
    (7, "What is shown here?", "A small dog runs over the wet green grass."),
    (8, "What is the color of the car?", "silver"),
    (9, "What is the color of the door?", "brown"),
    (10, "What is the color of the wall?", "white"),
    (11, "What is the color of the hat?", "black"),
    (12, "Which way?\nChoices:\nA. left\nB. left", "A"),
    (13, "Name it.\nOptions: one, two", "three"),
    (14, "", "nothing"),
    (15, "Context: none\nQuestion: When was it built?\nContext: A tower.", "1,950"),
    (16, "Where is the odd one?", "under the old table"),
]


def _rows(columns, *rows):
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


WANT = {
    "parse_lettered": _rows("id, background, question, options, index", "(1, '', 'Which animal is it?', 'A cat|A dog|A bird', 1)", "(2, 'Hint: Ice is cold.', 'What melts?', 'ice|rock', 0)", "(3, 'Lecture: Things fall.', 'Is it heavy?', 'no|yes', 1)"),
    "parse_listed": _rows("id, question, options, index", "(4, 'What colour is the sky?', 'Blue|red|green', 0)"),
    "strip_hints": r"""SELECT * FROM (VALUES (1, e'Which animal is it?'),
(2, e'Question: What melts?\nHint: Ice is cold.'),
(3, e'Lecture: Things fall.\nQuestion: Is it heavy?'),
(4, e'What colour is the sky?'),
(5, e'Is the cat asleep?'),
(6, e'How many birds are there?'),
(7, e'What is shown here?'),
(8, e'What is the color of the car?'),
(9, e'What is the color of the door?'),
(10, e'What is the color of the wall?'),
(11, e'What is the color of the hat?'),
(12, e'Which way?'),
(13, e'Name it.'),
(14, e''),
(15, e'Context: none\nQuestion: When was it built?\nContext: A tower.'),
(16, e'Where is the odd one?')) v(id, question)""",
    "split_context": r"""SELECT * FROM (VALUES (1, e'', e'Which animal is it?\nChoices:\nA. A cat.\nB. A dog\nC. A bird.\nAnswer with the letter.'),
(2, e'Hint: Ice is cold.\nChoices:\nA. ice\nB. rock', e'What melts?'),
(3, e'Lecture: Things fall.', e'Is it heavy?\nChoices:\nA. no\nB. yes\nPick one.'),
(4, e'', e'What colour is the sky?\nOptions: Blue, red , green.'),
(5, e'', e'Is the cat asleep?\nAnswer yes or no.'),
(6, e'', e'How many birds are there?\nKeep it brief.'),
(7, e'', e'What is shown here?'),
(8, e'', e'What is the color of the car?'),
(9, e'', e'What is the color of the door?'),
(10, e'', e'What is the color of the wall?'),
(11, e'', e'What is the color of the hat?'),
(12, e'', e'Which way?\nChoices:\nA. left\nB. left'),
(13, e'', e'Name it.\nOptions: one, two'),
(14, e'', e''),
(15, e'Context: A tower.\nContext: none', e'When was it built?'),
(16, e'', e'Where is the odd one?')) v(id, background, question)""",
    "turn_cascade": _rows(
        "id, rule, type, state, instructions, answer",
        "(1, 'options', 'choice', 'Image.', 'Which animal is it?', 'A dog')", "(2, 'options', 'choice', 'Hint: Ice is cold.', 'What melts?', 'ice')", "(3, 'options', 'noul', 'Lecture: Things fall.', 'Is it heavy?', '1')",
        "(4, 'options', 'choice', 'Image.', 'What colour is the sky?', 'Blue')", "(5, 'yes_no', 'noul', 'Image.', 'Is the cat asleep?', '1')", "(6, 'number', 'choice', 'Image.', 'How many birds are there?', '3')",
        "(7, 'description', 'noul', 'Image.', 'Does this description match the image? \"A small dog runs over the wet green grass\"', '1')", "(8, 'pool', 'choice', 'Image.', 'What is the color of the car?', 'silver')",
        "(9, 'pool', 'choice', 'Image.', 'What is the color of the door?', 'brown')", "(10, 'pool', 'choice', 'Image.', 'What is the color of the wall?', 'white')", "(11, 'pool', 'choice', 'Image.', 'What is the color of the hat?', 'black')",
        "(15, 'number', 'choice', e'Context: A tower.\\nContext: none', 'When was it built?', '1950')",
    ),  # fmt: skip,
}


def told(spark, name):
    rows = spark.createDataFrame(TURNS, "id int, user string, assistant string")
    user, answer = F.col("user"), F.col("assistant")
    if name == "parse_lettered":
        return rows.select("id", T.lettered(user, answer).alias("p")).where("p is not null").select("id", "p.background", "p.question", F.array_join("p.options", "|").alias("options"), "p.index")
    if name == "parse_listed":
        return rows.select("id", T.listed(user, answer).alias("p")).where("p is not null").select("id", "p.question", F.array_join("p.options", "|").alias("options"), "p.index")
    if name == "strip_hints":
        return rows.select("id", T.without_hints(user).alias("question"))
    if name == "split_context":
        return rows.select("id", T.context_and_question(user).alias("p")).select("id", "p.background", "p.question")
    done = Q.cascade(rows)
    return done.select("id", "rule", "type", "state", "instructions", F.when(F.size("criteria") > 0, F.get("criteria", F.col("label"))).otherwise(F.col("label").cast("string")).alias("answer"))


@pytest.mark.parametrize("name", sorted(WANT))
def test_turns(spark, duck, name):
    df, want = told(spark, name), duck.sql(WANT[name])
    assert canonical(df.columns, df.collect()) == canonical(want.columns, want.fetchall())
