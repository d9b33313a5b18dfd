"""Queries over the text parsers.  What they parse is made from documents by templates, and the SQL makes what should come out."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import text as T
from ..operators import questions as Q
from ..session import table

#: A turn for each branch of the rules; {a}, {b} and {c} are a document's number, language and source.
TURNS = [
    ("Which {c} is it?\nChoices:\nA. {a}.\nB. {b}\nC. {c}.\nAnswer with the letter.", "Answer: B"),
    ("Question: What melts {a}?\nHint: {c} is cold.\nChoices:\nA. {b}\nB. rock\n", "A"),
    ("Lecture: {c} falls.\nQuestion: Is {a} heavy?\nChoices:\nA. no\nB. yes\nPick one.", "b"),
    ("What colour is {c}?\nOptions: Blue, {a} , {b}.", "Answer: {a}."),
    ("Is {c} asleep?\nAnswer yes or no.", "Yes."),
    ("How many {c} are there?\nKeep it brief.", "3"),
    ("Which way?\nChoices:\nA. {a}\nB. {a}", "A"),
    ("Name it.\nOptions: {a}, {b}", "three"),
    ("", "nothing"),
    ("Context: none\nQuestion: When was {a} built?\nContext: A {c}.", "1,950"),
]


def filled(spark, sf_dir, *templates: list[str]):
    """Every document's number (id), with a text of each list of templates by the number, filled with the document's values."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")

    def text(template: str):
        for name, value in (("{a}", F.concat(F.lit("item "), n.cast("string"))), ("{b}", F.col("lang")), ("{c}", F.col("source"))):
            template = F.replace(F.lit(template) if isinstance(template, str) else template, F.lit(name), value)
        return template

    def chosen(of: list[str]):
        told = F.lit(None).cast("string")
        for i, t in enumerate(of):
            told = F.when(n % len(of) == i, text(t) if t is not None else F.lit(None)).otherwise(told)
        return told

    return d.select(n.alias("id"), *[chosen(t).alias(f"t{i}") for i, t in enumerate(templates)])


def turns(spark, sf_dir):
    return filled(spark, sf_dir, [u for u, _ in TURNS], [v for _, v in TURNS]).withColumnsRenamed({"t0": "user", "t1": "assistant"})


def paired_turns(spark, sf_dir):
    """User turns with the assistant's next turn."""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant"))
    return c.where("role = 'user'").join(answers, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("user"), "assistant")


def parse_lettered(spark, sf_dir):
    return turns(spark, sf_dir).select("id", T.lettered(F.col("user"), F.col("assistant")).alias("p")).where("p is not null").select("id", "p.background", "p.question", F.array_join("p.options", "|").alias("options"), "p.index")


def parse_listed(spark, sf_dir):
    return turns(spark, sf_dir).select("id", T.listed(F.col("user"), F.col("assistant")).alias("p")).where("p is not null").select("id", "p.question", F.array_join("p.options", "|").alias("options"), "p.index")


def split_context(spark, sf_dir):
    return turns(spark, sf_dir).select("id", T.context_and_question(F.col("user")).alias("p")).select("id", "p.background", "p.question")


def strip_hints(spark, sf_dir):
    return turns(spark, sf_dir).select("id", T.without_hints(F.col("user")).alias("question"))


def clean_answers(spark, sf_dir):
    return paired_turns(spark, sf_dir).select("id", T.clean_answer(F.col("assistant")).alias("answer"))


def question_kinds(spark, sf_dir):
    kinds = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.posexplode(T.question_kinds(F.col("text"))).alias("rank", "kind"))
    return kinds.groupBy("rank", "kind").agg(F.count(F.lit(1)).alias("n"))


def normalised_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


def content_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.content_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_captions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.captions(F.col("text"))).alias("at", "caption"))


ALTERNATIVES = [("Is the {c} blue or gray?", "gray"), ("Is the {c} light blue or dark red?", "dark red"), ("Is the {c} to the left or to the right of the {b}?", "right"), ("Is it {b} or small?", "huge"), ("Is it {b} or {b}?", "{b}"), ("Is it {c}?", "{c}"), ("Do you see the {c} or a {b}?", "{b}")]


def alternatives(spark, sf_dir):
    told = filled(spark, sf_dir, [q for q, _ in ALTERNATIVES], [v for _, v in ALTERNATIVES]).select("id", T.alternatives(F.col("t0"), F.col("t1")).alias("a"))
    return told.where("a is not null").select("id", F.array_join("a", "|").alias("options"))


def numbers(spark, sf_dir):
    """Lengths of documents as text: with commas, plain, halved, in thousand millions, as words, empty."""
    n = F.col("n_chars") * 7
    text = F.element_at(F.array(F.format_number(n, 0), n.cast("string"), F.format_string("%.1f", n / 2), F.concat(n.cast("string"), F.lit("e9")), F.concat(F.lit("n"), n.cast("string")), F.lit("inf"), F.lit("nan"), F.lit("")), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.number(text).alias("value"))


def number_options(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return p.select("p_partkey", F.array_join(F.transform(T.near_numbers(F.col("v")), lambda x: F.round(x, 2).cast("double").cast("decimal(18,2)").cast("string")), " ").alias("near"))


def null_like_filter(spark, sf_dir):
    return filled(spark, sf_dir, [None, "nan", " None ", "", "0", "{c}", " \t", "NaN", "none of {b}"]).where(~T.null_like(F.col("t0"))).select("id")


def humanised_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.humanise(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))).alias("label"))


def answer_requests(spark, sf_dir):
    asks = ["Is it {c}? Please answer yes or no.", "What is {a}? please answer this question with one word", "Please answer yes or no. Is it {b}?", " Is it {c}? "]
    return filled(spark, sf_dir, asks).select("id", T.without_answer_request(F.col("t0")).alias("q"))


def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return p.select("page_id", T.extension(F.col("path")).alias("ext"), F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("parent"))


def turn_cascade(spark, sf_dir):
    told = Q.cascade(turns(spark, sf_dir))
    return told.select("id", "rule", "type", "state", "instructions", F.when(F.size("criteria") > 0, F.get("criteria", F.col("label"))).otherwise(F.col("label").cast("string")).alias("answer"))


def turn_cascade_pairs(spark, sf_dir):
    told = Q.cascade(paired_turns(spark, sf_dir))
    return told.groupBy("rule", "type").agg(F.count(F.lit(1)).alias("n"))


def pool_collect(spark, sf_dir):
    rows = Q.pools(turns(spark, sf_dir).drop("id").unionByName(paired_turns(spark, sf_dir).drop("id")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def pool_fallback(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lit("what is"), F.regexp_replace("p_type", "[0-9]+", "")).alias("question"), F.col("p_name").alias("answer"))
    q = q.withColumn("kinds", T.question_kinds(F.col("question")))
    pool = q.select(F.explode(F.array_distinct("kinds")).alias("kind"), "answer").distinct()
    return Q.drawn_pool(q.select("id", "answer", "kinds"), pool, "id", "pool").select("id", "kind", F.array_join("wrong", "|").alias("wrong"))


def finetune_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".WAV").when(F.col("doc_id") % 3 == 1, ".jpg").otherwise(".txt")).alias("file"), F.col("lang").alias("label"))
    return Q.examples_to_rows(d, "Which language?").select("file", "media", "instructions", "state", "type", "label")


_USER_TURNS = "(SELECT u.conv_id || '-' || u.turn AS id, u.text AS \"user\", a.text AS assistant FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_CLEAN = r"regexp_replace(trim(split_part(regexp_replace(trim({0}, e' \t\n\r'), '(?i)^answer:\s*', ''), e'\n', 1), e' \t\n\r'), '\.+$', '')"
_NEAR_SQL = """CASE WHEN v = floor(v) AND abs(v) <= 20 THEN list_filter(list_transform(range(-4, 5), lambda d: v + d), lambda x: x <> v AND x >= 0)
ELSE list_filter(list_sort(list_distinct(list_transform([0.5, 0.75, 0.9, 1.1, 1.25, 1.5, 2.0], lambda s: CASE WHEN v = floor(v) THEN round(v * CAST(s AS DOUBLE), 0) ELSE round(v * CAST(s AS DOUBLE), 2) END))), lambda x: x <> v) END"""


_DOC = "doc AS (SELECT doc_id AS id, 'item ' || doc_id AS a, lang AS b, source AS c, doc_id % 10 AS k FROM documents)"


_KIND = "array_to_string(regexp_extract_all(lower({0}), '[a-z]+')[1:{1}], ' ')"
_STRIP = r"trim({0}, e' \t\n\r')"
ORACLE = {
    # lookbehind and lookahead as a mark put between what stands on either side
    "split_captions": rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({_STRIP.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), '([a-z])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
c AS (SELECT doc_id, list_transform(list_filter(p, lambda x: len(regexp_extract_all(x, '\S+')) >= 4), lambda x: regexp_replace({_STRIP.format('x')}, '\.+$', '')) AS c FROM p)
SELECT doc_id, CAST(i - 1 AS INT) AS at, c[i] AS caption FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)""",
    "pool_collect": f"""WITH {_DOC}, q AS (SELECT CASE k WHEN 0 THEN 'Which ' || c || ' is it?' WHEN 1 THEN 'What melts ' || a || '?' WHEN 2 THEN 'Is ' || a || ' heavy?' WHEN 3 THEN 'What colour is ' || c || '?' WHEN 4 THEN 'Is ' || c || ' asleep?' WHEN 5 THEN 'How many ' || c || ' are there?'
WHEN 6 THEN 'Which way?' WHEN 7 THEN 'Name it.' WHEN 8 THEN '' ELSE 'When was ' || a || ' built?' END AS question, CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'b' WHEN 3 THEN a WHEN 4 THEN 'Yes' WHEN 5 THEN '3' WHEN 6 THEN 'A' WHEN 7 THEN 'three' WHEN 8 THEN 'nothing' ELSE '1,950' END AS answer FROM doc
UNION ALL SELECT "user", {_CLEAN.format('assistant')} FROM {_USER_TURNS}),
k AS (SELECT answer, unnest([{_KIND.format('question', 4)}, {_KIND.format('question', 3)}, {_KIND.format('question', 2)}]) AS kind FROM q WHERE len(regexp_extract_all(answer, '\\S+')) BETWEEN 1 AND 5)
SELECT kind, count(DISTINCT answer) AS n FROM k GROUP BY kind""",
    "parse_lettered": f"""WITH {_DOC} SELECT id, CASE k WHEN 1 THEN 'Hint: ' || c || ' is cold.' WHEN 2 THEN 'Lecture: ' || c || ' falls.' ELSE '' END AS background, CASE k WHEN 0 THEN 'Which ' || c || ' is it?' WHEN 1 THEN 'What melts ' || a || '?' ELSE 'Is ' || a || ' heavy?' END AS question,
CASE k WHEN 0 THEN a || '|' || b || '|' || c WHEN 1 THEN b || '|rock' ELSE 'no|yes' END AS options, CAST(k <> 1 AS INT) AS index FROM doc WHERE k < 3""",
    "parse_listed": f"""WITH {_DOC} SELECT id, 'What colour is ' || c || '?' AS question, 'Blue|' || a || '|' || b AS options, 1 AS index FROM doc WHERE k = 3""",
    "strip_hints": f"""WITH {_DOC} SELECT id, CASE k WHEN 0 THEN 'Which ' || c || ' is it?' WHEN 1 THEN 'Question: What melts ' || a || e'?\\nHint: ' || c || ' is cold.' WHEN 2 THEN 'Lecture: ' || c || e' falls.\\nQuestion: Is ' || a || ' heavy?' WHEN 3 THEN 'What colour is ' || c || '?'
WHEN 4 THEN 'Is ' || c || ' asleep?' WHEN 5 THEN 'How many ' || c || ' are there?' WHEN 6 THEN 'Which way?' WHEN 7 THEN 'Name it.' WHEN 8 THEN '' ELSE e'Context: none\\nQuestion: When was ' || a || e' built?\\nContext: A ' || c || '.' END AS question FROM doc""",
    "split_context": f"""WITH {_DOC} SELECT id, CASE k WHEN 1 THEN 'Hint: ' || c || e' is cold.\\nChoices:\\nA. ' || b || e'\\nB. rock' WHEN 2 THEN 'Lecture: ' || c || ' falls.' WHEN 9 THEN 'Context: A ' || c || e'.\\nContext: none' ELSE '' END AS background,
CASE k WHEN 0 THEN 'Which ' || c || e' is it?\\nChoices:\\nA. ' || a || e'.\\nB. ' || b || e'\\nC. ' || c || e'.\\nAnswer with the letter.' WHEN 1 THEN 'What melts ' || a || '?' WHEN 2 THEN 'Is ' || a || e' heavy?\\nChoices:\\nA. no\\nB. yes\\nPick one.'
WHEN 3 THEN 'What colour is ' || c || e'?\\nOptions: Blue, ' || a || ' , ' || b || '.' WHEN 4 THEN 'Is ' || c || e' asleep?\\nAnswer yes or no.' WHEN 5 THEN 'How many ' || c || e' are there?\\nKeep it brief.' WHEN 6 THEN e'Which way?\\nChoices:\\nA. ' || a || e'\\nB. ' || a
WHEN 7 THEN e'Name it.\\nOptions: ' || a || ', ' || b WHEN 8 THEN '' ELSE 'When was ' || a || ' built?' END AS question FROM doc""",
    "clean_answers": f"SELECT id, {_CLEAN.format('assistant')} AS answer FROM {_USER_TURNS}",
    "question_kinds": f"""SELECT rank, kind, count(*) AS n FROM (SELECT unnest([0, 1, 2]) AS rank, unnest([{_KIND.format('text', 4)}, {_KIND.format('text', 3)}, {_KIND.format('text', 2)}]) AS kind FROM conversations WHERE role = 'user') GROUP BY 1, 2""",
    "normalised_texts": "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents",
    "content_words": f"""SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 3 AND w NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})))) AS word FROM documents) GROUP BY 1""",
    "alternatives": """SELECT id, CASE k WHEN 0 THEN 'blue|gray' WHEN 1 THEN 'light blue|dark red' WHEN 2 THEN 'left|right' ELSE source || '|' || lang END AS options FROM (SELECT doc_id AS id, doc_id % 7 AS k, source, lang FROM documents) WHERE k IN (0, 1, 2, 6)""",
    "numbers": """SELECT doc_id AS id, CASE WHEN doc_id % 8 < 2 THEN CAST(n_chars * 7 AS DOUBLE) WHEN doc_id % 8 = 2 THEN n_chars * 7 / 2.0 END AS value FROM documents""",
    "number_options": f"SELECT p_partkey, array_to_string(list_transform({_NEAR_SQL}, lambda x: CAST(CAST(round(x, 2) AS DECIMAL(18, 2)) AS VARCHAR)), ' ') AS near FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part)",
    "null_like_filter": "SELECT doc_id AS id FROM documents WHERE doc_id % 9 IN (4, 5, 8)",
    "humanised_labels": "SELECT p_partkey, lower(replace(replace(replace(p_type, ' ', '_'), '_and_', ' and '), '_', ' ')) AS label FROM part",
    "answer_requests": """SELECT doc_id AS id, CASE doc_id % 4 WHEN 1 THEN 'What is item ' || doc_id || '?' WHEN 2 THEN 'Please answer yes or no. Is it ' || lang || '?' ELSE 'Is it ' || source || '?' END AS q FROM documents""",
    "path_parts": r"SELECT page_id, lower(regexp_extract(path, '\.[^./]+$', 0)) AS ext, split_part(path, '/', -1) AS name, split_part(path, '/', -2) AS parent FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)",
    "turn_cascade": f"""WITH {_DOC} SELECT id, CASE WHEN k < 4 THEN 'options' WHEN k = 4 THEN 'yes_no' ELSE 'number' END AS rule, CASE WHEN k IN (2, 4) THEN 'noul' ELSE 'choice' END AS type,
CASE k WHEN 1 THEN 'Hint: ' || c || ' is cold.' WHEN 2 THEN 'Lecture: ' || c || ' falls.' WHEN 9 THEN 'Context: A ' || c || e'.\\nContext: none' ELSE 'Image.' END AS state,
CASE k WHEN 0 THEN 'Which ' || c || ' is it?' WHEN 1 THEN 'What melts ' || a || '?' WHEN 2 THEN 'Is ' || a || ' heavy?' WHEN 3 THEN 'What colour is ' || c || '?' WHEN 4 THEN 'Is ' || c || ' asleep?' WHEN 5 THEN 'How many ' || c || ' are there?' ELSE 'When was ' || a || ' built?' END AS instructions,
CASE k WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN '1' WHEN 3 THEN a WHEN 4 THEN '1' WHEN 5 THEN '3' ELSE '1950' END AS answer FROM doc WHERE k IN (0, 1, 2, 3, 4, 5, 9)""",
    "finetune_rows": """SELECT file, media, 'Which language?' AS instructions, CASE media WHEN 'image' THEN 'Image.' ELSE 'Audio clip.' END AS state, 'choice' AS type, CAST(list_position(labels, lang) - 1 AS INT) AS label
FROM (SELECT 'clips/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.jpg' ELSE '.txt' END AS file, CASE doc_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' END AS media, lang FROM documents), (SELECT list_sort(list(DISTINCT lang)) AS labels FROM documents) WHERE media IS NOT NULL""",
    "pool_fallback": f"""WITH q AS (SELECT p_partkey AS id, 'what is ' || regexp_replace(p_type, '[0-9]+', '', 'g') AS question, p_name AS answer FROM part),
k AS (SELECT id, answer, unnest([0, 1, 2]) AS rank, unnest([{_KIND.format('question', 4)}, {_KIND.format('question', 3)}, {_KIND.format('question', 2)}]) AS kind FROM q),
pool AS (SELECT kind, answer, row_number() OVER (PARTITION BY kind ORDER BY CAST('0x' || substr(md5(answer), 1, 4) AS INT) % 64, answer) - 1 AS place, count(*) OVER (PARTITION BY kind) - 1 AS size FROM (SELECT DISTINCT kind, answer FROM k)),
own AS (SELECT id, kind, place AS p, size FROM k JOIN pool USING (kind, answer) WHERE size >= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1),
f AS (SELECT *, {", ".join(f"CAST('0x' || substr(md5('pool:{i}:' || id), 1, 12) AS BIGINT) % (size - {i}) AS f{i}" for i in range(3))} FROM own),
a AS (SELECT *, f0 + CAST(p <= f0 AS INT) AS a0 FROM f), b AS (SELECT *, f1 + CAST(least(p, a0) <= f1 AS INT) AS m1 FROM a), c AS (SELECT *, m1 + CAST(greatest(p, a0) <= m1 AS INT) AS a1 FROM b),
d AS (SELECT *, list_sort([p, a0, a1]) AS t, f2 + CAST(list_sort([p, a0, a1])[1] <= f2 AS INT) AS m2 FROM c), e AS (SELECT *, m2 + CAST(t[2] <= m2 AS INT) AS m3 FROM d),
g AS (SELECT id, kind, unnest([0, 1, 2]) AS draw, unnest([a0, a1, m3 + CAST(t[3] <= m3 AS INT)]) AS place FROM e)
SELECT id, kind, string_agg(answer, '|' ORDER BY draw) AS wrong FROM g JOIN pool USING (kind, place) GROUP BY id, kind""",
}
_FUNCTIONS = [parse_lettered, parse_listed, split_context, strip_hints, clean_answers, question_kinds, normalised_texts, content_words, split_captions, alternatives, numbers, number_options, null_like_filter, humanised_labels, answer_requests, path_parts, turn_cascade, turn_cascade_pairs, pool_collect, pool_fallback, finetune_rows]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
