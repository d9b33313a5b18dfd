"""Converters of sounds over the driver tables, row by row, and the SQL of their draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..functions import text as T
from ..operators import convert as C
from ..session import table


def _told(rows, *more: str):
    return rows.select("id", "type", "instructions", F.coalesce(F.array_join("criteria", "|"), F.lit("")).alias("criteria"), "label", "split", *more)


def convert_emotions(spark, sf_dir):
    """Acted emotions with votes and voices, in two languages: every document is a clip of an actor."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    emotion = F.element_at(F.array(*map(F.lit, (*C.EMOTIONS, "bored"))), (n % 7 + 1).cast("int"))
    df = d.select(F.concat((1000 + n % 91).cast("string"), F.lit("_"), n.cast("string")).alias("id"), emotion.alias("emotion"), F.when(n % 3 == 0, "Male").when(n % 3 == 1, "female").alias("gender"), F.when(n % 4 > 0, n % 10).alias("angry"), (n % 7).alias("sad"))
    told = C.cremad(df).withColumns({"angry": F.col("votes")["angry"], "sad": F.col("votes")["sad"]})
    return _told(told, "angry", "sad")


def convert_vocals(spark, sf_dir):
    """Sounds of voices and whose they are: every document is a clip."""
    n = F.col("doc_id")
    label = F.element_at(F.array(*map(F.lit, (*C.VOCAL_SOUNDS, "Applause"))), (n % 7 + 1).cast("int"))
    df = table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), label.alias("label"), F.when(n % 5 == 0, "test").otherwise("train").alias("split"), F.element_at(F.array(*map(F.lit, ("f1", "m2", "x3"))), (n % 3 + 1).cast("int")).alias("speaker"))
    return _told(C.vocalsound(df))


def convert_music(spark, sf_dir):
    """Tempo, mode, key and metre of the members of archives: every document is a clip, some are copies of test clips."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    place = F.when(n % 5 == 0, F.concat(F.lit("d/x"), n.cast("string"))).otherwise(F.concat(F.lit("d/x"), F.expr("doc_id div 2").cast("string"), F.lit("_"), (n % 3).cast("string")))
    root = F.element_at(F.array(*map(F.lit, (*A.KEYS, "H"))), (n % 13 + 1).cast("int"))
    rows = d.select(n, place.alias("location"), F.lit(None).cast("string").alias("alt_caption"), (60 + n % 90).cast("double").alias("bpm"), root.alias("root"), F.when(n % 2 == 0, "minor").otherwise("major").alias("mode"), (n * 7 % 100 / 100.0).alias("keyprob"), (n % 6).cast("int").alias("metre"))
    members = d.where("doc_id % 4 > 0").select(F.concat(F.lit("archive/"), place).alias("member")).distinct()
    train, test = (rows.where(w).drop("doc_id") for w in ("doc_id % 5 > 0", "doc_id % 5 = 0"))
    return _told(C.musicbench(train, test, members))


def convert_intents(spark, sf_dir):
    """Calls to a bank with their language: every document is a call."""
    n = F.col("doc_id")
    df = table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), F.element_at(F.array(*map(F.lit, ("pay_bill", "freeze", "card_issues", "balance", "atm_limit"))), (n % 5 + 1).cast("int")).alias("intent"), "lang")
    return _told(C.minds14(df), "lang").drop("split")  # the split is a CRC-32 of the id, which split_crc32_mod10 has as SQL


def convert_sounds(spark, sf_dir):
    """Clips of a large label set with answers about them: every document is a clip, its label two of its words."""
    d = table(spark, sf_dir, "documents")
    label = F.concat(F.lit("sound "), (F.col("doc_id") % 40).cast("string"), F.lit(" of "), F.col("source"))
    df = d.select("doc_id", F.col("doc_id").cast("string").alias("id"), label.alias("label"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    answers = d.select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("answer_1"), F.when(F.col("doc_id") % 3 == 0, "There is no speech here.").otherwise("Someone gives a speech.").alias("answer_2"), F.when(F.col("doc_id") % 4 == 0, "It does not contain any music.").when(F.col("doc_id") % 4 == 1, "Music plays.").alias("answer_3"))
    rows = C.vggsound(df.drop("doc_id"), answers)
    own = df.select("id", "label").withColumnRenamed("label", "own")
    told = rows.join(own, "id")
    there = F.when(F.col("type") == "choice", F.get("criteria", F.col("label")) == F.col("own"))
    asks = F.when(F.col("type") == "choice", "which").when(F.startswith("instructions", F.lit("Can you hear")), "is it").otherwise(F.col("instructions"))
    near = F.size(F.filter("criteria", lambda c: F.arrays_overlap(F.split(c, " "), F.split("own", " ")))) > 1
    return told.select("id", asks.alias("ask"), "split", F.coalesce(there, F.when(asks == "is it", F.contains("instructions", "own") == (F.col("label") == 1))).alias("right"), F.when(asks.isin("which", "is it"), F.lit(None)).otherwise(F.col("label")).alias("label"), F.when(F.col("type") == "choice", near).alias("near"))


def convert_captions(spark, sf_dir):
    """Every document's whole text as the caption of its number: questions with digests of what they say."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("caption"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    rows = C.captioned(d, C.IMAGE, "split", "docs")
    return rows.select("id", "type", F.md5("instructions").alias("instructions"), F.md5(F.array_join("criteria", "|")).alias("criteria"), "label", "split")


def _draw(seed: str, key: str, *more: str) -> str:
    return f"md5('{seed}:' || {key}{''.join(f' || {chr(39)}:{chr(39)} || {m}' for m in more)})"


def _uniform(seed: str, key: str) -> str:
    return f"(CAST('0x' || substr({_draw(seed, key)}, 1, 8) AS BIGINT) / 4294967296.0)"


def _whole(seed: str, n: int, key: str) -> str:
    return f"(CAST('0x' || substr({_draw(seed, key)}, 1, 8) AS BIGINT) % {n})"


def _shuffled(seed: str, items: str, key: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda x: {{'d': {_draw(seed, key, 'x')}, 'x': x}})), lambda y: y.x)"


def _named_sql(seed: str, names: dict, label: str, which: tuple[str, str], is_it: str, more: str = "") -> str:
    keys = str(list(names))
    said = lambda k, second: f"CASE WHEN {second} THEN map({keys}, {[v[1] for v in names.values()]})[{k}] ELSE map({keys}, {[v[0] for v in names.values()]})[{k}] END"
    first, other = which
    return f"""w AS (SELECT *, list_filter({keys}, lambda x: x <> {label}) AS w, {_uniform(seed + '-language', 'id')} < 0.3 AS second FROM d WHERE {label} IN ({', '.join(repr(k) for k in names)})),
o AS (SELECT *, list_concat({_shuffled(seed, 'w', 'id')}[1:{_whole(seed + '-many', 5, 'id')} + 1], [{label}]) AS u, CASE WHEN {_uniform(seed + '-coin', 'id')} < 0.5 THEN {label} ELSE {_shuffled(seed + '-other', 'w', 'id')}[1] END AS s FROM w),
r AS (SELECT *, {_shuffled(seed + '-order', 'u', 'id')} AS o FROM o),
n AS (SELECT id, 'choice' AS type, CASE WHEN second THEN '{other}' ELSE '{first}' END AS instructions, array_to_string(list_transform(o, lambda k: {said('k', 'second')}), '|') AS criteria, CAST(list_position(o, {label}) - 1 AS INT) AS label, split{more} FROM r
UNION ALL SELECT id, 'noul', replace('{is_it}', '{{}}', {said('s', 'false')}), '', CAST(s = {label} AS INT), split{more} FROM r),
v AS (SELECT id, 'choice' AS type, CASE WHEN c THEN 'Is the speaker a man or a woman?' ELSE '说话的是男声还是女声？' END AS instructions, CASE WHEN c THEN 'man|woman' ELSE '男声|女声' END AS criteria, woman AS label, split{more}
FROM (SELECT *, {_uniform(seed + '-voice-language', 'id')} < 0.5 AS c FROM w) WHERE woman IS NOT NULL AND {_uniform(seed + '-voice', 'id')} < 0.3)
FROM n UNION ALL FROM v"""


def _near_sql(i: int) -> str:
    """The drawn caption that shares a word, by number among the word's captions without the row's own."""
    s = f"docs-{i}"
    return f"""pick{i} AS (SELECT clip, own, word, place, CAST('0x' || substr(md5('{s}:0:' || clip || ':' || own), 1, 12) AS BIGINT) % size AS free FROM wd JOIN pool USING (word, own) WHERE size >= 1
QUALIFY row_number() OVER (PARTITION BY clip, own ORDER BY md5('{s}-word:' || clip || ':' || own || ':' || word), word) = 1),
near{i} AS (SELECT p.clip, {i} AS draw, o.own AS other FROM pick{i} p JOIN pool o ON o.word = p.word AND o.place = p.free + CAST(p.place <= p.free AS INT)),
any{i} AS (SELECT a.clip, {i} AS draw, b.own AS other FROM cap a JOIN cap b ON a.split = b.split AND b.at = CAST('0x' || substr(md5('{s}:1:' || a.clip || ':' || a.own), 1, 12) AS BIGINT) % (a.n - 1)
+ CAST(a.at <= CAST('0x' || substr(md5('{s}:1:' || a.clip || ':' || a.own), 1, 12) AS BIGINT) % (a.n - 1) AS INT) WHERE a.n > 1)"""


_KEYS = str(list(A.KEYS))
ORACLE = {
    "convert_captions": f"""WITH raw AS (SELECT CAST(doc_id AS VARCHAR) AS clip, text AS caption, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE text <> ''),
cap AS (SELECT *, md5(split || ':' || coalesce(nullif(trim(regexp_replace(lower(caption), '[^a-z0-9]+', ' ', 'g')), ''), caption)) AS own, row_number() OVER (PARTITION BY split ORDER BY clip) - 1 AS at, count(*) OVER (PARTITION BY split) AS n FROM raw),
wd AS (SELECT DISTINCT clip, own, split || ':' || unnest(list_filter(regexp_extract_all(lower(caption), '[a-z]+'), lambda w: length(w) > 3 AND w NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}))) AS word FROM cap),
pool AS (SELECT word, own, row_number() OVER (PARTITION BY word ORDER BY CAST('0x' || substr(md5(own), 1, 4) AS INT) % 64, own) - 1 AS place, count(*) OVER (PARTITION BY word) - 1 AS size FROM (SELECT DISTINCT word, own FROM wd)),
{", ".join(_near_sql(i) for i in range(4))},
rows AS (SELECT *, clip || ':' || own AS row, {_whole('docs-many', 3, "clip || ':' || own")} + 1 AS many, {_uniform('docs-coin', "clip || ':' || own")} < 0.5 AS shown FROM cap),
drawn AS (SELECT r.clip, r.own, a.draw, CASE WHEN CAST('0x' || substr(md5('docs-near:' || a.draw || ':' || row), 1, 8) AS BIGINT) % 2 = 0 THEN coalesce(c.other, a.other) ELSE a.other END AS other
FROM rows r JOIN (FROM any0 UNION ALL FROM any1 UNION ALL FROM any2 UNION ALL FROM any3) a ON a.clip = r.clip LEFT JOIN (FROM near0 UNION ALL FROM near1 UNION ALL FROM near2 UNION ALL FROM near3) c ON c.clip = a.clip AND c.draw = a.draw
WHERE (a.draw = 0 AND NOT shown) OR (a.draw > 0 AND a.draw <= many)),
said AS (SELECT d.clip, d.draw, t.caption AS text FROM drawn d JOIN (SELECT own, min(caption) AS caption FROM cap GROUP BY own) t ON t.own = d.other AND d.other <> d.own),
told AS (SELECT r.*, coalesce(any_value(text) FILTER (draw = 0), any_value(caption)) AS said, list(DISTINCT text) FILTER (draw > 0 AND text <> caption) AS wrong FROM rows r LEFT JOIN said s USING (clip) GROUP BY ALL),
o AS (SELECT *, {_shuffled('docs-order', 'list_append(coalesce(wrong, []), caption)', 'row')} AS o FROM told)
SELECT clip AS id, 'noul' AS type, md5({list(C.MATCH_ASKS)}[{_whole('docs-match', len(C.MATCH_ASKS), 'row')} + 1] || ' "' || said || '"') AS instructions, NULL AS criteria, CAST(said = caption AS INT) AS label, split FROM o
UNION ALL SELECT clip, 'choice', md5({list(C.PICK_ASKS)}[{_whole('docs-pick', len(C.PICK_ASKS), 'row')} + 1]), md5(array_to_string(o, '|')), CAST(list_position(o, caption) - 1 AS INT), split FROM o WHERE len(o) > 1""",
    "convert_emotions": f"""WITH d AS (SELECT (1000 + doc_id % 91) || '_' || doc_id AS id, {[*C.EMOTIONS, 'bored']}[doc_id % 7 + 1] AS e, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS woman, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 10 AS DOUBLE) END AS angry,
CAST(doc_id % 7 AS DOUBLE) AS sad, CASE WHEN (1000 + doc_id % 91) % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
{_named_sql('cremad', C.EMOTIONS, 'e', ('How does the speaker sound?', '说话人是什么情绪？'), 'Does the speaker sound {}?', ', angry, sad')}""",
    "convert_vocals": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {[*C.VOCAL_SOUNDS, 'Applause']}[doc_id % 7 + 1] AS e, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS woman FROM documents),
{_named_sql('vocalsound', C.VOCAL_SOUNDS, 'e', ('Which vocal sound is this?', '这是哪种人声？'), 'Is this {}?')}""",
    "convert_music": f"""WITH d AS (SELECT *, doc_id % 5 = 0 AS test, CASE WHEN doc_id % 5 = 0 THEN 'd/x' || doc_id ELSE 'd/x' || (doc_id // 2) || '_' || (doc_id % 3) END AS id FROM documents),
m AS (SELECT DISTINCT id FROM d WHERE doc_id % 4 > 0),
e AS (SELECT id, CASE WHEN test THEN 'test' ELSE 'train' END AS split, 60 + doc_id % 90 AS bpm, {[*A.KEYS, 'H']}[doc_id % 13 + 1] AS root, doc_id % 2 = 0 AS minor, doc_id * 7 % 100 / 100.0 AS prob, doc_id % 6 AS metre FROM d SEMI JOIN m USING (id)
WHERE test OR 'd/x' || (doc_id // 2) NOT IN (SELECT 'd/x' || doc_id FROM documents WHERE doc_id % 5 = 0)),
w AS (SELECT *, list_append({_shuffled('music', f'list_filter({_KEYS}, lambda k: k <> root)', 'id')}[1:3], root) AS o FROM e),
t AS (SELECT id, 'What key is this music in?' AS instructions, {_shuffled('music-order', 'o', 'id')} AS o, root, split FROM w WHERE prob > 0.7 AND root <> 'H'),
f AS (SELECT id, 'How fast is this music?' AS instructions, 'slow|moderate|fast' AS criteria, CASE WHEN bpm < 80 THEN 0 WHEN bpm < 120 THEN 1 ELSE 2 END AS label, split FROM e WHERE least(abs(bpm - 80), abs(bpm - 120)) > 5
UNION ALL SELECT id, 'Is this in a major or a minor key?', 'major|minor', CAST(minor AS INT), split FROM e WHERE prob > 0.6
UNION ALL SELECT id, 'Does the beat count to three or to four?', 'three|four', CAST(metre = 4 AS INT), split FROM e WHERE metre IN (3, 4)
UNION ALL SELECT id, instructions, array_to_string(o, '|'), CAST(list_position(o, root) - 1 AS INT), split FROM t)
SELECT id, 'choice' AS type, instructions, criteria, label, split FROM f""",
    "convert_intents": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, ['pay_bill', 'freeze', 'card_issues', 'balance', 'atm_limit'][doc_id % 5 + 1] AS e, lang FROM documents),
w AS (SELECT *, list_filter(['atm_limit', 'balance', 'card_issues', 'freeze', 'pay_bill'], lambda x: x <> e) AS w FROM d),
o AS (SELECT *, list_concat({_shuffled('minds14', 'w', 'id')}[1:{_whole('minds14-many', 3, 'id')} + 1], [e]) AS u, CASE WHEN {_uniform('minds14-coin', 'id')} < 0.5 THEN e ELSE {_shuffled('minds14-other', 'w', 'id')}[1] END AS s FROM w),
r AS (SELECT *, {_shuffled('minds14-order', 'u', 'id')} AS o FROM o)
SELECT id, type, instructions, criteria, label, lang FROM (
SELECT id, 'choice' AS type, 'What does the caller want?' AS instructions, array_to_string(list_transform(o, lambda k: replace(k, '_', ' ')), '|') AS criteria, CAST(list_position(o, e) - 1 AS INT) AS label, lang FROM r
UNION ALL SELECT id, 'noul', 'Does the caller want ' || replace(s, '_', ' ') || '?', '', CAST(s = e AS INT), lang FROM r)""",
    "convert_sounds": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source, doc_id % 40 AS k, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
l AS (SELECT DISTINCT k, source FROM d)
SELECT id, 'which' AS ask, split, true AS "right", NULL AS label, true AS near FROM d UNION ALL SELECT id, 'is it', split, true, NULL, NULL FROM d
UNION ALL SELECT id, 'Is anyone speaking in this clip?', split, NULL, CAST(doc_id % 3 > 0 AS INT), NULL FROM d WHERE split = 'train'
UNION ALL SELECT id, 'Is there music in this clip?', split, NULL, CAST(doc_id % 4 = 1 AS INT), NULL FROM d WHERE split = 'train' AND doc_id % 4 < 2""",
}
QUERIES = {f.__name__: f for f in (convert_emotions, convert_vocals, convert_music, convert_intents, convert_sounds, convert_captions)}
