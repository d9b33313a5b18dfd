"""Queries over the operators that put rows together before training or evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import questions as Q
from ..session import table


def _media(spark, sf_dir):
    """Conversations as rows with pictures and sounds, some blank, some missing."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    path = lambda kind, when: F.when(when, F.concat(F.lit(f"{kind}/"), F.col("conv_id").cast("string")))
    i, a = path("pictures", F.col("conv_id") % 3 < 2), path("sounds", F.col("conv_id") % 4 == 1)
    return c.select("conv_id", "turn", F.concat(F.lit("set "), (F.col("conv_id") % 7).cast("string")).alias("source"), F.when(F.col("conv_id") % 5 == 0, "test").when(F.col("conv_id") % 5 == 1, "val").otherwise("train").alias("split"), i.alias("image"), a.alias("audio"))


def modality_filter(spark, sf_dir):
    m = _media(spark, sf_dir).withColumns({"images": F.array("image", F.lit("")), "audios": F.when(F.col("audio").isNotNull(), F.array("audio"))})
    of = lambda which: F.count_if(A.modality(F.col("images"), F.col("audios"), which)).alias(which)
    return m.groupBy("source").agg(of("image"), of("audio"), of("any"))


def speech_and_music(spark, sf_dir):
    """What descriptions say about speech and music; every fourth document is prefixed with a denial."""
    said = F.element_at(F.array(*map(F.lit, ("There is no speech at all. ", "The clip does not contain any clear Music. ", "It goes without music, then speech. ", "No. Speech follows. "))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(said, "text").alias("t"))
    return d.select("doc_id", A.has_speech(F.col("t")).alias("speech"), A.has_music(F.col("t")).alias("music"))


def mask_neutralised(spark, sf_dir):
    """Texts with the mask token put before every full stop come back with blanks there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit("[MASK].")).alias("t"))
    return d.select("doc_id", F.md5(A.without_mask(F.col("t"))).alias("digest"))


def serialised_states(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_name").alias("name"), F.array("n_nationkey", "n_regionkey").alias("keys")).alias("state"))
    return n.select("n_nationkey", A.state_text(n, "state").alias("nested"), A.state_text(n, "n_name").alias("plain"))


def rebased_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", A.rebased(F.col("url"), "https://www.ththst.example.com", "s3/mirror/").alias("path"), A.rebased(F.col("url"), "https://", "/data").alias("tree"))


def first_rows_of_sets(spark, sf_dir):
    return A.first_of_each(_media(spark, sf_dir), "source", ["conv_id", "turn"], 3).select("source", "conv_id", "turn")


def sets_without_sound(spark, sf_dir):
    """Sets for a model that hears nothing, and for one that does."""
    m = _media(spark, sf_dir).where("conv_id % 28 <> 5").withColumn("audio", F.when(F.col("source") < "set 4", F.col("audio")))
    told = A.sets_for(m, "source", "audio", False).withColumn("model", F.lit("deaf"))
    return told.unionByName(A.sets_for(m, "source", "audio", True).withColumn("model", F.lit("hears"))).groupBy("model", "source").agg(F.count(F.lit(1)).alias("n"))


def example_gallery(spark, sf_dir):
    return A.gallery(_media(spark, sf_dir).withColumn("key", F.concat_ws("-", "conv_id", "turn")), "source", "key", ["image", "audio"], 4).select("source", "key")


def holdout_sets(spark, sf_dir):
    told = A.held_out_sets(_media(spark, sf_dir), ["set 1", "set 4"])
    return told.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


def clip_answers(spark, sf_dir):
    """Answers for the train clips that have them."""
    clips = table(spark, sf_dir, "pages").select(F.col("page_id").alias("clip"), F.when(F.col("page_id") % 4 == 0, "test").otherwise("train").alias("split"))
    answers = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select(F.col("doc_id").alias("clip"), F.md5("text").alias("answer"))
    return A.with_answers(clips, answers, "clip").select("clip", "split", "answer")


def members_by_suffix(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    members = p.select("page_id", F.concat(F.lit("archive/part/"), F.regexp_extract("url", "//([^/]*)/", 1), F.lit("/"), (F.col("page_id") % 5).cast("string")).alias("member"))
    meta = p.where("page_id % 2 = 0").select(F.concat(F.regexp_extract("url", "//([^/]*)/", 1), F.lit("/"), (F.col("page_id") % 5).cast("string")).alias("location")).distinct()
    return A.by_suffix(members, meta).select("page_id", "location")


def clip_names_and_crops(spark, sf_dir):
    """Questions on clips of usable length, with the clip's file and the middle that is kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha1("text").alias("clip"), (F.col("n_chars") * 40).cast("long").alias("n"))
    return A.clip_files(d, "clip", "n", 16_000, 3).select("doc_id", "file", "start", "n_kept")


def media_second_pass(spark, sf_dir):
    """Each language's pool from ids and languages alone; the texts join the rows in a second scan."""
    d = table(spark, sf_dir, "documents")
    pools = d.groupBy("lang").agg(F.count(F.lit(1)).alias("pool"))
    rows = d.select("doc_id", "lang").join(pools, "lang")
    return A.with_media(rows, d, "doc_id", ["text"]).select("doc_id", "lang", "pool", F.md5("text").alias("media"))


def teacher_progress(spark, sf_dir):
    """Labelled and failed rows and the teacher's accuracy, by half."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"), F.when(F.col("doc_id") % 9 > 0, F.array((F.col("doc_id") % 10) / 10.0, (F.lit(9) - F.col("doc_id") % 10) / 10.0)).alias("probs"))
    parts = [A.labelling_progress(l.where(F.col("doc_id") % 2 == k)).withColumn("half", F.lit(k)) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def yes_no_keep_their_order(spark, sf_dir):
    """Shuffled options beside yes-or-no rows, which have none and stay as they are, probabilities included."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("options"))
    yes = F.col("n_regionkey") % 2 == 0
    n = n.select("n_regionkey", F.when(~yes, F.col("options")).alias("options"), F.when(yes, 1).otherwise(2).alias("label"), F.when(yes, F.array(F.lit(0.25), F.lit(0.75))).otherwise(F.transform("options", lambda o, i: (i + 1) / F.lit(10.0))).alias("probs"))
    told = Q.shuffle_options(n, "keep", "n_regionkey", probs="probs")
    return told.select("n_regionkey", F.array_join("options", "|").alias("options"), "label", F.round(F.get("probs", F.col("label")), 3).alias("p"), F.size("probs").alias("n"))


def frame_questions(spark, sf_dir):
    """Frames with drawn phrasings, and with the first ones."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("label"))
    asks, sets = ["Which way?", "Pick a move."], [["up", "down", "stay"], ["north", "south", "wait"]]
    drawn = A.phrased(e, asks, sets, "frames", "event_id").withColumn("kind", F.lit("drawn"))
    first = A.phrased(e, asks, sets, "frames", "event_id", augment=False).withColumn("kind", F.lit("first"))
    return drawn.unionByName(first).select("event_id", "kind", "instructions", F.array_join("options", "|").alias("options"), "label")


def batches_of_ranks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return A.rank_batches(d, "source", "doc_id", 3, 2).select("doc_id", "source", "batch", "rank")


def token_splice(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").cast("int").alias("n"))
    valid = F.transform(F.sequence(F.lit(1), (F.col("conv_id") % 5).cast("int") + 1), lambda i: (i + F.col("conv_id")) % 3 > 0)
    return c.select("conv_id", F.array_join(F.transform(A.splice_order(valid, F.col("n") + 1), lambda x: x.cast("string")), ",").alias("order"))


def padded_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("turns"))
    p = c.select("conv_id", A.padded(F.col("turns"), 4, F.lit(-1)).alias("p"))
    return p.select("conv_id", F.array_join(F.transform("p.items", lambda x: x.cast("string")), ",").alias("items"), F.size(F.filter("p.mask", lambda m: m)).alias("n"))


def inverted_lookup(spark, sf_dir):
    """Region of each nation by a map, and the last nation of each region by the inverse one."""
    n = table(spark, sf_dir, "nation")
    m = n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey")))).alias("m"))  # the 25 nations
    ids = spark.range(0, 30).crossJoin(m)
    return ids.select("id", F.try_element_at("m", F.col("id").cast("int")).cast("long").alias("region"), F.try_element_at(A.inverted(F.col("m")), F.col("id").cast("int")).cast("long").alias("nation"))


def perceptual_hashes(spark, sf_dir):
    """Difference hashes of 16 x 17 pictures made from the vectors."""
    v = table(spark, sf_dir, "embeddings")
    grey = F.transform(F.sequence(F.lit(0), F.lit(271)), lambda k: F.floor(F.get("embedding", k % 64).cast("double") * 1000 + k % 5).cast("int"))
    return v.select("vec_id", A.difference_hash(grey).alias("digest"))


def music_facts(spark, sf_dir):
    """Tempo, mode, key and metre questions, option by option."""
    e = table(spark, sf_dir, "events")
    root = F.element_at(F.array(*map(F.lit, (*A.KEYS, "H"))), (F.col("event_id") % 13 + 1).cast("int"))
    told = A.music_facts((60 + F.col("event_id") % 90).cast("double"), root, F.when(F.col("event_id") % 2 == 0, "minor").otherwise("major"), F.col("event_id") * 7 % 100 / 100.0, (F.col("event_id") % 6).cast("int"), F.col("event_id"))
    return e.select("event_id", F.inline(told)).select("event_id", "kind", F.array_join("options", "|").alias("options"), "label")


_MEDIA = "m AS (SELECT conv_id, turn, 'set ' || conv_id % 7 AS source, CASE conv_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN conv_id % 3 < 2 THEN 'pictures/' || conv_id END AS image, CASE WHEN conv_id % 4 = 1 THEN 'sounds/' || conv_id END AS audio FROM conversations WHERE role = 'user')"
_DENIED = r"(no|not contain any|does not contain|doesn''t contain|without)"
_OPTIONS = "list_transform(list_sort(list_transform({o}, lambda x, i: {{'d': md5('{seed}:' || {key} || ':' || (i - 1)), 'i': i - 1, 'o': x}})), lambda z: {{'i': z.i, 'o': z.o}})"
_UNIFORM = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"
ORACLE = {
    "modality_filter": f"WITH {_MEDIA} SELECT source, count(*) FILTER (WHERE image IS NOT NULL AND audio IS NULL) AS image, count(audio) AS audio, count(coalesce(image, audio)) AS any FROM m GROUP BY 1",
    "speech_and_music": rf"""SELECT doc_id, NOT regexp_matches(t, '\b{_DENIED}\b[^.]*\bspeech', 'i') AS speech, NOT regexp_matches(t, '\b{_DENIED}\b[^.]*\bmusic', 'i') AS music
FROM (SELECT doc_id, ['There is no speech at all. ', 'The clip does not contain any clear Music. ', 'It goes without music, then speech. ', 'No. Speech follows. '][doc_id % 4 + 1] || text AS t FROM documents)""",
    "mask_neutralised": "SELECT doc_id, md5(replace(text, '.', ' .')) AS digest FROM documents",
    "serialised_states": """SELECT n_nationkey, '{"name":"' || n_name || '","keys":[' || n_nationkey || ',' || n_regionkey || ']}' AS nested, n_name AS plain FROM nation""",
    "rebased_paths": "SELECT page_id, CASE WHEN starts_with(url, 'https://www.ththst.example.com/') THEN 's3/mirror/' || substr(url, 32) ELSE url END AS path, CASE WHEN starts_with(url, 'https://') THEN '/data/' || substr(url, 9) ELSE url END AS tree FROM pages",
    "first_rows_of_sets": f"WITH {_MEDIA} SELECT source, conv_id, turn FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY conv_id, turn) <= 3",
    "sets_without_sound": f"""WITH {_MEDIA}, k AS (SELECT source, CASE WHEN source < 'set 4' THEN audio END AS audio FROM m WHERE conv_id % 28 <> 5)
SELECT 'hears' AS model, source, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'deaf', source, count(*) FROM k GROUP BY 2 HAVING count(audio) = 0""",
    "example_gallery": f"WITH {_MEDIA}, k AS (SELECT source, conv_id || '-' || turn AS key FROM m WHERE split = 'test' AND coalesce(image, audio) IS NOT NULL) SELECT source, key FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('gallery:' || key), key) <= 4",
    "holdout_sets": f"WITH {_MEDIA} SELECT CASE WHEN source IN ('set 1', 'set 4') THEN 'holdout:' || source ELSE source END AS source, CASE WHEN source IN ('set 1', 'set 4') THEN 'test' ELSE split END AS split, count(*) AS n FROM m WHERE source NOT IN ('set 1', 'set 4') OR split <> 'val' GROUP BY 1, 2",
    "clip_answers": "SELECT page_id AS clip, CASE WHEN page_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN page_id % 4 > 0 THEN md5(text) END AS answer FROM pages LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 1) ON doc_id = page_id",
    "members_by_suffix": "WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)/', 1) || '/' || page_id % 5 AS location FROM pages) SELECT page_id, location FROM p WHERE location IN (SELECT location FROM p WHERE page_id % 2 = 0)",
    "clip_names_and_crops": """WITH d AS (SELECT doc_id, sha1(text) AS clip, CAST(n_chars * 40 AS BIGINT) AS n FROM documents), c AS (SELECT clip, min(n) AS n FROM d GROUP BY 1)
SELECT doc_id, substr(sha1(clip), 1, 16) || '.flac' AS file, (c.n - least(c.n, 48000)) // 2 AS start, least(c.n, 48000) AS n_kept FROM d JOIN c USING (clip) WHERE c.n >= 1600""",
    "media_second_pass": "SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS pool, md5(text) AS media FROM documents",
    "teacher_progress": """SELECT CAST(doc_id % 2 AS INT) AS half, count(*) FILTER (WHERE doc_id % 9 > 0) AS labelled, count(*) FILTER (WHERE doc_id % 9 = 0) AS failed,
round(count(*) FILTER (WHERE doc_id % 9 > 0 AND CAST(doc_id % 10 < 5 AS INT) = toxic) / greatest(1, count(*) FILTER (WHERE doc_id % 9 > 0)), 6) AS accuracy FROM labels GROUP BY 1""",
    "yes_no_keep_their_order": f"""WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS o FROM nation GROUP BY 1), z AS (SELECT n_regionkey, {_OPTIONS.format(o="o", seed="keep", key="n_regionkey")} AS z FROM n WHERE n_regionkey % 2 = 1)
SELECT n_regionkey, array_to_string(list_transform(z, lambda x: x.o), '|') AS options, CAST(list_position(list_transform(z, lambda x: x.i), 2) - 1 AS INT) AS label, 0.3 AS p, len(z)::INT AS n FROM z UNION ALL SELECT n_regionkey, NULL, 1, 0.75, 2 FROM n WHERE n_regionkey % 2 = 0""",
    "frame_questions": f"""WITH e AS (SELECT event_id, event_id % 3 AS label, [['up', 'down', 'stay'], ['north', 'south', 'wait']] AS sets, ['Which way?', 'Pick a move.'] AS asks FROM events),
d AS (SELECT *, asks[{_UNIFORM.format(seed="frames-ask", key="event_id")} % 2 + 1] AS ask, sets[{_UNIFORM.format(seed="frames-set", key="event_id")} % 2 + 1] AS o FROM e), z AS (SELECT *, {_OPTIONS.format(o="o", seed="frames", key="event_id")} AS z FROM d)
SELECT event_id, 'drawn' AS kind, ask AS instructions, array_to_string(list_transform(z, lambda x: x.o), '|') AS options, CAST(list_position(list_transform(z, lambda x: x.i), label) - 1 AS INT) AS label FROM z
UNION ALL SELECT event_id, 'first', asks[1], array_to_string(sets[1], '|'), CAST(label AS INT) FROM e""",
    "batches_of_ranks": "SELECT doc_id, source, CAST(a AS INT) AS batch, CAST(a % 2 AS INT) AS rank FROM (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 AS a, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE a < n // 6 * 2",
    "token_splice": """WITH c AS (SELECT conv_id, max(turn) AS n, conv_id % 5 + 1 AS m FROM conversations GROUP BY 1), p AS (SELECT *, unnest(range(0, m + n + 1)) AS i FROM c)
SELECT conv_id, string_agg(i, ',' ORDER BY CASE WHEN i BETWEEN 1 AND m AND (i + conv_id) % 3 = 0 THEN 1 ELSE 0 END, i) AS "order" FROM p GROUP BY 1""",
    "padded_batches": "SELECT conv_id, array_to_string(list_concat(t[1:4], [-1, -1, -1, -1])[1:4], ',') AS items, CAST(least(4, len(t)) AS INT) AS n FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1)",
    "inverted_lookup": "SELECT id, CAST(n_regionkey AS BIGINT) AS region, CAST(k AS BIGINT) AS nation FROM range(30) r(id) LEFT JOIN nation ON n_nationkey = id LEFT JOIN (SELECT n_regionkey AS g, max(n_nationkey) AS k FROM nation GROUP BY 1) ON g = id",
    "perceptual_hashes": """WITH g AS (SELECT vec_id, list_transform(range(0, 272), lambda k: CAST(floor(CAST(embedding[k % 64 + 1] AS DOUBLE) * 1000 + k % 5) AS INT)) AS a FROM embeddings),
b AS (SELECT vec_id, list_transform(range(0, 256), lambda k: CAST(a[k // 16 + k + 2] > a[k // 16 + k + 1] AS INT)) AS b FROM g)
SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda d: '0123456789abcdef'[8 * b[4 * d + 1] + 4 * b[4 * d + 2] + 2 * b[4 * d + 3] + b[4 * d + 4] + 1]), '') AS digest FROM b""",
    "music_facts": """WITH e AS (SELECT event_id, 60 + event_id % 90 AS bpm, event_id * 7 % 100 / 100.0 AS prob, event_id % 2 = 0 AS minor, event_id % 6 AS metre, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B', 'H'][event_id % 13 + 1] AS root FROM events),
k AS (SELECT event_id, root, list_sort(list_transform(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], lambda x: {'d': md5('music:' || event_id || ':' || x), 'x': x})) AS z FROM e WHERE prob > 0.7 AND root <> 'H'),
w AS (SELECT event_id, root, list_append(list_filter(list_transform(z, lambda y: y.x), lambda x: x <> root)[1:3], root) AS o FROM k),
o AS (SELECT event_id, root, list_transform(list_sort(list_transform(o, lambda x: {'d': md5('music-order:' || event_id || ':' || x), 'x': x})), lambda y: y.x) AS o FROM w)
SELECT event_id, 'tempo' AS kind, 'slow|moderate|fast' AS options, CASE WHEN bpm < 80 THEN 0 WHEN bpm < 120 THEN 1 ELSE 2 END AS label FROM e WHERE least(abs(bpm - 80), abs(bpm - 120)) > 5 UNION ALL SELECT event_id, 'mode', 'major|minor', CAST(minor AS INT) FROM e WHERE prob > 0.6
UNION ALL SELECT event_id, 'metre', 'three|four', CAST(metre = 4 AS INT) FROM e WHERE metre IN (3, 4) UNION ALL SELECT event_id, 'key', array_to_string(o, '|'), CAST(list_position(o, root) - 1 AS INT) FROM o""",
}
_FUNCTIONS = [modality_filter, speech_and_music, mask_neutralised, serialised_states, rebased_paths, first_rows_of_sets, sets_without_sound, example_gallery, holdout_sets, clip_answers, members_by_suffix]
_FUNCTIONS += [clip_names_and_crops, media_second_pass, teacher_progress, yes_no_keep_their_order, frame_questions, batches_of_ranks, token_splice, padded_batches, inverted_lookup, perceptual_hashes, music_facts]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
