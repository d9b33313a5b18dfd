"""Converters over the driver tables, roll-outs, scoring, files and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import convert as C
from ..operators import scoring
from ..session import table
from ..sources import readers, writers
from ..sources.games import rollouts
from ..streaming import append
from .text_queries import filled


def _dir(spark) -> str:
    """A fresh folder all executors see: under the cluster's checkpoint folder; a local one serves a local master (tests) alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/askwright-core/{uuid.uuid4().hex}"


def _told(rows):
    return rows.select("id", "type", "state", "instructions", F.coalesce(F.array_join("criteria", "|"), F.lit("")).alias("criteria"), "label", "split")


def convert_mmbench(spark, sf_dir):
    """A question about each document with three or four options, some blank, in every rotation."""
    n = F.col("doc_id")
    of = lambda *v: F.element_at(F.array(*v), (n % len(v) + 1).cast("int"))
    text, null = lambda *v: of(*map(F.lit, v)), F.lit(None).cast("string")
    hint = of(F.lit("nan"), F.concat(F.lit("Look at "), F.col("source"), F.lit(".")), null, F.lit(" "))
    df = table(spark, sf_dir, "documents").select(n.alias("index"), F.concat(F.lit(" What is it in "), F.col("source"), F.lit("? ")).alias("question"), hint.alias("hint"), F.col("lang").alias("A"), F.col("source").alias("B"), F.concat(F.lit("item "), n.cast("string")).alias("C"), of(null, F.lit("nan"), F.lit(""), F.lit("d")).alias("D"), text(*"ABCDE").alias("answer"))
    return _told(C.mmbench(df))


def convert_mmstar(spark, sf_dir):
    asks = ["What is {a}?\nOptions: A: {b}, B: {c}, C: a bird", "Pick {a}.\nChoices:\n(A) {b}\n(B) {c}", "None {a}", "Odd {a}.\nOptions: B: x, C: y"]
    return _told(C.mmstar(filled(spark, sf_dir, asks, ["B", "A", "A", "B"]).select(F.col("id").alias("index"), F.col("t0").alias("question"), F.col("t1").alias("answer"))))


def convert_mme(spark, sf_dir):
    asks = ["Is {a} red? Please answer yes or no.", "Is {c} blue? Please answer yes or no.", "How many of {b}?"]
    df = filled(spark, sf_dir, asks, ["Yes", "No", "3"], ["{b}"]).select(F.col("id").cast("string").alias("question_id"), F.col("t0").alias("question"), F.col("t1").alias("answer"), F.col("t2").alias("category"), F.expr("'i' || (id div 2)").alias("image"))
    return C.mme(df).select("id", "instructions", "label", "grp")


def convert_options(spark, sf_dir):
    """Converters of listed options, each over the documents of one remainder."""
    d = table(spark, sf_dir, "documents").withColumns({"id": F.col("doc_id").cast("string"), "question": F.concat(F.lit("What of item "), F.col("doc_id").cast("string"), F.lit("?")), "item": F.concat(F.lit("item "), F.col("doc_id").cast("string"))})
    part = lambda *k: d.where((F.col("doc_id") % 10).isin(*k))
    kind, two = F.col("doc_id") % 10, F.array("lang", "source")
    out = C.seed_bench(part(0, 1).select("id", "question", F.col("lang").alias("choice_a"), F.when(kind == 0, F.col("source")).otherwise(F.col("lang")).alias("choice_b"), F.col("item").alias("choice_c"), F.lit("d").alias("choice_d"), F.lit("C").alias("answer")))
    none = F.lit(None).cast("string")
    out = out.unionByName(C.airbench(part(2, 3).select("id", "question", F.col("lang").alias("choice_a"), F.col("source").alias("choice_b"), none.alias("choice_c"), none.alias("choice_d"), F.when(kind == 2, F.col("source")).otherwise("z").alias("answer_gt"))))
    out = out.unionByName(C.omnibench(part(4).select("id", "question", F.array("lang", "source", "item").alias("options"), F.col("item").alias("answer"))))
    out = out.unionByName(C.mmau(part(5, 6).select("id", "question", F.when(kind == 5, F.to_json(two)).otherwise(F.concat_ws(", ", "lang", "source")).alias("choices"), F.col("source").alias("answer"))))
    out = out.unionByName(C.aokvqa(part(7).select("id", "question", two.alias("choices"), F.lit(0).alias("correct_choice_idx"), F.lit("train").alias("split"))))
    out = out.unionByName(C.scienceqa(part(8).select("id", "question", two.alias("choices"), F.lit(1).alias("answer"), F.concat(F.lit(" in "), F.col("lang"), F.lit(" ")).alias("hint"), F.lit("test").alias("split"))))
    said = F.to_json(F.array(F.struct(F.array(F.struct(F.col("question").alias("text"))).alias("content"))))
    out = out.unionByName(C.chat_targets(part(9).select("id", said.alias("messages"), F.to_json(F.create_map(F.col("lang"), F.lit(0.2), F.col("source"), F.lit(0.8))).alias("targets"))))
    return _told(out)


def convert_yes_no(spark, sf_dir):
    d = filled(spark, sf_dir, ["Is there {a}?"], ["yes", " No ", "maybe", "YES"]).select(F.col("id"), F.col("t0").alias("question"), F.col("t1").alias("answer"), F.lit("train").alias("split"))
    named = lambda w: d.where(w).withColumn("id", F.col("id").cast("string"))
    return _told(C.pope(named("id % 4 < 3").drop("split")).unionByName(C.clothoaqa(named("id % 4 = 3"))))


def convert_labelled(spark, sf_dir):
    """Labelled parts as clips: the choice holds the label, yes means the label itself."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("category"), (F.col("p_partkey") % 5 + 1).alias("fold"))
    rows = C.esc50(p).join(p, "id")
    right = F.when(F.col("type") == "choice", F.get("criteria", F.col("label")) == T.humanise(F.col("category"))).otherwise((F.col("instructions") == F.concat(F.lit("Is this the sound of "), T.humanise(F.col("category")), F.lit("?"))) == (F.col("label") == 1))
    return rows.groupBy("type", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.min(F.when(F.col("type") == "choice", F.size("criteria") >= 2).otherwise(True)).alias("enough"))


def convert_vqa(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    df = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("image_id"), F.lit("What?").alias("question"), F.when(kind == 0, F.when(F.col("p_size") > 25, "yes").otherwise("no")).when(kind == 1, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("multiple_choice_answer"), F.when(kind == 0, "yes/no").when(kind == 1, "number").otherwise("other").alias("answer_type"), F.col("p_brand").alias("question_type"))
    rows = C.vqav2(df).join(df, "id")
    right = F.when(F.col("type") == "choice", F.get("criteria", F.col("label")) == F.col("multiple_choice_answer")).otherwise((F.col("multiple_choice_answer") == "yes") == (F.col("label") == 1))
    return rows.groupBy("answer_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"))


def snake_rollout(spark, sf_dir):
    return rollouts(spark, "snake", 4, 120)


def bird_rollout(spark, sf_dir):
    return rollouts(spark, "bird", 8, 200)


def bricks_rollout(spark, sf_dir):
    return rollouts(spark, "bricks", 8, 200)


def typed_predictions(spark, sf_dir):
    """Requests and questions through validation, a scorer and typed answers."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request_id"), F.concat(F.lit("the nation "), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, " is far").otherwise(" is near")).alias("state"))
    crit = F.array(*[F.struct(F.lit(x).alias("key"), F.lit(None).cast("string").alias("value")) for x in ("near", "far")])
    q = lambda kind, ok: F.struct(F.lit(kind).alias("type"), F.lit("Which?").alias("instructions"), (crit if ok else F.slice(crit, 1, 0)).alias("criteria"))
    questions = n.select("request_id", F.lit("place").alias("qid"), q("choice", True).alias("question"), F.lit(1.0).alias("temperature")).unionByName(n.where("request_id < 5").select("request_id", F.lit("bad").alias("qid"), q("choice", False).alias("question"), F.lit(1.0).alias("temperature")))
    return scoring.predict(n, questions, "overlap").select("request_id", "qid", "choice", F.round("confidence", 4).alias("confidence"), "error")


def jsonl_round_trip(spark, sf_dir):
    path = _dir(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source"), F.when(F.col("doc_id") % 4 > 0, F.lit("train")).alias("split"), F.col("text").alias("state"), F.struct(F.lit("noul").alias("type"), F.lit("Is it?").alias("instructions"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("criteria")).alias("question"), F.lit(1).alias("label"))
    writers.write_rows(d, path)
    back = readers.question_rows(spark, path)
    return back.groupBy("source", "split", "question.type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("state").alias("states"))


def stream_append(spark, sf_dir):
    """Events through the file stream, twice: the second run adds nothing."""
    path = _dir(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e.repartition(4, "event_id").write.parquet(f"{path}/in")
    schema = "event_id bigint, event_type string, value double"
    for _ in range(2):
        append.append_stream(spark, f"{path}/in", schema, f"{path}/out", f"{path}/checkpoint", ["event_id"], 2)
    return append.appended(spark, f"{path}/out", schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def append_with_resume(spark, sf_dir):
    path = _dir(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    writers.append_new(e.where("event_id % 3 = 0"), path, ["event_id"])
    writers.append_new(e, path, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_HUMAN = "lower(replace(p_brand, '_', ' '))"
ORACLE = {
    "convert_mmbench": """WITH d AS (SELECT doc_id, 'What is it in ' || source || '?' AS q, 'Image.' || CASE WHEN doc_id % 4 = 1 THEN ' Look at ' || source || '.' ELSE '' END AS state, list_concat([lang, source, 'item ' || doc_id], CASE WHEN doc_id % 4 = 3 THEN ['d'] ELSE [] END) AS o, doc_id % 5 AS ans FROM documents),
r AS (SELECT *, unnest(range(len(o))) AS r FROM d WHERE ans < len(o))
SELECT CAST(doc_id AS VARCHAR) AS id, 'choice' AS type, state, q AS instructions, array_to_string(list_concat(o[r + 1:], o[1:r]), '|') AS criteria, CAST((ans - r + len(o)) % len(o) AS INT) AS label, 'test' AS split FROM r""",
    "convert_mmstar": """SELECT CAST(doc_id AS VARCHAR) AS id, 'choice' AS type, 'Image.' AS state, CASE WHEN doc_id % 4 = 0 THEN 'What is item ' || doc_id || '?' ELSE 'Pick item ' || doc_id || '.' END AS instructions, lang || '|' || source || CASE WHEN doc_id % 4 = 0 THEN '|a bird' ELSE '' END AS criteria,
CAST(doc_id % 4 = 0 AS INT) AS label, 'test' AS split FROM documents WHERE doc_id % 4 < 2""",
    "convert_mme": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'Is item ' || doc_id || ' red?' ELSE 'Is ' || source || ' blue?' END AS instructions, CAST(doc_id % 3 = 0 AS INT) AS label, lang || '/i' || (doc_id // 2) AS grp FROM documents WHERE doc_id % 3 < 2""",
    "convert_options": """WITH d AS (SELECT *, doc_id % 10 AS k FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, 'choice' AS type, CASE k WHEN 0 THEN 'Image.' WHEN 2 THEN 'Audio clip.' WHEN 4 THEN 'Image and audio clip.' WHEN 5 THEN 'Audio clip.' WHEN 7 THEN 'Photo.' WHEN 8 THEN 'in ' || lang ELSE 'Image.' END AS state, 'What of item ' || doc_id || '?' AS instructions,
lang || '|' || source || CASE k WHEN 0 THEN '|item ' || doc_id || '|d' WHEN 4 THEN '|item ' || doc_id ELSE '' END AS criteria, CASE WHEN k IN (0, 4) THEN 2 WHEN k = 7 THEN 0 ELSE 1 END AS label, CASE WHEN k = 7 THEN 'train' ELSE 'test' END AS split FROM d WHERE k IN (0, 2, 4, 5, 7, 8, 9)""",
    "convert_yes_no": """SELECT CAST(doc_id AS VARCHAR) AS id, 'noul' AS type, CASE WHEN doc_id % 4 < 3 THEN 'Image.' ELSE 'Audio clip.' END AS state, 'Is there item ' || doc_id || '?' AS instructions, '' AS criteria, CAST(doc_id % 4 <> 1 AS INT) AS label, CASE WHEN doc_id % 4 < 3 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 4 <> 2""",
    "convert_labelled": "SELECT type, CASE WHEN p_partkey % 5 = 4 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) AS \"right\", true AS enough FROM part, (VALUES ('choice'), ('noul')) v(type) GROUP BY 1, 2",
    "convert_vqa": """SELECT CASE p_partkey % 3 WHEN 0 THEN 'yes/no' WHEN 1 THEN 'number' ELSE 'other' END AS answer_type, count(*) AS n, count(*) AS "right" FROM part p WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_size <= 20)
OR (p_partkey % 3 = 2 AND (SELECT count(DISTINCT q.p_type) FROM part q WHERE q.p_partkey % 3 = 2 AND q.p_brand = p.p_brand) >= 4) GROUP BY 1""",
    "typed_predictions": """SELECT n_nationkey AS request_id, 'place' AS qid, CASE WHEN n_nationkey % 2 = 0 THEN 'far' ELSE 'near' END AS choice, round(1 + (p * ln(p) + (1 - p) * ln(1 - p)) / ln(2), 4) AS confidence, NULL AS error FROM nation, (SELECT exp(1) / (1 + exp(1)) AS p)
UNION ALL SELECT n_nationkey, 'bad', NULL, NULL, 'choice needs criteria' FROM nation WHERE n_nationkey < 5""",
    "jsonl_round_trip": "SELECT lang AS source, CASE WHEN doc_id % 4 > 0 THEN 'train' ELSE 'test' END AS split, 'noul' AS type, count(*) AS n, count(DISTINCT text) AS states FROM documents GROUP BY 1, 2",
    "stream_append": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "append_with_resume": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
_FUNCTIONS = [convert_mmbench, convert_mmstar, convert_mme, convert_options, convert_yes_no, convert_labelled, convert_vqa, snake_rollout, bird_rollout, bricks_rollout, typed_predictions, jsonl_round_trip, stream_append, append_with_resume]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
