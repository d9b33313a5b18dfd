"""Predictions in batches, labelling by a teacher and running counts, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, teacher
from ..session import shared_dir, table
from ..streaming import progress

_OPTIONS = ("brief", "middling", "long-winded")


def _fresh(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/askwright-core/{uuid.uuid4().hex}"


def _lengths(frame):
    """A stand-in scorer: numbers from the lengths of state and option, one in fifty states not a number."""
    out = []
    for state, options in zip(frame["state"], frame["options"], strict=True):
        n = len(state or "")
        out.append([float("nan") if n % 50 == 0 else (n + 3 * len(o)) % 7 / 2.0 for o in options])
    return out


def batched_predictions(spark, sf_dir):
    """A question about each document, with pictures for some: batches of like length under a token budget."""
    d = table(spark, sf_dir, "documents")
    images = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("a.jpg")))
    audios = F.when(F.col("doc_id") % 14 == 0, F.array(F.lit("a.wav")))
    requests = d.select(F.col("doc_id").alias("request_id"), F.col("text").alias("state"), images.alias("images"), audios.alias("audios"))
    crit = F.array(*[F.struct(F.lit(x).alias("key"), F.lit(None).cast("string").alias("value")) for x in _OPTIONS])
    question = F.struct(F.lit("choice").alias("type"), F.lit("How is it told?").alias("instructions"), crit.alias("criteria"))
    questions = d.select(F.col("doc_id").alias("request_id"), F.lit("q").alias("qid"), question.alias("question"), F.lit(1.5).alias("temperature"))
    told = scoring.predict_in_batches(requests, questions, _lengths, F.ceil(F.length("state") / 4) + 16, ("image",))
    return told.select("request_id", "modalities", "choice", F.round("confidence", 3).alias("confidence"), "error", "cost")


def teacher_labelling(spark, sf_dir):
    """Every document asked for by a stand-in teacher that fails at first, or always, or names no option; two runs, one table."""
    path = _fresh(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    tried: dict = {}

    def client(row: dict) -> list[tuple[str, float]]:
        i = int(row["doc_id"])
        tried[i] = tried.get(i, 0) + 1
        if i % 17 == 0 or i % 5 == 0 and tried[i] == 1:
            raise ConnectionError("busy")
        return [("z", -1.0)] if i % 11 == 0 else [("A", -0.1 * (i % 7)), (" B", -0.3 * (i % 4)), ("z", -1.0)]

    variants = F.array(F.array(F.lit("A")), F.array(F.lit("B")))
    for part in (d.where("doc_id % 3 = 0"), d):  # the second run goes on from the first
        teacher.label_rows(part, client, path, ["doc_id"], variants, tasks=16, portions=2, pause=0.0)
    t = spark.read.parquet(path)
    return t.select("doc_id", "lang", F.round(F.get("teacher.probs", F.lit(0)), 4).alias("a"), F.round("teacher.mass", 3).alias("mass"), "teacher.model")


def running_counts(spark, sf_dir):
    """Labelled rows followed as a stream of files, twice: the second time nothing is new."""
    path = _fresh(spark)
    probs = F.when(F.col("doc_id") % 9 > 0, F.array((F.col("doc_id") % 10) / 10.0, (F.lit(9) - F.col("doc_id") % 10) / 10.0))
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("part"), F.col("toxic").cast("int").alias("label"), probs.alias("probs"))
    rows.repartition(4).write.parquet(f"{path}/in")
    for _ in range(2):
        progress.running_progress(spark, f"{path}/in", "part bigint, label int, probs array<double>", f"{path}/out", f"{path}/checkpoint", "part")
    return progress.latest_progress(spark, f"{path}/out", "part")


ORACLE = {
    "batched_predictions": """WITH d AS (SELECT doc_id AS request_id, length(coalesce(text, '')) AS n, CAST(ceil(length(text) / 4) AS BIGINT) + 16 AS cost,
CASE WHEN doc_id % 126 = 0 THEN 'image+audio' WHEN doc_id % 9 = 0 THEN 'image' WHEN doc_id % 14 = 0 THEN 'audio' ELSE 'text' END AS modalities FROM documents),
z AS (SELECT *, list_transform([5, 8, 11], lambda k: exp((n + 3 * k) % 7 / 2.0 / 1.5)) AS e FROM d),
p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM z),
t AS (SELECT *, modalities LIKE '%audio' AS no_audio, n % 50 = 0 AS odd FROM p)
SELECT request_id, modalities, CASE WHEN NOT no_audio AND NOT odd THEN ['brief', 'middling', 'long-winded'][list_position(p, list_max(p))] END AS choice,
CASE WHEN NOT no_audio AND NOT odd THEN round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(3), 3) END AS confidence,
CASE WHEN no_audio THEN 'the scorer takes no audio' WHEN odd THEN 'logits are not finite' END AS error, CASE WHEN NOT no_audio THEN coalesce(cost, 1) END AS cost FROM t""",
    "teacher_labelling": """WITH p AS (SELECT doc_id, lang, exp(-0.1 * (doc_id % 7)) AS a, exp(-0.3 * (doc_id % 4)) AS b FROM documents WHERE doc_id % 17 > 0 AND doc_id % 11 > 0)
SELECT doc_id, lang, round(round(a / (a + b), 5), 4) AS a, round(round(a + b, 4), 3) AS mass, 'teacher' AS model FROM p""",
    "running_counts": """WITH l AS (SELECT doc_id % 5 AS part, doc_id % 9 > 0 AS told, CASE WHEN doc_id % 10 >= 5 THEN 0 ELSE 1 END AS best, CAST(toxic AS INT) AS label FROM labels),
c AS (SELECT part, count(*) FILTER (told) AS labelled, count(*) FILTER (NOT told) AS failed, count(*) FILTER (told AND best = label) AS r FROM l GROUP BY 1)
SELECT part, labelled, failed, r AS "right", round(r / greatest(1, labelled), 6) AS accuracy FROM c""",
}
QUERIES = {f.__name__: f for f in (batched_predictions, teacher_labelling, running_counts)}
