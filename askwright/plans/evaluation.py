"""Queries over scored tables: the `embeddings` table stands in for a scorer's logits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.sampling import halves
from ..operators import metrics as M
from ..operators import spatial as B
from ..session import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and ten logits 6 * (e_i + [i = label and vec_id % 10 < 6])."""
    e = table(spark, sf_dir, "embeddings")
    z = F.transform(F.slice("embedding", 1, 10), lambda x, i: 6 * (x.cast("double") + F.when((i == F.col("label")) & (F.col("vec_id") % 10 < 6), 1.0).otherwise(0.0)))
    return e.select("vec_id", "label", z.alias("logits"))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without the boost, from the next ten components."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 11, 10), lambda x: 6 * x.cast("double")).alias("logits"))


def twin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scored(spark, sf_dir).withColumn("run", F.lit("with")).unionByName(plain(spark, sf_dir).withColumn("run", F.lit("without")))
    return both.withColumn("set", F.concat(F.lit("set"), (F.col("vec_id") % 3).cast("string")))


def eval_metrics_by_label(spark, sf_dir):
    return M.metrics(scored(spark, sf_dir), ["label"])


def eval_by_source_and_run(spark, sf_dir):
    return M.metrics(twin_runs(spark, sf_dir), ["set", "run"])


def eval_with_without_gain(spark, sf_dir):
    return M.gain(twin_runs(spark, sf_dir), "set")


def selection_score(spark, sf_dir):
    told = M.metrics(twin_runs(spark, sf_dir).where("run = 'with'"), ["set"])
    return told.agg(F.round(F.avg("nll"), 4).alias("mean_nll"))


def best_epoch(spark, sf_dir):
    epochs = twin_runs(spark, sf_dir).where("run = 'with'").withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    epochs = epochs.withColumn("logits", F.transform("logits", lambda x: x * F.col("epoch") / 2))
    return M.best_epoch(M.metrics(epochs, ["epoch", "set"]))


def calib_bucket(spark, sf_dir):
    sizes = spark.createDataFrame([(2,), (4,), (8,), (12,)], "k int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id").crossJoin(F.broadcast(sizes))
    return rows.groupBy(F.concat_ws(":", F.lit("image"), A.option_bucket(F.lit("choice"), F.col("k"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _bucketed(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("bucket", F.concat_ws(":", F.lit("image"), A.option_bucket(F.lit("choice"), F.size("logits")), (F.col("vec_id") % 2).cast("string")))
    return halves(rows, ["bucket"], ["vec_id"])


def calib_fit_temperature(spark, sf_dir):
    return M.fit_temperature(_bucketed(spark, sf_dir).where("half = 'even'"), "bucket")


def calib_before_after(spark, sf_dir):
    rows = _bucketed(spark, sf_dir)
    temps = M.fit_temperature(rows.where("half = 'even'"), "bucket")
    odd = rows.where("half = 'odd'").join(F.broadcast(temps.select("bucket", "temperature")), "bucket", "left")
    before = M.metrics(odd, ["bucket"]).withColumn("run", F.lit("before"))
    after = M.metrics(odd, ["bucket"], temperature=F.coalesce("temperature", F.lit(1.0))).withColumn("run", F.lit("after"))
    return before.unionByName(after)


def temperature_resolution(spark, sf_dir):
    """The temperature of a question about each document, by modality and number of options, by options, or by type."""
    n = F.col("doc_id") % 5
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", pick("image", "image", "audio", "text", "image").alias("modality"), pick("choice", "choice", "score", "noul", "noul").alias("type"), pick("choice:2", "choice:11+", "score:3-5", "noul:2", "noul:2").alias("bucket"))
    modal = spark.createDataFrame([("image", "choice:2", "0.2"), ("image", "noul:2", "nan")], "modality string, bucket string, temperature string")
    options = spark.createDataFrame([("choice:11+", "9"), ("noul:2", "1.5")], "bucket string, temperature string")
    kinds = spark.createDataFrame([("choice", "1.1"), ("score", "oops"), ("noul", "1.3")], "type string, temperature string")
    return M.resolve_temperature(rows, modal, options, kinds).select("doc_id", "temperature")


def _typed(spark, sf_dir, kind, k):
    return scored(spark, sf_dir).select("vec_id", F.lit(kind).alias("type"), F.slice("logits", 1, k).alias("logits"), F.lit(1.3).alias("temperature"), F.array(*[F.lit(f"option {i}") for i in range(k)]).alias("labels"))


def answer_choice(spark, sf_dir):
    return M.answers(_typed(spark, sf_dir, "choice", 5), "labels").select("vec_id", "choice", "confidence")


def answer_score(spark, sf_dir):
    return M.answers(_typed(spark, sf_dir, "score", 4)).select("vec_id", "score", "confidence")


def answer_noul(spark, sf_dir):
    return M.answers(_typed(spark, sf_dir, "noul", 2)).select("vec_id", "noul", "confidence")


def head_features(spark, sf_dir):
    told = scored(spark, sf_dir).select("vec_id", A.head_features(A.softmax(F.col("logits"))).alias("f"))
    return told.select("vec_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("top1", "margin", "entropy", "options")])


def distill_kl(spark, sf_dir, weight: float = 0.5):
    """Cross-entropy and the teacher's divergence, where the teacher agrees with the label."""
    teacher = plain(spark, sf_dir).select("vec_id", A.softmax(F.col("logits")).alias("probs"))
    return M.distilled_loss(scored(spark, sf_dir).join(teacher, "vec_id", "left"), weight)


def results(spark, sf_dir):
    """Benchmark rows from events: every fourth a rotation of the one before, milliseconds from the value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("set"), (F.col("user_id") % 4).cast("string")).alias("set"), F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 4).cast("int").alias("rot"), F.expr("event_id div 4").cast("string").alias("grp"), F.col("event_type").alias("category"), (F.col("event_id") * 7 % 11 < 8).alias("correct"), F.col("value").alias("ms"))


def circular_accuracy(spark, sf_dir):
    return M.benchmark_summary(results(spark, sf_dir)).select("set", "n", "acc", "circular_acc")


def acc_plus(spark, sf_dir):
    return M.benchmark_summary(results(spark, sf_dir).withColumn("rot", F.lit(None).cast("int")).withColumn("grp", F.expr("cast(id as bigint) div 2").cast("string"))).select("set", "n", "acc", "circular_acc")


def accuracy_by_category(spark, sf_dir):
    return M.by_category(results(spark, sf_dir))


def latency_summary(spark, sf_dir):
    return M.benchmark_summary(results(spark, sf_dir), "category").select("category", "ms_mean", "ms_p50", "ms_p90")


def run_parity(spark, sf_dir):
    a = scored(spark, sf_dir)
    return M.compare_runs(a, a.withColumn("logits", F.transform("logits", lambda x: F.round(x, 2))), "vec_id")


def lr_schedule(spark, sf_dir):
    """The rate at the step of each batch of sixteen documents, in their order."""
    step = F.expr("doc_id div 16")
    return table(spark, sf_dir, "documents").select(step.alias("step")).distinct().select("step", F.round(A.warmup_cosine(F.col("step"), 10, 100), 6).alias("rate"))


def pool_tokens_grid(spark, sf_dir):
    """64 components as an 8 x 8 grid, averaged over 2 x 2 blocks."""
    pooled = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(B.pooled_grid(F.col("embedding"), 8, 4)).alias("at", "x"))
    return pooled.select("vec_id", F.expr("at div 4").alias("r"), (F.col("at") % 4).alias("c"), F.round("x", 5).alias("x"))


def audio_lengths(spark, sf_dir):
    """Frames that reach the decoder for chunks of 100 input frames."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest("n", F.lit(1)) - 1) / 100).cast("int")), lambda i: A.strided(F.least(F.lit(100), F.col("n") - 100 * i)))
    return c.select("conv_id", "turn", F.aggregate(chunks, F.lit(0).cast("long"), lambda a, x: a + x).alias("frames"))


_SCORED = """scored AS (SELECT vec_id, label, list_transform(range(1, 11), lambda i: 6 * (CAST(embedding[i] AS DOUBLE) + CASE WHEN i - 1 = label AND vec_id % 10 < 6 THEN 1.0 ELSE 0.0 END)) AS z FROM embeddings)"""
_PLAIN = """plain AS (SELECT vec_id, label, list_transform(range(11, 21), lambda i: 6 * CAST(embedding[i] AS DOUBLE)) AS z FROM embeddings)"""
_TWIN = f"""{_SCORED}, {_PLAIN}, twin AS (SELECT *, 'set' || (vec_id % 3) AS "set" FROM (SELECT *, 'with' AS run FROM scored UNION ALL SELECT *, 'without' AS run FROM plain))"""


def _soft(z: str, t: str = "1.0") -> str:
    return f"list_transform(list_transform({z}, lambda x: exp((x - list_max({z})) / ({t}))), lambda e: e / list_sum(list_transform({z}, lambda x: exp((x - list_max({z})) / ({t})))))"


def _metrics(source: str, by: str, t: str = "1.0") -> str:
    return f"""SELECT {by}, count(*) AS n, round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1.0 ELSE 0.0 END), 4) AS acc, round(avg(-ln(greatest(p[label + 1], 1e-9))), 4) AS nll,
round(avg(list_sum(list_transform(range(1, len(p) + 1), lambda i: power(p[i] - CASE WHEN i - 1 = label THEN 1 ELSE 0 END, 2)))), 4) AS brier
FROM (SELECT *, {_soft("z", t)} AS p FROM {source}) GROUP BY {by}"""


def _loss(t: str) -> str:
    return f"ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / ({t}))))) - (z[label + 1] - list_max(z)) / ({t})"


_LOW, _HIGH = math.log(A.TEMP_MIN), math.log(A.TEMP_MAX)
_BUCKETED = f"""{_SCORED}, bucketed AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY bucket ORDER BY vec_id) - 1) % 2 = 0 THEN 'even' ELSE 'odd' END AS half
FROM (SELECT *, 'image:choice:6-10:' || (vec_id % 2) AS bucket FROM scored))"""
_FITTED = f"""{_BUCKETED},
grid AS (SELECT exp({_LOW!r} + ({_HIGH!r} - {_LOW!r}) * i / 60) AS t FROM range(61) g(i)),
coarse AS (SELECT bucket, n, arg_min(t, (loss, t)) AS coarse FROM (SELECT bucket, t, count(*) AS n, round(sum({_loss("t")}), 6) AS loss FROM bucketed, grid WHERE half = 'even' GROUP BY bucket, t) WHERE n >= 50 GROUP BY bucket, n),
fitted AS (SELECT bucket, n, round(arg_min(t, (loss, t)), 4) AS temperature FROM (SELECT bucket, n, t, round(sum({_loss("t")}), 6) AS loss
  FROM (SELECT b.*, c.n, c.coarse * exp(-0.05 + 0.01 * i) AS t FROM bucketed b JOIN coarse c USING (bucket), range(11) s(i) WHERE half = 'even') GROUP BY bucket, n, t) GROUP BY bucket, n)"""
_RESULTS = """results AS (SELECT 'set' || (user_id % 4) AS "set", CAST(event_id AS VARCHAR) AS id, event_id % 4 AS rot, event_id // 4 AS grp, event_type AS category, event_id * 7 % 11 < 8 AS correct, value AS ms FROM events)"""


def _typed_sql(k: int, columns: str) -> str:
    p = _soft(f"z[1:{k}]", "1.3")
    return f"""WITH {_SCORED} SELECT vec_id, {columns} FROM (SELECT vec_id, {p} AS p FROM scored)"""


def _confidence(k: int) -> str:
    return f"round(least(1.0, greatest(0.0, 1 + list_sum(list_transform(p, lambda x: x * ln(least(greatest(x, 1e-12), 1.0)))) / ln({k}))), 4)"


def _circular(rot: str, grp: str) -> str:
    return f"""WITH {_RESULTS}, r AS (SELECT "set", {rot} AS rot, {grp} AS grp, correct FROM results)
SELECT "set", n, acc, circular_acc FROM (SELECT "set", count(*) FILTER (WHERE coalesce(rot, 0) = 0) AS n, round(avg(CAST(correct AS INT)) FILTER (WHERE coalesce(rot, 0) = 0), 4) AS acc FROM r GROUP BY 1)
JOIN (SELECT "set", round(avg(CAST(ok AS INT)), 4) AS circular_acc FROM (SELECT "set", grp, bool_and(correct) AS ok FROM r GROUP BY 1, 2) GROUP BY 1) USING ("set")"""




def _thrice(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN ({n} - 1) // 2 + 1 ELSE 0 END"


ORACLE = {
    "eval_metrics_by_label": f"WITH {_SCORED} {_metrics('scored', 'label')}",
    "eval_by_source_and_run": f"WITH {_TWIN} {_metrics('twin', '''\"set\", run''')}",
    "eval_with_without_gain": f"""WITH {_TWIN}, h AS (SELECT "set", run, CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1.0 ELSE 0.0 END AS hit FROM twin)
SELECT "set", round(avg(hit) FILTER (WHERE run = 'with'), 4) AS acc_with, round(avg(hit) FILTER (WHERE run = 'without'), 4) AS acc_without, round(avg(hit) FILTER (WHERE run = 'with') - avg(hit) FILTER (WHERE run = 'without'), 4) AS gain FROM h GROUP BY 1""",
    "selection_score": f"""WITH {_TWIN} SELECT round(avg(nll), 4) AS mean_nll FROM ({_metrics('''(SELECT * FROM twin WHERE run = 'with')''', '''"set"''')})""",
    "best_epoch": f"""WITH {_TWIN}, m AS ({_metrics('''(SELECT vec_id, label, "set", epoch, list_transform(z, lambda x: x * epoch / 2) AS z FROM twin, (VALUES (1), (2), (3)) v(epoch) WHERE run = 'with')''', '''epoch, "set"''')}),
e AS (SELECT epoch, round(avg(nll), 6) AS mean_nll FROM m GROUP BY epoch) SELECT arg_min(epoch, (mean_nll, epoch)) AS epoch, min(mean_nll) AS mean_nll FROM e""",
    "calib_bucket": """SELECT 'image:choice:' || CASE WHEN k <= 2 THEN '2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n FROM embeddings, (VALUES (2), (4), (8), (12)) v(k) GROUP BY 1""",
    "calib_fit_temperature": f"WITH {_FITTED} SELECT * FROM fitted",
    "calib_before_after": f"""WITH {_FITTED}, odd AS (SELECT b.*, coalesce(temperature, 1.0) AS t FROM bucketed b LEFT JOIN fitted USING (bucket) WHERE half = 'odd')
SELECT *, 'before' AS run FROM ({_metrics('odd', 'bucket')}) UNION ALL SELECT *, 'after' AS run FROM ({_metrics('odd', 'bucket', 't')})""",
    "temperature_resolution": "SELECT doc_id, [0.5::DOUBLE, 5.0, 1.0, 1.5, 1.0][doc_id % 5 + 1] AS temperature FROM documents",
    "answer_choice": _typed_sql(5, f"'option ' || (list_position(p, list_max(p)) - 1) AS choice, {_confidence(5)} AS confidence"),
    "answer_score": _typed_sql(4, f"round(list_sum(list_transform(range(1, 5), lambda i: p[i] * (i - 1))), 4) AS score, {_confidence(4)} AS confidence"),
    "answer_noul": _typed_sql(2, "round(p[2], 4) AS noul, round(greatest(p[2], 1 - p[2]), 4) AS confidence"),
    "head_features": f"""WITH {_SCORED} SELECT vec_id, round(s[1], 6) AS top1, round(s[1] - s[2], 6) AS margin, round(-list_sum(list_transform(p, lambda x: x * ln(least(greatest(x, 1e-9), 1.0)))) / ln(10), 6) AS entropy, round(10 / 255.0, 6) AS options
FROM (SELECT vec_id, p, list_reverse_sort(p) AS s FROM (SELECT vec_id, {_soft("z")} AS p FROM scored))""",
    "distill_kl": f"""WITH {_SCORED}, {_PLAIN}, r AS (SELECT s.label, {_soft("s.z")} AS p, {_soft("t.z")} AS q FROM scored s LEFT JOIN plain t USING (vec_id)),
k AS (SELECT -ln(greatest(p[label + 1], 1e-9)) AS ce, list_position(q, list_max(q)) - 1 = label AS agree, list_sum(list_transform(range(1, 11), lambda i: q[i] * (ln(q[i]) - ln(greatest(p[i], 1e-12))))) AS kl FROM r)
SELECT count(*) AS n, count(*) FILTER (WHERE agree) AS agreeing, round(avg(ce), 4) AS ce, round(avg(ce) + 0.5 * sum(CASE WHEN agree THEN kl ELSE 0 END) / count(*), 4) AS loss FROM k""",
    "circular_accuracy": _circular("rot", "grp"),
    "acc_plus": _circular("NULL", "CAST(id AS BIGINT) // 2"),
    "accuracy_by_category": f"""WITH {_RESULTS}, c AS (SELECT "set", category, count(*) AS n, round(avg(CAST(correct AS INT)), 4) AS acc FROM results WHERE rot = 0 GROUP BY 1, 2) SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY "set") > 1""",
    "latency_summary": "SELECT event_type AS category, round(avg(value), 1) AS ms_mean, round(median(value), 1) AS ms_p50, round(quantile_cont(value, 0.9), 1) AS ms_p90 FROM events GROUP BY 1",
    "run_parity": f"""WITH {_SCORED}, b AS (SELECT z AS x, list_transform(z, lambda v: round(v, 2)) AS y FROM scored), d AS (SELECT x, y, list_max(list_transform(range(1, 11), lambda i: abs(x[i] - y[i]))) AS m FROM b)
SELECT count(*) AS n, round(max(m), 6) AS max_abs, round(max(m / greatest(list_max(list_transform(y, lambda v: abs(v))), 1e-9)), 6) AS max_rel, count(*) FILTER (WHERE list_position(x, list_max(x)) = list_position(y, list_max(y))) AS same FROM d""",
    "lr_schedule": "SELECT DISTINCT i AS step, round(CASE WHEN i < 10 THEN (i + 1) / 10.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (i - 10) / 90.0))) END, 6) AS rate FROM (SELECT doc_id // 16 AS i FROM documents)",
    "pool_tokens_grid": "SELECT vec_id, (i - 1) // 8 // 2 AS r, (i - 1) % 8 // 2 AS c, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS x FROM embeddings, range(1, 65) g(i) GROUP BY 1, 2, 3",
    "audio_lengths": f"""SELECT conv_id, turn, CAST(sum({_thrice("m")}) AS BIGINT) AS frames FROM (SELECT conv_id, turn, {_thrice("l")} AS m FROM (SELECT conv_id, turn, {_thrice("n")} AS l
FROM (SELECT conv_id, turn, least(100, length(text) - 100 * unnest(range((greatest(length(text), 1) - 1) // 100 + 1))) AS n FROM conversations))) GROUP BY 1, 2""",
}
_FUNCTIONS = [eval_metrics_by_label, eval_by_source_and_run, eval_with_without_gain, selection_score, best_epoch, calib_bucket, calib_fit_temperature, calib_before_after, temperature_resolution, answer_choice, answer_score, answer_noul, head_features, distill_kl, circular_accuracy, acc_plus, accuracy_by_category, latency_summary, run_parity, lr_schedule, pool_tokens_grid, audio_lengths]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
