"""Evaluation of scored rows: metrics, calibration, benchmark summaries, comparison of runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def metrics(rows: DataFrame, by: list[str], logits: str = "logits", label: str = "label", temperature: Column | None = None) -> DataFrame:
    """n, accuracy, log loss and Brier score for each group, to four places."""
    p = A.softmax(F.col(logits), temperature if temperature is not None else 1.0)
    told = rows.withColumn("__p", p)
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((A.argmax(F.col(logits)) == F.col(label)).cast("double")), 4).alias("acc"), F.round(F.avg(A.nll(F.col("__p"), F.col(label))), 4).alias("nll"), F.round(F.avg(A.brier(F.col("__p"), F.col(label))), 4).alias("brier"))


def gain(rows: DataFrame, by: str, run: str = "run") -> DataFrame:
    """Accuracy with and without the modality, and the difference."""
    hit = (A.argmax(F.col("logits")) == F.col("label")).cast("double")
    of = lambda name: F.avg(F.when(F.col(run) == name, hit))
    return rows.groupBy(by).agg(F.round(of("with"), 4).alias("acc_with"), F.round(of("without"), 4).alias("acc_without"), F.round(of("with") - of("without"), 4).alias("gain"))


def temperature_grid(n: int = 61) -> list[float]:
    low, high = math.log(A.TEMP_MIN), math.log(A.TEMP_MAX)
    return [math.exp(low + (high - low) * i / (n - 1)) for i in range(n)]


def fit_temperature(rows: DataFrame, by: str, least: int = 50, logits: str = "logits", label: str = "label") -> DataFrame:
    """The temperature of least log loss for each group of ``least`` rows and more.

    One aggregation holds the sums for all 61 grid points of a group (partial sums before the shuffle, no row is
    repeated); a second one refines the best point by 11 steps within 5 %.  There are at most as many groups as modalities and
    option buckets, so the table of best points is broadcast.
    """
    grid = temperature_grid()
    z, y = F.col(logits), F.col(label)
    at = lambda t: A.log_loss(z, y, t)
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.round(F.sum(at(F.lit(t))), 6) for t in grid]).alias("loss")).where(F.col("n") >= least)
    best = sums.select(by, "n", F.element_at(F.array(*[F.lit(t) for t in grid]), F.array_position("loss", F.array_min("loss")).cast("int")).alias("coarse"))
    steps = [math.exp(-0.05 + 0.01 * i) for i in range(11)]
    fine = rows.join(F.broadcast(best), by).groupBy(by, "n", "coarse").agg(F.array(*[F.round(F.sum(at(F.col("coarse") * s)), 6) for s in steps]).alias("loss"))
    return fine.select(by, "n", F.round(F.col("coarse") * F.element_at(F.array(*[F.lit(s) for s in steps]), F.array_position("loss", F.array_min("loss")).cast("int")), 4).alias("temperature"))


def resolve_temperature(rows: DataFrame, by_modality: DataFrame, by_options: DataFrame, by_type: DataFrame) -> DataFrame:
    """The temperature of (modality, bucket), else of the bucket, else of the question type; the tables are tiny."""
    told = rows.join(F.broadcast(by_modality.select("modality", "bucket", F.col("temperature").alias("__m"))), ["modality", "bucket"], "left")
    told = told.join(F.broadcast(by_options.select("bucket", F.col("temperature").alias("__o"))), "bucket", "left")
    told = told.join(F.broadcast(by_type.select("type", F.col("temperature").alias("__t"))), "type", "left")
    return told.withColumn("temperature", A.clamp_temperature(F.coalesce("__m", "__o", "__t"))).drop("__m", "__o", "__t")


def answers(rows: DataFrame, labels: str | None = None) -> DataFrame:
    """Adds probabilities and the typed answer of each row by its ``type`` and ``temperature``."""
    p = A.softmax(F.col("logits"), F.col("temperature"), 1e-3)
    rows = rows.withColumn("p", p)
    kind, prob = F.col("type"), F.col("p")
    choice = F.when(kind == "choice", F.get(F.col(labels), A.argmax(prob)) if labels else A.argmax(prob).cast("string"))
    yes = F.get(prob, 1)
    sure = F.when(kind == "noul", F.greatest(yes, 1 - yes)).otherwise(A.confidence(prob))
    return rows.withColumns({"choice": choice, "score": F.when(kind == "score", F.round(A.expectation(prob), 4)), "noul": F.when(kind == "noul", F.round(yes, 4)), "confidence": F.round(sure, 4), "probabilities": F.transform("p", lambda x: F.round(x, 4))}).drop("p")


def benchmark_summary(results: DataFrame, by: str = "set") -> DataFrame:
    """n and accuracy of unrotated rows, share of groups with every member right, latency over all rows."""
    first = F.coalesce(F.col("rot"), F.lit(0)) == 0
    groups = results.where("grp is not null").groupBy(by, "grp").agg(F.bool_and("correct").alias("all_right")).groupBy(by).agg(F.round(F.avg(F.col("all_right").cast("double")), 4).alias("circular_acc"))
    main = results.groupBy(by).agg(F.count_if(first).alias("n"), F.round(F.avg(F.when(first, F.col("correct").cast("double"))), 4).alias("acc"), F.round(F.avg("ms"), 1).alias("ms_mean"), F.round(F.median("ms"), 1).alias("ms_p50"), F.round(F.percentile("ms", 0.9), 1).alias("ms_p90"))
    return main.join(groups, by, "left")


def by_category(results: DataFrame, by: str = "set") -> DataFrame:
    """Accuracy of each category, for sets with more than one."""
    first = results.where(F.coalesce(F.col("rot"), F.lit(0)) == 0).withColumn("category", F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("all")))
    told = first.groupBy(by, "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("acc"))
    return told.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy(by))).where("__c > 1").drop("__c")


def distilled_loss(rows: DataFrame, weight: float = 0.5, logits: str = "logits", label: str = "label", probs: str = "probs") -> DataFrame:
    """n, agreeing, ce and loss: the mean cross-entropy plus ``weight`` times the teacher's divergence over all rows.

    The divergence counts only where the teacher's likeliest option is the label; rows without ``probs`` have none.
    """
    p, agree = A.softmax(F.col(logits)), F.coalesce(A.argmax(F.col(probs)) == F.col(label), F.lit(False))
    apart = F.when(agree, A.kl(F.col(probs), F.col("__p"))).otherwise(0.0)
    told = rows.withColumn("__p", p).agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("agreeing"), F.avg(A.nll(F.col("__p"), F.col(label))).alias("ce"), F.sum(apart).alias("kl"))
    return told.select("n", "agreeing", F.round("ce", 4).alias("ce"), F.round(F.col("ce") + weight * F.col("kl") / F.col("n"), 4).alias("loss"))


def compare_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows, largest absolute and relative difference of logits, rows with the same decision."""
    both = a.select(key, F.col("logits").alias("x")).join(b.select(key, F.col("logits").alias("y")), key)
    apart = F.zip_with("x", "y", lambda x, y: F.abs(x - y))
    scale = F.greatest(F.array_max(F.transform("y", F.abs)), F.lit(1e-9))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.array_max(apart)), 6).alias("max_abs"), F.round(F.max(F.array_max(apart) / scale), 6).alias("max_rel"), F.count_if(A.argmax(F.col("x")) == A.argmax(F.col("y"))).alias("same"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch with the least mean of its sets' log losses; of equals the earliest."""
    mean = epochs.groupBy("epoch").agg(F.round(F.avg("nll"), 6).alias("mean_nll"))
    return mean.agg(F.min_by("epoch", F.struct("mean_nll", "epoch")).alias("epoch"), F.min("mean_nll").alias("mean_nll"))
