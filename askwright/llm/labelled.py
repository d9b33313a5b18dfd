"""A bounded sample of labelled documents, and the calibration both classifiers share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, settle, small_batches


@dataclass
class Sample:
    texts: list[str]
    labels: np.ndarray  # 0 or 1
    rates: tuple[int, int]  # rows of either label among all that may be learnt from


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = 2048, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> Sample:
    """At most ``per_class`` documents of either label and ``max_bytes`` of text, in the order of a hash of the id.

    Only rows outside the held-out fold with label 0 or 1 are learnt from.  A document that does not fit in what is left of
    ``max_bytes`` is passed over whole; none is cut.  Ids with both labels are left out, equal rows count once, and of an id with several
    texts each is a document; at most 4 * ``per_class`` texts are looked at.  The sample does not depend on partitioning.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(label_id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most").drop("__most")
    counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    by = F.xxhash64("__id")
    picked = known.where("__label = 0").orderBy(by, "__id").limit(per_class).unionByName(known.where("__label = 1").orderBy(by, "__id").limit(per_class))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = settle(texts.join(F.broadcast(picked), "__id").withColumn("__size", F.octet_length("__text")), "sample")
    sizes = found.select(F.xxhash64("__id").alias("__by"), "__id", "__size", F.xxhash64("__text").alias("__mark")).distinct()
    sizes = sizes.orderBy("__by", "__id", "__size", "__mark").limit(4 * per_class).collect()
    room, chosen = max_bytes, []
    for _, i, size, mark in sizes:
        if size <= room:
            room -= size
            chosen.append((i, mark))
    rows: dict = {}
    if chosen:
        ids = found.sparkSession.createDataFrame(chosen, found.select("__id", F.xxhash64("__text").alias("__mark")).schema)
        kept = found.withColumn("__mark", F.xxhash64("__text")).join(F.broadcast(ids), ["__id", "__mark"])
        # repeated rows go before the collect: what comes here is a row for each chosen text
        rows = {(r[0], r[1]): (r[2], r[3]) for r in kept.groupBy("__id", "__mark").agg(F.min("__text"), F.min("__label")).collect()}
    got = [rows[k] for k in chosen if k in rows]
    return Sample([t for t, _ in got], np.array([y for _, y in got], np.int64), (counts.get(0, 0), counts.get(1, 0)))


def logistic(features: np.ndarray, labels: np.ndarray, rates: tuple[int, int], ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression; classes weigh as among all rows."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    have = np.bincount(labels, minlength=2)
    if not len(x) or not have.all() or not all(rates):
        rate = (rates[1] + 0.5) / (sum(rates) + 1)
        w[-1] = np.log(rate / (1 - rate))
        return w
    weight = np.where(labels == 1, rates[1] / have[1], rates[0] / have[0])
    weight *= len(x) / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + ridge * len(x) * np.append(w[:-1], 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge * len(x) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))
