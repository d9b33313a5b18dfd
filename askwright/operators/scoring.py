"""Pluggable vectorised scorers: rows of questions to logits, each distinct input once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], list]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a function from a frame (state, instructions, options) to a list of logits for each row.

    A row's logits must not depend on the rows beside it.
    """

    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


def score(rows: DataFrame, name: str | Scorer, inputs: list[str], out: str = "logits") -> DataFrame:
    """Adds logits.  Rows with equal inputs are scored once: distinct inputs are scored and joined back by null-safe keys."""
    f = SCORERS[name] if isinstance(name, str) else name
    distinct = rows.select(*inputs).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(__logits=f(batch))

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in distinct.schema) + ", __logits array<double>"
    told = distinct.mapInPandas(run, schema).select(*[F.col(c).alias(f"__{c}") for c in inputs], F.col("__logits").alias(out))
    joined = rows.join(told, [rows[c].eqNullSafe(F.col(f"__{c}")) for c in inputs], "left")
    return joined.select(*rows.columns, out)


def predict(requests: DataFrame, questions: DataFrame, name: str | Scorer) -> DataFrame:
    """Typed answers of every (request, question) pair of a request: validate, render, score, calibrate, answer.

    ``requests``: request_id, state.  ``questions``: request_id, qid, question, temperature.  An invalid question has an error and no answer.
    """
    from . import metrics, questions as Q

    rows = requests.join(questions, "request_id").withColumn("error", Q.problem(F.col("question")))
    good = rows.where("error is null").withColumns({"type": F.col("question.type"), "instructions": F.col("question.instructions"), "options": Q.rendered(F.col("question"))})
    good = score(good, name, ["state", "type", "instructions", "options"])
    names = F.when(F.col("type") == "choice", F.transform("question.criteria", lambda c: c["key"])).otherwise(F.col("options"))
    told = metrics.answers(good.withColumn("labels", names), "labels").select("request_id", "qid", "type", "choice", "score", "noul", "confidence", "probabilities", "error")
    bad = rows.where("error is not null").select("request_id", "qid", F.col("question.type").alias("type"), "error")
    return told.unionByName(bad, allowMissingColumns=True)


def _padded_batches(frames: Iterator[pd.DataFrame], budget: int, most: int) -> Iterator[pd.DataFrame]:
    """Batches of rows that come in the order of their cost: at most ``most``, and at most ``budget`` when all cost as much as the last.

    A row that alone is over the budget is a batch of its own.
    """
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        while True:
            costs = held["__cost"].to_numpy()
            over = np.flatnonzero((np.arange(1, len(costs) + 1) > most) | (np.arange(1, len(costs) + 1) * costs > budget))
            if not len(over):
                break
            n = max(1, int(over[0]))
            if n == len(held):
                break
            yield held.iloc[:n]
            held = held.iloc[n:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def score_in_batches(rows: DataFrame, name: str | Scorer, inputs: list[str], cost: Column, budget: int = 16_384, most: int = 64, out: str = "logits") -> DataFrame:
    """As ``score``, in batches of like length: adds logits, ``failure``, ``cost`` and ``padded`` (what a row cost in its batch).

    Distinct inputs are sorted by ``cost`` (tokens, one at least) within their task, so a batch is padded to little more than its rows are long
    and memory is bounded by ``budget`` tokens.  A row with a logit that is not finite, or with no logits, has none and a failure; the rows
    beside it keep theirs.  Answers do not depend on the budget, as a scorer's rows do not depend on each other.
    """
    f = SCORERS[name] if isinstance(name, str) else name
    # inputs are known by 128 bits of hash, which say where nulls are: long texts are shuffled once, and not joined on
    there = [F.when(F.col(c).isNull(), 1).otherwise(0) for c in inputs]
    keyed = rows.withColumns({"__h1": F.xxhash64(*there, *inputs), "__h2": F.xxhash64(F.lit(1), *there, *inputs)})
    costs = F.greatest(F.lit(1), F.coalesce(cost.cast("long"), F.lit(1))).alias("__cost")
    distinct = keyed.select("__h1", "__h2", *inputs, costs).dropDuplicates(["__h1", "__h2"]).sortWithinPartitions("__cost")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _padded_batches(frames, budget, most):
            told = list(f(batch[inputs]))
            if len(told) != len(batch):
                raise ValueError(f"the scorer gave {len(told)} rows for {len(batch)}")
            ok = [z is not None and len(z) > 0 and bool(np.isfinite(np.asarray(z, float)).all()) for z in told]
            failure = [None if good else "logits are not finite" for good in ok]
            yield pd.DataFrame({"h1": batch["__h1"].to_numpy(), "h2": batch["__h2"].to_numpy(), out: [z if good else None for z, good in zip(told, ok, strict=True)], "failure": failure, "cost": batch["__cost"].to_numpy(), "padded": int(batch["__cost"].max())})

    told = distinct.mapInPandas(run, f"h1 long, h2 long, `{out}` array<double>, failure string, cost long, padded long")
    joined = keyed.join(told, (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2")), "left")
    return joined.select(*rows.columns, out, "failure", "cost", "padded")


def padding_share(scored: DataFrame) -> DataFrame:
    """The share of what was computed that was padding."""
    return scored.agg(F.round(1 - F.sum("cost") / F.sum("padded"), 6).alias("padding"))


def modalities(rows: DataFrame) -> Column:
    """`image`, `audio`, both with a plus, or `text`: what a request brings beside its state."""
    there = [F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c[:-1]) for c in ("images", "audios") if c in rows.columns]
    combo = F.concat_ws("+", *there) if there else F.lit("")
    return F.when(combo == "", "text").otherwise(combo)


def predict_in_batches(requests: DataFrame, questions: DataFrame, name: str | Scorer, cost: Column, supports: tuple[str, ...] = (), budget: int = 16_384, most: int = 64) -> DataFrame:
    """As ``predict``, with media and batches: an error instead of an answer for an invalid question, for media of a kind that the
    scorer does not take (``supports``: image, audio), and for logits that are not finite.

    ``requests`` may have ``images`` and ``audios`` (arrays of paths, given to the scorer); ``cost`` is an expression over a row's state, instructions
    and options.
    """
    from . import metrics, questions as Q

    media = [c for c in ("images", "audios") if c in requests.columns]
    lacking = F.concat_ws(", ", *[F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c[:-1]) for c in media if c[:-1] not in supports])
    no_media = F.when(lacking != "", F.concat(F.lit("the scorer takes no "), lacking)) if media else F.lit(None).cast("string")
    rows = requests.withColumns({"modalities": modalities(requests), "__no_media": no_media}).join(questions, "request_id")
    rows = rows.withColumn("error", F.coalesce(Q.problem(F.col("question")), "__no_media")).drop("__no_media")
    good = rows.where("error is null").withColumns({"type": F.col("question.type"), "instructions": F.col("question.instructions"), "options": Q.rendered(F.col("question"))})
    good = score_in_batches(good, name, ["state", "type", "instructions", "options", *media], cost, budget, most).withColumn("error", F.col("failure"))
    names = F.when(F.col("type") == "choice", F.transform("question.criteria", lambda c: c["key"])).otherwise(F.col("options"))
    kept = ["request_id", "qid", "modalities", "type"]
    told = metrics.answers(good.withColumn("labels", names), "labels")
    told = told.select(*kept, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("choice", "score", "noul", "confidence", "probabilities")], "error", "cost", "padded")
    bad = rows.where("error is not null").select("request_id", "qid", "modalities", F.col("question.type").alias("type"), "error")
    return told.unionByName(bad, allowMissingColumns=True)


@scorer("overlap")
def overlap_scorer(frame: pd.DataFrame) -> list:
    """Words an option shares with the state: a stand-in that needs no weights."""
    out = []
    for state, options in zip(frame["state"], frame["options"], strict=True):
        words = set((state or "").lower().split())
        out.append([float(len(words & set(o.lower().split()))) for o in options])
    return out
