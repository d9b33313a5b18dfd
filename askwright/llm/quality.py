"""Quality by Naive Bayes support vectors.

A document is the set of its byte n-grams (n = 2, 3, 4; upper and lower case apart), hashed to ``DIMS`` places.  Each indicator is
scaled by the log-ratio of its smoothed counts in either class, rows are brought to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent.  A fifth of the sample is kept from the fit and turns margins
into probabilities by a logistic curve, with classes weighted as among all labelled rows.

The fit reads a bounded sample (``per_class`` rows, 64 MB); every document is scored on its whole text.  Scoring needs no
shuffle.  Defined cases: null texts are empty and have no n-grams (their score follows from the intercept); with no usable labels every
score is the smoothed base rate; empty tables give no rows; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, release, table
from .labelled import Sample, labelled_sample, logistic, probability

_BITS = 17
DIMS = (1 << 16) + 2 * (1 << _BITS)
SLICE = 1 << 20  # bytes of a text that are turned into n-grams at once


class Indicators:
    """The places of a text's n-grams, each once."""

    def __init__(self) -> None:
        self.mark = np.zeros(DIMS, bool)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, max(len(data) - 1, 0), SLICE):
            b = data[at : at + SLICE + 3].astype(np.uint32)
            two = (b[:-1] << np.uint32(8)) | b[1:]
            self.mark[two] = True
            if len(b) > 2:
                three = (two[:-1] << np.uint32(8)) | b[2:]
                self.mark[(1 << 16) + ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)).astype(np.int64)] = True
                if len(b) > 3:
                    four = (three[:-1] << np.uint32(8)) | b[3:]
                    self.mark[(1 << 16) + (1 << _BITS) + ((four * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BITS)).astype(np.int64)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [alpha + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c] or [np.zeros(0, np.int64)]), minlength=DIMS) for c in (0, 1)]
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, c: float = 1.0, epochs: int = 20, seed: int = 0) -> np.ndarray:
    """min |w|^2 / 2 + c * sum of hinge losses; the last weight is that of a constant 1."""
    w = np.zeros(dims + 1)
    sign = np.where(labels == 1, 1.0, -1.0)
    duals = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = sign[i] * (v @ w[at] + w[-1]) - 1
            new = min(max(duals[i] - slope / square[i], 0.0), c)
            if new != duals[i]:
                step = (new - duals[i]) * sign[i]
                w[at] += step * v
                w[-1] += step
                worst = max(worst, abs(new - duals[i]))
                duals[i] = new
        if worst < 1e-3:
            break
    return w


class QualityModel:
    def __init__(self, sample: Sample):
        of = Indicators()
        rows = [of(t) for t in sample.texts]
        last = np.arange(len(rows)) % 5 == 4
        fit = np.flatnonzero(~last)
        self.ratio = log_count_ratios([rows[i] for i in fit], sample.labels[fit])
        scaled = [self._scale(r) for r in rows]
        w = dual_coordinate_descent([(rows[i], scaled[i]) for i in fit], sample.labels[fit], DIMS)
        self.weights, self.bias = w[:-1].astype(np.float32), float(w[-1])
        margins = np.array([self._margin(rows[i], scaled[i]) for i in np.flatnonzero(last)]).reshape(-1, 1)
        self.curve = logistic(margins, sample.labels[last], sample.rates)

    def _scale(self, row: np.ndarray) -> np.ndarray:
        v = self.ratio[row]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def _margin(self, row: np.ndarray, v: np.ndarray) -> float:
        return float(v @ self.weights[row]) + self.bias

    def scores(self, texts, of: Indicators) -> np.ndarray:
        rows = [of(t) for t in texts]
        return probability(np.array([self._margin(r, self._scale(r)) for r in rows]).reshape(-1, 1), self.curve)


def quality_score(model: QualityModel, text: Column) -> Column:
    """The model (3 MB, whatever the input) travels with the function."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Indicators()
        for texts in batches:
            yield pd.Series(model.scores(texts, of))
        release()

    return score(F.coalesce(text, F.lit("")))


def op1_nb_svm_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = QualityModel(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_nb_svm_quality": op1_nb_svm_quality}
