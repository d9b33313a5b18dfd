"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, lower-cased; every other character, blanks of all kinds included, separates them, in the fit
and in scoring alike.  A token's features are the character n-grams (4 to 8) of the token with a blank on either side, so beginnings and
ends are told from middles, and the n-grams of the tokens before and after it.

Documents are labelled, tokens are not: the token labels come from held-out evidence.  The sample is cut in two halves; an
n-gram is evidence of a half when it is ``sure`` times as frequent in its toxic documents as in others, and it labels tokens
in toxic documents of the *other* half.  A field fitted on these labels then labels the halves anew by its marginals, each by the field
of the other half, and the last field is fitted on those.  So no label is read off a feature that was chosen on the same
document.  The field (two tags, transitions, a weight for each feature of a token and of its neighbours that is ``ratio`` times as
frequent in toxic documents of the sample) is fitted by proximal gradient ascent with an L1 penalty and forward-backward marginals; most weights end at zero.

The fit reads a bounded sample (see ``labelled_sample``), of which ``windows`` windows of ``width`` tokens, ``spots`` about
evidence and one at random a document; every document is scored on its whole text.  Scoring finds the features that have weights by one
Aho-Corasick pass.  Between tokens that no such feature touches all potentials are equal, so forward-backward goes through each gap
by a power of one 2x2 matrix: exact for the field, in time that follows the length of the text and the number of features found.
Marginals give offending spans; their expected number, their share of the tokens, the largest one and the text's length give the
document's score through a logistic curve fitted on a kept fifth of the sample.

Defined cases: null texts are empty; empty texts, and those without a token, get the curve's value for no evidence; with no usable
labels the score is the smoothed base rate; documents with both labels are not learnt from; equal rows get equal scores; ties in a
maximum change nothing; an empty table gives no rows; only id and text are read, so extra columns of any name are not touched;
labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_process, release, table
from .labelled import Sample, labelled_sample, logistic, probability

_GRAMS = range(4, 9)


def _features(token: str) -> set[str]:
    padded = f" {token} "
    return {padded[i : i + n] for n in _GRAMS for i in range(len(padded) - n + 1)} or {padded}


def _code_points() -> np.ndarray:
    """The small letter or digit of each character, a blank for every character that is neither.

    A character whose small form is longer stays as it is, so offsets hold.
    """
    out = np.full(0x110000, 32, "<u4")
    for i, c in enumerate(map(chr, range(0x110000))):
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _spaced(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Lower-cased and cut to letters and digits, one blank before and after; and begin and end of each token there."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    codes = per_process("toxicity_code_points", _code_points)[codes]
    edge = np.diff((codes != 32).view(np.int8))
    return codes.tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def _forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, t) of tag 1 and pair marginals summed over windows (2, 2); e: (n, t) potentials of tag 1."""
    n, t = e.shape
    psi = np.exp(np.stack([np.zeros_like(e), np.clip(e, -30, 30)], axis=2))
    a = np.exp(trans)
    alpha, scale = np.empty((n, t, 2)), np.empty((n, t, 1))
    for i in range(t):
        x = (np.exp(start) if i == 0 else alpha[:, i - 1] @ a) * psi[:, i]
        scale[:, i] = x.sum(1, keepdims=True)
        alpha[:, i] = x / scale[:, i]
    beta = np.ones((n, t, 2))
    pairs = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        x = psi[:, i + 1] * beta[:, i + 1]
        pairs += a * np.einsum("nj,nk->jk", alpha[:, i] / scale[:, i + 1], x)
        beta[:, i] = (x @ a.T) / scale[:, i + 1]
    gamma = alpha * beta
    return gamma[:, :, 1] / gamma.sum(2), pairs


class Matcher:
    """Finds features in spaced texts by one Aho-Corasick pass."""

    def __init__(self, names):
        self.names = list(names)
        self.find = ahocorasick.Automaton()
        for i, f in enumerate(self.names):
            self.find.add_word(f, (i, len(f) - 2 if f[0] == " " else len(f) - 1))  # back to a character of the token
        if self.names:
            self.find.make_automaton()

    def __call__(self, low: str) -> tuple[np.ndarray, np.ndarray]:
        """(a place inside the token, feature) of each occurrence."""
        found = [(end - back, i) for end, (i, back) in self.find.iter(low)] if self.names else []
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def distinct(self, low: str) -> list[int]:
        return list({i for _, (i, _) in self.find.iter(low)}) if self.names else []

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Which tokens have a feature."""
        out = np.zeros(len(tokens), bool)
        low, begin, _ = _spaced(" ".join(tokens))
        out[np.searchsorted(begin, self(low)[0], side="right") - 1] = True
        return out


def _frequent(fit: list[tuple[list[str], int]], halves: int, wanted: list[tuple[tuple[int, ...], float]], least: float = 0.006) -> list[list[str]]:
    """For each (halves, ratio) of ``wanted``: features in 3 and in ``least`` of the toxic documents of these halves whose rate there
    is ``ratio`` times that among the others.

    Rates are smoothed by one half; of fewer than 200 toxic documents a smaller ratio is asked.  Documents are dealt to halves in turn.
    """
    n = np.array([[sum(y == k for _, y in fit[h::halves]) for h in range(halves)] for k in (0, 1)])
    toxic = [Counter() for _ in range(halves)]
    for i, (tokens, y) in enumerate(fit):
        if y and tokens:
            toxic[i % halves].update(set().union(*map(_features, set(tokens))))
    floor = [max(3, least * n[1, list(of)].sum()) for of, _ in wanted]
    names = sorted(f for f in set().union(*toxic) if any(sum(toxic[h][f] for h in of) >= low for (of, _), low in zip(wanted, floor, strict=True)))
    match = Matcher(names)
    there = np.array([[c[f] for f in names] for c in toxic]).reshape(halves, len(names))
    other = np.zeros_like(there)
    for i, (tokens, y) in enumerate(fit):
        if not y and tokens:
            other[i % halves, match.distinct(f" {' '.join(set(tokens))} ")] += 1
    out = []
    for (of, ratio), low in zip(wanted, floor, strict=True):
        clean, bad = n[:, list(of)].sum(1)
        asked = 1 + (ratio - 1) * min(1.0, bad / 200) ** 0.5
        c, o = there[list(of)].sum(0), other[list(of)].sum(0)
        hit = (c >= low) & ((c + 0.5) / (bad + 1) >= asked * (o + 0.5) / (clean + 1)) if clean and bad else np.zeros(len(names), bool)
        out.append([names[i] for i in np.flatnonzero(hit)])
    return out


class _Windows:
    """Windows of tokens with a label each, and the features of the distinct tokens."""

    def __init__(self, rows: list[list[str]], labels: list[np.ndarray], names: list[str], width: int):
        self.names = names
        self.y, self.real = np.zeros((len(rows), width)), np.zeros((len(rows), width), bool)
        types: dict[str, int] = {"": 0}  # beyond the ends of a window
        self.token = np.zeros((len(rows), width + 2), np.int64)
        for i, (row, y) in enumerate(zip(rows, labels, strict=True)):
            self.y[i, : len(row)], self.real[i, : len(row)] = y, True
            self.token[i, 1 : len(row) + 1] = [types.setdefault(t, len(types)) for t in row]
        self.types = len(types)
        index = {f: i for i, f in enumerate(names)}
        pairs = [(t, index[f]) for token, t in types.items() if token for f in _features(token) if f in index]
        self.of, self.which = np.array(pairs, np.int64).reshape(-1, 2).T

    def potentials(self, w: np.ndarray) -> np.ndarray:
        """Of each place: the weights of its token, of the one before and of the one after."""
        own, before, after = (np.bincount(self.of, x[self.which], minlength=self.types) for x in w)
        return own[self.token[:, 1:-1]] + before[self.token[:, :-2]] + after[self.token[:, 2:]]

    def gradient(self, miss: np.ndarray) -> np.ndarray:
        sides = (self.token[:, 1:-1], self.token[:, :-2], self.token[:, 2:])
        by_type = [np.bincount(t.ravel(), miss.ravel(), minlength=self.types) for t in sides]
        return np.stack([np.bincount(self.which, x[self.of], minlength=len(self.names)) for x in by_type])


class ToxicField:
    def __init__(self, sample: Sample, width: int = 24, windows: int = 6000, spots: int = 8, rounds: int = 70, penalty: float = 2.0, sure: float = 25.0, ratio: float = 3.0, seed: int = 0):
        self.weights: dict[str, tuple[float, float, float]] = {}  # of a token's own n-gram, of the one before, of the one after
        self.bias, self.trans, self.start = -4.0, np.zeros((2, 2)), np.zeros(2)
        self._prepare()
        last = np.arange(len(sample.texts)) % 5 == 4
        fit = [(_spaced(sample.texts[i])[0].split(), int(sample.labels[i])) for i in np.flatnonzero(~last)]
        names, *evidence = _frequent(fit, 2, [((0, 1), ratio), ((0,), sure), ((1,), sure)])
        halves, evidence = [fit[::2], fit[1::2]], [Matcher(e) for e in evidence]
        if any(e.names for e in evidence):
            rng = np.random.default_rng(seed)
            told = [self._cut(half, e.tokens, e.tokens, width, windows // 2, spots, rng) for half, e in zip(halves, evidence[::-1], strict=True)]
            first = []
            for rows in told:
                field = ToxicField.__new__(ToxicField)
                field.start = self.start
                field._train(*rows, names, width, rounds, penalty)
                field._prepare()
                first.append(field)
            told = [self._cut(half, e.tokens, field._tags, width, windows // 2, spots, rng) for half, e, field in zip(halves, evidence[::-1], first[::-1], strict=True)]
            self._train([r for rows, _ in told for r in rows], [y for _, labels in told for y in labels], names, width, rounds, penalty)
        self._prepare()
        scored = np.array([self.read(sample.texts[i])[0] for i in np.flatnonzero(last)]).reshape(-1, 4)
        self.curve = logistic(scored, sample.labels[last], sample.rates)

    def _tags(self, tokens: list[str]) -> np.ndarray:
        """Tokens that this field holds for toxic."""
        out = np.zeros(len(tokens), bool)
        at, marginal = self._marginals(*_spaced(" ".join(tokens))[:2])
        out[at] = marginal >= 0.5
        return out

    @staticmethod
    def _cut(half, marks, tags, width: int, windows: int, spots: int, rng) -> tuple[list[list[str]], list[np.ndarray]]:
        """Windows about marked tokens and at random; only tokens of toxic documents can be toxic."""
        rows, labels = [], []
        for tokens, y in half:
            if not tokens:
                continue
            toxic = tags(tokens) if y else np.zeros(len(tokens), bool)
            marked = np.flatnonzero(toxic | marks(tokens))
            marked = rng.permutation(marked)[:spots]
            for at in [*marked.tolist(), int(rng.integers(len(tokens)))]:
                begin = max(0, at - int(rng.integers(width)))
                rows.append(tokens[begin : begin + width])
                labels.append(toxic[begin : begin + width])
        pick = rng.permutation(len(rows))[:windows]
        return [rows[i] for i in pick], [labels[i] for i in pick]

    def _train(self, rows: list[list[str]], labels: list[np.ndarray], names: list[str], width: int, rounds: int, penalty: float) -> None:
        of = _Windows(rows, labels, names, width)
        y, real = of.y, of.real
        w, bias, trans = np.zeros((3, len(of.names))), -3.0, np.zeros((2, 2))
        sums = [np.full_like(w, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
        told = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
        pad = (~real[:, 1:]).sum()
        for _ in range(rounds):
            e = of.potentials(w) + bias
            e[~real] = -30.0  # beyond the end of a short window the tag is 0
            p, pairs = _forward_backward(e, trans, self.start)
            pairs[0, 0] -= pad  # pairs that end in the padding
            miss = np.where(real, y - p, 0.0)
            grads = [of.gradient(miss), miss.sum() - 0.01 * bias, told - pairs - 0.1 * trans]
            for k, g in enumerate(grads):
                sums[k] = sums[k] + g * g
            step = 0.5 / np.sqrt(sums[0])
            w = w + step * grads[0]
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)  # the proximal step of the L1 penalty
            bias, trans = bias + 0.5 * grads[1] / np.sqrt(sums[1]), trans + 0.2 * grads[2] / np.sqrt(sums[2])
        keep = np.flatnonzero((w != 0).any(0))
        self.weights = {of.names[i]: tuple(w[:, i].tolist()) for i in keep}
        self.bias, self.trans = float(bias), trans

    def _prepare(self) -> None:
        self._plain = np.exp(self.trans) * np.exp(np.array([0.0, min(self.bias, 30.0)]))
        self._plain /= np.abs(np.linalg.eigvals(self._plain)).max()
        self._powers: dict[int, np.ndarray] = {}
        self._find = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_find", "_powers", "_table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._powers, self._find = {}, None

    def _power(self, n: int) -> np.ndarray:
        if n not in self._powers:
            if len(self._powers) > 20_000:
                self._powers.clear()
            self._powers[n] = np.linalg.matrix_power(self._plain, n)
        return self._powers[n]

    def _matcher(self):
        if self._find is None:
            self._find = Matcher(self.weights)
            self._table = np.array(list(self.weights.values())).reshape(-1, 3)
        return self._find

    def _potentials(self, low: str, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that a feature touches, itself or from a neighbour, and the sum of its weights there."""
        place, which = self._matcher()(low)
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.unique((np.searchsorted(begin, place, side="right") - 1) * len(self.weights) + which)  # a feature counts once a token
        token, weight = both // len(self.weights), self._table[both % len(self.weights)]
        at = np.concatenate([token, token + 1, token - 1])
        weight = weight.T.ravel()
        some = (weight != 0) & (at >= 0) & (at < len(begin))
        spots, back = np.unique(at[some], return_inverse=True)
        return spots, np.bincount(back, weight[some], minlength=len(spots))

    def _marginals(self, low: str, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that a feature touches and their marginals."""
        spots, weight = self._potentials(low, begin)
        if not len(spots):
            return spots, weight
        psi = np.ones((len(spots), 2))
        psi[:, 1] = np.exp(np.minimum(30.0, self.bias + weight))
        gaps = np.diff(spots, prepend=-1) - 1
        tail = len(begin) - 1 - int(spots[-1])
        step = np.exp(self.trans)
        alphas, state = np.empty((len(spots), 2)), None
        for k, g in enumerate(gaps.tolist()):
            if state is None and g:
                state = np.array([1.0, np.exp(min(self.bias, 30.0))]) @ self._power(g - 1)
            elif g:
                state = state @ self._power(g)
            state = psi[k] if state is None else (state @ step) * psi[k]
            state = state / state.sum()
            alphas[k] = state
        beta, out = self._power(tail) @ np.ones(2), np.empty(len(spots))
        for k in range(len(spots) - 1, -1, -1):
            both = alphas[k] * beta
            out[k] = both[1] / both.sum()
            beta = self._power(int(gaps[k])) @ (step @ (psi[k] * beta))
            beta = beta / beta.sum()
        return spots, out

    def read(self, text: str) -> tuple[tuple[float, float, float, float], list[tuple[int, int, float]]]:
        """(evidence of the document, (begin, end, marginal) of each token with a feature); offsets in characters."""
        low, begin, end = _spaced(text)
        spots, marginals = self._marginals(low, begin)
        length = float(np.log1p(len(text)))
        if not len(spots):
            return (0.0, -8.0, length, -8.0), []
        top, total = min(max(float(marginals.max()), 1e-9), 1 - 1e-9), float(marginals.sum())
        share = float(np.log(max(total / len(begin), np.exp(-8.0))))
        spans = [(int(b) - 1, int(e) - 1, float(m)) for b, e, m in zip(begin[spots], end[spots], marginals, strict=True)]
        return (float(np.log1p(total)), float(np.clip(np.log(top / (1 - top)), -8, 8)), length, share), spans

    def score(self, evidence) -> np.ndarray:
        return probability(np.array(evidence, float).reshape(-1, 4), self.curve)


_TOLD = "struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>"


def toxicity(field: ToxicField, text: Column, least: float = 0.5) -> Column:
    """A struct: score, and spans (character offsets) whose marginal is ``least`` or more.  The field travels with the function."""
    @F.pandas_udf(_TOLD)
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            read = [field.read(t) for t in texts]
            yield pd.DataFrame({"score": field.score([r[0] for r in read]), "spans": [[{"start": b, "end": e, "marginal": m} for b, e, m in r[1] if m >= least] for r in read]})
        release()

    return tell(F.coalesce(text, F.lit("")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, **options) -> ToxicField:
    return ToxicField(labelled_sample(docs, labels, "toxic", **options))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    field = fit_toxicity(docs, labels)
    return docs.where(toxicity(field, docs["text"])["score"] < threshold)


def op4_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(field, F.col("text")).alias("told"))
    return told.select("doc_id", "held_out", "told.score", (F.col("told.score") >= 0.3).cast("int").alias("predicted"), "told.spans")


ORACLE: dict[str, str] = {}
QUERIES = {"op4_crf_toxicity": op4_crf_toxicity}
