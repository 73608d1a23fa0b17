"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (McMahan et al., 2013).

Features are indicators of words, stems of words, pairs of neighbours and pairs that skip
one or two words, after lower-casing A-Z.  Per-coordinate rates let rare features move
fast; the L1 term leaves most weights at exactly zero, so that what is broadcast is small.
The model is fitted on a bounded sample of the labelled rows; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lakefinder.llm import linear, words as W

BITS = 20
#: Labelled rows of each class on which the model is fitted, at most (about).
SAMPLE = 3000
_U = np.uint64
#: Lengths in bytes of the beginnings of words that count as stems.
STEMS = (4, 5, 6, 7, 8)


def features(w: W.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and columns of all n-grams."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = w.doc
    parts = [(doc, w.hash, 1), *((*linear.adjacent(w, w.hash, gap), 1 + gap) for gap in (1, 2, 3))]
    for n in STEMS:
        some = np.flatnonzero(w.end - w.start >= n)
        stem = np.zeros(len(some), np.uint64)
        for k in range(n):
            stem = (stem << _U(8)) | W.LOWER[w.buf[w.start[some] + k]]
        parts.append((doc[some], W.mix(stem), 10 + n))
    return np.concatenate([p[0] for p in parts]), np.concatenate([linear.columns(h, kind, bits) for _, h, kind in parts])


def ftrl(offs: np.ndarray, cols: np.ndarray, y: np.ndarray, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, rounds: int = 4, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias after some rounds over the rows, each in another fixed order.

    The rate, the strength of L1 and the rounds were chosen by folds within training rows.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, n_bias = 0.0, 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            at = cols[offs[i] : offs[i + 1]]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y[i]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
            n_bias += g * g
            bias -= alpha / (beta + np.sqrt(n_bias)) * g
    return weights(slice(None)), bias


@dataclass
class Model:
    weights: np.ndarray  #: of each column's indicator; most are zero
    bias: float
    a: float = 1.0  #: slope and offset that calibrate the sums of weights
    b: float = 0.0

    def __getstate__(self) -> tuple:
        """What is sent is the weights that are not 0."""
        return linear.packed(self.weights), self.bias, self.a, self.b

    def __setstate__(self, state: tuple) -> None:
        weights, self.bias, self.a, self.b = state
        self.weights = linear.unpacked(*weights)

    def used(self) -> np.ndarray:
        return self.weights != 0

    def margins(self, offs: np.ndarray, cols: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[cols])))
        return sums[offs[1:]] - sums[offs[:-1]] + self.bias

    def scores(self, offs: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(offs, cols) + self.b, -60, 60)))


def fit(offs: np.ndarray, cols: np.ndarray, y: np.ndarray, bits: int = BITS) -> Model:
    """Fit to a sample; of no rows, or one class only, a model whose scores are constant."""
    if not len(y) or len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << bits), linear.platt(np.zeros(len(y)), y)[1] if len(y) else -4.0)
    # one third of the sample calibrates: L1 shrinks the weights, which leaves the plain sums too low for class 1
    unseen = np.arange(len(y)) % 3 == 0
    train, test = np.flatnonzero(~unseen), np.flatnonzero(unseen)
    margin = np.zeros(len(test))
    if len(set(y[train].tolist())) == 2:
        margin = Model(*ftrl(*linear.some_rows(offs, cols, train), y[train], bits)).margins(*linear.some_rows(offs, cols, test))
    return Model(*ftrl(offs, cols, y, bits), *linear.platt(margin, y[test]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic") -> Model:
    """Learn from the labelled documents outside the held-out fold, ``sample`` of each class at most (about)."""
    rows = linear.training_rows(docs, labels, label, sample)
    return fit(*linear.sample_matrix(rows, features, BITS, cased=False))


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless that is to be kept) with ``out`` (0 to 1; higher: likelier toxic).

    Null and empty texts have no features and get the model's bias as score.  A column
    of that name is replaced; ids, null or repeated, are not looked at.
    """
    return linear.score(docs, features, BITS, False, model, text_col, out, keep_text)


def held_out(doc_id: Column) -> Column:
    return linear.held_out(doc_id, 5, 0)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learnt from ``labels``."""
    out = toxicity_scores(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
