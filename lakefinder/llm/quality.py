"""Quality classifier: a support vector machine on Naive Bayes features (NB-SVM; Wang and Manning, 2012).

Features are indicators of n-grams: words and pairs of words, the ends of words, runs of
word shapes, and runs of repetition (whether successive words are the same).  Each
indicator is scaled by the log ratio of its smoothed frequencies in the two classes, and a
linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al., 2008).  The
model is fitted on a bounded sample of the labelled rows; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lakefinder.llm import linear, words as W

BITS = 18
#: Labelled rows of each class on which the model is fitted, at most (about).
SAMPLE = 4000
_U = np.uint64

#: Classes of bytes for word shapes: 0 lower case, 1 upper case, 2 digit, 3 beyond ASCII, 4 and up: other signs by themselves.
_KIND = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 4 + b for b in range(256)], np.int64)


def features(w: W.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and columns of all n-grams; the words' hashes must be those of the text as it is written."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, n = w.doc, w.end - w.start
    first, last, second = _KIND[w.buf[w.start]], _KIND[w.buf[w.end - 1]], _KIND[w.buf[np.minimum(w.start + 1, w.end - 1)]]
    before = _KIND[w.buf[np.maximum(w.end - 2, w.start)]]
    shape = (((first * 256 + second) * 256 + before) * 256 + last) * 4 + np.minimum(n - 1, 3)
    shape = W.mix(shape.astype(np.uint64))
    tail = (w.buf[np.maximum(w.end - 3, w.start)].astype(np.uint64) << _U(16)) | (w.buf[np.maximum(w.end - 2, w.start)].astype(np.uint64) << _U(8)) | w.buf[w.end - 1]
    again = np.concatenate((w.hash[1:] == w.hash[:-1], [False]))
    again[doc != np.concatenate((doc[1:], [-1]))] = False
    size = W.mix(np.frexp(np.diff(w.offs).astype(float))[1].astype(np.uint64))  # of the text in words, by powers of two
    parts = [(doc, w.hash, 1), (*linear.adjacent(w, w.hash), 2), (doc, W.mix(tail), 3), (doc, shape, 4), (*linear.adjacent(w, shape), 5), (np.arange(len(size)), size, 8)]
    same = again.astype(np.uint64) + _U(1)
    parts.append((doc, W.mix(same), 6))
    parts.append((*linear.adjacent(w, same), 7))
    return np.concatenate([p[0] for p in parts]), np.concatenate([linear.columns(h, kind, bits) for _, h, kind in parts])


def log_count_ratio(offs: np.ndarray, cols: np.ndarray, y: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    """log((n1 + s) / |n1 + s|) - log((n0 + s) / |n0 + s|) for each column, of the rows that have it; 0 for a column that no row has."""
    label = np.repeat(y, np.diff(offs))
    n1 = np.bincount(cols[label == 1], minlength=1 << bits) + smooth
    n0 = np.bincount(cols[label == 0], minlength=1 << bits) + smooth
    ratio = np.log(n1 / n1.sum()) - np.log(n0 / n0.sum())
    ratio[n1 + n0 == 2 * smooth] = 0.0
    return ratio


def dual_coordinate_descent(offs: np.ndarray, cols: np.ndarray, y: np.ndarray, scale: np.ndarray, c: float = 0.1, rounds: int = 10, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model of indicator rows scaled by column, each of unit length.

    Classes weigh the same in all: an error in the smaller one costs more.
    """
    rows = len(y)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.maximum([(y == 0).sum(), (y == 1).sum()], 1)
    cost = c * rows / 2 / share[y]
    norm = np.zeros(rows)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(rows)
    own = [cols[offs[i] : offs[i + 1]] for i in range(rows)]
    for i in range(rows):
        norm[i] = 1 / np.sqrt(np.square(scale[own[i]]).sum() + 1e-12) if len(own[i]) else 0.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(rows):
            x = scale[own[i]] * norm[i]
            gradient = sign[i] * (w[own[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (1.0 + bool(len(x))), 0.0), cost[i])
            step = new - alpha[i]
            if step:
                most = max(most, abs(step) / cost[i])
                alpha[i] = new
                w[own[i]] += step * sign[i] * x
                bias += step * sign[i]
        if most < 0.01:
            break
    return w, bias


@dataclass
class Model:
    weights: np.ndarray  #: of each column's indicator, the ratio included
    ratio: np.ndarray  #: the log-count ratio, for the length of a row
    bias: float
    a: float
    b: float

    def __getstate__(self) -> tuple:
        """What is sent is the columns that were learnt."""
        return linear.packed(self.weights), linear.packed(self.ratio), self.bias, self.a, self.b

    def __setstate__(self, state: tuple) -> None:
        weights, ratio, self.bias, self.a, self.b = state
        self.weights, self.ratio = linear.unpacked(*weights), linear.unpacked(*ratio)

    def used(self) -> np.ndarray:
        """Columns with a ratio count, if only for the length of the row."""
        return self.ratio != 0

    def margins(self, offs: np.ndarray, cols: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[cols])))
        squares = np.concatenate(([0.0], np.cumsum(np.square(self.ratio[cols]))))
        length = np.sqrt(squares[offs[1:]] - squares[offs[:-1]] + 1e-12)
        return (sums[offs[1:]] - sums[offs[:-1]]) / length + self.bias

    def scores(self, offs: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(offs, cols) + self.b, -60, 60)))


def fit(offs: np.ndarray, cols: np.ndarray, y: np.ndarray, bits: int = BITS) -> Model:
    """Fit to a sample; of no rows, or one class only, a model whose scores are constant."""
    if not len(y) or len(set(y.tolist())) < 2:
        a, b = linear.platt(np.zeros(len(y)), y)
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), 0.0, a, b)
    ratio = log_count_ratio(offs, cols, y, bits)
    # margins for calibration come from rows that the model they come from has not seen
    unseen = np.arange(len(y)) % 3 == 0
    train, test = np.flatnonzero(~unseen), np.flatnonzero(unseen)
    margin = np.zeros(len(test))
    if len(set(y[train].tolist())) == 2:
        o, c = linear.some_rows(offs, cols, train)
        r = log_count_ratio(o, c, y[train], bits)
        w, bias = dual_coordinate_descent(o, c, y[train], r)
        margin = Model(w * r, r, bias, 1, 0).margins(*linear.some_rows(offs, cols, test))
    w, bias = dual_coordinate_descent(offs, cols, y, ratio)
    return Model(w * ratio, ratio, bias, *linear.platt(margin, y[test]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Learn from the labelled documents outside the held-out fold, ``sample`` of each class at most (about)."""
    rows = linear.training_rows(docs, labels, label, sample)
    return fit(*linear.sample_matrix(rows, features, BITS, cased=True))


def quality_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless that is to be kept) with ``out`` (0 to 1; higher: likelier of quality).

    Null and empty texts have no features but their length; they are scored by that.  A
    column of that name is replaced; ids, null or repeated, are not looked at.
    """
    return linear.score(docs, features, BITS, True, model, text_col, out, keep_text)


def held_out(doc_id: Column) -> Column:
    return linear.held_out(doc_id, 5, 0)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learnt from ``labels``."""
    out = quality_scores(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
