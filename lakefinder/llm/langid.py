"""Language identification: a linear-chain conditional random field over the words of a text.

Each word gets a language; a text may change its language from word to word.  Features of
a word are its affixes (first and last one to three bytes), all its byte bigrams and
trigrams with marks at its ends, and lexicon features: the word itself, hashed.  Scores of
neighbours' languages are learnt transitions.  Training maximises the likelihood of the
labels (a document's language for all its words) by stochastic gradients on a bounded
sample of windows of words, taken from anywhere in the texts; forward-backward gives every
word of every whole text its probabilities.

Forward-backward runs over all texts of a piece at once.  Texts are cut into segments of
``SEGMENT`` words; products of a segment's matrices carry the state across it, so a long
text costs no longer a loop than a short one, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakefinder.llm.arrow import tidy
from lakefinder.llm import linear, words as W

BITS = 17
#: Documents of each language on which the model is fitted, at most (about), and words of a window of each.
SAMPLE, WINDOW = 1500, 48
SEGMENT = 64
#: Bytes of text worked on at once; fewer with more than ``MANY`` languages, as a segment's matrix grows with their square.
PIECE, MANY = 1 << 18, 64
_U = np.uint64

#: Words are runs of ASCII letters and of what lies beyond ASCII.
LETTERS = W.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def emissions(w: W.Words, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Scores of the languages (columns) for each word: the sums of the weights of its features."""
    if not len(w.hash):
        return np.zeros((0, weights.shape[1]), weights.dtype)
    out = np.zeros((len(w.hash), weights.shape[1]), weights.dtype)
    for word, col in word_features(w, bits):
        if word is None:
            out += weights[col]
        else:  # words in ascending order, at least one feature of each
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(weights[col], first, axis=0)
    return out


def word_features(w: W.Words, bits: int) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """(words, columns) of the features, kind by kind; None: one for each word."""
    low = W.LOWER[w.buf].astype(np.uint64)
    n = w.end - w.start
    yield None, linear.columns(w.hash, 1, bits)
    yield None, np.full(len(n), linear.columns(np.zeros(1, np.uint64), 2, bits)[0])  # of every word
    for k in (1, 2, 3):
        front, back = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        for j in range(k):
            inside = j < n
            front = (front << _U(8)) | np.where(inside, low[np.minimum(w.start + j, w.end - 1)], 0).astype(np.uint64)
            back = (back << _U(8)) | np.where(inside, low[np.maximum(w.end - 1 - j, w.start)], 0).astype(np.uint64)
        yield None, linear.columns(front, 10 + k, bits)
        yield None, linear.columns(back, 20 + k, bits)
    ends = np.cumsum(n)
    word = np.repeat(np.arange(len(n)), n)
    at = np.repeat(w.start - ends + n, n) + np.arange(ends[-1])  # positions of the words' bytes
    last = np.zeros(len(at), bool)
    last[ends - 1] = True
    one = low[at]
    two = np.where(last, 1, one[np.minimum(np.arange(len(at)) + 1, len(at) - 1)]).astype(np.uint64)
    yield word, linear.columns((one << _U(8)) | two, 30, bits)
    past = last | np.concatenate((last[1:], [True]))
    three = np.where(past, 1, one[np.minimum(np.arange(len(at)) + 2, len(at) - 1)]).astype(np.uint64)
    yield word, linear.columns((one << _U(16)) | (two << _U(8)) | three, 31, bits)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  #: a row for each feature, a column for each language
    moves: np.ndarray  #: score of language j after language i
    start: np.ndarray  #: score of the first word's language

    def word_probabilities(self, w: W.Words) -> np.ndarray:
        """Forward-backward: the probability of each language for each word of the piece."""
        return forward_backward(emissions(w, self.weights), w.offs, self.moves, self.start)[0]


def forward_backward(scores: np.ndarray, offs: np.ndarray, moves: np.ndarray, start: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label probabilities for rows of scores, and normalised forward states; text d is rows offs[d] to offs[d + 1]."""
    total, k = scores.shape
    post, alpha = np.zeros((total, k)), np.zeros((total, k))
    lengths = np.diff(offs)
    texts = np.flatnonzero(lengths)
    if not len(texts):
        return post, alpha
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)).astype(np.float64)
    trans = np.exp(moves - moves.max())
    n_seg = -(-lengths[texts] // segment)
    text_of = np.repeat(np.arange(len(texts)), n_seg)
    head = np.cumsum(n_seg) - n_seg  # each text's first segment
    nth = np.arange(len(text_of)) - head[text_of]
    begin = offs[texts][text_of] + nth * segment
    size = np.minimum(segment, offs[texts + 1][text_of] - begin)

    def longest_first(n: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """An order, and how many have more than t elements, for each t."""
        order = np.argsort(-n, kind="stable")
        return order, np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left").tolist()

    def forward(seg: np.ndarray, state: np.ndarray, fresh: bool) -> np.ndarray:
        """Fill alpha for the segments, from the states before them (fresh: scores of the first label); the last states."""
        order, active = longest_first(size[seg])
        at, now = begin[seg][order], state[order]
        for t, a in enumerate(active):
            into = (now[:a] if fresh and not t else now[:a] @ trans) * emit[at[:a] + t]
            now[:a] = alpha[at[:a] + t] = into / into.sum(axis=1, keepdims=True)
        out = np.empty_like(now)
        out[order] = now
        return out

    ends = forward(head, np.broadcast_to(np.exp(start - start.max()), (len(texts), k)), True)
    later = np.flatnonzero(nth)
    after = np.ones((len(begin), k))  # from a segment's last label on
    if len(later):
        # products of the matrices of each later segment
        order, active = longest_first(size[later])
        prod = np.broadcast_to(np.eye(k), (len(later), k, k)).copy()
        at = begin[later][order]
        for t, a in enumerate(active):
            step = (prod[:a].reshape(-1, k) @ trans).reshape(a, k, k) * emit[at[:a] + t][:, None, :]
            prod[:a] = step / step.sum(axis=(1, 2), keepdims=True)
        whole = np.empty((len(begin), k, k))
        whole[later[order]] = prod
        by_text, active = longest_first(n_seg)
        before = np.empty((len(begin), k))
        for r, a in list(enumerate(active))[1:]:
            t = by_text[:a]
            before[head[t] + r] = ends[t]
            end = np.einsum("ti,tij->tj", ends[t], whole[head[t] + r])
            ends[t] = end / end.sum(axis=1, keepdims=True)
        forward(later, before[later], False)
        tails = np.ones((len(texts), k))
        for r, a in list(enumerate(active))[:0:-1]:
            t = by_text[:a]
            after[head[t] + r] = tails[t]
            tail = np.einsum("tij,tj->ti", whole[head[t] + r], tails[t])
            tails[t] = tail / tail.sum(axis=1, keepdims=True)
        after[head] = tails
    order, active = longest_first(size)
    now, last = after[order], (begin + size - 1)[order]
    for t, a in enumerate(active):
        at = last[:a] - t
        both = alpha[at] * now[:a]
        post[at] = both / both.sum(axis=1, keepdims=True)
        back = (now[:a] * emit[at]) @ trans.T
        now[:a] = back / back.sum(axis=1, keepdims=True)
    return post, alpha


def fit(col: pa.Array, langs: list[str], labels: np.ndarray, rounds: int = 4, rate: float = 0.5, seed: int = 1) -> Model:
    """Learn from windows of words; labels: number of the language of each window.

    AdaGrad on the negative log-likelihood of the label sequences.  To show the model what
    a change of language is, every other window is put together from halves of two.
    """
    k = len(langs)
    weights, moves, start = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    speed, speed_m, speed_s = np.full((1 << BITS, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    pieces = list(W.words(col, LETTERS, limit=PIECE))
    rnd = np.random.default_rng(seed)
    for r in range(rounds):
        for w in pieces:
            feats = list(word_features(w, BITS))
            lengths = np.diff(w.offs)
            pick = rnd.permutation(len(lengths))
            for some in np.array_split(pick, max(1, len(pick) // 64)):
                some = some[lengths[some] > 0]
                if not len(some):
                    continue
                chosen = np.concatenate([np.arange(w.offs[d], w.offs[d + 1]) for d in some])
                y = np.repeat(labels[w.first + some], lengths[some])
                # every other text goes on in the next one: the seam is a change of language
                joined = np.concatenate(([0], np.cumsum(lengths[some])))
                offs = np.unique(np.concatenate((joined[::2], joined[-1:]))) if r % 2 else joined
                cols, rows = _features_of(feats, chosen, len(w.hash))
                score = np.zeros((len(chosen), k))
                np.add.at(score, rows, weights[cols])
                p, alpha = forward_backward(score, offs, moves, start)
                grad = p.copy()
                grad[np.arange(len(y)), y] -= 1
                grad /= len(some)
                hit, own = np.unique(cols, return_inverse=True)
                g = np.zeros((len(hit), k))
                np.add.at(g, own, grad[rows])
                speed[hit] += g**2
                weights[hit] -= rate * (g + 1e-5 * weights[hit]) / np.sqrt(speed[hit])
                inner = np.ones(len(chosen), bool)
                inner[offs[:-1]] = False
                b = np.flatnonzero(inner)
                # P(i, j) of neighbours is alpha(i) move(i, j) times what makes the second margin right
                trans = np.exp(moves - moves.max())
                gm = trans * (alpha[b - 1].T @ (p[b] / (alpha[b - 1] @ trans)))
                np.add.at(gm, (y[b - 1], y[b]), -1)
                gm /= len(some)
                speed_m += gm**2
                moves -= rate * gm / np.sqrt(speed_m)
                gs = (p[offs[:-1]].sum(axis=0) - np.bincount(y[offs[:-1]], minlength=k)) / len(some)
                speed_s += gs**2
                start -= rate * gs / np.sqrt(speed_s)
    return Model(langs, weights.astype(np.float32), moves, start)


def _features_of(feats: list, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the chosen words' features, and the place of the word each belongs to."""
    place = np.full(n, -1)
    place[chosen] = np.arange(len(chosen))
    cols, rows = [], []
    for word, col in feats:
        if word is None:
            cols.append(col[chosen])
            rows.append(np.arange(len(chosen)))
        else:
            own = place[word]
            cols.append(col[own >= 0])
            rows.append(own[own >= 0])
    return np.concatenate(cols), np.concatenate(rows)


def held_out(doc_id: Column) -> Column:
    return linear.held_out(doc_id, 3, 1)


def training_windows(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> DataFrame:
    """(lang, text) windows for fitting: about ``sample`` documents of each language outside the held-out fold.

    Documents are taken by a hash of their id, and of each a window of ``window`` blanks-separated
    words from a place that another hash gives, so all parts of texts are alike.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    size = own.groupBy("lang").agg(F.count("*").alias("n"))
    share = size.select("lang", F.floor(F.least(F.lit(float(1 << 30)), F.lit(float((1 << 30) * sample)) / F.col("n"))).alias("share"))
    chosen = own.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share"))
    parts = chosen.withColumn("parts", F.split("text", r"\s+"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.size("parts") - window + 1, F.lit(1))).cast("int") + 1
    return parts.select("lang", "doc_id", F.array_join(F.slice("parts", place, F.lit(window)), " ").alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> Model:
    """Learn from text and non-null lang of documents outside the held-out fold; no such rows, a model of no languages.

    Every such lang is learnt, however rare.  The driver holds 2 MB for each, a worker 0.5 MB.
    """
    got = training_windows(docs, sample, window).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    mixed = np.random.default_rng(7).permutation(len(got))
    got = got.take(pa.array(mixed))
    number = {x: i for i, x in enumerate(langs)}
    return fit(got.column("text").combine_chunks(), langs, np.array([number[x] for x in got.column("lang").to_pylist()]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", runs: bool = False) -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``; with ``runs`` also the words' languages.

    lang_pred has the largest share of the words' probabilities, score is that share.  A text
    that is null or has no letter (ASCII letters and what is beyond ASCII count) gets ``und``
    and 0.  runs: array of (lang, first byte, end byte) of successive words of one language,
    the most probable for each word.  Ties go to the language that sorts first.
    """
    kept = [f for f in docs.schema if f.name not in (text_col, "lang_pred", "score", "runs")]
    added = ["lang_pred string", "score double"] + ["runs array<struct<lang:string,first:int,end:int>>"] * runs
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join(added))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.langs)
        for batch in batches:
            langs, scores, spans = [], [], []
            for w in W.words(batch.column(len(kept)), LETTERS, limit=max(1 << 14, int(PIECE * min(1.0, (MANY / max(k, 1)) ** 2)))):
                n = np.diff(w.offs)
                if not k:
                    langs += ["und"] * len(n)
                    scores.append(np.zeros(len(n)))
                    spans += [[] for _ in n] if runs else []
                    continue
                p = model.word_probabilities(w)
                sums = np.concatenate((np.zeros((1, k)), np.cumsum(p, axis=0)))
                share = (sums[w.offs[1:]] - sums[w.offs[:-1]]) / np.maximum(n, 1)[:, None]
                best = share.argmax(axis=1)
                spoken = has_letter(w)
                langs += [model.langs[b] if m else "und" for b, m in zip(best.tolist(), spoken.tolist(), strict=True)]
                scores.append(np.where(spoken, np.clip(share[np.arange(len(n)), best], 0, 1), 0.0))
                if runs:
                    spans += _runs(w, p.argmax(axis=1), model.langs)
            columns = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            columns += [pa.array(spans, run_type)] * runs
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*(f.name for f in kept), "lang_pred", "score", *["runs"] * runs])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


_ASCII_LETTER = W.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def has_letter(w: W.Words) -> np.ndarray:
    """Which texts have a letter of any script; texts without ASCII letters are looked at by character."""
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[w.buf])))
    out = seen[w.bounds[1:]] > seen[w.bounds[:-1]]
    for d in np.flatnonzero(~out & (np.diff(w.offs) > 0)):
        out[d] = any(map(str.isalpha, w.buf[w.bounds[d] : w.bounds[d + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _runs(w: W.Words, label: np.ndarray, langs: list[str]) -> list[list[dict]]:
    out = []
    for d in range(w.last - w.first):
        a, b, base = int(w.offs[d]), int(w.offs[d + 1]), int(w.bounds[d])
        cut = (a + np.flatnonzero(np.diff(label[a:b], prepend=-1))).tolist()
        out.append([{"lang": langs[label[i]], "first": int(w.start[i]) - base, "end": int(w.end[j - 1]) - base} for i, j in zip(cut, [*cut[1:], b], strict=False)])
    return out


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model learnt from the others' lang."""
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
