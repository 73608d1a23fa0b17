"""Held-out accuracy, calibration of the algorithms, and edge cases of the three classifiers."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakefinder.llm import langid, linear, quality, toxicity, words as W

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.mark.parametrize("module, label, least, each", [(quality, "quality", 0.98, 0.93), (toxicity, "toxic", 0.97, 0.8)])
def test_held_out_accuracy(tables, module, label, least, each):
    docs, labels = tables
    rows = module.classify(docs, labels).join(labels, "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in own) / len(own) >= least
    for y in (0, 1):
        mine = [r for r in own if r[label] == y]
        assert sum(r.predicted == y for r in mine) / len(mine) >= each


def test_languages(tables):
    docs, _ = tables
    rows = langid.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in own) / len(own) >= 0.97


def test_every_language_is_learnt(spark):
    """Seventy languages, the last six with fewer documents than the others."""
    rnd = random.Random(9)
    rows = []
    for i in range(70):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 8)
        words = ["".join(rnd.choices(letters, k=rnd.randrange(3, 9))) for _ in range(30)]
        rows += [(100 * i + d, f"l{i:02d}", " ".join(rnd.choices(words, k=40))) for d in range(12 if i < 64 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert model.langs == [f"l{i:02d}" for i in range(70)]
    got = langid.identify(docs.where("lang >= 'l64'"), model).collect()
    assert len(got) == 48 and sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("classify", [lambda d, y: quality.classify(d, y), lambda d, y: toxicity.classify(d, y), lambda d, y: langid.classify(d)])
def test_edges(spark, classify):
    docs = [(1, None, "en"), (2, "", "en"), (3, "12 34 … 🎉", None), (None, "some words", "de"), (4, "long " * 30000, "de"), (4, "long " * 30000, "de"), (5, "le la les", "fr")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS y", "0 AS place")
    labels = spark.createDataFrame([(2, 0, 1), (4, 1, 0), (4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(frame, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    if "lang_pred" in got[0]:
        assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert classify(frame.limit(0), labels.limit(0)).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).first().predicted == 0
    assert 0 <= quality.classify(docs, labels).first().score <= 1


def test_dual_coordinate_descent_reaches_the_optimum():
    rnd = np.random.default_rng(0)
    n, k = 60, 12
    rows = [np.flatnonzero(rnd.random(k) < 0.4) for _ in range(n)]
    y = np.array([int(2 * (0 in r) + (1 in r) - (2 in r) + rnd.normal() * 0.3 > 0.7) for r in rows])
    offs, cols = np.concatenate(([0], np.cumsum(list(map(len, rows))))), np.concatenate(rows)
    w, b = quality.dual_coordinate_descent(offs, cols, y, np.ones(k), c=1.0, rounds=2000)
    cost = 1.0 * n / 2 / np.array([(y == 0).sum(), (y == 1).sum()])[y]
    x = np.zeros((n, k))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(len(r), 1e-12)) if len(r) else 0

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - (2 * y - 1) * (x @ w + b))).sum()

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rnd.normal(size=k) * 0.05, b + rnd.normal() * 0.05) >= best - 0.02 * best


def test_ftrl_against_plain_python():
    rows, y = [[0, 1], [1, 2], [0, 2], [2]], [1, 0, 1, 0]
    offs, cols = np.array([0, 2, 4, 6, 7]), np.array([0, 1, 1, 2, 0, 2, 2])
    got, bias = toxicity.ftrl(offs, cols, np.array(y), 2, alpha=0.5, l1=0.1, rounds=5)
    z, n, b, nb = [0.0] * 4, [0.0] * 4, 0.0, 0.0
    order = np.random.default_rng(1)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 1.0)
    for _ in range(5):
        for r in order.permutation(4):
            w = {i: weight(i) for i in rows[r]}
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y[r]
            for i in rows[r]:
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i] += g - s * w[i]
                n[i] += g * g
            nb += g * g
            b -= 0.5 / (1 + nb**0.5) * g
    assert np.allclose(got, [weight(i) for i in range(4)]) and np.isclose(bias, b)


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_forward_backward_by_enumeration(segment):
    rnd = np.random.default_rng(0)
    k, lengths = 3, [0, 1, 2, 5, 0, 6]
    offs = np.concatenate(([0], np.cumsum(lengths)))
    score, moves, start = rnd.normal(size=(offs[-1], k)), rnd.normal(size=(k, k)), rnd.normal(size=k)
    got, _ = langid.forward_backward(score, offs, moves, start, segment)
    for d, n in enumerate(lengths):
        total = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            if n:
                p = np.exp(start[y[0]] + sum(score[offs[d] + i, y[i]] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)))
                total[range(n), y] += p
        if n:
            assert np.allclose(total / total.sum(axis=1, keepdims=True), got[offs[d] : offs[d + 1]])


def test_words_against_a_pattern():
    import re

    rnd = random.Random(0)
    texts = ["", None, "a", "éa É x-y_z 9", "\x1f\x0b\x85 q"] + ["".join(rnd.choice("ab É\n\t-Z9") for _ in range(rnd.randint(0, 60))) for _ in range(100)]
    for inside, pattern in ((W.NON_SPACE, rb"[^\x20\x09-\x0D]+"), (W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (W.PIECE, 5, 50):
            got, hashes = [], {}
            for w in W.words(pa.array(texts), inside, limit=limit):
                low = W.LOWER[w.buf].tobytes()
                for d in range(w.last - w.first):
                    at = range(w.offs[d], w.offs[d + 1])
                    got.append([low[w.start[i] : w.end[i]] for i in at])
                    for i in at:
                        assert hashes.setdefault(low[w.start[i] : w.end[i]], w.hash[i]) == w.hash[i]
            assert got == [re.findall(pattern, (t or "").encode().translate(W.LOWER.tobytes())) for t in texts]
            assert len(set(hashes.values())) == len(hashes)


def test_held_out_is_crc32(spark):
    rows = spark.range(200).select("id", linear.held_out(linear.F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
