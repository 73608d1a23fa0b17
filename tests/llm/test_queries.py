"""The registered queries over whole tables, against plain Python where SQL cannot express them."""

import bisect
import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from lakefinder.llm import linear, pii, quality, queries as Q, toxicity, words as W  # noqa: E402

DIR = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def plain_toxic(text):
    """The n-grams of a text, as strings."""
    w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text.translate(LOW)).split(" ") if x]
    out = {("1", x) for x in w}
    for gap in (1, 2, 3):
        out |= {(f"gap{gap}", a, b) for a, b in zip(w, w[gap:], strict=False)}
    for x in w:
        b = x.encode()
        out |= {(f"stem{n}", b[:n]) for n in toxicity.STEMS if len(b) >= n}
    return out


def test_toxicity_features_and_scores(docs):
    texts = [r.text or "" for r in list(docs.values())[:60]] + ["", "a", "a A  b\ta"]
    got = [c for n, offs, cols in linear.rows(pa.array(texts), toxicity.features, toxicity.BITS, False) for c in np.split(cols, offs[1:-1])]
    for text, cols in zip(texts, got, strict=True):
        want = len(plain_toxic(text))
        assert want - max(3, want // 100) <= len(cols) <= want  # a few share a column
    weights = np.random.default_rng(0).normal(size=1 << toxicity.BITS) * (np.arange(1 << toxicity.BITS) % 5 == 0)
    model = toxicity.Model(weights, -0.3, 0.7, 0.1)
    import pickle

    model = pickle.loads(pickle.dumps(model))
    offs = np.cumsum([0, *map(len, got)])
    plain = [1 / (1 + np.exp(-(0.7 * (sum(weights[c] for c in cols) - 0.3) + 0.1))) for cols in got]
    assert np.allclose(model.scores(offs, np.concatenate(got)), plain)


def test_quality_scores(docs):
    texts = [r.text or "" for r in list(docs.values())[:40]] + ["", "one"]
    got = [c for n, offs, cols in linear.rows(pa.array(texts), quality.features, quality.BITS, True) for c in np.split(cols, offs[1:-1])]
    rnd = np.random.default_rng(0)
    ratio, own = rnd.normal(size=1 << quality.BITS), rnd.normal(size=1 << quality.BITS)
    model = quality.Model(own * ratio, ratio, 0.2, 1.5, -0.1)
    plain = []
    for cols in got:
        length = np.sqrt(sum(ratio[c] ** 2 for c in cols) + 1e-12)
        plain.append(1 / (1 + np.exp(-(1.5 * (sum(own[c] * ratio[c] for c in cols) / length + 0.2) - 0.1))))
    assert np.allclose(model.scores(np.cumsum([0, *map(len, got)]), np.concatenate(got)), plain)


@pytest.mark.parametrize("query, label, least", [(Q.op2_quality, "quality", 0.3), (Q.op6_toxicity, "toxic", 0.5)])
def test_classifiers(spark, docs, query, label, least):
    got = query(spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for r in got)


def test_languages(spark, docs):
    got = {r.doc_id: r for r in Q.op9_langid(spark, DIR).collect()}
    assert set(got) == set(docs) and all(r.held_out == held(i, 3, 1) for i, r in got.items())
    langs = {r.lang for i, r in docs.items() if r.lang and not held(i, 3, 1)}
    seen = [(r.lang, got[i].lang_pred) for i, r in docs.items() if held(i, 3, 1) and r.lang and (r.text or "").strip()]
    assert {r.lang_pred for r in got.values()} <= langs | {"und"} and sum(a == b for a, b in seen) >= 0.9 * len(seen)


def test_pseudonyms_go_back(spark, docs):
    got = {r.doc_id: r for r in Q.op3_pii(spark, DIR).collect()}
    back = pii.Pseudonyms(Q.PII_KEY, back=True)
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.n_private == len(r.private or [])
        assert (r.text == docs[i].text) or back.text(r.text)[0] == docs[i].text


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(Q.vocabulary())
    whole.no_truncation()
    whole.no_padding()
    own = sorted(len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in docs.values())
    counts, total = collections.Counter(own), sum(own)
    got = {r.length: r for r in Q.op8_token_counts(spark, DIR).collect()}
    assert {n: r.n_docs for n, r in got.items()} == counts
    for n, r in got.items():
        at = bisect.bisect_right(own, n)
        assert (r.docs_up_to, r.docs_longer, r.tokens_longer) == (at, len(own) - at, total - sum(own[:at]))
        assert r.total_truncated == sum(own[:at]) + n * (len(own) - at)


def test_words_of_a_text_of_several_pieces():
    text = " ".join(f"w{k}" for k in range(120_000))
    (w,) = list(W.words(pa.array([text]), W.NON_SPACE))
    assert len(w.hash) == 120_000 and len(set(w.hash.tolist())) == 120_000
