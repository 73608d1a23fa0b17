"""The stages of the pipeline against plain Python, each on its own input."""

import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from lakefinder.llm import toxicity  # noqa: E402
from lakefinder.llm.queries import vocabulary  # noqa: E402

DIR = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "bpe"]


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    out = P.drop_toxic(spark, docs, DIR)
    assert out.columns == docs.columns
    assert set(rows(out)) == {i for i, s in scores.items() if s < P.TOXIC}
    assert set(rows(out)) < set(scores)


def test_exact_copies(spark, docs):
    best = {}
    for i, r in sorted(rows(docs).items()):
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        if key not in best or len(r.text or "") > len(best[key].text or ""):
            best[key] = r
    out = P.drop_exact_copies(spark, docs, DIR)
    assert out.columns == docs.columns
    assert set(rows(out)) == {r.doc_id for r in best.values()}


def test_near_copies(spark, docs):
    from tests.llm.test_ngram_jaccard import brute

    out = P.drop_near_copies(spark, docs, DIR)
    assert out.columns == docs.columns
    assert set(rows(out)) == {i for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100) if c == i}


def test_contaminated(spark, docs):
    from tests.llm.test_decontaminate import brute

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    out = P.drop_contaminated(spark, docs, DIR)
    assert out.columns == docs.columns
    assert set(rows(out)) == {r[0] for r in brute([(r.doc_id, r.text) for r in docs.collect()], bench, 10) if not r[2]}


def test_encoded(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    whole.no_truncation()
    whole.no_padding()
    own = rows(docs)
    for i, r in rows(P.encode(spark, docs, DIR)).items():
        assert r.ids == whole.encode(own[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_chains_the_stages(spark, docs):
    step = docs
    for _, f in P.STAGES:
        step = f(spark, step, DIR)
    got, want = rows(P.run(spark, DIR)), rows(step)
    assert got == want and 0 < len(got) < docs.count()


def test_extra_columns_nulls_and_empty(spark, docs):
    odd = spark.createDataFrame([(10**6, None, None, None, None, 1.5, "s"), (10**6 + 1, "", "en", "s", 0, None, None), (None, "z y x w v", "en", "s", 9, 2.5, "i")], "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")
    for _, f in P.STAGES[:-1]:
        out = f(spark, odd, DIR)
        assert sorted(out.columns) == sorted(odd.columns)
        got = out.collect()
        assert len(got) in (2, 3) and {r.score for r in got if r.doc_id == 10**6} == {1.5}
        assert f(spark, odd.limit(0), DIR).count() == 0
    assert P.encode(spark, odd, DIR).count() == 3
