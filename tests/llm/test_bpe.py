import hashlib
import random

import numpy as np
import pytest

from lakefinder.llm import bpe, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = "abcthe ingANDß'Éñ12²½ªº́ẞİſŉΣςΑ中文🎉\x00\x1c\x1f\x85\xa0 !?#$%&*_-'s't'll\n\t\r\x0b\x0c|<>㍘Ⅷⅷ٣"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(2)
    out = ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    out += ["".join(rnd.choice("aeinstrhlo") for _ in range(rnd.randrange(300))) for _ in range(500)]
    return [*out, "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "it's I'LL we'Re", "word " * 5000, "x" * 3000]


def test_texts_match_the_library(whole):
    tables, spec, special, vocab = bpe.load(PATH)
    encoder, decoder = bpe.TextEncoder(tables, spec, special), bpe.Decoder(vocab)
    for t in texts():
        ids = whole.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == ids, t
        assert decoder.decode(np.array(ids, np.int64)).decode() == whole.decode(ids, skip_special_tokens=False)


def test_documents(spark, whole):
    rows = [(1, "The cat, it's 12!", "x"), (2, None, "y"), (3, "", None), (None, "ÉÉ<|endoftext|>", "z"), (1, "The cat, it's 12!", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(frame, PATH, digests=True).collect()}
    want = set()
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == want
    encoded = bpe.encode_documents(frame.drop("n_tokens"), PATH, decoded=True)
    assert all(r.decoded == r.again for r in encoded.join(bpe.decode_ids(encoded.select("doc_id", "ids"), PATH).withColumnRenamed("decoded", "again"), "doc_id").collect())
    assert bpe.encode_documents(frame.limit(0), PATH).count() == 0


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BITS", 2)
    lengths = [0, 0, 3, 3, 3, 4, 7, 8, 8, 21, None]
    own = [x or 0 for x in lengths]
    h = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    got = {r.length: r for r in h.collect()}
    assert sorted(got) == sorted(set(own))
    for n, r in got.items():
        assert (r.n_docs, r.n_tokens) == (own.count(n), n * own.count(n))
        assert (r.docs_longer, r.tokens_longer) == (sum(x > n for x in own), sum(x for x in own if x > n))
        assert (r.docs_up_to, r.total_truncated) == (sum(x <= n for x in own), sum(min(x, n) for x in own))
    for limit in (0, 1, 5, 8, 100):
        assert token_counts.truncated_total(h, limit) == sum(min(x, limit) for x in own)
    q = {r.q: r.length for r in token_counts.quantiles(h, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert q == {0.0: 0, 0.5: 3, 0.9: 8, 1.0: 21}
    assert token_counts.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_decoding_of_nulls_none_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, [], "y"), (3, [320], "z"), (3, [320], "z")]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string")
    got = sorted((r.doc_id, r.decoded) for r in bpe.decode_ids(frame, PATH).collect() if r.decoded is not None)
    assert got[0] == (2, "") and got[1] == got[2] and got[1][0] == 3 and got[1][1]
    assert bpe.decode_ids(frame, PATH).where("decoded is null").count() == 1
    assert bpe.decode_ids(frame.limit(0), PATH).count() == 0


def test_lengths_with_clashing_columns(spark, whole):
    rows = [("it's a word", 5), (None, 6), ("", 7), ("it's a word", 8)]
    got = token_counts.token_lengths(spark.createDataFrame(rows, "text string, n_tokens int"), PATH)
    n = len(whole.encode("it's a word", add_special_tokens=False).ids)
    assert got.columns == ["n_tokens"] and sorted(r.n_tokens for r in got.collect()) == [0, 0, n, n]
    assert token_counts.token_lengths(spark.createDataFrame([], "text string"), PATH).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2000)
    memory = bpe.Memory(lambda w: [len(w)] * 3)
    for k in range(500):
        assert np.frombuffer(memory(f"word{k}"), "<u4").tolist() == [len(f"word{k}")] * 3
        assert len(memory.known) * bpe.ENTRY <= 2000
    memory("x" * (bpe.LONGEST + 1))
    assert "x" * (bpe.LONGEST + 1) not in memory.known
