import hashlib
import random
import re

import pytest

from lakefinder.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, bench, window):
    items = {}
    for i, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        n = min(window, len(w))
        if n:
            items.setdefault(i, []).extend(w[k : k + n] for k in range(len(w) - n + 1))
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for item, wins in items.items():
            for x in wins:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit.update(range(k, k + len(x)))
                        if item is not None:
                            ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["a", "B", "cc", "é", "dé9", "x-y"]) for _ in range(n))
    bench = [(k, text(rnd.choice([0, 1, 2, 4, 6, 9, 14]))) for k in range(12)] + [(3, text(7)), (None, text(5)), (20, None), (21, "z z z z z z z z z z z")]
    docs = [(k, text(rnd.randrange(40))) for k in range(60)]
    docs += [(100 + k, text(6) + " " + bench[k % 12][1].upper() + "\n" + text(5)) for k in range(20)]
    docs += [(7, None), (7, ""), (None, "a b"), (300, "z " * 30), (301, text(4000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"spans": D.F.lit(1), "item": D.F.lit("x")})
    b = spark.createDataFrame(bench, "item_id long, text string")
    for window in (10, 4):
        got = D.contamination(d, b, window).selectExpr("doc_id", "n_words", "spans", "items").withColumn("hit", D.n_hit())
        rows = [(r.doc_id, r.n_words, r.hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got.collect()]
        assert sorted(rows, key=str) == brute(docs, bench, window)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, b).count() == 0
    row = D.contamination(one, b).first()
    assert (row.doc_id, row.n_words, row.spans, row["items"]) == (1, 2, [], [])
