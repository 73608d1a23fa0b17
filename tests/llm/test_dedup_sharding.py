import hashlib
import random
import re
import zlib

import pytest

from lakefinder.llm import dedup, sharding


def corpus():
    rnd = random.Random(1)
    base = ["a b", "ab", "a\tb\n", " ", "", None, "é b", "éb ", "x" * 50000, "x" * 50000 + " ", "unique one"]
    rows = [(i, rnd.choice(base)) for i in range(120)]
    return rows + [(7, "ab"), (7, "ab"), (None, "ab"), (None, "only null"), (500, "a  b  ")]


def test_exact_dedup(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS run", "'s' AS sha", "2 AS row_no").repartition(7)
    got = dedup.exact_dedup(frame).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, t))
    want = []
    for body, rows in groups.items():
        best = min(rows, key=lambda r: (r[0], r[1], r[2] or 0))
        want += [(r[2], best[2], len(rows), hashlib.sha256(body.encode()).hexdigest()) for r in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_tree_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FAN_IN_BITS", 1)
    frame = spark.createDataFrame([(i, str(i % 10)) for i in range(500)], "doc_id long, text string").repartition(13)
    got = dedup.exact_dedup(frame).where("kept").collect()
    assert sorted(r.doc_id for r in got) == list(range(10)) and {r.group_size for r in got} == {50}


def test_hot_text(spark):
    frame = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS text")
    got = {r.group_size: r["count"] for r in dedup.exact_dedup(frame).groupBy("group_size").count().collect()}
    assert got == {1667: 1667, 1: 3333}


def test_drop_copies(spark):
    frame = spark.createDataFrame([(2, "a b", 1.0), (1, "ab", 2.0), (3, None, None), (3, "", 0.5)], "doc_id long, text string, n_chars double").coalesce(1)
    out = dedup.drop_copies(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


@pytest.mark.parametrize("n_shards", [8, 3])
def test_sharding(spark, n_shards):
    rnd = random.Random(2)
    docs = [(i, rnd.choice([None, "", "é" * rnd.randrange(300), "x" * rnd.randrange(2000)])) for i in range(700)] + [(None, "n"), (5, "again"), (5, "again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS part", "3 AS seq").repartition(9)
    got = sorted(sharding.shard_by_bytes(frame, n_shards).collect(), key=lambda r: r.first_byte)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    total, largest, at = sum(r.size for r in got), max(r.size for r in got), 0
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    for r in got:
        assert r.first_byte == at and r.law == "bytes" and r.grown_shard is None
        at += r.size
    assert [r.shard for r in got] == sorted(r.shard for r in got) and {r.shard for r in got} <= set(range(n_shards))
    for s in range(n_shards):
        mine = [r for r in got if r.shard == s]
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / n_shards) <= largest


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.exact_dedup(none).count() == 0 and sharding.shard_by_bytes(none).count() == 0


def test_drop_copies_of_any_input(spark):
    """The rows that stay are one of each text, however the input comes: shuffled, joined, with columns more."""
    rnd = random.Random(4)
    docs = [(rnd.choice([None, k % 400]), rnd.choice(["", " ", "a"]) * rnd.randrange(3) + f"text {rnd.randrange(250)}" + " " * rnd.randrange(3), k) for k in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int")
    other = spark.range(900).selectExpr("cast(id as int) AS n", "cast(id * 3 as string) AS sha", "id % 7 AS raw")
    want = {}
    for i, t, _ in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", t)
        want[body] = min(want.get(body, (0, True, 0)), (-len(t), i is None, i or 0))
    for given in (frame.repartition(7), frame.repartition(5, "n").join(other, "n"), frame.join(other, "n").repartition(9).where("n >= 0")):
        out = dedup.drop_copies(given)
        assert out.columns == given.columns
        got = out.collect()
        assert {re.sub(r"[\x20\x09-\x0D]", "", r.text): (-len(r.text), r.doc_id is None, r.doc_id or 0) for r in got} == want and len(got) == len(want)
