"""Searches with a verifier, words and assignment; streams that run a batch again; order statistics."""

import collections
import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefinder.config import Config
from lakefinder.operators import evaluate, fusion, lsh, metadata, overlap, ranks, vectors
from lakefinder.plans import columns as P, discover, report, routing, verify
from lakefinder.sources import catalog, store
from lakefinder.streaming import incremental


@pytest.fixture(scope="module")
def frames(spark):
    users = spark.createDataFrame([(i, f"name {i}", f"u{i}@x.org") for i in range(40)], "user_id int, username string, email string")
    orders = spark.createDataFrame([(i, i % 30, f" Note\t {i % 3}") for i in range(100)], "order_id int, user_id int, note string")
    return {"users": users, "orders": orders, "users_copy": users, "clients": users.selectExpr("user_id AS client_id", "username AS full_name")}


@pytest.fixture(scope="module")
def lake(frames):
    return catalog.lake_of(frames)


def test_unindexed_overlap_is_that_of_the_index(lake, frames, monkeypatch):
    query = catalog.values_of(frames, {("orders", "user_id"), ("orders", "note")}).select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), "value")
    sizes = lambda some: catalog.values_of(frames, some).groupBy("table_name", "column_name").agg(F.count("*").alias("n_target"))
    want = sorted(map(tuple, overlap.value_overlap(query, lake.values, 0.1).collect()))
    assert len(want) == 3
    for few in (0, 1_000_000):
        monkeypatch.setattr(overlap, "FEW_VALUES", few)
        assert sorted(map(tuple, overlap.value_overlap_unindexed(query, catalog.rows_of_values(frames), sizes, 0.1).collect())) == want
    assert overlap.value_overlap_unindexed(query, catalog.rows_of_values(frames), sizes, 1.1).count() == 0


def test_ranks_and_latencies(spark):
    rnd = random.Random(1)
    rows = [(g, float(rnd.choice([rnd.randrange(5), rnd.random()]))) for g in "aab" for _ in range(150)] + [("c", 1.0), ("d", None), (None, 2.0)]
    log = spark.createDataFrame([(g, v, v is not None and v > 3) for g, v in rows], "g string, v double, bad boolean").repartition(5)
    own = collections.defaultdict(list)
    for g, v in rows:
        if g and v is not None:
            own[g].append(float(v))
    got = {r.g: r for r in evaluate.latencies(log, "g", "v", slow=2.5, failed="bad").collect()}
    assert set(got) == set(own)
    for g, vs in own.items():
        vs.sort()
        r = got[g]
        assert (r.n, r.p50, r.p90) == (len(vs), vs[len(vs) // 2], vs[math.floor(len(vs) * 0.9)]) and r.p99 == (vs[-1] if len(vs) < 100 else vs[math.floor(len(vs) * 0.99)])
        assert r.n_slow == sum(v > 2.5 for v in vs) and r.success_rate == pytest.approx(1 - sum(v > 3 for v in vs) / len(vs)) and r.qps == pytest.approx(len(vs) / sum(vs))
    counted = spark.createDataFrame(rows, "g string, v double").where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in ranks.placed(counted, ["g"], "v").where("g is not null").collect():
        assert r.before == sum(x < r.v for x in own[r.g])


def test_quartiles(spark):
    rnd = random.Random(2)
    xs = [rnd.choice([1, 2, 2, 7, 100]) + rnd.randrange(3) for _ in range(83)]
    t = spark.createDataFrame([(x, float("nan") if k % 9 == 0 else x / 7) for k, x in enumerate(xs)], "a int, b double")
    got = {r.column_name: r.quartiles for r in P.numeric_profiles({"t": t}).collect()}
    assert got["a"] == pytest.approx(np.percentile(xs, [25, 50, 75]))
    assert got["b"] == pytest.approx(np.percentile([x / 7 for k, x in enumerate(xs) if k % 9], [25, 50, 75]))


def _stream(spark, source, index, checkpoint):
    incremental.keep_index(spark.readStream.schema("name string").parquet(str(source / "*")), "people", index, checkpoint).awaitTermination()


def test_a_batch_that_runs_again_loses_nothing(spark, tmp_path):
    source, index, checkpoint = tmp_path / "in", str(tmp_path / "values"), str(tmp_path / "checkpoint")
    want = set()
    for number, names in enumerate((["Ann", "Bob"], ["bob", "Cid"], ["Dan"], ["Eve", "Ann"])):
        spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.parquet(str(source / str(number)))
        want |= {x.lower() for x in names}
        for again in range(2 if number in (0, 3) else 1):
            if again:  # as if the driver had died before the commit
                os.remove(f"{checkpoint}/commits/{number}")
                shutil.rmtree(checkpoint + "/commits/." + f"{number}.crc", ignore_errors=True)
                if os.path.exists(f"{checkpoint}/commits/.{number}.crc"):
                    os.remove(f"{checkpoint}/commits/.{number}.crc")
            _stream(spark, source, index, checkpoint)
            got = [r.value for r in spark.read.parquet(index).collect()]
            assert sorted(got) == sorted(want)


def test_a_stream_adds_to_a_saved_index(spark, tmp_path):
    path = str(tmp_path / "index")
    store.save(catalog.lake_of({"people": spark.createDataFrame([("Ann",), ("Bob",)], "name string")}), path)
    spark.createDataFrame([("bob",), ("Cid",)], "name string").write.parquet(str(tmp_path / "in" / "1"))
    _stream(spark, tmp_path / "in", f"{path}/values", str(tmp_path / "checkpoint"))
    assert sorted(r.value for r in store.load(spark, path).values.collect()) == ["ann", "bob", "cid"]


def test_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (1, "d", None), (2, "e", 1)], "k int, v string, at int")
    for given in (new, new.orderBy("v"), new.orderBy(F.desc("v"))):
        assert {tuple(r) for r in store.upsert(old, given, ["k"], "at").collect()} == {(1, "c", 3), (2, "e", 1)}


def test_append_to_an_index(spark, frames, tmp_path):
    path = str(tmp_path / "index")
    store.save(catalog.lake_of({"users": frames["users"]}), path)
    store.append(catalog.lake_of({n: frames[n] for n in ("users", "orders")}), path)
    got = store.load(spark, path)
    assert store.verify(got).first().complete and {r.table_name for r in got.tables.collect()} == {"users", "orders"}
    assert got.values.where("table_name = 'users'").count() == catalog.values_of({"users": frames["users"]}).count()


class Judge:
    """Finds everything with ``client`` a match, fails at its first try, and says nothing of orders."""

    def __init__(self):
        self.tried = 0

    def judge(self, prompts):
        self.tried += 1
        if self.tried == 1:
            raise RuntimeError("not yet")
        return [None if "orders" in p else ("client" in p, 0.9) for p in prompts]


def test_verifier_steps(spark, lake):
    scores = spark.createDataFrame([("users", t, s) for t, s in (("clients", 50.0), ("orders", 40.0), ("users_copy", 30.0), ("users", 20.0))], "query_table string, table_name string, score double")
    got = {r.table_name: r.score for r in verify.judged_tables(scores, lake.tables, Judge()).collect()}
    assert got == pytest.approx({"clients": 0.7 * 50 + 27, "orders": 40, "users_copy": 21 + 3, "users": 14 + 3})
    assert {r.table_name: r.score for r in verify.judged_tables(scores, lake.tables, Judge(), 4).collect()}["clients"] == 50
    m = [("users", "user_id", "clients", "client_id", 0.8, "x"), ("users", "user_id", "users_copy", "user_id", 0.7, "x"), ("users", "user_id", "orders", "user_id", 0.6, "x"), ("users", "email", "orders", "note", 0.5, "x")]
    matches = spark.createDataFrame(m, "query_table string, query_column string, table_name string, column_name string, confidence double, match_type string")
    got = {(r.query_column, r.table_name): r.confidence for r in verify.judged_columns(matches, lake.columns, Judge(), 2).collect()}
    assert got == pytest.approx({("user_id", "clients"): 0.56 + 0.27, ("user_id", "users_copy"): 0.49 + 0.03, ("email", "orders"): 0.5})
    some = spark.createDataFrame([("users", "clients", 0.6), ("users", "orders", 0.85), ("users", "users_copy", 0.5)], "query_table string, table_name string, score double")
    got = {r.table_name: r.score for r in verify.filtered_tables(some, lake.tables, Judge(), 2).collect()}
    assert got == pytest.approx({"clients": 0.72, "orders": 0.85})
    asked = verify.prompts(some, lake.tables)
    assert {(r.table_name, r.is_match, r.confidence) for r in verify.ask(asked, Judge(), default=(False, 0.5)).collect()} == {("clients", True, 0.9), ("orders", False, 0.5), ("users_copy", False, 0.9)}
    best = verify.padded(some.where("table_name = 'users_copy'"), some, 2).collect()
    assert [(r.table_name, r.rank) for r in sorted(best, key=lambda r: r.rank)] == [("users_copy", 1), ("orders", 2)]


def test_searches_by_words_assignment_and_early_stop(spark, lake):
    asked = spark.createDataFrame([("users",)], "table_name string")
    found = discover.by_assignment(lake, asked)
    first = found.tables.orderBy("rank").first()
    assert first.table_name == "users_copy" and first.n_matched == 3 and "users_copy" in report.as_json(found)
    assert discover.by_assignment(lake, asked, Config(max_table_columns=2)).tables.count() == 0
    words = discover.asked_in_words(lake, "clients full name")
    assert words.strategy == "keywords" and words.tables.orderBy("rank").first().table_name == "clients"
    early = discover.top_down(lake, asked, Config(early_stop=0.5), early=True).tables.collect()
    assert early and {r.method for r in early} == {"early"} and "users_copy" in {r.table_name for r in early}
    late = discover.top_down(lake, asked, Config(early_stop=2.0), early=True).tables.collect()
    assert sorted(map(tuple, late)) == sorted(map(tuple, discover.top_down(lake, asked).tables.collect()))
    failed = discover.attempt(discover.discover, lake)
    assert failed.strategy == "failed" and "needs a table" in report.as_json(failed)
    loose = discover.pseudo_table(spark.createDataFrame([("users", "email"), ("orders", "note")], "table_name string, column_name string"), lake).first()
    assert loose.column_count == 2 and {c.column_name for c in loose["columns"]} == {"email", "note"}


def test_saved_vector_index(spark, tmp_path):
    rnd = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rnd.normal(size=8)]) for i in range(200)], "id long, embedding array<double>")
    centre = vectors.centroids(v, 8)
    path = str(tmp_path / "index")
    vectors.save_index(vectors.assign(v.where("id < 150"), centre), centre, path)
    rows, back = vectors.load_index(spark, path)
    vectors.add_to_index(v.where("id >= 150"), back, path)
    rows, back = vectors.load_index(spark, path)
    assert np.allclose(back, centre) and vectors.index_sizes(rows).first().n_rows == 200
    q = v.where("id % 20 = 0")
    assert vectors.recall(vectors.index_search(q, rows, back, 8, 5), vectors.nearest(q, v, 5)) == 1.0


def test_small_reports(spark):
    hits = spark.createDataFrame([("q", "a", "t", "b", 0.9, "semantic"), ("q", "c", "t", "d", 0.8, "semantic+value"), ("q", "c", "u", "d", 0.7, "semantic")], "query_table string, query_column string, table_name string, column_name string, confidence double, match_type string")
    assert {(r.table_name, r.match_type, r.n) for r in fusion.type_histogram(hits).collect()} == {("t", "semantic", 1), ("t", "semantic+value", 1), ("u", "semantic", 1)}
    scores = fusion.score_tables(hits, spark.createDataFrame([("q", 2)], "query_table string, n_query int"))
    r = fusion.table_statistics(scores).first()
    assert r.n_tables == 2 and r.max_score == max(s.score for s in scores.collect()) and "matching columns" in scores.first().reason
    summary = spark.createDataFrame([(0.9, 12.0, 0.5), (1.0, 1.0, 0.9)], "success_rate double, mean_seconds double, cache_hit_rate double")
    assert [a.alert for a in evaluate.alerts(summary).collect()] == ["success rate below 95 %", "mean time above 10 s"]
    m = spark.createDataFrame([tuple([x] * 7) for x in (0.0, 1.0)], ", ".join(f"{c} double" for c in evaluate.METRICS))
    assert {(r["mean"], r["std"], r["min"], r["max"]) for r in evaluate.spread(m).collect()} == {(0.5, 0.5, 0.0, 1.0)}
    found = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8)], "query_id int, id int, score double")
    assert [(r.id, r["rank"]) for r in vectors.within(found, spark.createDataFrame([(1, 3)], "query_id int, id int"), 5).collect()] == [(3, 1)]
    assert routing.components(60) == {"fast_path": False, "lsh": False, "vector": False, "cache": True, "parallel": True}


def test_similar_sets_by_brute_force(spark):
    """All pairs of a Jaccard similarity of 0.3 or more are found."""
    rnd = random.Random(3)
    sets = {f"s{k}": sorted({f"f{rnd.randrange(25)}" for _ in range(rnd.randrange(9))}) for k in range(60)}
    items = spark.createDataFrame(list(sets.items()), "id string, features array<string>").withColumn("signature", lsh.signature(F.col("features")))
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    want = {(a, b) for a in sets for b in sets if a != b and jac(sets[a], sets[b]) >= 0.3}
    assert {(r.query_id, r.id) for r in lsh.similar(items, items, 0.3, None).collect()} == want


def test_traditional_pairs_by_hand(spark, lake):
    pairs = P.column_pairs(lake.columns, spark.createDataFrame([("users", "clients")], "query_table string, table_name string"))
    got = {(r.query_column, r.column_name): r.score for r in P.traditional(pairs, F.lit(0.5)).collect()}
    # the same values, nulls and numbers of values: 0.4 * 0.5 + 0.2 + 0.3 + 0.1
    assert got["user_id", "client_id"] == pytest.approx(0.8) and got["username", "full_name"] == pytest.approx(0.8)
    # other types and values, the same counts, as many samples: 0.4 * 0.5 + 0.2 * 0.2 + 0.3 * 0.2 + 0.1
    assert got["user_id", "full_name"] == pytest.approx(0.2 + 0.2 * 0.2 + 0.3 * 0.2 + 0.1)


def test_relaxed_layer(spark):
    rows = spark.createDataFrame([("q", f"t{i}", s) for i, s in enumerate([0.9, 0.2, 0.1])], "query_table string, table_name string, score double")
    got = {r.table_name: (r.score, r.kind) for r in metadata.relaxed(rows, 6, high=0.25, discount=0.9, pad_to=3, pad_discount=0.7).collect()}
    assert got == {"t0": (0.9, 0), "t1": (0.18, 1), "t2": (0.07, 2)}


def test_nearest_among_scores_the_candidates_alone(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.5, 0.5]), (5, None)], "id int, embedding array<double>")
    asked = v.where("id = 1")
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 4), (1, 5), (1, 9), (7, 2)], "query_id int, id int")
    got = vectors.nearest_among(asked, v.where("embedding is not null"), pairs, 5).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in got] == [(1, 4, 1), (1, 3, 2)]
    assert [r.id for r in vectors.nearest_among(asked, v, pairs, 1, 0.5).collect()] == [4]
    assert vectors.nearest_among(asked, v, pairs.limit(0), 5).count() == 0
    assert vectors.nearest_among(asked.limit(0), v, pairs, 5).count() == 0
