import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefinder.config import Config
from lakefinder.functions import similarity as S
from lakefinder.operators import assignment, evaluate, fusion, lsh, metadata, overlap, vectors
from lakefinder.plans import columns as P, discover, queries, report, routing, verify
from lakefinder.sources import catalog, store


@pytest.fixture(scope="module")
def lake(spark):
    users = spark.createDataFrame([(i, f"name {i}", f"u{i}@x.org") for i in range(40)], "user_id int, username string, email string")
    orders = spark.createDataFrame([(i, i % 30, float(i)) for i in range(100)], "order_id int, user_id int, total_amount double")
    clients = users.select(F.col("user_id").alias("client_id"), F.col("username").alias("full_name"), F.col("email").alias("email_address"))
    odd = spark.createDataFrame([(None, None), ("only", None)], "note string, blank string")
    return catalog.lake_of({"users": users, "orders": orders, "clients": clients, "users_copy": users, "odd": odd})


def test_catalog(lake):
    rows = {(r.table_name, r.column_name): r for r in lake.columns.collect()}
    assert len(rows) == 14
    assert rows["orders", "user_id"].unique_count == 30 and rows["orders", "user_id"].sample_values == ["0", "1", "10", "11", "12"]
    assert rows["orders", "total_amount"].unique_count is None and rows["orders", "total_amount"].data_type == "double"
    assert rows["odd", "blank"].null_count == 2 and rows["odd", "blank"].sample_values == []
    assert store.verify(lake).first().complete


def test_save_and_load(spark, lake, tmp_path):
    store.save(lake, str(tmp_path / "index"))
    again = store.load(spark, str(tmp_path / "index"))
    assert sorted(map(str, again.values.select("table_name", "column_name", "value").collect())) == sorted(map(str, lake.values.select("table_name", "column_name", "value").collect()))
    assert again.tables.count() == 5


def test_value_overlap_by_sets(lake):
    sets = {}
    for r in lake.values.collect():
        sets.setdefault((r.table_name, r.column_name), set()).add(r.value)
    want = {}
    for (a, x), (b, y) in itertools.product(sets.items(), sets.items()):
        if a[0] != b[0] and len(x & y) / len(x) >= 0.35:
            want[a + b] = 0.7 * len(x & y) / len(x) + 0.3 * len(x & y) / len(y)
    q = lake.values.select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), "value")
    got = {(r.query_table, r.query_column, r.table_name, r.column_name): r.score for r in overlap.value_overlap(q, lake.values).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    best = overlap.value_overlap(q, lake.values, k=1).collect()
    assert all(r["rank"] == 1 for r in best) and len(best) == len({k[:2] for k in want})


def test_pattern_and_text_search(lake):
    got = {(r.table_name, r.column_name): r for r in overlap.pattern_search(lake.values, r"^U1\d?@").collect()}
    assert set(got) == {("users", "email"), ("clients", "email_address"), ("users_copy", "email")} and got["users", "email"].n_hit == 11 and len(got["users", "email"].matched_values) == 10
    hits = overlap.text_search(overlap.text_postings(lake.columns), ["email"]).collect()
    assert hits[0].score == 0.5 and {h.table_name for h in hits} == {"users", "users_copy", "clients"}


def test_metadata_search(lake):
    f = metadata.table_features(lake.tables)
    got = metadata.metadata_search(f, f, 2).collect()
    first = {r.query_table: r for r in got if r["rank"] == 1}
    assert all(r.score == 1.0 for r in first.values()) and all(first[t].table_name == t for t in ('users', 'orders', 'odd'))
    second = {r.query_table: r.table_name for r in got if r["rank"] == 2}
    assert second["users"] == "users_copy"
    assert metadata.prefilter(f, ["nothing"]).count() == 0
    assert metadata.prefilter(f).count() == 5
    assert {r.table_name for r in metadata.prefilter(f, ["email"], max_candidates=10).collect()} == {"users", "users_copy", "clients"}
    assert metadata.signature_search(f, f, 1).where("query_table = 'users'").first().table_name == "users_copy"


def test_nearest(spark, monkeypatch):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=8).tolist(), i % 3) for i in range(300)] + [(300, [0.0] * 8, 0), (301, None, 1), (302, [1.0], 2)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(5)
    m = np.array([r[1] for r in rows[:301]])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(norm == 0, 1, norm)
    for block in (4096, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        q = v.where("id % 20 = 0")
        for metric, score in (("cosine", unit @ unit.T), ("euclidean", 1 / (1 + np.linalg.norm(m[:, None] - m[None], axis=2)))):
            got = {}
            for r in vectors.nearest(q, v, 5, metric=metric).collect():
                got.setdefault(r.query_id, []).append((r["rank"], r.id))
            for i in range(0, 301, 20):
                want = sorted((-round(s, 9), j) for j, s in enumerate(score[i]) if j != i)[:5]
                assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    few = vectors.nearest(v.where("id = 20"), v, 5, threshold=0.2, where="label = 1").collect()
    assert all(r.id % 3 == 1 and r.score >= 0.2 for r in few)


def test_index_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = v.where("id % 20 = 0")
    centre = vectors.centroids(v, 20)
    indexed = vectors.assign(v, centre)
    assert indexed.count() == v.count()
    assert vectors.recall(vectors.index_search(q, indexed, centre, 14, 10), vectors.nearest(q, v, 10)) >= 0.9


def test_registered_index_recall(spark):
    """The registered query reaches a recall of 0.9, and scores rows of cells, not joined pairs."""
    d = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    found = queries.q_index_search(spark, d)
    assert vectors.recall(found, vectors.nearest(v.where("id % 20 = 0"), v, 10)) >= 0.9
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 9, "CANDIDATES": 16, "CELLS": 50}])
def test_index_search_by_cells(spark, monkeypatch, sizes):
    """All of the probed cells and nothing else; copies, repeated ids, nulls and other lengths."""
    for name, size in sizes.items():
        monkeypatch.setattr(vectors, name, size)
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 340)] + [(20, rows[20][1])] * 8 + [(400, [0.0] * 6), (420, None), (None, rows[1][1])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    centre = vectors.centroids(v.where("id < 300"), 10)
    m = {p: np.array(r[1]) for p, r in enumerate(rows) if r[0] is not None and r[1] is not None}
    unit = {p: x / (np.linalg.norm(x) or 1) for p, x in m.items()}
    for include_self in (False, True):
        got = {}
        q = v.where("id % 20 = 0").distinct()
        for r in vectors.index_search(q, vectors.assign(v, centre), centre, 4, 5, include_self).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.id))
        cell = {p: int(np.argmax(centre @ x)) for p, x in m.items()}
        for i, x in {rows[p][0]: (x, unit[p]) for p, x in m.items() if rows[p][0] % 20 == 0}.items():
            probed = {*np.argsort(-(centre @ x[0]), kind="stable")[:4].tolist()}
            want = sorted((-round(float(unit[p] @ x[1]), 9) + 0.0, rows[p][0]) for p in m if cell[p] in probed and (include_self or rows[p][0] != i))[:5]
            assert [(round(s, 8) + 0.0, j) for _, s, j in sorted(got.pop(i))] == [(round(s, 8) + 0.0, j) for s, j in want], i
        assert not got
    assert vectors.index_search(v.where("id < 0"), vectors.assign(v, centre), centre, 4, 5).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, rows[2][1])], "id long, embedding array<double>")
    assert {r.query_id for r in vectors.index_search(odd, vectors.assign(v, centre), centre, 4, 5).collect()} == {2}


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 9, "CANDIDATES": 16, "TILE": 5}])
def test_nearest_hybrid(spark, monkeypatch, sizes):
    """As the expression on all pairs; near copies far from the origin, copies, nulls, NaN and other lengths."""
    for name, size in sizes.items():
        monkeypatch.setattr(vectors, name, size)
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=5).tolist(), i % 3) for i in range(160)]
    rows += [(i, (1e4 + rnd.normal(size=5) * 1e-7).tolist(), 1) for i in range(160, 200)] + [(i, rows[20][1], i % 2) for i in range(200, 240)] + [(40, rows[40][1], 1)] * 9
    rows += [(240, [0.0] * 5, 0), (260, None, 1), (280, [1.0, 2.0], 2), (300, [1.0, None, 2.0, 3.0, 4.0], 2), (320, rows[3][1], None), (340, [float("nan")] + [1.0] * 4, 1), (None, rows[4][1], 1), (360, [], 0)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(3)
    q = v.where("id % 20 = 0").distinct()
    score = S.hybrid_vector(F.col("q_embedding"), F.col("embedding"), F.col("q_label") == F.col("label"), F.lit(False))
    for few in (v, v.where("id >= 237 or id = 3 or id is null")):
        want, got = (sorted((r.query_id, r["rank"], r.id, repr(r.score and round(r.score, 8))) for r in found.collect()) for found in (vectors.nearest_by_expression(q, few, 5, score), vectors.nearest_hybrid(q, few, 5)))
        assert got == want and len(got) > 50
    assert vectors.nearest_hybrid(v.where("id < 0"), v, 5).count() == vectors.nearest_hybrid(q, v.where("id < 0"), 5).count() == 0


def test_registered_hybrid_without_join(spark):
    assert "Join" not in queries.q_nearest_hybrid(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()


def test_minhash(spark):
    rnd = random.Random(1)
    rows = [(str(i), sorted(rnd.sample([f"f{k}" for k in range(30)], rnd.randrange(0, 12)))) for i in range(40)]
    items = spark.createDataFrame(rows, "id string, features array<string>").withColumn("signature", lsh.signature(F.col("features"))).cache()
    import hashlib

    coef = lsh.coefficients(64)
    for r in items.collect():
        h = [int(hashlib.md5(x.encode()).hexdigest(), 16) for x in r.features]
        assert r.signature == [min(((a * x + b) % lsh.PRIME for x in h), default=0) for a, b in coef]
    sets = dict(rows)
    exact = {(a, b) for a, b in itertools.permutations(sets, 2) if sets[a] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.5}
    got = {(r.query_id, r.id) for r in lsh.similar(items, items, 0.5, None, bands=32).collect() if sets[r.id]}
    assert got <= exact and len(got) >= 0.95 * len(exact)


def test_similar_loses_no_pair(spark):
    """As the registered query calls it: threshold 0.3, everything else by default."""
    rnd = random.Random(5)
    words = [f"f{k}" for k in range(60)]
    rows = [(str(i), ["common", *sorted(rnd.sample(words[: 12 + i % 40], rnd.randrange(0, 12)))]) for i in range(150)] + [("e1", []), ("e2", []), ("r", ["a", "b", "a"]), ("s", ["b", "a"])]
    items = spark.createDataFrame(rows, "id string, features array<string>").withColumn("signature", lsh.signature(F.col("features"))).cache()
    sets = {i: {*f} for i, f in rows}
    for threshold in (0.3, 0.5, 1.0):
        score = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) if sets[a] | sets[b] else 1.0 for a, b in itertools.permutations(sets, 2)}
        want = {p: s for p, s in score.items() if s >= threshold}
        assert len(want) > 2 and {(r.query_id, r.id): r.score for r in lsh.similar(items, items, threshold, None).collect()} == want


def test_nearest_apart(spark):
    """Vectors of the query's own group take no place among the best k; with and without a cut to the best."""
    rnd = np.random.default_rng(3)
    rows = [(i, f"g{i % 7}" if i % 7 else None, rnd.normal(size=4).round(2).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, g string, embedding array<double>").coalesce(1)
    m = np.array([r[2] for r in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in vectors.nearest(v.where("id < 20"), v, 5, apart="g").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for i in range(20):
        want = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(400) if j != i and (i % 7 == 0 or j % 7 != i % 7))[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_bottom_up_of_a_wide_table(spark):
    """A query table of more columns than there are candidates does not hide the others' like columns."""
    wide = spark.createDataFrame([tuple(f"w{k} {i}" for k in range(45)) for i in range(3)], ", ".join(f"customer_address_{k} string" for k in range(45)))
    other = spark.createDataFrame([("x",), ("y",)], "customer_address_7 string")
    found = catalog.lake_of({"wide": wide, "other": other})
    asked = found.columns.where("column_name = 'customer_address_7' and table_name = 'wide'").select("table_name", "column_name")
    config = Config(semantic_threshold=0.0, confidence_threshold=0.0)
    got = discover.bottom_up(found, asked, config).matches.collect()
    assert [(r.table_name, r.column_name) for r in got] == [("other", "customer_address_7")]


def test_pairs_of_wide_tables(spark, monkeypatch):
    """As the registered queries call it: columns from the 21st on are compared, too."""
    wide = spark.createDataFrame([tuple(range(25))], ", ".join(f"c{k} int" for k in range(25)))
    found = catalog.lake_of({"a": wide, "b": wide})
    monkeypatch.setattr(queries, "lake", lambda spark, sf_dir: found)
    assert queries._pairs(spark, "").count() == 2 * 25 * 25
    assert P.column_pairs(found.columns, None, 20).count() == 2 * 20 * 20


def test_text_search_of_all(spark):
    postings = spark.range(1200).selectExpr("'word' AS term", "concat('t', id) AS table_name", "'c' AS column_name")
    assert overlap.text_search(postings, ["word"], None).count() == 1200
    assert overlap.text_search(postings, ["word"], 10).count() == 10


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    rnd = np.random.default_rng(seed)
    n, m = map(int, rnd.integers(1, 6, 2))
    sim = np.round(rnd.random((n, m)), 1)
    t = [0.0, 0.3, 0.6][seed % 3]
    got = assignment.assign(sim, t)
    assert len({r for r, _ in got}) == len(got) == len({c for _, c in got}) and all(sim[r, c] >= t for r, c in got)
    small, big = (sim, m) if n <= m else (sim.T, n)
    best = max(sum(small[r, c] for r, c in enumerate(p) if small[r, c] >= t) for p in itertools.permutations(range(big), min(n, m)))
    assert math.isclose(sum(sim[r, c] for r, c in got), best)


def test_matching_of_tables(spark, lake):
    pairs = P.by_names(P.column_pairs(lake.columns), 0.1)
    found = assignment.matched_columns(pairs, 0.6)
    own = {(r.query_column, r.column_name) for r in found.where("query_table = 'users' and table_name = 'users_copy'").collect()}
    assert own == {("user_id", "user_id"), ("username", "username"), ("email", "email")}
    scores = assignment.enhanced(assignment.table_scores(found, lake.tables))
    assert scores.where("query_table = 'users' and table_name = 'users_copy'").first().score == 100.0
    assert assignment.best_tables(scores, 1).where("query_table = 'users'").first().table_name == "users_copy"
    assert "user_id = user_id" in assignment.explanation(found).where("query_table = 'users' and table_name = 'users_copy'").first().explanation
    assert assignment.thresholds(pairs, (0.3, 0.9)).where("threshold = 0.9").agg(F.sum("total")).first()[0] <= assignment.thresholds(pairs, (0.3,)).agg(F.sum("total")).first()[0]


def test_rules(spark, lake):
    got = {(r.query_table, r.table_name): r for r in fusion.verdicts(spark.createDataFrame([("users", "users_copy", 0.95), ("users", "clients", 0.7), ("users", "odd", 0.5), ("users", "orders", 0.61)], "query_table string, table_name string, score double"), lake.tables).collect()}
    assert got["users", "users_copy"].rule == "overlap" and ("users", "odd") not in got
    assert got["users", "clients"].method == "uncertain" and got["users", "orders"].rule == "uncertain"
    answers = spark.createDataFrame([("users", "clients", True, 0.9), ("users", "orders", False, 0.3)], verify.ANSWER)
    judged = {r.table_name: r.score for r in fusion.judged(spark.createDataFrame([("users", "clients", 0.7), ("users", "orders", 0.61)], "query_table string, table_name string, score double"), answers).collect()}
    assert judged == {"clients": 0.9, "orders": 0.3}


def test_merge_hits(spark):
    cols = "query_table string, query_column string, table_name string, column_name string, score double"
    s = spark.createDataFrame([("q", "a", "t", "x", 0.8), ("q", "a", "t", "y", 0.7)], cols)
    v = spark.createDataFrame([("q", "a", "t", "x", 0.5), ("q", "a", "t", "z", 0.9)], cols)
    got = {r.column_name: (r.confidence, r.match_type) for r in fusion.merge_hits(s, v).collect()}
    assert got == {"x": (0.68, "semantic+value"), "y": (0.7, "semantic"), "z": (0.9, "value_overlap")}


def test_metrics_by_hand(spark):
    pred = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.8), ("q", "c", 0.7), ("q", "q", 1.0), ("r", "z", 0.5)], "query_table string, table_name string, score double")
    truth = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "q"), ("r", "y"), ("s", "x")], "query_table string, candidate_table string")
    got = {r.query_table: r for r in evaluate.query_metrics(pred, truth).collect()}
    q = got["q"]
    assert (q.precision, q.recall, q.mrr, q.hit, q.average_precision) == (round(1 / 3, 9), 0.5, 0.5, 1, 0.25) and math.isclose(q.f1, 0.4)
    assert math.isclose(q.ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs_tol=1e-8)
    assert all(got[t].precision == got[t].recall == got[t].f1 == got[t].mrr == got[t].hit == 0 for t in "rs")
    assert evaluate.macro(evaluate.query_metrics(pred, truth)).first().n_queries == 3


def test_latencies(spark):
    rows = [("a", float(i)) for i in range(150)] + [("b", 1.0), ("b", 3.0)]
    got = {r.g: r for r in evaluate.latencies(spark.createDataFrame(rows, "g string, seconds double"), "g").collect()}
    assert (got["a"].p50, got["a"].p90, got["a"].p99) == (75.0, 135.0, 148.0) and (got["b"].p50, got["b"].p99) == (3.0, 3.0)


def test_discover(spark, lake):
    down = discover.discover(lake, query_tables=spark.createDataFrame([("users",)], "table_name string"))
    assert down.tables.orderBy("rank").first().table_name == "users_copy"
    up = discover.discover(lake, query_columns=spark.createDataFrame([("users", "user_id"), ("users", "email")], "table_name string, column_name string"))
    names = [r.table_name for r in up.tables.orderBy("rank").collect()]
    assert names[0] == "users_copy"
    text = report.as_json(up)
    assert '"strategy": "bottom_up"' in text and "users_copy" in report.as_markdown(up) and "users_copy" in report.as_text(up)
    with pytest.raises(ValueError):
        discover.discover(lake)


def test_verifier(spark, lake):
    class Yes:
        def judge(self, prompts):
            if any("orders" in p for p in prompts):
                raise RuntimeError
            return [(True, 0.99)] * len(prompts)

    cand = spark.createDataFrame([("users", "clients", 0.7)], "query_table string, table_name string, score double")
    got = verify.ask(verify.prompts(cand, lake.tables), Yes()).collect()
    assert [(r.table_name, r.is_match) for r in got] == [("clients", True)]
    assert verify.ask(verify.prompts(cand, lake.tables), None).count() == 0


def test_query_analysis(spark):
    rows = [(1, "find joinable customer orders", 0, 0), (2, None, 0, 0), (3, "union of similar price tables", 1, 5)]
    got = {r.query_id: r for r in routing.analyse(spark.createDataFrame(rows, "query_id int, text string, n_tables int, n_columns int")).collect()}
    assert got[1].intent == "join" and got[1].domains == ["customer"] and got[2].intent == "search" and got[2].complexity == 0.0 and got[3].intent == "union"
    assert routing.strategy(True, True) == "top_down" and routing.strategy(False, True) == "bottom_up"


def test_relaxed_and_early_stop(spark):
    rows = spark.createDataFrame([("q", f"t{i}", s) for i, s in enumerate([0.9, 0.5, 0.3, 0.2, 0.1])], "query_table string, table_name string, score double")
    got = {r.table_name: (r.score, r.kind) for r in metadata.relaxed(rows, 6, pad_to=5).collect()}
    assert got == {"t0": (0.9, 0), "t1": (0.5, 0), "t2": (0.24, 1), "t3": (0.12, 2), "t4": (0.06, 2)}
    assert fusion.early_stop(rows, 0.8).first().stop and not fusion.early_stop(rows, 0.8, 0.6).first().stop
