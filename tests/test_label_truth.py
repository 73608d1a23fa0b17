"""Metrics against labels: the truth is counted, never listed as pairs."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakefinder.operators import evaluate, vectors
from lakefinder.plans import oracles, queries

COLUMNS = "id long, embedding array<float>, label int"


def shuffled(spark, df):
    """The rows of what ``df`` gives, and how many records its stages wrote to shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    rows = df().collect()
    return rows, sum(n for i, n in stages().items() if i not in before)


def one_label(spark, n=4000):
    """n vectors, all but one of a label: n * n / 20 pairs match."""
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], int(i == 7)) for i in range(n)], COLUMNS).repartition(4)


def ties(spark):
    """Few different vectors, whose labels differ: whole neighbourhoods tie."""
    pick = random.Random(3)
    kinds = [[1.0, 0.0], [1.0, 0.25], [0.0, 1.0]]
    return spark.createDataFrame([(i, pick.choice(kinds), pick.choice([0, 1, 2, 3])) for i in range(300)], COLUMNS).repartition(4)


def by_sql(v, name):
    with duckdb.connect() as db:
        db.register("embeddings", pa.table(v.select(F.col("id").alias("vec_id"), "embedding", "label").toArrow()))
        return sorted(tuple(r) for r in db.sql(oracles.SQL[name]).fetchall())


def odd(spark):
    """Predictions and labelled names: several labels of a name, null and absent ones, repeats."""
    pick = random.Random(1)
    rows = [(str(pick.randrange(40)), pick.choice([None, 1, 2, 3])) for _ in range(90)] + [(None, 1), ("200", None), ("201", 9)]
    asked = [r for r in rows if r[0] is None or int(r[0]) % 4 == 0 or int(r[0]) > 100] + [("absent", 2), ("absent", 8)]
    got = [(q, str(t), pick.random()) for q in sorted({r[0] for r in asked if r[0]} - {"8"}) for t in pick.sample(range(45), 7)]
    labels = evaluate.Labels(spark.createDataFrame(asked, "query_table string, label int"), spark.createDataFrame(rows, "table_name string, label int"))
    pairs = spark.createDataFrame(sorted({(q, t) for q, x in asked for t, y in rows if q and t and x is not None and x == y}), "query_table string, candidate_table string")
    return spark.createDataFrame(got, "query_table string, table_name string, score double"), labels, pairs


@pytest.mark.parametrize("include_self", [False, True])
def test_counted_labels_are_the_listed_pairs(spark, include_self):
    got, labels, pairs = odd(spark)
    want = sorted(map(tuple, evaluate.query_metrics(got, pairs, 5, include_self).collect()))
    assert len(want) > 5 and sorted(map(tuple, evaluate.query_metrics(got, labels, 5, include_self).collect())) == want


def check(spark, monkeypatch, name):
    """No pairs move, and ties go as in the SQL."""
    v = one_label(spark).cache()
    monkeypatch.setattr(queries, "_vectors", lambda *_: v)
    rows, moved = shuffled(spark, lambda: queries.QUERIES[name](spark, ""))
    assert rows and moved < 200_000  # 800,000 pairs match
    tied = ties(spark).cache()
    monkeypatch.setattr(queries, "_vectors", lambda *_: tied)
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, "").collect()) == by_sql(tied, name)


def test_metric_spread(spark, monkeypatch):
    check(spark, monkeypatch, "metric_spread")


def test_vector_metrics(spark, monkeypatch):
    check(spark, monkeypatch, "vector_metrics")


def test_layer_means(spark, monkeypatch):
    searches, search = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda *a, **k: searches.append(1) or search(*a, **k))
    check(spark, monkeypatch, "layer_means")
    assert len(searches) == 2  # one for each of the two tables


def test_layer_metrics(spark, monkeypatch):
    check(spark, monkeypatch, "layer_metrics")


def test_layer_metrics_of_labels_are_those_of_pairs(spark):
    got, labels, pairs = odd(spark)
    inputs = got.select("query_table").distinct().withColumn("n_in", F.lit(50))
    want = sorted(map(tuple, evaluate.layer_metrics(inputs, got, pairs).collect()))
    assert len(want) > 8 and sorted(map(tuple, evaluate.layer_metrics(inputs, got, labels).collect())) == want


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_of_equal_vectors(spark, metric):
    """Many copies, a vector of NaN and a threshold, against plain Python."""
    pick = random.Random(2)
    kinds = [[1.0, 0.0], [0.6, 0.8], [float("nan"), 1.0], [0.0, 0.0], [-1.0, 0.5]]
    rows = [(i, pick.choice(kinds), 0) for i in range(240)]
    v = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    data = [(i, np.array(e)) for i, e, _ in rows]

    def score(a, b):
        if metric == "euclidean":
            return round(1 / (1 + float(np.sqrt(((a - b) ** 2).sum()))), 9)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / size), 9) if size else 0.0

    want = []
    for i, a in [(i, a) for i, a in data if i % 10 == 0]:
        scored = sorted((-score(a, b), j) for j, b in data if j != i and not np.isnan(score(a, b)) and score(a, b) >= 0.2)
        want += [(i, j, round(-s, 6)) for s, j in scored[:6]]
    got = {(r.query_id, r.id, round(r.score, 6)) for r in vectors.nearest(v.where("id % 10 = 0"), v, 6, 0.2, metric).collect()}
    assert got == set(want)
