import difflib
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from lakefinder.functions import embedding as E, features as X, normalize as N, similarity as S

NAMES = ["user_id", "userID_name12", "orders", "order_date", "", "A", "customerName", "XMLFile", "a  b", "note", "fk_user_id", "USER_ID"]
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[0-9]+")


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_normalisers(spark):
    rows = spark.createDataFrame([(v,) for v in [" A  B\tc ", "x", "", None, "É É", "12.50", "nan", "inf", "1e3", "-"]], "v string")
    got = [(r.a, r.b, r.c) for r in rows.select(N.value(F.col("v")).alias("a"), N.number(F.col("v")).alias("b"), N.category(F.col("v")).alias("c")).collect()]
    assert got == [("a b c", None, "a  b\tc"), (None, None, "x"), (None, None, None), (None, None, None), ("é é", None, "é é"), ("12.50", 12.5, "12.50"), ("nan", None, "nan"), ("inf", None, "inf"), ("1e3", 1000.0, "1e3"), (None, None, "-")]


def test_tokens(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for r in rows.select("n", N.tokens(F.col("n")).alias("t")).collect():
        assert set(r.t) == {t.lower() for t in TOKEN.findall(r.n) if len(t) > 1}
    assert one(spark, t=N.tokens(F.lit("userID_name12"))).t == ["user", "name", "12"]


def test_types_disagree_as_meant(spark):
    t = F.col("t")
    rows = spark.createDataFrame([("double",), ("bigint",), ("array<int>",), (None,), ("timestamp",), ("time",)], "t string")
    got = [tuple(r) for r in rows.select(N.metadata_type(t), N.matcher_type(t), N.signature_type(t), N.query_type(t, F.lit("text")), N.type_group(t)).collect()]
    assert got == [
        ("numeric", "other", "numeric", "numeric", "float"),
        ("numeric", "numeric", "integer", "integer", "integer"),
        ("other", "other", "other", "other", None),
        ("other", "unknown", None, "text", None),
        ("datetime", "datetime", "temporal", "temporal", "datetime"),
        ("datetime", "datetime", "other", "temporal", "datetime"),
    ]


def test_feature_rules(spark):
    rows = spark.createDataFrame([(n,) for n in ["lineitem", "events", "Customer", "dim_date", "x", "a_b_c", "CamelCase"]], "n string")
    got = [tuple(r) for r in rows.select(X.domain(F.col("n")), X.naming_pattern(F.col("n"))).collect()]
    assert got == [("product", "simple"), ("log", "simple"), ("user", "simple"), ("dim", "dim_*_date"), ("general", "simple"), ("general", "a_*_c"), ("general", "*amel*ase")]
    n = F.col("id").cast("int")
    sizes = [tuple(r) for r in spark.range(0, 35, 5).select(X.size_category(n), X.column_bucket(n), X.column_range(n)).collect()]
    assert sizes == [(0, 5, "small"), (0, 5, "small"), (1, 10, "medium"), (1, 20, "medium"), (1, 20, "large"), (2, 50, "large"), (2, 50, "large")]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_name_similarities(spark):
    rows = spark.createDataFrame(list(itertools.product(NAMES, NAMES)), "a string, b string")
    a, b = F.col("a"), F.col("b")
    jac = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
    toks = lambda s: {t.lower() for t in TOKEN.findall(s) if len(t) > 1}
    for r in rows.select("a", "b", S.levenshtein(a, b).alias("l"), S.sequence_ratio(a, b).alias("s"), S.token_jaccard(a, b).alias("t"), S.character_jaccard(a, b).alias("c"), S.table_name(a, b).alias("n"), S.name(a, b).alias("m")).collect():
        x, y = r.a.lower(), r.b.lower()
        assert math.isclose(r.l, 0.0 if not x or not y else 1 - lev(x, y) / max(len(x), len(y)))
        assert math.isclose(r.s, difflib.SequenceMatcher(None, x, y).ratio())
        assert math.isclose(r.t, jac(toks(r.a), toks(r.b)))
        assert math.isclose(r.c, 1.0 if x == y else 0.0 if not x or not y else jac(set(x), set(y)))
        assert math.isclose(r.m, 0.4 * r.l + 0.3 * r.s + 0.3 * r.t)
        prefix = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert math.isclose(r.n, 1.0 if x == y else 0.8 if x in y or y in x else 0.5 * prefix / max(len(x), len(y)) if prefix else 0.1)


def test_value_similarities(spark):
    lists = [[], ["a"], ["a", "A ", "b"], ["b", "c", "c"], ["1", "2", "x", "2"]]
    rows = spark.createDataFrame(list(itertools.product(lists, lists)), "a array<string>, b array<string>")
    norm = lambda xs: [x.strip().lower() for x in xs if x.strip()]
    for r in rows.select("a", "b", S.values(F.col("a"), F.col("b")).alias("v"), S.frequency_cosine(N.categories(F.col("a")), N.categories(F.col("b"))).alias("c")).collect():
        x, y = norm(r.a), norm(r.b)
        want = 0.8 * len(set(x) & set(y)) / len(set(x) | set(y)) + 0.2 * min(len(r.a), len(r.b)) / max(len(r.a), len(r.b)) if x and y else 0.0
        assert math.isclose(r.v, want)
        size = lambda xs: math.sqrt(sum(xs.count(v) ** 2 for v in set(xs)))
        assert math.isclose(r.c, sum(x.count(v) * y.count(v) for v in set(x + y)) / (size(x) * size(y)) if x and y else 0.0)


def test_type_and_statistics(spark):
    t = lambda a, b: one(spark, x=S.type_match(F.lit(a).cast("string"), F.lit(b).cast("string"))).x
    assert [t("int", "INT "), t("int", "bigint"), t("int", "double"), t("int", "string"), t("int", "blob"), t(None, "int")] == [1.0, 0.8, 0.6, 0.2, 0.1, 0.0]
    s = lambda *x: one(spark, x=S.stats(*(F.lit(v).cast("long") for v in x))).x
    assert [s(10, 5, 0, 0), s(None, 5, 1, 3), s(None, None, None, 1), s(0, 0, 0, 0)] == [0.75, 0.5, 0.0, 1.0]


def test_vectors(spark):
    r = one(spark, c=S.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))), z=S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), d=S.by_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))))
    assert math.isclose(r.c, 1.0) and r.z == 0.0 and math.isclose(r.d, 1 / 6)
    v = one(spark, v=E.digest_vector(F.lit("orders"))).v
    import hashlib

    h = [int(c, 16) for c in hashlib.md5(b"orders").hexdigest()]
    want = [x for i in range(96) for d in [h[i % 32]] for x in (d / 15 - 0.5, d * 7 % 16 / 15 - 0.5, d * 13 % 16 / 15 - 0.5, d * 17 % 16 / 15 - 0.5)]
    assert v == pytest.approx(want)
    g = spark.createDataFrame([("customer name",), ("customer names",), ("zebra",), ("",), (None,)], "t string").select(E.gram_vector(F.col("t"), 64).alias("v")).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    assert cos(g[0].v, g[1].v) > cos(g[0].v, g[2].v) and not any(g[3].v) and not any(g[4].v)
