import random
import re

import numpy as np
import pytest

from lakefinder.llm import ngram_jaccard as N, parity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, size, num, den):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    par = {i: i for i, _ in docs if i is not None}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, (i, _) in enumerate(docs):
        for b, (j, _) in enumerate(docs[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                par[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for (i, _), s in zip(docs, sets, strict=True) if i is not None)


def corpus(seed, n_family, copies):
    """Families of copies with edits, around a common passage."""
    rnd = random.Random(seed)
    new = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [new() for _ in range(25)]
    docs = []
    for _ in range(n_family):
        base = [new() for _ in range(rnd.choice([1, 2, 3, 4, 9, 20, 60, 130]))]
        if rnd.random() < 0.5:
            base += passage
        for _ in range(rnd.choice(copies)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rnd.randrange(len(w))] = new()
            docs.append(" ".join(w).replace(" ", rnd.choice([" ", "\n", "  "])))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("size, num, seed, families", [(3, 90, 1, (12, (1, 4, 40))), (5, 80, 2, (12, (1, 4, 40))), (3, 90, 3, (2, (150,)))])
def test_against_brute_force(spark, size, num, seed, families):
    docs = corpus(seed, *families)
    docs += [(9001, None), (9002, ""), (9003, " \n"), (9004, docs[0][1].upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS rep", "3 AS key")
    got = N.similar_documents(frame, size, num, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs, size, num, 100)


def test_null_and_repeated_ids(spark):
    a, b = "a b c d e f g", "t u v w x y z"
    docs = [(5, a), (5, b), (3, b), (None, a), (None, "alone here"), (8, a), (8, a)]
    got = N.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (8, 3), (8, 3)], key=str)


def test_empty(spark):
    assert N.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_keeps_columns(spark):
    docs = [(2, "a b c d e f", "x"), (1, "a  b c d e f", "y"), (3, "", "z"), (None, "a b c d e f", "w")]
    out = N.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(out.columns) == ["doc_id", "lang", "text"]
    assert {r.doc_id for r in out.collect()} == {1, 3, None}


def test_keys_lose_no_pair():
    rnd = np.random.default_rng(0)
    for num in (80, 90):
        for n in [*range(2, 60), 200, 1000]:
            a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(4):
                apart = parity.most_apart(n, n, num, 100)
                drop = int(rnd.integers(0, apart + 1))
                b = np.unique(np.concatenate((a[drop:], rnd.integers(0, 2**63, apart - drop, dtype=np.uint64))))
                same = len(np.intersect1d(a, b))
                if 100 * same >= num * (len(a) + len(b) - same) and apart:
                    assert np.intersect1d(parity.keys(a, num, 100), parity.keys(b, num, 100)).size
                    assert parity.hamming(parity.sketch(a, num, 100), parity.sketch(b, num, 100)) <= len(a) + len(b) - 2 * same


@pytest.mark.parametrize("small, shared, spread, cross", [(2, 1, 1, 0), (1, 2, 2, 0)])
def test_every_way_of_comparing(spark, monkeypatch, small, shared, spread, cross):
    """Bounds so low that hubs, strays, better hubs and spreading are all gone through."""
    for name, value in (("SMALL", small), ("SMALL_SHARED", shared), ("SPREAD", spread), ("CROSS", cross)):
        monkeypatch.setattr(N, name, value)
    docs = corpus(5, 3, (14,))
    got = N.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs, 3, 90, 100)


def test_ids_of_another_type_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(90_000))  # more than two pieces of W.PIECE bytes
    docs = [("b", long), ("a", long.replace("w77 ", "v ")), ("c", "other words altogether here"), ("d", " ".join(f"x{k}" for k in range(90_000)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.similar_documents(spark.createDataFrame(docs, "doc_id string, text string"), 3, 90, 100).collect()}
    assert got == {"a": (89_998, "a"), "b": (89_998, "a"), "c": (2, "c"), "d": (89_998, "d")}


def test_one_of_each_tells_rows_by_their_texts(spark):
    a, b = "a b c d e f g", "t u v w x y z"
    docs = [(5, a, 1), (5, b, 2), (3, b, 3), (4, a + "  ", 4), (4, a, 5), (9, "a  b c d e f g", 6), (9, "a  b c d e f g", 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int").repartition(7).withColumn("__s", N.F.rand(3)).repartition(3, "__s").drop("__s")
    out = sorted((r.doc_id, r.text.strip()) for r in N.one_of_each(frame).collect())
    # of the texts a one row of doc_id 4 stays, the smallest; of the texts b that of doc_id 3
    assert out == [(3, b), (4, a)]


def test_what_sets_may_do_without():
    """Similar sets still share a key when each leaves out as many as allowed of those that come last in any common order."""
    rnd = np.random.default_rng(1)
    for num in (80, 90):
        allowed = parity.allowances(num, 100)
        for n in (12, 40, 150, 900):
            for _ in range(12):
                a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
                apart = parity.most_apart(n, n, num, 100)
                b = np.unique(np.concatenate((a[apart // 2 :], rnd.integers(0, 2**63, apart // 2, dtype=np.uint64))))
                same = len(np.intersect1d(a, b))
                if 100 * same < num * (len(a) + len(b) - same) or not apart:
                    continue
                left = []
                common = set(parity.keys(a, num, 100).tolist()) & set(parity.keys(b, num, 100).tolist())
                for s in (a, b):
                    by_tag = {}
                    for k in parity.keys(s, num, 100).tolist():
                        by_tag.setdefault(k & (1 << parity.TAG_BITS) - 1, []).append(k)
                    # the worst order: the shared keys are the commonest
                    left.append({k for t, ks in by_tag.items() for k in sorted(ks, key=lambda k: (k in common, k))[: len(ks) - allowed[t]]})
                assert left[0] & left[1]


def test_one_shuffle_of_all_keys_at_a_time(spark, monkeypatch):
    """No table is made from the keys of all classes twice over: their sizes are a table of their own."""
    spread, write = {}, N.materialize

    def seen(df, name):
        spread.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Generate explode(keys"))
        return write(df, name)

    monkeypatch.setattr(N, "materialize", seen)
    docs = corpus(4, 6, (1, 3))
    N.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).count()
    assert spread["shared"] == [1] and max(max(x) for x in spread.values()) == 1


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_keys_are_kept_once_and_moved_in_parts(spark, monkeypatch, few):
    """Only the rows' own table holds arrays of keys; counting and joining take one part of the keys at a time, and lose none."""
    tables, write = {}, N.materialize

    def seen(df, name):
        out = write(df, name)
        tables.setdefault(name, []).append((out.columns, {r.key for r in out.select("key").collect()} if name == "shared" else None))
        return out

    monkeypatch.setattr(N, "materialize", seen)
    monkeypatch.setattr(N, "SLICED", 0, raising=False)
    monkeypatch.setattr(N, "SLICES", 3, raising=False)
    monkeypatch.setattr("lakefinder.llm.components.FEW", few)
    docs = corpus(7, 14, (2, 6))
    docs += [(1000 + i, t) for i, t in docs[:20]] + [(None, "a class of nulls alone " * 9), (None, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)  # copies in several batches
    got = N.similar_documents(frame, 3, 90, 100).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs, 3, 90, 100)
    assert {name for name, made in tables.items() for columns, _ in made if "keys" in columns} == {"classes"}
    parts = [keys for _, keys in tables["shared"]]
    assert len(parts) == 3 and all(parts) and sum(map(len, parts)) == len(set.union(*parts))
