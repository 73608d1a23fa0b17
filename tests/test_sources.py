import json

import pytest

from lakefinder import cli
from lakefinder.sources import catalog, store
from lakefinder.streaming import incremental


@pytest.fixture
def described(tmp_path):
    tables = [
        {"table_name": " users ", "columns": [{"column_name": "user_id", "data_type": "int", "sample_values": [1, 2]}, {"name": "email", "sample_values": ["a@x", None]}], "row_count": 100, "column_count": 7},
        {"name": "customers", "columns": [{"name": "customer_id", "type": "int"}], "description": "who buys"},
        {"table_name": "empty"},
        {"nothing": 1},
    ]
    path = tmp_path / "tables.json"
    path.write_text(json.dumps(tables))
    return str(path)


def test_json_dialects(spark, described, tmp_path):
    rows = {r.table_name: r for r in catalog.read_json_tables(spark, described).collect()}
    assert set(rows) == {"users", "customers", "empty"}
    assert [(c.column_name, c.data_type) for c in rows["users"]["columns"]] == [("user_id", "int"), ("email", "string")]
    assert rows["users"].column_count == 2 and rows["customers"].description == "who buys" and rows["empty"].column_count == 0
    plain = catalog.read_json_tables(spark, described, None).where("table_name = 'users'").first()
    assert plain["columns"][1].data_type is None
    cols = tmp_path / "columns.json"
    cols.write_text(json.dumps([{"table_name": "t", "name": "a", "type": "int"}, {"column_name": "b"}, {"x": 1}]))
    assert [(r.table_name, r.column_name, r.data_type) for r in catalog.read_json_columns(spark, str(cols)).collect()] == [("t", "a", "int"), ("unknown", "b", "string")]


def test_csv(spark, tmp_path):
    good, latin = tmp_path / "good.csv", tmp_path / "latin.csv"
    good.write_text("id, name ,x\n1, é ,\n2,b,\n" + "3,c,z\n" * 20)
    latin.write_bytes("name\ncafé\n".encode("latin-1"))
    d = catalog.describe_csv(spark, str(good), "good.csv").first()
    assert d.row_count == 22 and [(c.column_name, c.data_type) for c in d["columns"]] == [("id", "numeric"), ("name", "string"), ("x", "string")]
    assert catalog.read_csv(spark, str(latin)).first()[0] == "café"
    found, account = catalog.describe_csv_files(spark, {"good": str(good), "gone": str(tmp_path / "gone.csv")})
    assert found.count() == 1 and catalog.success(account).first().success_rate == 0.5


def test_truth(spark, tmp_path):
    pairs, grouped = tmp_path / "p.json", tmp_path / "g.json"
    pairs.write_text(json.dumps([{"query_table": "a", "candidate_table": "b", "query_type": "union"}]))
    grouped.write_text(json.dumps([{"query_table": "a", "ground_truth": ["b", "c"]}]))
    assert [tuple(r) for r in catalog.read_truth(spark, str(pairs)).collect()] == [("a", None, "b", None, "union")]
    assert [r.candidate_table for r in catalog.read_truth(spark, str(grouped)).collect()] == ["b", "c"]
    csv = tmp_path / "q.csv"
    csv.write_text("query_table,query_column\na,x\n")
    assert tuple(catalog.read_pairs(spark, str(csv)).first()) == ("a", "x", None, None, None)


def test_look_up(spark):
    tables = spark.createDataFrame([("a.csv", 1), ("b", 2)], "table_name string, column_count int")
    names = spark.createDataFrame([(" a ",), ("b",), ("none",)], "table_name string")
    assert {r.asked: r.column_count for r in catalog.look_up(names, tables, with_csv=False).collect()} == {" a ": 1, "b": 2, "none": None}
    assert {r.asked: r.column_count for r in catalog.look_up(names, tables).collect()} == {" a ": None, "b": 2, "none": None}


def test_upsert_and_runs(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in store.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    runs = spark.createDataFrame([("r1", "join", "2024-01-01 00:00:00", 0.5, 3), ("r2", "join", "2024-02-01 00:00:00", 0.4, 4), ("r3", "union", "2024-01-05 00:00:00", 0.9, 1)], "run_id string, task string, at string, f1 double, n_queries int").selectExpr("run_id", "task", "cast(at AS timestamp) AS at", "f1", "n_queries")
    store.save_run(runs, str(tmp_path / "runs"))
    found = store.runs(spark, str(tmp_path / "runs"))
    assert {r.task: r.run_id for r in store.latest(found).collect()} == {"join": "r2", "union": "r3"}
    assert {r.task: (r.n_runs, r.best_run, r.n_queries) for r in store.summary(found).collect()} == {"join": (2, "r1", 7), "union": (1, "r3", 1)}
    kept, gone = store.archive(found, "2024-01-03")
    assert (kept.count(), gone.count()) == (2, 1)
    with pytest.raises(Exception):
        store.vectors(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2).collect()


def test_command_line(spark, described, tmp_path, capsys):
    index = str(tmp_path / "index")
    assert cli.main(["build-index", "--tables", described, "--save", index], spark) == 0
    assert cli.main(["verify-index", index], spark) == 0
    assert cli.main(["discover", index, "--table", "users", "--format", "table"], spark) == 0
    assert cli.main(["config"], spark) == 0
    assert "overlap_threshold" in capsys.readouterr().out


def test_incremental_index(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "values")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "name string")
    rows("Ann", "Bob", "x").coalesce(1).write.parquet(str(source / "1"))
    run = lambda: incremental.keep_index(spark.readStream.schema("name string").parquet(str(source / "*")), "people", index, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    rows("bob", "Cid").coalesce(1).write.parquet(str(source / "2"))
    run()
    got = spark.read.parquet(index)
    assert sorted((r.table_name, r.column_name, r.value) for r in got.collect()) == [("people", "name", v) for v in ("ann", "bob", "cid")]
