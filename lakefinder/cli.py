"""Command line: build and check an index, and search it.

python -m lakefinder.cli build-index --tables T.json [--columns C.json] --save DIR
python -m lakefinder.cli build-index --parquet name=path ... --save DIR
python -m lakefinder.cli verify-index DIR
python -m lakefinder.cli discover DIR [--table NAME ...] [--column TABLE COLUMN ...] [--all-tables] [-q WORDS] [--assign] [--early-stop] [--task join|union] [--format json|markdown|table] [--output FILE]
python -m lakefinder.cli add-tables DIR --parquet name=path ...
python -m lakefinder.cli experiments RUNS list|summary|latest
python -m lakefinder.cli config
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession, functions as F

from lakefinder.config import PRESETS, Config
from lakefinder.plans import report
from lakefinder.plans.discover import asked_in_words, attempt, by_assignment, discover, top_down
from lakefinder.sources import catalog, store


def described_lake(spark: SparkSession, tables: str, columns: str | None = None) -> catalog.Lake:
    """A catalog from descriptions; columns of a second file are added to the tables they name."""
    own = catalog.read_json_tables(spark, tables)
    cols = catalog.columns_of(own)
    if columns:
        more = catalog.read_json_columns(spark, columns).withColumns({"ordinal": F.lit(1 << 20), "row_count": F.lit(None).cast("long")})
        cols = cols.unionByName(more.join(cols, ["table_name", "column_name"], "left_anti").select(cols.columns))
    return catalog.Lake(catalog.tables_of(cols), cols, catalog.described_values(cols))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakefinder")
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build-index")
    build.add_argument("--tables")
    build.add_argument("--columns")
    build.add_argument("--parquet", nargs="*", default=[])
    build.add_argument("--save", required=True)
    check = sub.add_parser("verify-index")
    check.add_argument("index")
    find = sub.add_parser("discover")
    find.add_argument("index")
    find.add_argument("--table", nargs="*", default=[])
    find.add_argument("--column", nargs=2, action="append", default=[])
    find.add_argument("--all-tables", action="store_true")
    find.add_argument("-q", "--query", help="what is wanted, in words")
    find.add_argument("--assign", action="store_true", help="by an assignment of columns")
    find.add_argument("--early-stop", action="store_true")
    find.add_argument("--task", choices=sorted(PRESETS))
    find.add_argument("--format", choices=sorted(report.FORMATS), default="json")
    find.add_argument("--output")
    more = sub.add_parser("add-tables")
    more.add_argument("index")
    more.add_argument("--parquet", nargs="+", required=True)
    kept = sub.add_parser("experiments")
    kept.add_argument("runs")
    kept.add_argument("what", choices=["list", "summary", "latest"])
    sub.add_parser("config")
    asked = parser.parse_args(args)
    if asked.command == "config":
        print(json.dumps(dataclasses.asdict(Config()), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("lakefinder").getOrCreate()
    if asked.command == "build-index":
        if asked.parquet:
            lake = catalog.profile_lake(spark, dict(p.split("=", 1) for p in asked.parquet))
        elif asked.tables:
            lake = described_lake(spark, asked.tables, asked.columns)
        else:
            parser.error("build-index needs --tables or --parquet")
        store.save(lake, asked.save)
        print(store.verify(store.load(spark, asked.save)).first().asDict())
        return 0
    if asked.command == "experiments":
        found = store.runs(spark, asked.runs)
        shown = {"list": found.orderBy(F.desc("at")), "summary": store.summary(found), "latest": store.latest(found)}[asked.what]
        for row in shown.toLocalIterator():
            print(json.dumps(row.asDict(), default=str))
        return 0
    if asked.command == "add-tables":
        store.append(catalog.profile_lake(spark, dict(p.split("=", 1) for p in asked.parquet)), asked.index)
        print(store.verify(store.load(spark, asked.index)).first().asDict())
        return 0
    lake = store.load(spark, asked.index)
    if asked.command == "verify-index":
        row = store.verify(lake).first()
        print(row.asDict())
        return 0 if row.complete else 1
    tables = lake.tables.select("table_name") if asked.all_tables else spark.createDataFrame([(t,) for t in asked.table], "table_name string") if asked.table else None
    columns = spark.createDataFrame([tuple(c) for c in asked.column], "table_name string, column_name string") if asked.column else None
    if asked.assign and tables is not None:
        found = attempt(by_assignment, lake, tables, PRESETS.get(asked.task, Config()))
    elif asked.query:
        found = attempt(asked_in_words, lake, asked.query, tables, columns)
    elif asked.early_stop and tables is not None:
        found = attempt(top_down, lake, tables, PRESETS.get(asked.task, Config()), early=True)
    elif tables is None and columns is None:
        parser.error("discover needs --table, --column, --all-tables or -q")
    else:
        found = attempt(discover, lake, tables, columns, asked.task)
    text = report.FORMATS[asked.format](found)
    if asked.output:
        with open(asked.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 1 if found.errors else 0


if __name__ == "__main__":
    sys.exit(main())
