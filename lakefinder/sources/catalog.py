"""The lake's catalog: tables, columns and values, from Parquet data or from JSON and CSV descriptions.

``columns`` has a row for each column, ``tables`` one for each table with its columns as an
array, ``values`` the distinct normalised values of the columns that serve for overlap.
Statistics of a table are computed in one pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lakefinder import schema as S
from lakefinder.functions import normalize as N
from lakefinder.scratch import materialize

#: Names of Spark types in the catalog.
TYPE_NAMES = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "float": "double", "double": "double", "string": "string", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def type_name(t: T.DataType) -> str:
    return "array" if isinstance(t, T.ArrayType) else "decimal" if isinstance(t, T.DecimalType) else TYPE_NAMES.get(t.simpleString(), t.simpleString())


def indexed(t: T.DataType) -> bool:
    """Whether a column's values serve for overlap: strings and whole numbers; measures and nested values do not."""
    return isinstance(t, (T.StringType, T.IntegralType))


@dataclass
class Lake:
    tables: DataFrame
    columns: DataFrame
    values: DataFrame


def profile(table: DataFrame, name: str, n_samples: int = 5) -> DataFrame:
    """Catalog rows of a table's columns, with its row count; samples are the first of the sorted distinct values.

    One aggregate over the table: distinct counts and samples come from the distinct (column,
    value) pairs, which are pre-aggregated in every task, so neither a hot value nor a long
    column gathers in one place.  Columns that are not ``indexed`` have no distinct count.
    """
    fields = table.schema.fields
    counts = table.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)))
    rows = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"), F.lit(type_name(f.dataType)).alias("data_type"), (F.col("n") - F.col(f"c{i}")).alias("null_count")) for i, f in enumerate(fields)))
    base = counts.select("n", F.explode(rows).alias("c")).select(F.lit(name).alias("table_name"), "c.*", F.col("n").alias("row_count"))
    own = [f for f in fields if indexed(f.dataType)]
    if not own:
        return base.withColumns({"unique_count": F.lit(None).cast("long"), "sample_values": F.array().cast("array<string>")})
    pairs = distinct_values(table, own)
    unique = pairs.groupBy("column_name").agg(F.count("*").alias("unique_count"))
    ranked = first_values(pairs, n_samples)
    return (
        base.join(F.broadcast(unique), "column_name", "left")
        .join(F.broadcast(ranked), "column_name", "left")
        .withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
        .select("table_name", "column_name", "ordinal", "data_type", "null_count", "row_count", "unique_count", "sample_values")
    )


def distinct_values(table: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(column_name, raw): the distinct values, as strings, of the given columns; one scan."""
    each = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("raw")) for f in fields))
    return table.select(F.explode(each).alias("v")).select("v.*").where("raw is not null").distinct()


def first_values(pairs: DataFrame, n: int) -> DataFrame:
    """(column_name, sample_values): the n smallest values of each column.

    Values are cut to their least n in buckets first, so a column of any size meets in one
    task only as n values of each bucket.
    """
    buckets = pairs.withColumn("bucket", F.pmod(F.xxhash64("raw"), F.lit(256)))
    few = buckets.withColumn("at", F.row_number().over(Window.partitionBy("column_name", "bucket").orderBy("raw"))).where(F.col("at") <= n)
    return few.groupBy("column_name").agg(F.slice(F.array_sort(F.collect_list("raw")), 1, n).alias("sample_values"))


def profile_lake(spark: SparkSession, paths: dict[str, str], n_samples: int = 5) -> Lake:
    """The catalog of Parquet tables, by name; each part is written to the shared folder."""
    return lake_of({name: spark.read.parquet(path) for name, path in paths.items()}, n_samples)


def lake_of(frames: dict[str, DataFrame], n_samples: int = 5) -> Lake:
    """The catalog of DataFrames, by name."""
    columns = reduce(DataFrame.unionByName, (profile(t, n, n_samples) for n, t in frames.items()))
    columns = materialize(columns, "lake_columns")
    return Lake(tables_of(columns), columns, values_of(frames))


def tables_of(columns: DataFrame) -> DataFrame:
    """One row for each table, its columns in order."""
    own = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "sample_values", "null_count", "unique_count")))
    grouped = columns.groupBy("table_name").agg(F.max("row_count").alias("row_count"), own.alias("columns"))
    return grouped.withColumn("column_count", F.size("columns"))


def rows_of_values(frames: dict[str, DataFrame], only: set[tuple[str, str]] | None = None) -> DataFrame:
    """(table_name, column_name, value) of the rows of indexed columns, normalised, with repeats; only: of these columns."""
    parts = []
    for name, t in frames.items():
        own = [f for f in t.schema.fields if indexed(f.dataType) and (only is None or (name, f.name) in only)]
        if own:
            norm = lambda f: (N.plain_value if isinstance(f.dataType, T.NumericType) else N.value)(F.col(f"`{f.name}`"))
            each = F.array(*(F.struct(F.lit(f.name).alias("column_name"), norm(f).alias("value")) for f in own))
            parts.append(t.select(F.lit(name).alias("table_name"), F.explode(each).alias("v")).select("table_name", "v.*").where("value is not null"))
    if not parts:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], "table_name string, column_name string, value string")
    return reduce(DataFrame.union, parts)


def values_of(frames: dict[str, DataFrame], only: set[tuple[str, str]] | None = None) -> DataFrame:
    """Distinct (table_name, column_name, value) of indexed columns, normalised."""
    return rows_of_values(frames, only).distinct()


# Descriptions

def _columns_of(c):
    return F.struct(
        F.coalesce(c["column_name"], c["name"], F.lit("unknown")).alias("column_name"),
        F.coalesce(c["data_type"], c["type"]).alias("data_type"),
        F.coalesce(c["sample_values"], F.array().cast("array<string>")).alias("sample_values"),
        c["null_count"].alias("null_count"),
        c["unique_count"].alias("unique_count"),
    )


def read_json_tables(spark: SparkSession, path: str, default_type: str | None = "string") -> DataFrame:
    """Tables described in JSON, in either dialect (table_name or name, data_type or type).

    A record that cannot be read, or has neither a name nor columns, is left out.  Types that are not
    given become ``default_type`` (None leaves them null, as the index builder does).  Names are trimmed.
    """
    raw = spark.read.schema(S.JSON_TABLES + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.where("_bad is null and (table_name is not null or name is not null or columns is not null)")
    own = F.transform(F.coalesce("columns", F.array().cast(raw.schema["columns"].dataType)), _columns_of)
    typed = F.transform(own, lambda c: c.withField("data_type", F.coalesce(c["data_type"], F.lit(default_type))))
    return raw.select(
        N.table_name(F.coalesce("table_name", "name", F.lit("unknown"))).alias("table_name"), "row_count", F.size(typed).alias("column_count"), "file_path", "description", typed.alias("columns")
    )


def read_json_columns(spark: SparkSession, path: str, default_type: str | None = "string") -> DataFrame:
    """Columns described in JSON, in either dialect."""
    raw = spark.read.schema(S.JSON_COLUMNS + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.where("_bad is null and (column_name is not null or name is not null)")
    return raw.select(
        N.table_name(F.coalesce("table_name", F.lit("unknown"))).alias("table_name"),
        F.coalesce("column_name", "name").alias("column_name"),
        F.coalesce(F.coalesce("data_type", "type"), F.lit(default_type)).alias("data_type"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "null_count",
        "unique_count",
    )


def columns_of(tables: DataFrame) -> DataFrame:
    """One row for each column of a table description."""
    each = tables.select("table_name", "row_count", F.posexplode("columns").alias("ordinal", "c"))
    return each.select("table_name", "c.column_name", "ordinal", "c.data_type", "c.sample_values", "c.null_count", "c.unique_count", "row_count")


def described_values(columns: DataFrame) -> DataFrame:
    """The value index of described columns: their normalised samples."""
    each = columns.select("table_name", "column_name", F.explode("sample_values").alias("raw"))
    return each.select("table_name", "column_name", N.value(F.col("raw")).alias("value")).where("value is not null").distinct()


ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """A CSV file with a header, all strings, in the first encoding that reads it without replacement characters."""
    for e in encodings:
        found = spark.read.option("header", True).option("encoding", e).option("multiLine", True).csv(path)
        bad = reduce(lambda a, b: a | b, (F.contains(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit("�")) for c in found.columns), F.lit(False))
        if e == encodings[-1] or (not any("�" in c for c in found.columns) and found.where(bad).isEmpty()):
            return found
    raise ValueError("no encodings given")


def describe_csv(spark: SparkSession, path: str, name: str, n_values: int = 10, n_samples: int = 8) -> DataFrame:
    """One description row of a CSV file: the first values of each column, trimmed, without blank ones.

    A column is numeric if its first value that is not blank is a number.  ``row_count`` is
    that of the whole file.
    """
    table = read_csv(spark, path)
    head = table.limit(n_values).agg(*(F.collect_list(F.trim(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(table.columns)))
    own = []
    for i, c in enumerate(table.columns):
        samples = F.slice(F.filter(F.col(f"c{i}"), lambda v: v != ""), 1, n_samples)
        kind = F.when(N.number(F.get(samples, F.lit(0))).isNotNull(), "numeric").otherwise("string")
        own.append(F.struct(F.lit(c.strip()).alias("column_name"), kind.alias("data_type"), samples.alias("sample_values"), F.lit(None).cast("long").alias("null_count"), F.lit(None).cast("long").alias("unique_count")))
    rows = table.agg(F.count("*").alias("row_count"))
    return head.crossJoin(rows).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(own)).alias("column_count"), F.lit(path).alias("file_path"), F.lit(None).cast("string").alias("description"), F.array(*own).alias("columns"))


def describe_csv_files(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, DataFrame]:
    """Descriptions of CSV files by name, and an account (table_name, path, error) of all; a bad file stops nothing."""
    good, account = [], []
    for name, path in paths.items():
        try:
            found = describe_csv(spark, path, name)
            found.first()
            good.append(found)
            account.append((name, path, None))
        except Exception as e:  # noqa: BLE001  whatever is wrong with one file is told in its row
            account.append((name, path, f"{type(e).__name__}: {str(e)[:200]}"))
    return (reduce(DataFrame.unionByName, good) if good else None), spark.createDataFrame(account, "table_name string, path string, error string")


def success(account: DataFrame) -> DataFrame:
    """Total, failed and the success rate of a scan's account."""
    return account.agg(F.count("*").alias("total"), F.count("error").alias("failed"), (1 - F.count("error") / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Queries or ground truth from CSV, with the columns of ``schema.TRUTH`` (those that are absent are null)."""
    found = spark.read.option("header", True).csv(path)
    return found.select(*(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in T.StructType.fromDDL(S.TRUTH).names))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from JSON: pairs, or one record for each query with its ``ground_truth`` or ``related_tables``."""
    found = spark.read.option("multiLine", True).json(path)
    names = found.columns
    many = next((c for c in ("ground_truth", "related_tables") if c in names), None)
    one = F.explode(many) if many else F.col("candidate_table")
    get = lambda *cs: F.coalesce(*(F.col(c) for c in cs if c in names), F.lit(None).cast("string"))
    return found.select(get("query_table", "query_id").alias("query_table"), get("query_column").alias("query_column"), one.alias("candidate_table"), get("candidate_column").alias("candidate_column"), get("query_type").alias("query_type"))


def read_experiment(spark: SparkSession, tables: str, queries: str, truth: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three files of an experiment: described tables, the queries' table names (query_table), and known matches."""
    asked = spark.read.option("multiLine", True).json(queries)
    named = next((c for c in ("query_table", "table_name", "name", "query_id") if c in asked.columns), None)
    if named is None:
        raise ValueError(f"queries in {queries} name no table")
    return read_json_tables(spark, tables), asked.select(F.col(named).cast("string").alias("query_table")).where("query_table is not null").distinct(), read_truth(spark, truth)


def look_up(names: DataFrame, tables: DataFrame, with_csv: bool = True) -> DataFrame:
    """The catalog rows of names (a ``table_name`` column); with_csv: whether the ending .csv makes a difference."""
    key = N.table_name if with_csv else N.bare_name
    left = names.select(F.col("table_name").alias("asked")).withColumn("__key", key(F.col("asked")))
    return left.join(tables.withColumn("__key", key(F.col("table_name"))), "__key", "left").drop("__key")
