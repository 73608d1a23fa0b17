"""Writing the catalog, reading it again, changing single rows, and the store of experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakefinder.scratch import materialize
from lakefinder.sources.catalog import Lake


def save(lake: Lake, path: str) -> None:
    """Write a catalog; values are laid out by table, so a table's index is one folder."""
    lake.tables.write.mode("overwrite").parquet(f"{path}/tables")
    lake.columns.write.mode("overwrite").parquet(f"{path}/columns")
    lake.values.write.mode("overwrite").partitionBy("table_name").parquet(f"{path}/values")


def load(spark: SparkSession, path: str) -> Lake:
    return Lake(*(spark.read.parquet(f"{path}/{p}") for p in ("tables", "columns", "values")))


def append(lake: Lake, path: str) -> None:
    """Add those tables of a catalog to a written one that it does not have, with their columns and values."""
    spark = lake.tables.sparkSession
    known = load(spark, path).tables.select("table_name")
    new = materialize(lake.tables.join(known, "table_name", "left_anti"), "appended")
    names = new.select("table_name")
    lake.values.join(names, "table_name", "left_semi").write.mode("append").partitionBy("table_name").parquet(f"{path}/values")
    lake.columns.join(names, "table_name", "left_semi").write.mode("append").parquet(f"{path}/columns")
    new.write.mode("append").parquet(f"{path}/tables")  # last, so that a table that is listed is whole


def verify(lake: Lake) -> DataFrame:
    """One row: tables, columns, columns with values, and values; and whether each column belongs to a table."""
    tables = lake.tables.agg(F.count("*").alias("n_tables"), F.sum("column_count").cast("long").alias("n_listed"))
    columns = lake.columns.agg(F.count("*").alias("n_columns"))
    values = lake.values.agg(F.count("*").alias("n_values"), F.count_distinct("table_name", "column_name").alias("n_indexed"))
    return tables.crossJoin(columns).crossJoin(values).withColumn("complete", F.col("n_listed") == F.col("n_columns"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys.

    Of several new rows of one key the one with the largest ``newest`` (a time, say; null first)
    stays; where that is not given, or equal, the one with the largest hash of all columns, so
    the result does not depend on the order of rows.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    latest = [F.col(newest).desc_nulls_last()] if newest else []
    first = Window.partitionBy(*keys).orderBy(F.desc("__new"), *latest, F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in new.columns)).desc())
    return both.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at", "__new")


def vectors(rows: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """``rows`` if all vectors have ``dim`` numbers; reading them fails otherwise."""
    checked = F.when(F.size(col) == dim, F.col(col)).otherwise(F.raise_error(F.format_string("a vector has %d numbers", F.size(col))))
    return rows.withColumn(col, checked)


def save_run(run: DataFrame, path: str) -> None:
    """Append runs: run_id, task, at (timestamp), f1, n_queries and whatever else."""
    run.write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def latest(found: DataFrame) -> DataFrame:
    """The last run of each task."""
    return found.groupBy("task").agg(F.max_by("run_id", "at").alias("run_id"), F.max("at").alias("at"))


def summary(found: DataFrame) -> DataFrame:
    """Runs, best F1 and its run, and queries of each task."""
    return found.groupBy("task").agg(F.count("*").alias("n_runs"), F.max("f1").alias("best_f1"), F.max_by("run_id", "f1").alias("best_run"), F.sum("n_queries").alias("n_queries"))


def archive(found: DataFrame, before: str) -> tuple[DataFrame, DataFrame]:
    """Runs since a time, and those before it."""
    old = F.col("at") < F.lit(before).cast("timestamp")
    return found.where(~old), found.where(old)
