"""The value index kept up to date by a stream of rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lakefinder.functions import normalize as N
from lakefinder.sources.catalog import indexed


def new_values(rows: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, value) of a batch or stream of a table's rows; not yet distinct."""
    own = [f for f in rows.schema.fields if indexed(f.dataType)]
    each = F.array(*(F.struct(F.lit(f.name).alias("column_name"), N.value(F.col(f"`{f.name}`")).alias("value")) for f in own))
    return rows.select(F.lit(table).alias("table_name"), F.explode(each).alias("v")).select("table_name", "v.*").where("value is not null")


def keep_index(stream: DataFrame, table: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Add a stream's values to the index at ``path``: of each batch those that the table's part does not have.

    The index may be one that ``store.save`` wrote (its folder ``values``), or none yet.  A batch's
    files carry the stream's name (a digest of its checkpoint's path) and the batch's number.
    A batch that is run again, because the driver died before its commit, first removes what it
    left, and compares itself with the other files only, so it writes the same values again.
    Files are written aside and then renamed: readers never see one that is half written.
    """
    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        root, aside = jvm.Path(f"{path}/table_name={table}"), jvm.Path(f"{path}/_{stream_name}-{number}")
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(root)
        mark = f"batch-{stream_name}-{number}-"
        others = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(mark):
                files.delete(status.getPath(), False)
            elif name.endswith(".parquet"):
                others.append(status.getPath().toString())
        own = new_values(batch, table).select("column_name", "value").distinct()
        if others:
            known = spark.read.schema("column_name string, value string").parquet(*others)
            own = own.join(known, ["column_name", "value"], "left_anti")
        own.write.mode("overwrite").parquet(aside.toString())
        for k, status in enumerate(s for s in files.listStatus(aside) if s.getPath().getName().endswith(".parquet")):
            if not files.rename(status.getPath(), jvm.Path(root, f"{mark}{k:05d}.parquet")):
                raise OSError(f"cannot move {status.getPath()} into the index")
        files.delete(aside, True)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "10 minutes", late: str = "10 minutes", value: Column | None = None) -> DataFrame:
    """Counts (and sums) per window of event time and group; rows later than ``late`` are left out of a stream."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp"))
    marked = timed.withWatermark("__time", late)
    return marked.groupBy(F.window("__time", width), group).agg(F.count("*").alias("n"), F.sum(value if value is not None else F.lit(0)).alias("total"))
