"""Intermediate tables in the folder that all executors share.

A table written here cuts the lineage and survives the loss of an executor.
The folder is ``spark.checkpoint.dir`` of the session; where that is unset and all runs
in one process (tests on one machine), a temporary folder is set instead.  On a cluster the
setting must be there: a folder of one machine's own would scatter the parts of a table.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one of its own only where the session names none."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{KEY} must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="lakefinder-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with its schema.

    The files are removed when the driver's JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakefinder/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakefinder_path = path
    return out


def stamp(spark: SparkSession, *paths: str) -> str:
    """What changes when files at the paths (or in the folders of that name) are written anew: their names, sizes and times."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    seen = []
    for p in map(jvm.Path, paths):
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        seen += sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in files.listStatus(p))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def discard(df: DataFrame) -> None:
    """Remove the files behind a DataFrame that ``materialize`` returned and nothing reads any more."""
    path = getattr(df, "_lakefinder_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the JVM look for plans that nobody holds any more: Spark then removes their shuffle files.

    Otherwise these stay until the driver happens to collect its garbage, which a driver
    with little to do may not for long.
    """
    spark.sparkContext._jvm.System.gc()
