"""Exact order statistics of groups of any size, from counts of distinct values and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakefinder.scratch import materialize


def placed(counted: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Rows (keys, value, n; each value once a group) with ``before``: how many of the group lie below the value.

    The rows are range partitioned by group and value, so a large group lies in many parts.  Each
    part's total, summed over the parts before it, and a running sum within the part make the
    place; what meets in one task is a part, or one number of each part.
    """
    parts = counted.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "ranks")
    below = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "__part").agg(F.sum(n).alias("__total"))
    totals = totals.select(*keys, "__part", F.coalesce(F.sum("__total").over(below), F.lit(0)).alias("__below"))
    within = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    both = parts.withColumn("__within", F.coalesce(F.sum(n).over(within), F.lit(0))).join(totals, [*keys, "__part"])
    return both.withColumn("before", F.col("__below") + F.col("__within")).drop("__part", "__below", "__within")


def value_at(place: Column, value: str, n: str = "n") -> Column:
    """An aggregate over ``placed`` rows of a group: the value at a place, counted from 0."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col(n)), F.col(value)))
