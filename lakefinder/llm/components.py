"""Connected components by alternating large and small stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakefinder.scratch import discard, materialize


#: Ids in one broadcast, at most.
FEW = 1_000_000


def if_few(ids: DataFrame) -> DataFrame:
    """Rows of ids to be broadcast if they are ``FEW`` at most (they are counted), else to be joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches, from edges (u, v) of comparable ids with u != v.

    Returns (u, v) rows: v is the smallest node of u's component, for every node u but the
    smallest ones themselves.  Repeated edges count once; no edges give no rows.  A hub of
    any degree costs one aggregate and one join on its id, which adaptive execution splits.
    """
    now = edges.where("u != v")
    while True:
        after = materialize(_small_star(_large_star(now)), "edges")
        if now is not edges:
            discard(now)
        now = after
        # done when every node has one edge, to a node that has none: trees of depth one, one for each component
        ends = after.select(F.col("u").alias("w"), F.lit(1).alias("out")).unionByName(after.select(F.col("v").alias("w"), F.lit(0).alias("out")))
        degrees = ends.groupBy("w").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
        if not degrees.where("n > 1 or n = 1 and least = 0").agg(F.count("*")).first()[0]:
            return after
