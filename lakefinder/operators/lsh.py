"""MinHash signatures and banding: which items have like feature sets."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakefinder.functions import similarity as S
from lakefinder.operators.overlap import top_k

#: The modulus of the hash functions; a fixed value.
PRIME = 2**31 - 1


def coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """n pairs (a, b) of hash functions a * h + b modulo PRIME."""
    rnd = random.Random(seed)
    return [(rnd.randint(1, PRIME - 1), rnd.randint(0, PRIME - 1)) for _ in range(n)]


def digest(feature: Column) -> Column:
    """MD5 of the feature, a number of 128 bits, modulo PRIME: 2**32 is 2 modulo PRIME."""
    h = F.md5(feature.cast("binary"))
    word = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    return F.pmod(8 * word(0) + 4 * word(1) + 2 * word(2) + word(3), F.lit(PRIME))


def signature(features: Column, n: int = 64, seed: int = 42) -> Column:
    """The minima of n hash functions over a set of features; zeros for an empty set."""
    pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in coefficients(n, seed)))
    hashed = F.transform(features, digest)
    least = F.transform(pairs, lambda p: F.array_min(F.transform(hashed, lambda h: F.pmod(p["a"] * h + p["b"], F.lit(PRIME)))))
    return F.when(F.size(features) == 0, F.array_repeat(F.lit(0).cast("long"), n)).otherwise(least)


def estimate(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures: an estimate of the sets' Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def banded(items: DataFrame, bands: int = 8, rows: int = 2) -> DataFrame:
    """(id, band, bucket): the first ``bands`` bands of ``rows`` places of each signature; all bands, if there are so many."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.slice("signature", k * rows + 1, F.lit(rows))).alias("bucket")))
    return items.select("id", F.explode(each).alias("b")).select("id", "b.*")


def candidates(queries: DataFrame, items: DataFrame, bands: int = 8, rows: int = 2) -> DataFrame:
    """Distinct (query_id, id) that share a bucket."""
    q = banded(queries, bands, rows).withColumnRenamed("id", "query_id")
    return q.join(banded(items, bands, rows), ["band", "bucket"]).where("query_id != id").select("query_id", "id").distinct()


def sharing(queries: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Distinct (query_id, id) of all pairs whose Jaccard similarity may be ``threshold`` or more, by a prefix filter.

    Features are ordered by how many items have them, rare ones first.  Of n features a set must
    share ceil(threshold * n) with one so similar, so two such sets meet in the first
    n - ceil(threshold * n) + 1 of both; and the smaller has ``threshold`` of the larger's size at
    least.  Nothing is lost.  Empty sets meet each other; a threshold of 0 or less takes every pair.
    """
    if threshold <= 0:
        return queries.select(F.col("id").alias("query_id")).join(items.select("id"), F.col("query_id") != F.col("id")).distinct()
    own = F.array_distinct("features")
    each = lambda rows: rows.select("id", own.alias("features")).distinct().select("id", "features", F.size("features").alias("n"), F.explode(F.when(F.size("features") == 0, F.array(F.lit(""))).otherwise(F.col("features"))).alias("feature"))
    df = each(items).groupBy("feature").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("id", "features").orderBy("df", "feature")
    kept = F.col("n") - F.ceil(threshold * F.col("n") - 1e-6) + 1

    def prefix(rows: DataFrame) -> DataFrame:
        ranked = each(rows).join(df, "feature", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("place", F.row_number().over(rarest))
        return ranked.where(F.col("place") <= kept).select("id", "n", "feature")

    q = prefix(queries).select(F.col("id").alias("query_id"), F.col("n").alias("m"), "feature")
    alike = F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-6
    return q.join(prefix(items), "feature").where((F.col("query_id") != F.col("id")) & alike).select("query_id", "id").distinct()


def similar(queries: DataFrame, items: DataFrame, threshold: float = 0.5, k: int | None = 1000, bands: int | None = None, rows: int = 2) -> DataFrame:
    """Pairs whose true Jaccard similarity is ``threshold`` or more, best first; rows: (id, features, signature).

    All such pairs are found; with ``bands``, only those that share a bucket of that many
    bands, which finds a pair of similarity s with probability 1 - (1 - s ** rows) ** bands.
    """
    found = sharing(queries, items, threshold) if bands is None else candidates(queries, items, bands, rows)
    both = found.join(queries.select(F.col("id").alias("query_id"), F.col("features").alias("qf")), "query_id").join(items.select("id", "features"), "id")
    scored = both.select("query_id", "id", F.round(S.jaccard(F.col("qf"), F.col("features")), 9).alias("score")).where(F.col("score") >= threshold)
    return top_k(scored, k, ["query_id"], ["score"], ["id"])


def statistics(bands: DataFrame) -> DataFrame:
    """(n_buckets, items_per_bucket, largest_bucket)."""
    sizes = bands.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_buckets"), F.avg("n").alias("items_per_bucket"), F.max("n").alias("largest_bucket"))
