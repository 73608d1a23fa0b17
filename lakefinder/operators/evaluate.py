"""How good rankings are: retrieval metrics against known matches, layer metrics, latencies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from lakefinder.operators import ranks

CUTS = (1, 3, 5, 10, 20)


class Labels(NamedTuple):
    """A truth that is not listed: the matches of a query are the rows that share a label with it.

    queries: (query_table, label); rows: (table_name, label).  A name may have several labels, in a row
    each; a null label matches nothing.  Listed pairs would grow with queries times rows; here names are
    counted by their sets of labels, and only what was predicted is looked up.
    """

    queries: DataFrame
    rows: DataFrame


def _label_sets(named: DataFrame, name: str, out: str) -> DataFrame:
    return named.where(F.col(name).isNotNull() & F.col("label").isNotNull()).groupBy(name).agg(F.sort_array(F.collect_set("label")).alias(out))


def _truth_sizes(truth: DataFrame | Labels, include_self: bool) -> DataFrame:
    """(query_table, n_true) of the queries that have matches."""
    if not isinstance(truth, Labels):
        return truth.groupBy("query_table").agg(F.count("*").alias("n_true"))
    asked, own = _label_sets(truth.queries, "query_table", "asked"), _label_sets(truth.rows, "table_name", "own")
    sets = own.groupBy("own").agg(F.count("*").alias("n"))
    met = asked.select("asked").distinct().withColumn("label", F.explode("asked")).join(sets.withColumn("label", F.explode("own")), "label")
    counted = met.groupBy("asked", "own").agg(F.first("n").alias("n")).groupBy("asked").agg(F.sum("n").alias("n_true"))
    sizes = asked.join(counted, "asked")
    if not include_self:
        same = sizes.join(own.withColumnRenamed("table_name", "query_table"), "query_table", "left")
        sizes = same.withColumn("n_true", F.col("n_true") - F.coalesce(F.arrays_overlap("asked", "own").cast("long"), F.lit(0)))
    return sizes.where("n_true > 0").select("query_table", "n_true")


def _with_hits(first: DataFrame, truth: DataFrame | Labels) -> DataFrame:
    """Predictions with ``hit``, 1 for a match and else 0."""
    if not isinstance(truth, Labels):
        return first.join(truth.withColumn("hit", F.lit(1)), ["query_table", "table_name"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    both = first.join(_label_sets(truth.rows, "table_name", "own"), "table_name", "left").join(_label_sets(truth.queries, "query_table", "asked"), "query_table", "left")
    return both.withColumn("hit", F.coalesce(F.arrays_overlap("asked", "own").cast("int"), F.lit(0))).drop("asked", "own")


def _known(truth: DataFrame | Labels, include_self: bool) -> DataFrame | Labels:
    """A listed truth as distinct (query_table, table_name); one of labels as it is."""
    if isinstance(truth, Labels):
        return truth
    known = truth.select("query_table", F.col("candidate_table").alias("table_name")).distinct()
    return known if include_self else known.where("query_table != table_name")


def ranked(predictions: DataFrame, k: int = 10) -> DataFrame:
    """The first k predictions of each query, with their ``rank``."""
    order = Window.partitionBy("query_table").orderBy(F.desc("score"), "table_name")
    return predictions.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_metrics(predictions: DataFrame, truth: DataFrame | Labels, k: int = 10, include_self: bool = False) -> DataFrame:
    """Per query of the truth: precision, recall, f1, mrr, hit, average precision and nDCG at k.

    predictions: (query_table, table_name, score); truth: (query_table, candidate_table), or ``Labels``.
    A query without predictions has 0 in all.  With ``include_self`` a table may be its own match.
    """
    known = _known(truth, include_self)
    got = predictions if include_self else predictions.where("query_table != table_name")
    sizes = _truth_sizes(known, include_self)
    hits = _with_hits(ranked(got, k), known)
    hits = hits.withColumn("so_far", F.sum("hit").over(Window.partitionBy("query_table").orderBy("rank")))
    found = hits.groupBy("query_table").agg(
        F.count("*").alias("n_predicted"),
        F.sum("hit").alias("n_hit"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    both = sizes.join(found, "query_table", "left").na.fill(0, ["n_predicted", "n_hit", "ap", "dcg"])
    p = F.when(F.col("n_predicted") > 0, F.col("n_hit") / F.col("n_predicted")).otherwise(0.0)
    r = F.col("n_hit") / F.col("n_true")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_true", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return both.select(
        "query_table",
        F.round(p, 9).alias("precision"),
        F.round(r, 9).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9).alias("f1"),
        F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 9).alias("mrr"),
        (F.col("n_hit") > 0).cast("int").alias("hit"),
        F.round(F.col("ap") / F.least("n_true", F.lit(k)), 9).alias("average_precision"),
        F.round(F.col("dcg") / ideal, 9).alias("ndcg"),
    )


METRICS = ("precision", "recall", "f1", "mrr", "hit", "average_precision", "ndcg")


def macro(metrics: DataFrame) -> DataFrame:
    """Means over the queries."""
    return metrics.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(m), 9).alias(m) for m in METRICS))


def spread(metrics: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) over runs or queries."""
    each = metrics.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))).alias("m")).select("m.*")
    return each.groupBy("metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_pop("value"), 9).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def layer_metrics(inputs: DataFrame, outputs: DataFrame, truth: DataFrame | Labels, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """For each query and cut k with k outputs or more: precision, recall and hit; with the share that was filtered and the truth that was retained.

    inputs: (query_table, n_in); outputs: (query_table, table_name, score); truth as for ``query_metrics``.
    A table is not its own match.
    """
    known = _known(truth, False)
    sizes = _truth_sizes(known, False)
    order = Window.partitionBy("query_table").orderBy(F.desc("score"), "table_name")
    placed = outputs.drop("rank").withColumn("rank", F.row_number().over(order))
    hits = _with_hits(placed, known).withColumn("hit", F.when(F.col("query_table") != F.col("table_name"), F.col("hit")).otherwise(0))
    each = hits.withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    got = each.groupBy("query_table", "k").agg(F.count("*").alias("n_out"), F.sum("hit").alias("n_kept"), F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit")).otherwise(0)).alias("n_hit"))
    both = got.where("n_out >= k").join(sizes, "query_table").join(inputs, "query_table")
    return both.select(
        "query_table",
        "k",
        F.round(1 - F.col("n_out") / F.col("n_in"), 9).alias("filter_ratio"),
        F.round(F.col("n_kept") / F.col("n_true"), 9).alias("retention"),
        F.round(F.col("n_hit") / F.col("k"), 9).alias("precision"),
        F.round(F.col("n_hit") / F.col("n_true"), 9).alias("recall"),
        (F.col("n_hit") > 0).cast("int").alias("hit"),
    )


def layer_means(layers: DataFrame) -> DataFrame:
    """Means of layer metrics (with a ``layer`` column) for each layer and cut."""
    return layers.groupBy("layer", "k").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(m), 9).alias(m) for m in ("filter_ratio", "retention", "precision", "recall", "hit")))


def truth_frequency(truth: DataFrame, k: int = 10) -> DataFrame:
    return truth.groupBy("query_table").agg(F.count("*").alias("n_matches")).orderBy(F.desc("n_matches"), "query_table").limit(k)


def latencies(log: DataFrame, group: str, value: str = "seconds", at: tuple[float, ...] = (0.5, 0.9, 0.99), slow: float | None = None, failed: str | None = None) -> DataFrame:
    """Per group: count, mean, and the values at floor(n * q) of the sorted ones; the largest for 0.99 of fewer than 100.

    Equal values are counted before they move, and places are found by prefix sums (``ranks``), so
    no group is a task of its own.  With ``slow`` also ``n_slow``, how many took longer; with
    ``failed``, a boolean column, ``success_rate``; and ``qps``, the count over the sum of the values.
    Null values are left out; a group that has no others, or a null name, is left out too.
    """
    rows = log.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counted = rows.groupBy(group, F.col(value).alias("__value")).agg(F.count("*").alias("n"))
    sizes = rows.groupBy(group).agg(
        F.count("*").alias("__all"),
        F.avg(value).alias("__mean"),
        F.max(value).alias("__most"),
        *([F.sum((F.col(value) > slow).cast("long")).alias("n_slow")] if slow is not None else []),
        *([(1 - F.avg(F.coalesce(F.col(failed), F.lit(False)).cast("double"))).alias("success_rate"), (F.count("*") / F.sum(value)).alias("qps")] if failed else []),
    )
    more = (["n_slow"] if slow is not None else []) + (["success_rate", "qps"] if failed else [])
    both = ranks.placed(counted, [group], "__value").join(sizes, group)
    cols = [ranks.value_at(F.floor(F.col("__all") * F.lit(q)), "__value").alias(f"p{round(q * 100)}") for q in at]
    out = both.groupBy(group).agg(F.max("__all").alias("n"), F.round(F.max("__mean"), 6).alias("mean"), F.max("__most").alias("__most"), *cols, *(F.max(c).alias(c) for c in more))
    if 0.99 in at:
        out = out.withColumn("p99", F.when(F.col("n") < 100, F.col("__most")).otherwise(F.col("p99")))
    return out.drop("__most")


def alerts(summary: DataFrame) -> DataFrame:
    """What is wrong with a summary (success_rate, mean_seconds, cache_hit_rate), in words; no row if nothing is."""
    found = F.array(
        F.when(F.col("success_rate") < 0.95, "success rate below 95 %"),
        F.when(F.col("mean_seconds") > 10, "mean time above 10 s"),
        F.when(F.col("cache_hit_rate") < 0.30, "cache hit rate below 30 %"),
    )
    return summary.select(F.explode(F.filter(found, lambda a: a.isNotNull())).alias("alert"))
