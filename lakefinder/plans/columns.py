"""Scored pairs of columns of two tables: the inputs of matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from lakefinder.functions import features as X, normalize as N, similarity as S
from lakefinder.functions.embedding import gram_vector
from lakefinder.operators import ranks
from lakefinder.operators.fusion import best_pairs_score
from lakefinder.scratch import materialize

SIDE = ["table_name", "column_name", "data_type", "sample_values", "null_count", "unique_count"]


def column_pairs(columns: DataFrame, table_pairs: DataFrame | None = None, per_table: int | None = None) -> DataFrame:
    """Pairs of columns of the given pairs (query_table, table_name); of all tables, if none are given.

    All columns of each table take part; with ``per_table``, its first so many only.  Columns of
    side one have the prefix q_.  Table pairs come from a search.
    """
    own = (columns if per_table is None else columns.where(F.col("ordinal") < per_table)).select(*SIDE)
    q = own.select(*(F.col(c).alias(f"q_{c}") for c in SIDE))
    if table_pairs is None:
        both = q.join(own, F.col("q_table_name") != F.col("table_name"))
    else:
        both = table_pairs.select(F.col("query_table").alias("q_table_name"), "table_name").distinct().join(q, "q_table_name").join(own, "table_name")
    return both.withColumnRenamed("q_table_name", "query_table").withColumnRenamed("q_column_name", "query_column")


def _scored(pairs: DataFrame, score, *more) -> DataFrame:
    return pairs.select("query_table", "query_column", "table_name", "column_name", F.round(score, 9).alias("score"), *more)


def traditional(pairs: DataFrame, name_score=None) -> DataFrame:
    """0.4 name + 0.2 type + 0.3 values + 0.1 statistics, 0.1 or more; with match type and reason.

    name_score: a Column over query_column and column_name; equal names (case does not count) score 1,
    others by character n-gram vectors if it is not given.
    """
    a, b = F.col("query_column"), F.col("column_name")
    if name_score is None:
        names = pairs.select(F.col("query_column").alias("name")).union(pairs.select("column_name")).distinct()
        names = materialize(names.withColumn("grams", gram_vector(F.col("name"), 128)), "grams")
        names = materialize(names.withColumn("v", S.unit(F.col("grams"))).drop("grams"), "names")  # one vector for each name
        pairs = pairs.join(names.select(F.col("name").alias("query_column"), F.col("v").alias("qv")), "query_column").join(names.select(F.col("name").alias("column_name"), "v"), "column_name")
        same = F.when(F.lower(a) == F.lower(b), 1.0).otherwise(F.greatest(S.dot(F.col("qv"), F.col("v")), F.lit(0.0)))
        pairs = pairs.withColumn("name_sim", same).drop("qv", "v")
    else:
        pairs = pairs.withColumn("name_sim", name_score)
    scored = pairs.withColumns({
        "type_sim": S.type_match(F.col("q_data_type"), F.col("data_type")),
        "value_sim": S.values(F.col("q_sample_values"), F.col("sample_values")),
        "stats_sim": S.stats(F.col("q_unique_count"), F.col("unique_count"), F.col("q_null_count"), F.col("null_count")),
    })
    score = 0.4 * F.col("name_sim") + 0.2 * F.col("type_sim") + 0.3 * F.col("value_sim") + 0.1 * F.col("stats_sim")
    kind = S.match_type(F.col("name_sim"), F.col("value_sim")).alias("match_type")
    why = S.match_reason(F.col("name_sim"), F.col("type_sim"), F.col("value_sim"), F.col("stats_sim")).alias("reason")
    return _scored(scored, score, kind, why).where("score >= 0.1")


def fast(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """0.5 characters of the names + 0.3 type + 0.2 values, above ``least``; all pairs are scored before any cut."""
    same = F.when(F.lower("q_data_type") == F.lower("data_type"), 1.0).otherwise(0.3)
    raw = S.jaccard(F.array_distinct("q_sample_values"), F.array_distinct("sample_values"), 0.0)
    return _scored(pairs, 0.5 * S.character_jaccard(F.col("query_column"), F.col("column_name")) + 0.3 * same + 0.2 * raw).where(F.col("score") > least)


def by_names(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """0.7 characters of the names + 0.3 type, above ``least``."""
    same = F.when(F.lower("q_data_type") == F.lower("data_type"), 1.0).otherwise(0.3)
    return _scored(pairs, 0.7 * S.character_jaccard(F.col("query_column"), F.col("column_name")) + 0.3 * same).where(F.col("score") > least)


def hybrid(pairs: DataFrame, samples: bool = True) -> DataFrame:
    """Hybrid similarity: by name; with samples 0.4 name + 0.2 structure + 0.4 values (numbers or categories)."""
    names = pairs.select("query_column", "column_name").distinct()
    names = materialize(names.withColumn("name_sim", S.name(F.col("query_column"), F.col("column_name"))), "names")
    both = pairs.join(names, ["query_column", "column_name"])
    if not samples:
        return _scored(both, F.col("name_sim"))
    both = both.withColumns({
        "q_numeric": X.is_numeric(F.col("q_data_type"), F.col("q_sample_values")),
        "numeric": X.is_numeric(F.col("data_type"), F.col("sample_values")),
        "q_numbers": N.numbers(F.col("q_sample_values")),
        "numbers": N.numbers(F.col("sample_values")),
    })
    has = (F.size("q_sample_values") > 0) & (F.size("sample_values") > 0)
    values = F.when(has & F.col("q_numeric") & F.col("numeric"), numeric_samples(F.col("q_numbers"), F.col("numbers"))).when(has & ~F.col("q_numeric") & ~F.col("numeric"), S.categorical(N.categories(F.col("q_sample_values")), N.categories(F.col("sample_values")))).otherwise(F.lit(0.0))
    structure = S.structural(F.col("q_data_type"), F.col("data_type"), F.col("q_null_count"), F.col("null_count"))
    return _scored(both, S.column(F.col("name_sim"), structure, values))


def numeric_samples(a, b):
    """Numeric similarity of two arrays of samples."""
    n = F.size
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n(x)
    deviation = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean(x)) * (v - mean(x))) / n(x))

    def quantile(x, q):
        s = F.array_sort(x)
        at = F.lit(q) * (n(x) - 1)
        low = F.floor(at).cast("int")
        below, above = F.get(s, low), F.get(s, F.least(low + 1, n(x) - 1))
        return below + (above - below) * (at - low)

    span = lambda x: F.array_max(x) - F.array_min(x)
    both = F.concat(a, b)
    qs = (0.25, 0.5, 0.75)
    return S.numeric(mean(a), mean(b), deviation(a), deviation(b), deviation(both), [quantile(a, q) for q in qs], [quantile(b, q) for q in qs], span(a), span(b), n(a), n(b))


def numeric_profiles(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, n, mean, std, quartiles, span, sum, sum2) of the numeric columns of tables; exact quartiles."""
    parts = []
    for name, t in frames.items():
        own = [f.name for f in t.schema.fields if isinstance(f.dataType, T.NumericType)]
        if own:
            each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in own))
            parts.append(t.select(F.lit(name).alias("table_name"), F.explode(each).alias("v")).select("table_name", "v.*"))
    rows = reduce(DataFrame.union, parts).where("x is not null and not isnan(x)")
    # equal values are counted before they move; quartiles are found by their places
    counted = rows.groupBy("table_name", "column_name", "x").agg(F.count("*").alias("w"))
    counted = ranks.placed(counted, ["table_name", "column_name"], "x", "w")
    sizes = counted.groupBy("table_name", "column_name").agg(F.sum("w").alias("n"))
    counted = counted.join(F.broadcast(sizes), ["table_name", "column_name"])  # one row for each column of the catalog
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ends = [(ranks.value_at(F.floor(place(q)), "x", "w"), ranks.value_at(F.ceil(place(q)), "x", "w"), F.max(place(q) - F.floor(place(q)))) for q in (0.25, 0.5, 0.75)]
    return counted.groupBy("table_name", "column_name").agg(
        F.sum("w").alias("n"),
        (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"),
        F.sum(F.col("x") * F.col("w")).alias("total"),
        F.sum(F.col("x") * F.col("x") * F.col("w")).alias("squares"),
        F.array(*(low + (high - low) * part for low, high, part in ends)).alias("quartiles"),
        (F.max("x") - F.min("x")).alias("span"),
    )


def numeric_similarity(profiles: DataFrame) -> DataFrame:
    """Numeric similarity of every pair of profiled columns of two tables (the catalog's columns, not rows)."""
    q = profiles.select(*(F.col(c).alias(f"q_{c}") for c in profiles.columns))
    both = q.join(profiles, F.col("q_table_name") < F.col("table_name"))
    var = lambda p: F.greatest(F.col(f"{p}squares") / F.col(f"{p}n") - F.pow(F.col(f"{p}mean"), F.lit(2)), F.lit(0.0))
    n = F.col("q_n") + F.col("n")
    mean = (F.col("q_total") + F.col("total")) / n
    joint = F.greatest((F.col("q_squares") + F.col("squares")) / n - mean * mean, F.lit(0.0))
    score = S.numeric(F.col("q_mean"), F.col("mean"), F.sqrt(var("q_")), F.sqrt(var("")), F.sqrt(joint), F.col("q_quartiles"), F.col("quartiles"), F.col("q_span"), F.col("span"), F.col("q_n"), F.col("n"))
    return both.select(F.col("q_table_name").alias("query_table"), F.col("q_column_name").alias("query_column"), "table_name", "column_name", F.round(score, 6).alias("score"))


def best_per_source(pairs: DataFrame, widths: DataFrame, least: float = 0.5) -> DataFrame:
    """Table similarity: the mean of each query column's best score above ``least``, and the share of columns that have one."""
    return best_pairs_score(pairs, widths, least).select("query_table", "table_name", "similarity", "match_ratio")
