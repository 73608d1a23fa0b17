"""Putting evidence together: column matches to table scores, rules and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakefinder.config import Config
from lakefinder.functions import similarity as S
from lakefinder.operators.overlap import top_k

COLUMNS = ["query_table", "query_column", "table_name", "column_name"]
#: Parts of names that mark key columns; a fixed value.
KEY_PARTS = "id|key|uuid|guid|primary|pk"


def merge_hits(semantic: DataFrame, value: DataFrame) -> DataFrame:
    """Column hits of both searches: both 0.6 semantic + 0.4 value, else the one there is; (COLUMNS, confidence, match_type)."""
    s = semantic.select(*COLUMNS, F.col("score").alias("s"))
    v = value.select(*COLUMNS, F.col("score").alias("v"))
    both = s.join(v, COLUMNS, "full_outer")
    confidence = F.when(F.col("s").isNotNull() & F.col("v").isNotNull(), F.least(0.6 * F.col("s") + 0.4 * F.col("v"), F.lit(1.0))).otherwise(F.coalesce("s", "v"))
    kind = F.when(F.col("v").isNull(), "semantic").when(F.col("s").isNull(), "value_overlap").otherwise("semantic+value")
    return both.select(*COLUMNS, F.round(confidence, 9).alias("confidence"), kind.alias("match_type"))


def enhance(hits: DataFrame, hybrid: DataFrame) -> DataFrame:
    """0.3 confidence + 0.7 hybrid similarity, where there is one (``hybrid``: COLUMNS, similarity)."""
    both = hits.join(hybrid, COLUMNS, "left")
    return both.withColumn("confidence", F.coalesce(F.round(0.3 * F.col("confidence") + 0.7 * F.col("similarity"), 9), "confidence")).drop("similarity")


def keep_best(hits: DataFrame, least: float = 0.65, k: int = 10) -> DataFrame:
    return top_k(hits.where(F.col("confidence") >= least), k, ["query_table", "query_column"], ["confidence"], ["table_name", "column_name"])


def score_tables(hits: DataFrame, n_query: DataFrame, config: Config = Config()) -> DataFrame:
    """Tables by their matched columns: count, confidence and coverage, with a bonus for key columns; 0 to 100.

    n_query: (query_table, n_query), the number of query columns.  ``n_matches`` counts
    matches, of which a query column may have several.
    """
    is_key = F.lower("column_name").rlike(KEY_PARTS).cast("int")
    got = hits.groupBy("query_table", "table_name").agg(
        F.count("*").alias("n_matches"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_distinct("query_column").alias("n_covered"),
        F.least(F.lit(20.0), config.key_bonus * F.sum(is_key)).alias("key_bonus"),
        F.array_sort(F.collect_set("match_type")).alias("match_types"),
    )
    both = got.join(n_query, "query_table").withColumn("coverage", F.col("n_covered") / F.col("n_query"))
    base = config.column_count_weight * F.least(F.col("n_matches") / F.col("n_query"), F.lit(1.0)) + config.confidence_weight * F.col("avg_confidence") + config.coverage_weight * F.col("coverage")
    out = both.withColumn("score", F.round(F.least(F.lit(100.0), 100 * base + F.col("key_bonus")), 6))
    return out.withColumn("reason", reason()).select("query_table", "table_name", "n_matches", F.round("avg_confidence", 9).alias("avg_confidence"), F.round("coverage", 9).alias("coverage"), F.round("key_bonus", 9).alias("key_bonus"), "score", "reason")


def reason():
    """Why a table is recommended, in words, from the columns of ``score_tables``."""
    kinds = F.col("match_types")
    has = lambda k: F.array_contains(kinds, k)
    return F.concat_ws(
        ", ",
        F.concat(F.col("n_matches").cast("string"), F.lit(" matching columns")),
        F.when(F.col("avg_confidence") >= 0.8, "high confidence").when(F.col("avg_confidence") >= 0.6, "medium confidence").otherwise("low confidence"),
        F.when(has("semantic+value"), "meaning and values agree")
        .when(has("semantic") & has("value_overlap"), "meaning, and values of other columns")
        .when(has("semantic"), "by meaning")
        .when(has("value_overlap"), "by values"),
        F.when(F.col("key_bonus") > 0, "key columns"),
        F.when(F.col("coverage") >= 0.8, "covers the query").when(F.col("coverage") >= 0.5, "covers half of the query"),
    )


def type_histogram(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_table", "table_name", "match_type").agg(F.count("*").alias("n"))


def normalised_sums(hits: DataFrame, k: int | None = 100) -> DataFrame:
    """The sum of a table's column scores over the largest such sum of the query."""
    sums = hits.groupBy("query_table", "table_name").agg(F.sum("score").alias("total"))
    out = sums.withColumn("score", F.round(F.col("total") / F.max("total").over(Window.partitionBy("query_table")), 9)).drop("total")
    return top_k(out, k, ["query_table"], ["score"], ["table_name"])


def table_statistics(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_tables"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.round(F.avg("n_matches"), 6).alias("avg_matches"))


def pair_score(pairs: DataFrame, widths: DataFrame, least: float = 0.3) -> DataFrame:
    """Table pairs from column pairs above ``least``: confidence, larger and smaller coverage, ratio of widths; 0 to 100."""
    got = pairs.where(F.col("score") > least).groupBy("query_table", "table_name").agg(F.avg("score").alias("c"), F.count_distinct("query_column").alias("a"), F.count_distinct("column_name").alias("b"), F.count("*").alias("n_matches"))
    q = widths.select(F.col("table_name").alias("query_table"), F.col("column_count").alias("n1"))
    t = widths.select("table_name", F.col("column_count").alias("n2"))
    both = got.join(q, "query_table").join(t, "table_name").withColumn("s", F.col("a") / F.col("n1")).withColumn("t", F.col("b") / F.col("n2"))
    score = 0.4 * F.col("c") + 0.3 * F.greatest("s", "t") + 0.2 * F.least("s", "t") + 0.1 * F.least("n1", "n2") / F.greatest("n1", "n2")
    return both.select("query_table", "table_name", "n_matches", F.round(100 * F.least(score, F.lit(1.0)), 6).alias("score"))


def best_pairs_score(pairs: DataFrame, widths: DataFrame, least: float = 0.5) -> DataFrame:
    """mean of the best matches * coverage * 100, from each query column's best match above ``least``."""
    best = Window.partitionBy("query_table", "table_name", "query_column").orderBy(F.desc("score"), "column_name")
    one = pairs.where(F.col("score") > least).withColumn("at", F.row_number().over(best)).where("at = 1")
    got = one.groupBy("query_table", "table_name").agg(F.avg("score").alias("c"), F.count("*").alias("n_matches"))
    q = widths.select(F.col("table_name").alias("query_table"), F.col("column_count").alias("n1"))
    return got.join(q, "query_table").select("query_table", "table_name", "n_matches", F.round(F.col("c") * F.col("n_matches") / F.col("n1") * 100, 6).alias("score"), F.round("c", 9).alias("similarity"), F.round(F.col("n_matches") / F.col("n1"), 9).alias("match_ratio"))


def verdicts(candidates: DataFrame, tables: DataFrame, k: int = 10) -> DataFrame:
    """Rules on the k best candidates (query_table, table_name, score in 0 to 1): method, score and reason.

    In order: a score above 0.9 with column overlap above 0.8; the same structure (score times
    1.2, 1 at most); matching keys; a pattern of dimension or fact tables.  Other candidates
    above 0.6 are ``uncertain``, the rest is dropped.
    """
    few = top_k(candidates.drop("rank"), k, ["query_table"], ["score"], ["table_name"]).drop("rank")
    cols = tables.select("table_name", "columns")
    both = few.join(cols.select(F.col("table_name").alias("query_table"), F.col("columns").alias("a")), "query_table").join(cols.withColumnRenamed("columns", "b"), "table_name")
    a, b, score = F.col("a"), F.col("b"), F.col("score")
    overlap, keys = S.column_overlap(a, b), S.key_match(a, b)
    rule = (
        F.when((score > 0.9) & (overlap > 0.8), "overlap")
        .when(S.identical_structure(a, b), "structure")
        .when(keys > 0.8, "keys")
        .when(S.special_pattern(F.col("query_table"), F.col("table_name"), a, b), "pattern")
        .when(score > 0.6, "uncertain")
    )
    out = both.withColumn("rule", rule).where("rule is not null")
    return out.select(
        "query_table",
        "table_name",
        F.round(F.when(F.col("rule") == "structure", F.least(score * 1.2, F.lit(1.0))).otherwise(score), 9).alias("score"),
        "rule",
        F.when(F.col("rule") == "uncertain", "uncertain").otherwise("rule").alias("method"),
    )


def judged(uncertain: DataFrame, answers: DataFrame) -> DataFrame:
    """A verifier's answers (query_table, table_name, is_match, confidence) applied: a match raises, a refusal lowers the score."""
    both = uncertain.join(answers, ["query_table", "table_name"])
    score = F.when(F.col("is_match"), F.greatest("score", "confidence")).otherwise(F.least(0.8 * F.col("score"), F.col("confidence")))
    return both.select("query_table", "table_name", F.round(score, 9).alias("score"), F.lit("verifier").alias("method"))


def merge_verdicts(rules: DataFrame, verified: DataFrame, k: int = 10) -> DataFrame:
    """Rules win over the verifier for the same table; the k best of each query."""
    both = rules.select("query_table", "table_name", "score", "method", F.lit(0).alias("order")).unionByName(verified.select("query_table", "table_name", "score", "method", F.lit(1).alias("order")))
    first = Window.partitionBy("query_table", "table_name").orderBy("order", F.desc("score"))
    one = both.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at", "order")
    return top_k(one, k, ["query_table"], ["score"], ["table_name"])


def early_stop(found: DataFrame, first: float = 0.90, second: float | None = None) -> DataFrame:
    """(query_table, stop): whether the best score is above ``first`` (and the next above ``second``)."""
    best = found.drop("rank").withColumn("at", F.row_number().over(Window.partitionBy("query_table").orderBy(F.desc("score"), "table_name"))).where("at <= 2")
    got = best.groupBy("query_table").agg(F.max(F.when(F.col("at") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("s2"))
    stop = F.col("s1") > first
    return got.select("query_table", (stop if second is None else stop & F.coalesce(F.col("s2") > second, F.lit(False))).alias("stop"))
