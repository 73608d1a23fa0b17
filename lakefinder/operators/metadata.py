"""Search by what is known of tables without looking at their data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakefinder.functions import features as X, normalize as N, similarity as S
from lakefinder.operators.overlap import top_k

FEATURES = ["domain", "size_category", "column_count", "type_counts", "key_columns"]


def table_features(tables: DataFrame) -> DataFrame:
    """The metadata index: all rule-derived features of each table."""
    cols, name = F.col("columns"), F.col("table_name")
    typed = F.filter(F.transform(cols, lambda c: N.signature_type(c["data_type"])), lambda t: t.isNotNull())
    return tables.select(
        "table_name",
        "row_count",
        F.size(cols).alias("column_count"),
        X.domain(name).alias("domain"),
        X.size_category(F.size(cols)).alias("size_category"),
        X.column_bucket(F.size(cols)).alias("column_bucket"),
        X.column_range(F.size(cols)).alias("column_range"),
        X.row_range(F.coalesce("row_count", F.lit(0))).alias("row_range"),
        X.naming_pattern(name).alias("naming_pattern"),
        F.array(*(X.count_type(cols, t) for t in X.TYPE_ORDER)).alias("type_counts"),
        X.type_signature(cols).alias("type_signature"),
        X.key_columns(cols).alias("key_columns"),
        X.matcher_keys(cols).alias("matcher_keys"),
        X.identifier_columns(cols).alias("identifier_columns"),
        X.is_dimension(name).alias("is_dimension"),
        X.is_fact(name).alias("is_fact"),
        X.foreign_key_ratio(cols).alias("foreign_key_ratio"),
        X.schema_pattern(cols).alias("schema_pattern"),
        X.domain_keywords(name, cols).alias("domain_keywords"),
        X.table_signature(cols).alias("table_signature"),
        F.map_from_entries(F.transform(F.array_distinct(typed), lambda t: F.struct(t, F.size(F.filter(typed, lambda x: x == t))))).alias("signature_types"),
    )


def schema_summary(tables: DataFrame) -> DataFrame:
    """(table_name, semantic_group, columns): each table's columns by meaning."""
    each = tables.select("table_name", F.posexplode("columns").alias("at", "c"))
    each = each.withColumn("semantic_group", X.semantic_group(F.col("c.column_name")))
    return each.groupBy("table_name", "semantic_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c.column_name"))), lambda s: s["column_name"]).alias("columns"))


def _pairs(queries: DataFrame, features: DataFrame, columns: list[str], include_self: bool) -> DataFrame:
    """Every query with every table: the queries are few (a search's tables), and a table is a row of the catalog."""
    q = queries.select(F.col("table_name").alias("query_table"), *(F.col(c).alias(f"q_{c}") for c in columns))
    both = features.select("table_name", *columns).join(F.broadcast(q) if _few(q) else q, F.lit(True))
    return both if include_self else both.where("query_table != table_name")


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether there are no more than ``most`` rows; looks at no more than that."""
    return rows.limit(most + 1).count() <= most


def metadata_search(queries: DataFrame, features: DataFrame, k: int | None = 1000, include_self: bool = True) -> DataFrame:
    """The k best tables for each query table by metadata similarity; a table scores 1 with itself."""
    both = _pairs(queries, features, FEATURES, include_self)
    score = S.metadata(*(F.col(p + c) for c in FEATURES for p in ("q_", "")))
    score = F.when(F.col("query_table") == F.col("table_name"), 1.0).otherwise(score)
    found = both.select("query_table", "table_name", F.round(score, 9).alias("score")).where("score > 0")
    return top_k(found, k, ["query_table"], ["score"], ["table_name"])


def signature_search(queries: DataFrame, features: DataFrame, k: int | None = 100, include_self: bool = False) -> DataFrame:
    """The k best tables for each query table by signature similarity."""
    names = ["column_count", "signature_types", "schema_pattern", "domain_keywords"]
    both = _pairs(queries, features, names, include_self)
    score = S.signature(*(F.col(p + c) for c in names for p in ("q_", "")))
    return top_k(both.select("query_table", "table_name", F.round(score, 9).alias("score")), k, ["query_table"], ["score"], ["table_name"])


def best_of_queries(found: DataFrame) -> DataFrame:
    """Each table once, with its best score over the queries."""
    return found.groupBy("table_name").agg(F.max("score").alias("score"))


#: Neighbours of each range of column counts.
RANGES = ("small", "medium", "large", "xlarge")


def prefilter(features: DataFrame, keywords: list[str] | None = None, column_range: str | None = None, pattern: str | None = None, max_candidates: int = 1000) -> DataFrame:
    """Tables that meet the criteria given: any keyword, the column range or one beside it, a like schema pattern.

    The tables that meet all criteria that some table meets; if those are fewer than a tenth of
    ``max_candidates``, the tables that meet any.  Without criteria all tables.  In order
    of name, ``max_candidates`` at most (it is the size of the result that was asked for).
    """
    tests: list[Column] = []
    if keywords:
        tests.append(F.arrays_overlap("domain_keywords", F.array(*(F.lit(w.lower()) for w in keywords))))
    if column_range:
        at = RANGES.index(column_range)
        tests.append(F.col("column_range").isin(*RANGES[max(0, at - 1) : at + 2]))
    if pattern:
        parts = lambda p: F.array_distinct(F.split(p, r"\|"))
        tests.append((F.col("schema_pattern") == pattern) | (S.jaccard(parts(F.col("schema_pattern")), parts(F.lit(pattern))) > 0.5))
    if not tests:
        return features.select("table_name").orderBy("table_name").limit(max_candidates)
    met = features.select("table_name", *(t.alias(f"t{i}") for i, t in enumerate(tests)))
    used = met.agg(*(F.coalesce(F.max(f"t{i}"), F.lit(False)).alias(f"t{i}") for i in range(len(tests)))).first()
    use = [f"t{i}" for i in range(len(tests)) if used[f"t{i}"]]
    if not use:
        return met.select("table_name").limit(0)
    every, some = " and ".join(use), " or ".join(use)
    kept = met.where(every)
    if kept.count() < 0.1 * max_candidates:
        kept = met.where(some)
    return kept.select("table_name").orderBy("table_name").limit(max_candidates)


def shared_letters(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Pairs of tables of one of the domains user, order and product, or with min(3, 0.3 letters) letters in common."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))
    q = queries.select(F.col("table_name").alias("query_table"))
    both = tables.select("table_name").join(F.broadcast(q) if _few(q) else q, F.col("table_name") != F.col("query_table"))
    a, b = F.col("query_table"), F.col("table_name")
    same = X.domain(a).isin("user", "order", "product") & (X.domain(a) == X.domain(b))
    common = F.size(F.array_intersect(letters(a), letters(b)))
    return both.where(same | (common >= F.least(F.lit(3.0), 0.3 * F.char_length(a)))).select("query_table", "table_name")


def threshold(found: DataFrame, least: float, k: int | None) -> DataFrame:
    """Scores above ``least``, the best k of each query."""
    return top_k(found.where(F.col("score") > least), k, ["query_table"], ["score"], ["table_name"])


def relaxed(found: DataFrame, k: int, high: float = 0.35, discount: float = 0.8, pad_to: int = 20, pad_discount: float = 0.6) -> DataFrame:
    """The best k above ``high``; where they are fewer than k / 2, also those above half of it at a discount; padded to ``pad_to``.

    Order is by score, then name; rows of a group keep their order and carry their discounted score.
    """
    by = Window.partitionBy("query_table")
    ranked = found.drop("rank").withColumn("at", F.row_number().over(by.orderBy(F.desc("score"), "table_name")))
    ranked = ranked.withColumn("n_high", F.count(F.when(F.col("score") > high, 1)).over(by))
    kind = (
        F.when((F.col("score") > high) & (F.col("at") <= k), 0)
        .when((F.col("score") <= high) & (F.col("score") > high / 2) & (F.col("at") <= F.greatest(F.col("n_high"), F.lit(k // 2))), 1)
        .when(F.col("at") <= pad_to, 2)
    )
    kept = ranked.withColumn("kind", kind).where("kind is not null")
    score = F.when(F.col("kind") == 0, F.col("score")).when(F.col("kind") == 1, F.col("score") * discount).otherwise(F.col("score") * pad_discount)
    return kept.select("query_table", "table_name", F.round(score, 9).alias("score"), "kind")
