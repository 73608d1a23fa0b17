"""Search by values: which columns of the lake share values with query columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from lakefinder.scratch import materialize

KEYS = ["query_table", "query_column", "table_name", "column_name"]
#: Values of a query in one broadcast, at most; they are counted, and joined by a shuffle beyond that.
FEW_VALUES = 1_000_000


def value_overlap(query: DataFrame, values: DataFrame, min_overlap: float = 0.35, k: int | None = None, include_self: bool = False) -> DataFrame:
    """Columns that share values with query columns, by 0.7 share of the query + 0.3 share of the column.

    query: distinct (query_table, query_column, value); values: distinct (table_name,
    column_name, value).  Kept are pairs whose share of the query is ``min_overlap`` or
    more; with k, the best k for each query column (ties by name).  A value is joined by a
    hash of itself, and hits are added up in every task before they move; a frequent value
    brings a row for each column that has it, as each of them is a hit.
    """
    sizes = values.groupBy("table_name", "column_name").agg(F.count("*").alias("n_target"))
    wanted = query.groupBy("query_table", "query_column").agg(F.count("*").alias("n_query"))
    hits = query.join(values, "value")
    if not include_self:
        hits = hits.where("query_table != table_name")
    hits = hits.groupBy(*KEYS).agg(F.count("*").alias("n_hit"))
    out = hits.join(wanted, ["query_table", "query_column"]).join(sizes, ["table_name", "column_name"])
    out = (
        out.withColumn("overlap", F.col("n_hit") / F.col("n_query"))
        .withColumn("target", F.col("n_hit") / F.col("n_target"))
        .withColumn("score", 0.7 * F.col("overlap") + 0.3 * F.col("target"))
        .where(F.col("overlap") >= min_overlap)
        .select(*KEYS, "n_hit", "overlap", "target", "score")
    )
    return top_k(out, k, ["query_table", "query_column"], ["score"], ["table_name", "column_name"])


def value_overlap_unindexed(query: DataFrame, rows: DataFrame, sizes_of: Callable[[set[tuple[str, str]]], DataFrame], min_overlap: float = 0.35, k: int | None = None) -> DataFrame:
    """As ``value_overlap`` for one search over a lake without an index.

    query: distinct (query_table, query_column, value) of few columns; rows: (table_name,
    column_name, value) of the lake, with repeats; sizes_of: (table_name, column_name, n_target)
    of given columns.  Only rows whose value the query has are made distinct, and the
    distinct values are counted of those columns alone that share enough: no other value moves.
    """
    query = materialize(query, "query")
    wanted = query.groupBy("query_table", "query_column").agg(F.count("*").alias("n_query"))
    values = query.select("value").distinct()
    few = values.count() <= FEW_VALUES
    met = rows.join(F.broadcast(values) if few else values, "value", "left_semi").distinct()
    hits = query.join(met, "value").where("query_table != table_name").groupBy(*KEYS).agg(F.count("*").alias("n_hit"))
    hits = hits.join(wanted, ["query_table", "query_column"]).withColumn("overlap", F.col("n_hit") / F.col("n_query")).where(F.col("overlap") >= min_overlap)
    hits = materialize(hits, "hits")
    columns = {(r.table_name, r.column_name) for r in hits.select("table_name", "column_name").distinct().toLocalIterator()}  # names of the schema
    out = hits.join(F.broadcast(sizes_of(columns)), ["table_name", "column_name"])
    out = out.withColumn("target", F.col("n_hit") / F.col("n_target")).withColumn("score", 0.7 * F.col("overlap") + 0.3 * F.col("target"))
    return top_k(out.select(*KEYS, "n_hit", "overlap", "target", "score"), k, ["query_table", "query_column"], ["score"], ["table_name", "column_name"])


def top_k(rows: DataFrame, k: int | None, by: list[str], desc: list[str], ties: list[str]) -> DataFrame:
    """The best k rows of each group; the group limit is pushed below the shuffle."""
    if k is None:
        return rows
    order = [F.desc(c) for c in desc] + [F.asc(c) for c in ties]
    window = Window.partitionBy(*by).orderBy(*order) if by else None
    if window is None:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def pattern_search(values: DataFrame, pattern: str, k: int | None = 10, shown: int = 10) -> DataFrame:
    """Columns with values that have a pattern (case does not count): the share of their values, and some of them."""
    hit = F.col("value").rlike("(?i)" + pattern)
    found = values.groupBy("table_name", "column_name").agg(F.count("*").alias("n_values"), F.count(F.when(hit, 1)).alias("n_hit"))
    found = found.where("n_hit > 0").withColumn("score", F.col("n_hit") / F.col("n_values"))
    best = top_k(found, k, [], ["score"], ["table_name", "column_name"])
    some = Window.partitionBy("table_name", "column_name").orderBy("value")
    few = values.where(hit).withColumn("at", F.row_number().over(some)).where(F.col("at") <= shown)
    few = few.groupBy("table_name", "column_name").agg(F.array_sort(F.collect_list("value")).alias("matched_values"))
    return best.join(few, ["table_name", "column_name"]).select("table_name", "column_name", "n_values", "n_hit", "score", "matched_values")


def index_statistics(values: DataFrame) -> DataFrame:
    """(n_columns, n_values, values_per_column): distinct values of the lake, and their mean number in a column."""
    columns = values.groupBy("table_name", "column_name").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_columns"), F.avg("n").alias("values_per_column"))
    return columns.crossJoin(values.select("value").distinct().agg(F.count("*").alias("n_values")))


def posting_histogram(values: DataFrame, k: int = 10) -> DataFrame:
    """How many values are in how many columns; the k most frequent lengths."""
    lengths = values.groupBy("value").agg(F.count("*").alias("n_columns")).groupBy("n_columns").agg(F.count("*").alias("n_values"))
    return top_k(lengths, k, [], ["n_values"], ["n_columns"])


def text_postings(columns: DataFrame, shown: int = 5) -> DataFrame:
    """(term, table_name, column_name): words of names, types and first samples, of two characters or more."""
    words = F.split(F.lower(F.concat_ws(" ", "table_name", "column_name", "data_type", F.array_join(F.slice("sample_values", 1, shown), " "))), r"[^\p{L}\p{N}]+")
    each = columns.select("table_name", "column_name", F.explode(F.array_distinct(words)).alias("term"))
    return each.where(F.char_length("term") > 1)


def text_search(postings: DataFrame, query: list[str], k: int | None = 10) -> DataFrame:
    """Columns that have the query's words, by the sum of the words' rarity; ``score`` is min(0.9, 1 / (1 + rank)); k None: all of them."""
    terms = sorted({w.lower() for w in query if len(w) > 1})
    n = postings.select("table_name", "column_name").distinct().agg(F.count("*").alias("n"))
    hits = postings.where(F.col("term").isin(terms))
    rarity = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    found = hits.join(F.broadcast(rarity), "term").groupBy("table_name", "column_name").agg(F.sum("idf").alias("weight"))
    found = found.withColumn("weight", F.round("weight", 9))
    best = top_k(found, k, [], ["weight"], ["table_name", "column_name"])
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "table_name", "column_name")))
    return ranked.withColumn("score", F.least(F.lit(0.9), 1 / (1 + F.col("rank"))))
