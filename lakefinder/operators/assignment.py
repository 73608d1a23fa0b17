"""Matching the columns of two tables: greedy, and by maximum-weight assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakefinder.config import Config
from lakefinder.operators.overlap import top_k

PAIR = ["query_table", "table_name"]


def assign(similarity: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-weight matching, entries below the threshold counting 0; only pairs not below it.

    Shortest augmenting paths with potentials, row by row, O(rows**2 * columns).
    """
    sim = np.asarray(similarity, float)
    if not sim.size:
        return []
    if sim.shape[0] > sim.shape[1]:
        return sorted((r, c) for c, r in assign(sim.T, threshold))
    cost = -np.where(sim >= threshold, sim, 0.0)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)  # the row of each column
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        cur, base, last = row, 0.0, -1
        while True:
            step = base + cost[cur] - u[cur] - v
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], last
            last = int(np.where(done, np.inf, dist).argmin())
            base = dist[last]
            done[last] = True
            if owner[last] < 0:
                break
            cur = owner[last]
        u[row] += base
        for c in np.flatnonzero(done):
            if owner[c] >= 0 and c != last:
                u[owner[c]] += base - dist[c]
            v[c] -= base - dist[c]
        while last >= 0:
            before = via[last]
            owner[last] = row if before < 0 else owner[before]
            last = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0 and sim[r, c] >= threshold)


def matched_columns(pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The assignment of each pair of tables: (query_table, table_name, query_column, column_name, score).

    pairs: scored column pairs with ``query_column``, ``column_name`` and ``score``.  A
    group is the columns of two tables, so its size is the product of two tables' widths.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        a, b = sorted(group.query_column.unique()), sorted(group.column_name.unique())
        matrix = np.zeros((len(a), len(b)))
        rows, cols = pd.Index(a).get_indexer(group.query_column), pd.Index(b).get_indexer(group.column_name)
        matrix[rows, cols] = group.score
        own = [(group.query_table.iloc[0], group.table_name.iloc[0], a[i], b[j], float(matrix[i, j])) for i, j in assign(matrix, threshold)]
        return pd.DataFrame(own, columns=[*PAIR, "query_column", "column_name", "score"])

    schema = "query_table string, table_name string, query_column string, column_name string, score double"
    return pairs.select(*PAIR, "query_column", "column_name", "score").groupBy(*PAIR).applyInPandas(solve, schema)


def greedy(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """The best column for each query column (a column may serve more than one), ties by name."""
    best = Window.partitionBy(*PAIR, "query_column").orderBy(F.desc("score"), "column_name")
    return pairs.where(F.col("score") > least).withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")


def table_scores(matches: DataFrame, widths: DataFrame) -> DataFrame:
    """Six scores of a matching, from its pairs and the tables' numbers of columns (table_name, column_count).

    raw sum, by the smaller and by the larger number of columns, by the union, mean, and
    mean times the share of the larger table that is matched.  Pairs of tables without any match are absent.
    """
    got = matches.groupBy(*PAIR).agg(F.count("*").alias("n_matched"), F.sum("score").alias("raw"))
    q = widths.select(F.col("table_name").alias("query_table"), F.col("column_count").alias("n1"))
    t = widths.select("table_name", F.col("column_count").alias("n2"))
    both = got.join(q, "query_table").join(t, "table_name")
    n, larger = F.col("n_matched"), F.greatest("n1", "n2")
    return both.select(
        *PAIR,
        "n_matched",
        F.round("raw", 9).alias("raw"),
        F.round(F.col("raw") / F.least("n1", "n2"), 9).alias("norm_min"),
        F.round(F.col("raw") / larger, 9).alias("norm_max"),
        F.round(F.col("raw") / (F.col("n1") + F.col("n2") - n), 9).alias("jaccard"),
        F.round(F.col("raw") / n, 9).alias("average"),
        F.round(F.col("raw") / n * n / larger, 9).alias("weighted"),
        F.round(n / larger, 9).alias("match_ratio"),
    )


def enhanced(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``score``: the weighted mean of the six scores times 100, 100 at most."""
    w = weights or Config().assignment_weights
    total: Column = F.lit(0.0)
    for name, x in w.items():
        total = total + x * F.col(name)
    return scores.withColumn("score", F.round(F.least(F.lit(100.0), 100 * total / sum(w.values())), 9))


def best_tables(scores: DataFrame, k: int = 10, by: str = "weighted") -> DataFrame:
    return top_k(scores, k, ["query_table"], [by], ["table_name"])


def explanation(matches: DataFrame, shown: int = 3) -> DataFrame:
    """The best matched columns of each pair of tables, in words."""
    said = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "query_column", "column_name")))), 1, shown), lambda m: F.format_string("%s = %s (%.2f)", m["query_column"], m["column_name"], m["score"]))
    return matches.groupBy(*PAIR).agg(F.count("*").alias("n_matched"), F.array_join(said, "; ").alias("explanation"))


def thresholds(pairs: DataFrame, values: tuple[float, ...] = (0.3, 0.5, 0.7, 0.8, 0.9)) -> DataFrame:
    """Matched columns and their sum for each pair of tables at each threshold."""
    found = None
    for t in values:
        one = matched_columns(pairs, t).groupBy(*PAIR).agg(F.count("*").alias("n_matched"), F.round(F.sum("score"), 9).alias("total")).withColumn("threshold", F.lit(t))
        found = one if found is None else found.unionByName(one)
    return found
