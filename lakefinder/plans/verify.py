"""The place for a verifier (a language model, say): an interface, and one that leaves scores alone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakefinder.operators.overlap import top_k

ANSWER = "query_table string, table_name string, is_match boolean, confidence double"


class Verifier(Protocol):
    """Judges batches of candidate pairs, described in words, within an executor."""

    def judge(self, prompts: list[str]) -> list[tuple[bool, float] | None]: ...


def prompts(candidates: DataFrame, tables: DataFrame, columns: int = 5, samples: int = 3) -> DataFrame:
    """(query_table, table_name, prompt): both tables' first columns with some samples."""
    sketch = F.array_join(
        F.transform(F.slice("columns", 1, columns), lambda c: F.concat(c["column_name"], F.lit(" "), F.coalesce(c["data_type"], F.lit("?")), F.lit(" ["), F.array_join(F.slice(c["sample_values"], 1, samples), ", "), F.lit("]"))), "; "
    )
    drawn = tables.select("table_name", sketch.alias("sketch"))
    both = candidates.select("query_table", "table_name", "score").join(drawn.select(F.col("table_name").alias("query_table"), F.col("sketch").alias("q")), "query_table").join(drawn, "table_name")
    return both.select("query_table", "table_name", F.format_string("Do these tables match?\n%s: %s\n%s: %s\nscore so far: %.3f", "query_table", "q", "table_name", "sketch", "score").alias("prompt"))


def column_prompts(matches: DataFrame, columns: DataFrame, samples: int = 3) -> DataFrame:
    """(query_table, query_column, table_name, column_name, prompt) of column matches: both columns with type and samples."""
    told = F.format_string("%s.%s (%s) [%s]", "table_name", "column_name", F.coalesce("data_type", F.lit("?")), F.array_join(F.slice(F.coalesce("sample_values", F.array().cast("array<string>")), 1, samples), ", "))
    drawn = columns.select("table_name", "column_name", told.alias("told"))
    q = drawn.select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), F.col("told").alias("q"))
    both = matches.select("query_table", "query_column", "table_name", "column_name", "confidence").join(q, ["query_table", "query_column"]).join(drawn, ["table_name", "column_name"])
    return both.select("query_table", "query_column", "table_name", "column_name", F.format_string("Do these columns match?\n%s\n%s\nconfidence so far: %.3f", "q", "told", "confidence").alias("prompt"))


def ask(rows: DataFrame, verifier: Verifier | None, batch: int = 10, tries: int = 2, default: tuple[bool, float] | None = None) -> DataFrame:
    """Answers (is_match, confidence) for rows of a ``prompt`` and keys; each distinct prompt is judged once.

    A batch on which the verifier fails is tried ``tries`` times in all.  A pair it fails on, or
    says nothing of, has no answer, or the ``default`` one.  Without a verifier there are no answers.
    """
    keys = [c for c in rows.columns if c != "prompt"]
    if verifier is None:
        return rows.select(*keys, F.lit(None).cast("boolean").alias("is_match"), F.lit(None).cast("double").alias("confidence")).limit(0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                got: list = [None] * len(part)
                for _ in range(tries):
                    try:
                        got = verifier.judge(part.prompt.tolist())
                        break
                    except Exception:  # noqa: BLE001  a batch that fails is a batch without answers
                        continue
                yield pd.DataFrame([(p, a[0], float(a[1])) for p, a in zip(part.prompt, got, strict=False) if a is not None], columns=["prompt", "is_match", "confidence"])

    answers = rows.select("prompt").distinct().mapInPandas(run, "prompt string, is_match boolean, confidence double")
    both = rows.join(answers, "prompt", "inner" if default is None else "left")
    if default is not None:
        both = both.withColumns({"is_match": F.coalesce("is_match", F.lit(default[0])), "confidence": F.coalesce("confidence", F.lit(float(default[1])))})
    return both.select(*keys, "is_match", "confidence")


def _said() -> Column:
    """How likely a match is by an answer."""
    return F.when(F.col("is_match"), F.col("said")).otherwise(1 - F.col("said"))


def judged_columns(matches: DataFrame, columns: DataFrame, verifier: Verifier | None, more_than: int = 5, shown: int = 10) -> DataFrame:
    """Column matches after the verifier: 0.7 confidence + 0.3 its answer.

    Asked are the ``shown`` best of each query column that has more than ``more_than``; of those
    columns, matches without an answer are dropped.  Other columns' matches stay as they are.
    """
    if verifier is None:
        return matches
    keys = ["query_table", "query_column", "table_name", "column_name"]
    by = Window.partitionBy("query_table", "query_column")
    ranked = matches.withColumns({"__at": F.row_number().over(by.orderBy(F.desc("confidence"), "table_name", "column_name")), "__n": F.count("*").over(by)})
    asked = ranked.where((F.col("__n") > more_than) & (F.col("__at") <= shown))
    answers = ask(column_prompts(asked, columns), verifier).withColumnRenamed("confidence", "said")
    judged = asked.join(answers, keys).withColumn("confidence", F.round(0.7 * F.col("confidence") + 0.3 * _said(), 9))
    return judged.select(matches.columns).unionByName(ranked.where(F.col("__n") <= more_than).select(matches.columns))


def judged_tables(scores: DataFrame, tables: DataFrame, verifier: Verifier | None, more_than: int = 3) -> DataFrame:
    """Table scores (0 to 100) after the verifier: 0.7 score + 0.3 its answer, for queries of more than ``more_than`` tables; what has no answer stays."""
    if verifier is None:
        return scores
    counted = scores.withColumn("__n", F.count("*").over(Window.partitionBy("query_table")))
    answers = ask(prompts(counted.where(F.col("__n") > more_than), tables), verifier).withColumnRenamed("confidence", "said")
    both = counted.join(answers, ["query_table", "table_name"], "left")
    score = F.when(F.col("said").isNotNull(), 0.7 * F.col("score") + 30 * _said()).otherwise(F.col("score"))
    return both.withColumn("score", F.round(score, 6)).select(scores.columns)


def filtered_tables(candidates: DataFrame, tables: DataFrame, verifier: Verifier | None, more_than: int = 10, shown: int = 15, keep: float = 0.8, boost: float = 1.2, k: int = 10) -> DataFrame:
    """Candidates (query_table, table_name, score in 0 to 1) after the verifier, for queries of more than ``more_than``.

    Of the ``shown`` best those it names score ``boost`` times as much (1 at most); others stay from
    ``keep`` on.  The best k of each query.
    """
    if verifier is None:
        return candidates
    own = candidates.select("query_table", "table_name", "score")
    by = Window.partitionBy("query_table")
    ranked = own.withColumns({"__at": F.row_number().over(by.orderBy(F.desc("score"), "table_name")), "__n": F.count("*").over(by)})
    named = ask(prompts(ranked.where((F.col("__n") > more_than) & (F.col("__at") <= shown)), tables), verifier).where("is_match").select("query_table", "table_name", F.lit(True).alias("named"))
    both = ranked.join(named, ["query_table", "table_name"], "left")
    score = F.when(F.col("named"), F.least(boost * F.col("score"), F.lit(1.0))).otherwise(F.col("score"))
    kept = both.where((F.col("__n") <= more_than) | F.col("named") | (F.col("score") >= keep)).select("query_table", "table_name", F.round(score, 9).alias("score"))
    return top_k(kept, k, ["query_table"], ["score"], ["table_name"])


def padded(best: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """The verifier's ranking filled up to k from the vector layer's; what is filled in ranks after the rest."""
    both = best.select("query_table", "table_name", "score", F.lit(0).alias("__order")).unionByName(
        found.select("query_table", "table_name", "score", F.lit(1).alias("__order")).join(best.select("query_table", "table_name"), ["query_table", "table_name"], "left_anti")
    )
    order = Window.partitionBy("query_table").orderBy("__order", F.desc("score"), "table_name")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__order")
