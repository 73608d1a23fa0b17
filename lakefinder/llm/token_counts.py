"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by length, so all that follows works on one row per distinct
length.  Suffix sums over the lengths (within blocks of lengths, plus the totals of the
blocks above) then answer, for every context limit at once, how many documents are longer,
what truncation at the limit leaves, and quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakefinder.llm import bpe

#: Lengths in one block: a task holds a block of the histogram at most.
BLOCK_BITS = 14


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The number of tokens of each text, ``n_tokens``, by the tokenizers file at ``path``.

    A null or empty text counts 0; rows are counted singly; an empty table gives no rows; other
    columns are left out.
    """
    return bpe.encode_documents(docs.select(text_col), path, text_col, counts=True)


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row per distinct length: what holds of all documents when the context limit is that length.

    n_docs and n_tokens: of documents of just this length; docs_longer and tokens_longer: of
    longer ones; total_truncated: the sum of min(length, limit) over all documents;
    docs_up_to: the rank (from 1) of the last document of this length, by length, which
    answers quantiles.  A null length counts as 0.  No rows give no rows.
    """
    counts = lengths.groupBy(F.coalesce(F.col(col), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.shiftright("length", BLOCK_BITS))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    above, below = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        "block",
        zero(F.sum("block_docs").over(above)).alias("docs_above"),
        zero(F.sum("block_tokens").over(above)).alias("tokens_above"),
        zero(F.sum("block_docs").over(below)).alias("docs_below"),
        zero(F.sum("block_tokens").over(below)).alias("tokens_below"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(blocks, "block")
        .withColumn("docs_longer", F.col("docs_above") + zero(F.sum("n_docs").over(longer)))
        .withColumn("tokens_longer", F.col("tokens_above") + zero(F.sum("n_tokens").over(longer)))
        .withColumn("docs_up_to", F.col("docs_below") + F.sum("n_docs").over(up_to))
        .withColumn("tokens_up_to", F.col("tokens_below") + F.sum("n_tokens").over(up_to))
        .select("length", "n_docs", "n_tokens", "docs_longer", "tokens_longer", "docs_up_to", (F.col("tokens_up_to") + F.col("docs_longer") * F.col("length")).alias("total_truncated"))
    )


def quantiles(histogram: DataFrame, at: list[float]) -> DataFrame:
    """The length below or at which a share of the documents lies: the smallest whose docs_up_to reaches it."""
    n = histogram.agg(F.sum("n_docs").alias("n"))
    shares = histogram.sparkSession.createDataFrame([(float(q),) for q in at], "q double")
    wide = histogram.crossJoin(F.broadcast(n)).join(F.broadcast(shares), F.col("docs_up_to") >= F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1)))
    return wide.groupBy("q").agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """The tokens that remain when every document is cut at ``limit``, whether or not a document has that length."""
    got = histogram.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs"))).first()[0]
    return got or 0
