"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition makes one run: its distinct digests, sorted, each with the
best row and a count.  Runs then merge in binomial rounds: in each round the runs
whose numbers agree but for their lowest ``FAN_IN_BITS`` bits become one run, cut by
digest over many tasks, so that no task ever holds a whole run.  What a digest
gathers is one row for each run, never its rows, so a text that a third of all rows
repeat costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakefinder.llm.components import if_few
from lakefinder.scratch import materialize

#: White space that does not count; fixed by the contract.
SPACE = r"[\x20\x09-\x0D]"
#: 2**5 runs merge into one in each round.
FAN_IN_BITS = 5
#: A digest of more than 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE such.
HOT_SHARE = 1024


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its key, what ranks it and a row number.

    The key is SHA-256 of the normalised text, verified by the text's length in bytes and
    an independent 64-bit hash: rows are equal only if all three agree.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), *ranks(F.col(text_col)), normalised(F.col(text_col)).alias("norm"))
    return norm.select("doc_id", "n_chars", "raw", *key(F.col("norm")), F.monotonically_increasing_id().alias("row_no"))


def ranks(text: Column) -> list[Column]:
    """By what rows of one group are ranked besides their ids: code points, and a hash of the text as it is written."""
    return [F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("raw")]


def key(norm: Column) -> list[Column]:
    return [F.unhex(F.sha2(norm, 256)).alias("sha"), F.octet_length(norm).cast("long").alias("n_bytes"), F.xxhash64(norm).alias("xx")]


KEY = ["sha", "n_bytes", "xx"]


def merge_runs(rows: DataFrame, n_runs: int) -> DataFrame:
    """Merge the runs of ``rows`` (``run`` numbers them) into one row per key: ``best`` and ``group_size``.

    ``best`` is the row with most code points, then the smallest doc_id (null last), then
    the smallest hash of the text as it is written, then the smallest row number; a minimum of
    structs, so every level may take the minimum of the level below.
    """
    runs = rows.groupBy("run", *KEY).agg(
        F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw", "row_no")).alias("best"),
        F.count("*").alias("group_size"),
    )
    while n_runs > 1:
        n_runs = ((n_runs - 1) >> FAN_IN_BITS) + 1
        runs = (
            runs.withColumn("run", F.shiftright("run", FAN_IN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
    return runs.drop("run")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's digests with its group's ``best`` and ``group_size``."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    # the upper bits of row_no number the partition that made the row: its run
    rows = rows.withColumn("run", F.shiftright("row_no", 33))
    stats = rows.agg(F.max("run"), F.count("*")).first()
    n_runs, total = (stats[0] or 0) + 1, stats[1]
    groups = materialize(merge_runs(rows, n_runs), "groups")
    # hot groups are few by definition: at most HOT_SHARE rows are broadcast
    is_hot = F.col("group_size") * HOT_SHARE > F.lit(total)
    hot, rest = groups.where(is_hot), groups.where(~is_hot)
    keys = rows.drop("run")
    of_hot = keys.join(F.broadcast(hot), KEY)
    others = keys.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(rest, KEY)
    return of_hot.unionByName(others)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark in every group of equal texts the row that stays.

    Texts are equal when identical after deleting white space (null counts as empty).  The
    row with most code points stays, then the smallest doc_id (a null doc_id last), then the
    text with the smallest hash; of rows that agree in all three exactly one stays.  Returns one
    row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_no (a number of the
    row).  An empty table gives an empty result; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row_no",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns are kept as they are.

    Rows are told by doc_id and digests of the text, not by their place, so the result is right
    for any input: shuffled, joined or read anew.  Of rows that are equal in doc_id and text any
    single one stays, whatever their other columns.
    """
    found = _grouped(docs, id_col, text_col).where("group_size > 1")
    who = ["doc_id", *KEY, "n_chars", "raw"]
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.neg")) & (F.col("raw") == F.col("best.raw"))
    found = materialize(found.groupBy(*who).agg(F.max(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "marked")
    names = {c: f"__{c}" for c in who}
    own = docs.withColumn("__norm", normalised(F.col(text_col))).withColumns({"__doc_id": F.col(id_col)} | dict(zip(("__n_chars", "__raw"), ranks(F.col(text_col)), strict=True)) | dict(zip((names[c] for c in KEY), key(F.col("__norm")), strict=True))).drop("__norm")

    def of(rows: DataFrame, marked: DataFrame, how: str) -> DataFrame:
        other = if_few(marked.select(*who))
        same = [F.col(names[c]).eqNullSafe(other[c]) if c == "doc_id" else F.col(names[c]) == other[c] for c in who]
        return rows.join(other, same, how)

    left = of(own, found.where("not stays"), "left_anti")
    again = found.where("stays")
    if not again.isEmpty():
        left = of(left, again, "left_anti").unionByName(of(left, again, "left_semi").dropDuplicates(list(names.values())))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
