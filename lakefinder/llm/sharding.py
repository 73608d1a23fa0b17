"""Balanced contiguous shards from global byte-size prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakefinder.scratch import materialize


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in order of doc_id, into ``n_shards`` contiguous shards of near equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1.  The rows are range
    partitioned by (doc_id, size, CRC, input position) and sorted; each partition's total
    gives, summed over the partitions before it, the partition's offset; offset plus a
    running sum within the partition is the global prefix sum.  A row goes to the shard in
    whose equal share of the total its middle byte lies, so a shard misses its target by
    half the largest row at either end at most.

    Null doc_ids come first; repeated rows and ties in doc_id are ordered by size, CRC and
    input position, which also splits a doc_id that many rows share.  Returns one row per
    input row: doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 in each
    shard), grown_shard (null: the law gives no promise for one more shard) and first_byte.
    An empty table gives an empty result; shards may be empty when there are few rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("pos"),
    )
    order = ["doc_id", "size", "text_crc32", "pos"]
    # the upper bits of seq number the sorted partition, the lower ones the row in it
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    rows = materialize(rows.drop("pos").withColumn("part", F.shiftright("seq", 33)), "sized")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition, so both the single task and the broadcast are bounded by the number of partitions
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    grand = totals.agg(F.sum("bytes").alias("total"))
    offsets = offsets.crossJoin(F.broadcast(grand))

    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("bytes_in", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
        .withColumn("rows_in", F.row_number().over(Window.partitionBy("part").orderBy("seq")) - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn("first_byte", F.col("bytes_before") + F.col("bytes_in"))
        .withColumn("rank", F.col("rows_before") + F.col("rows_in"))
        # the middle of the row is first_byte + size / 2; decimals, as n_shards times twice the bytes could pass a long
        .withColumn("shard", F.expr(f"cast(((first_byte * 2 + size) * cast({n_shards} as decimal(10, 0))) div (total * 2) as int)"))
    )
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "rank", "first_byte"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "first_byte",
    )
