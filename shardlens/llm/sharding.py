"""Contiguous shards of near-equal size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlens.llm.common import staged

ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text (null: none) plus 8.  Rows are put in ``id_col`` order (nulls first, ties
    by checksum, then by place in the input) and cut where the running size passes each ``1 / shards`` of the total,
    so that shards are contiguous and differ by less than one row's size.  Rows are range-partitioned and written
    once with their partition number; a partition's rows then need only the total of the partitions before, which
    is one small row per partition.  An empty table gives an empty result.  Columns besides id and text are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["doc_id", "text_crc32", "_tie"]
    # Written before anything is counted: the range bounds come from a sample and may differ in a second evaluation.
    laid = staged(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "shard-sizes")

    # A row per partition, then per shard: both bounded by parameters, never by the number of documents.
    totals = laid.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn("_start", F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("_bytes_before"))
        .withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_rows_before"))
        # The middle of a row decides, so that a cut falls on the nearer side of it; decimals keep the product exact.
        .withColumn("_twice", (2 * F.col("_start") + F.col("size")).cast("decimal(25,0)"))
        .withColumn("shard", F.expr(f"CAST(_twice * {shards} DIV (2 * CAST(_total AS decimal(25,0))) AS int)"))
        .select("doc_id", "size", "text_crc32", "shard", "_rank")
    )
    placed = staged(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
