"""Contiguous shards of near-equal size from global prefix sums of text sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.sources.shared import materialize


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and size of every row: (id, size, text_crc32, law, shard, slot, grown_shard).

    Rows are taken in order of (id, checksum, size), nulls first. A row belongs to the shard in whose
    equal part of the total its middle byte lies, so shards are contiguous, numbers do not fall, and
    sizes differ from the target by at most one row. ``slot`` counts rows within the shard from 0.

    Only (id, checksum, size) is moved. Rows are laid out in ranges and stored with the number of
    their range; the totals of the ranges, one row each, give every range its offset, so no task
    holds more than a range and no sum runs over all rows at once.

    Null texts count as empty (size 1, checksum 0). Rows that agree in id, checksum and size are kept
    and get neighbouring slots. A row larger than a shard's share leaves shards without rows. An empty
    table gives no rows. Other columns of ``docs`` do not matter.
    """
    text_column = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_id"),
        text_size(text_column).alias("size"),
        F.crc32(F.coalesce(text_column, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["_id", "text_crc32", "size"]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "sizes")
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range"),
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    within = Window.partitionBy("_range").orderBy(*order)
    before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    numbered = (
        ranged.withColumn("_before", before)
        .withColumn("_index", F.row_number().over(within) - 1)
        .join(offsets, "_range")
        .withColumn("_before", F.col("_before") + F.col("_bytes_before"))
        .withColumn("_index", F.col("_index") + F.col("_rows_before"))
        .withColumn("shard", F.expr(f"(2 * _before + size) * {shards} div (2 * _total)").cast("int"))
    )
    placed = materialize(numbered.select(*order, "shard", "_index"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(firsts, "shard").select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_index") - F.col("_first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
