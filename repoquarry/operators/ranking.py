"""Ranks within keys that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.sources.shared import materialize

# Parts that the rows of a key are cut in before they meet.
_SHARES = 256


def first_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank: str = "rank",
    spread: list[str] | None = None,
    shares: int = _SHARES,
) -> DataFrame:
    """The first ``n`` rows of every key, numbered from 1 in ``rank``; ``order`` is total within a key.

    Rows are always cut to ``n`` within (key, hash of ``spread``) first, so a hot key is sorted by many
    tasks and the last step sees at most ``n`` rows of each share. The result is the same, as a row among
    the first ``n`` of a key is among the first ``n`` of its share. Without ``spread`` all columns but
    the keys are hashed; columns in it must tell the rows of a key apart.
    """
    share = F.pmod(F.xxhash64(*(spread or [c for c in df.columns if c not in keys])), F.lit(shares))
    by_share = Window.partitionBy(*keys, share).orderBy(*order)
    cut = df.withColumn(rank, F.row_number().over(by_share)).where(F.col(rank) <= n).drop(rank)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(by_key)).where(F.col(rank) <= n)


def laid_out_in_ranges(df: DataFrame, key: str, arrival: str, tie: str, ranges: int | None = None) -> DataFrame:
    """``df`` stored in ranges of (key, arrival, tie), with the number of each row's range in ``_range``.

    A hot key, even one with a single arrival time, spans many ranges. Stored numbers are the same for
    every reader, which a repeated sampling would not promise.
    """
    order = [F.col(key), F.col(arrival), F.col(tie)]
    ranged = df.repartitionByRange(*([ranges] if ranges else []), *order)
    return materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def rank_in_ranges(ranged: DataFrame, key: str, arrival: str, tie: str, rank: str = "rank") -> DataFrame:
    """Numbers all rows of every key from 0 by (``arrival``, ``tie``), for keys of any size.

    Each (key, range) is ranked on its own and shifted by the rows of the key in earlier ranges.
    """
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(key).alias("_key"),
        F.col("_range").alias("_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(key, "_range").orderBy(arrival, tie)
    return (
        ranged.withColumn(rank, F.row_number().over(inside) - 1)
        .join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_part")))
        .withColumn(rank, F.col(rank) + F.col("_before"))
        .drop("_range", "_key", "_part", "_before")
    )


def rank_within(
    df: DataFrame, key: str, arrival: str, tie: str, rank: str = "rank", ranges: int | None = None
) -> DataFrame:
    """``rank_in_ranges`` of a table that is not laid out yet."""
    return rank_in_ranges(laid_out_in_ranges(df, key, arrival, tie, ranges), key, arrival, tie, rank)


def sum_below(df: DataFrame, key: str, position: str, value: Column, total: str, width: int = 1_000_000) -> DataFrame:
    """Adds ``total``: the sum of ``value`` over the key's rows at lower positions.

    Positions are distinct within a key. Rows are summed within blocks of ``width`` positions, and the
    totals of earlier blocks are added, so no task holds all rows of a key.
    """
    blocks = df.withColumn("_block", F.floor(F.col(position) / width)).withColumn("_value", value)
    within = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    offsets = totals.select(
        F.col(key).alias("_key"),
        F.col("_block").alias("_part"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    return (
        blocks.withColumn(total, F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_part")))
        .withColumn(total, F.col(total) + F.col("_before"))
        .drop("_block", "_value", "_key", "_part", "_before")
    )
