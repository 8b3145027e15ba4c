"""Positions and running sums in an order that no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.session import materialised


def in_blocks(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` range-sorted by keys and order and written, with _block and _seq: rows of a block follow _seq.

    Range boundaries are sampled, so the table is written: what reads it later sees the same blocks.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = ranged.withColumn("_block", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    return materialised(numbered, label)


def earlier_blocks(blocks: DataFrame, keys: list[str], value) -> DataFrame:
    """(keys, _block, _before): what earlier blocks hold of each key, and _first, its first _seq in this one."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"), F.min("_seq").alias("_first"))
    total = F.coalesce(F.sum("_sum").over(before), F.lit(0))
    return sums.select(*keys, "_block", "_first", total.alias("_before"))


def joined_on(blocks: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join on the keys and the block."""
    other = small.select(*[F.col(c).alias(f"_at_{c}") for c in keys + ["_block"]], *[c for c in small.columns if c not in keys + ["_block"]])
    met = blocks["_block"] == other["_at__block"]
    for c in keys:
        met = met & blocks[c].eqNullSafe(other[f"_at_{c}"])
    return blocks.join(other, met).drop(*[f"_at_{c}" for c in keys + ["_block"]])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, label: str) -> DataFrame:
    """Add ``name``: each row's position among the rows of its key, from 0. A row number in a block is a difference
    of _seq, so there is no window over rows."""
    blocks = in_blocks(df, keys, order, label)
    small = earlier_blocks(blocks, keys, F.lit(1))
    joined = joined_on(blocks, small, keys)
    return joined.withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first")).select(*df.columns, name)


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, label: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the same key."""
    blocks = in_blocks(df, keys, order, label)
    small = earlier_blocks(blocks, keys, F.col(value))
    joined = joined_on(blocks, small, keys)
    inside = Window.partitionBy(*keys, "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(name, F.col("_before") + own).select(*df.columns, name)
