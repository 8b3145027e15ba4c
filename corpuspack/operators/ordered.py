"""Order-dependent work that must not put one key into one task.

Rows are range-partitioned on their full order, so a key that holds a third of the
table is spread over a third of the partitions. Each partition is a *block*: a
contiguous run of the order. Work inside a block is local; what crosses a block
boundary is one small row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.session import checkpointed


def ordered_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted globally by ``order``, one block per partition, numbered by ``block``.

    Checkpointed, because range boundaries are sampled: every later use, and every
    retried task, must see the same blocks.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(ranged.withColumn("block", F.spark_partition_id()))


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the 1-based position of each row in its group.

    Groups are ranked per block and shifted by what earlier blocks hold, so a group of any size is spread.
    """
    blocks = ordered_blocks(df, keys + order)
    per_block = blocks.groupBy(*keys, "block").count()
    earlier = (
        Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    # A group continues into a block only if it is the first of that block, so at most one
    # row per block survives the filter: the broadcast is bounded by the partition count.
    shifts = per_block.select(*keys, "block", F.sum("count").over(earlier).alias("shift")).where("shift > 0")
    local = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order))
    ranked = blocks.withColumn("local_rank", local).join(F.broadcast(shifts), [*keys, "block"], "left")
    position = (F.col("local_rank") + F.coalesce("shift", F.lit(0))).cast("int")
    return ranked.withColumn(name, position).select(*df.columns, name)
