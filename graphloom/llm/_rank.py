"""Places of rows in a global order, by range partitions: nothing is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._common import materialise

#: Rows of a table of counts that may be broadcast (some 40 bytes each).
SMALL_ROWS = 100_000


def ranked(rows: DataFrame, group: str, order: list[str | Column], keep: list[str], name: str) -> DataFrame:
    """The columns keep and group (never null) of rows, with pos (from 0, in the order within its group) and members (rows of the group); written.

    rows should be a written table.  Rows that tie in the order take different places; equal ones are dealt
    out over partitions by a number of their own, so no key has to fit into a task.
    """
    spread = rows.withColumn("_own", F.xxhash64(F.monotonically_increasing_id()))
    dealt = spread.repartitionByRange(group, *order, "_own").sortWithinPartitions(group, *order, "_own")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(dealt.select(*keep, group, F.spark_partition_id().alias("_part"), row.alias("_row")), name)
    counts = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part")  # a row for each partition that holds the group
    whole = Window.partitionBy(group)
    offsets = counts.select(group, "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("members"))
    offsets = materialise(offsets, f"{name}-offsets")
    small = F.broadcast(offsets) if offsets.count() <= SMALL_ROWS else offsets
    return placed.join(small, [group, "_part"]).select(*keep, group, (F.col("_row") + F.col("_shift")).alias("pos"), "members")
