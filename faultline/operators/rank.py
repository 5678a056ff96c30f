"""Global order without one task: ranks and sorted exports over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.sources.shared import staged

#: monotonically_increasing_id() has the partition above these bits and the row in it below.
ROW_BITS = 33


def ranged(df: DataFrame, by: list[str | Column], partitions: int | None = None) -> DataFrame:
    """df in range partitions by columns, sorted in each: together the partitions are in order."""
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def global_rank(df: DataFrame, by: list[str | Column], into: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with its rows' places from 0 in the order of by, a key without repeats.

    Rows are range-partitioned, sorted and staged with their place in the partition; what is brought together is one count for each partition.
    """
    placed = staged(ranged(df, by, partitions).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", ROW_BITS)
    counts = sorted(placed.groupBy(part.alias("_part")).count().collect())  # a row for each partition
    before, offsets = 0, []
    for number, n in counts:
        offsets.append((number, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(into, place).drop("_part", "_at", "_before")
