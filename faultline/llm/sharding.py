"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups are the rows of equal text, in the order of their 64-bit text hash. The smallest capacity C is searched
for which a greedy pass (open a shard, take groups while they fit) needs at most k shards. The cuts go where no shard
exceeds C, and within that nearest to even shares.

The search sees the groups through a tree of key ranges that is finer only where cuts can fall. C is at least
the mean and the largest group, and at most the smallest capacity over whole ranges. The ranges that hold a cut
for any C between the two are opened by 8 more bits of the hash, until no range that can hold a cut has two
groups; then a pass over ranges is a pass over groups. A level brings about 2 ** 16 rows to the driver, whatever
the input; the groups stay in Spark.

Defined results: null text is empty, with size 1 as an empty one, and equal to it; texts of equal hash are one
group; long texts count their bytes whole; groups of equal size have the order of their hashes; repeated rows are rows of their own with slots of their own, dealt by row number; fewer groups than shards leave the last
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, small_or_not, staged

FIRST_BITS = 12
STEP_BITS = 8
SLOT_ROWS = 5_000


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """The first index of each shard but the first, or None if the groups don't fit in so many shards."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    cuts, at = [], 0
    for _ in range(shards):
        to = bisect_right(sums, sums[at] + capacity) - 1
        if to == len(sizes):
            return cuts
        if to == at:
            return None
        cuts.append(to)
        at = to
    return None


def minimax(sizes: list[int], shards: int) -> int:
    """The smallest capacity for which greedy() succeeds, by binary search."""
    low, high = max(sizes, default=0), sum(sizes)
    low = max(low, -(-high // shards))
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def level(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """The first index of each shard but the first, as even as the capacity allows; greedy() succeeds with it.

    A cut lies between where a pass from the end must have begun its shards and where one from the start ends them; there it
    goes nearest to an even share of what is left.
    """
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    least = [len(sizes)] * (shards + 1)
    for k in range(shards - 1, 0, -1):
        least[k] = bisect_left(sums, sums[least[k + 1]] - capacity)
    cuts, at = [], 0
    for k in range(1, shards):
        share = sums[at] + (sums[-1] - sums[at]) / (shards - k + 1)
        low, high = max(at, least[k]), bisect_right(sums, sums[at] + capacity) - 1
        i = min(max(bisect_left(sums, share), low), high)
        if i > low and share - sums[i - 1] < sums[i] - share:
            i -= 1
        cuts.append(i)
        at = i
    return cuts


class Ranges:
    """Key ranges in order, each (first key, bits fixed, total size, largest group, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]], shards: int):
        self.rows, self.shards = sorted(rows), shards
        self.sums = [0]
        for r in self.rows:
            self.sums.append(self.sums[-1] + r[2])
        self.low = max([r[3] for r in self.rows] + [-(-self.sums[-1] // shards)])
        self.high = max(self.low, minimax([r[2] for r in self.rows], shards))

    def earliest(self, capacity: int) -> list[int]:
        """Where the cuts fall at the earliest: whole ranges are taken while they fit."""
        at, out = 0, []
        for _ in range(self.shards - 1):
            at = max(at, bisect_right(self.sums, self.sums[at] + capacity) - 1)
            out.append(at)
        return out

    def open(self) -> list[tuple[int, int, int, int, int]]:
        """The ranges of several groups in which a cut can fall for a capacity from low to high; large ones first, alone."""
        if large := [r for r in self.rows if r[4] > 1 and r[2] * 8 > self.low]:
            return large
        found: set[int] = set()
        for k, first in enumerate(self.earliest(self.low), 1):
            last = bisect_right(self.sums, k * self.high)  # the k-th cut is at k times the capacity at most
            found.update(i for i in range(first, min(last, len(self.rows))) if self.rows[i][4] > 1)
        return [self.rows[i] for i in sorted(found)]


def _level(groups: DataFrame, bits: int, within: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The ranges of bits bits inside the given ones of (first key, fewer bits)."""
    rows = groups
    if within:
        near = F.lit(False)
        for depth in sorted({b for _, b in within}):
            near = near | F.shiftright("key", 64 - depth).isin([k >> (64 - depth) for k, b in within if b == depth])
        rows = rows.where(near)
    found = rows.groupBy(F.shiftright("key", 64 - bits).alias("p")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n"))
    return [(r["p"] << (64 - bits), bits, r["s"], r["m"], r["n"]) for r in found.collect()]


def find_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first key of each shard but the first, smallest capacity) for staged groups (key, size) in key order."""
    ranges = Ranges(_level(groups, FIRST_BITS, []), shards)
    while opened := ranges.open():
        bits = min(64, max(b for _, b, *_ in opened) + STEP_BITS)
        gone = set(opened)
        ranges = Ranges([r for r in ranges.rows if r not in gone] + _level(groups, bits, [r[:2] for r in opened]), shards)
    cuts = level([r[2] for r in ranges.rows], ranges.high, shards)
    return [ranges.rows[i][0] for i in cuts if i < len(ranges.rows)], ranges.high


def shard_rows(docs: DataFrame, shards: int, carry: list[str]) -> DataFrame:
    """carry's columns, key, size, text_crc32, shard and slot of each row; texts of equal hash share a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(*carry, F.xxhash64(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "sizes"
    )
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts, _ = find_cuts(groups, shards)
    shard = F.lit(0)
    for first in cuts:
        shard = shard + (F.col("key") >= F.lit(first).cast("long")).cast("int")
    buckets = bucket_count(rows.count(), SLOT_ROWS)
    rows = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("shard", "bucket").orderBy("key", *carry)
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(small_or_not(offsets, 200_000), ["shard", "bucket"])
    return placed.select(*carry, "key", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    rows = shard_rows(docs, shards, ["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
