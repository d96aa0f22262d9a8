"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts are one indivisible group. Groups are sorted by size, and each goes into the bin with the least
room that still holds it, found in a balanced tree of the bins' rooms. The capacity is the smallest one with which the
groups fit the wanted number of bins, so that the shards' sizes are near equal (law ``bytes``). A group larger than an equal
share of what is left gets a shard of its own.

Best fit treats groups of one size alike: the bin that takes the first of them is the fullest that fits, and stays it until it is
full. So the packing is worked out on the counts of each size (at most about the square root of twice all bytes of them, as
different sizes add up), and rows find their shard by their size and their number among the groups of this size. Numbers come
from counts of hash buckets, so that no size, shard or group is sorted in one task.

Defined results: a null text is empty, and equal to an empty one; repeated rows are rows of one group; slots follow a hash of
doc_id, then doc_id; null doc_ids are kept; no rows give no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import if_small, stored
from ledgerloom.scale import ordinal

SHARDS = 40
ROW_BYTES = 16
BUCKET_ROWS = 50_000


class Rooms:
    """Bins by room, as a tree of two levels: sorted leaves of bounded length, and their largest entries."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, room: int, number: int) -> None:
        entry = (room, number)
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        at = min(bisect.bisect_left(self.tops, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        bisect.insort(leaf, entry)
        self.tops[at] = leaf[-1]
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at:at + 1] = [leaf[:half], leaf[half:]]
            self.tops[at:at + 1] = [leaf[half - 1], leaf[-1]]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least ``size``."""
        at = bisect.bisect_left(self.tops, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect.bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return entry


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Pack ``sizes`` (size, how many; largest first) into bins: runs (size, how many, bin); None if over ``most`` bins."""
    rooms, runs, bins = Rooms(), [], 0
    for size, count in sizes:
        while count:
            found = rooms.tightest(size)
            if found is None:
                if bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            room, number = found
            take = min(count, room // size)
            runs.append((size, take, number))
            count -= take
            rooms.add(room - take * size, number)
    return runs


def pack(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, how many, shard) with the smallest capacity that best fit keeps to ``shards`` bins."""
    left = sorted(((s, c) for s, c in sizes if c), reverse=True)
    total, alone, runs = sum(s * c for s, c in left), 0, []
    while left and alone < shards - 1 and left[0][0] * (shards - alone) > total:
        size, count = left[0]
        runs.append((size, 1, alone))
        total -= size
        alone += 1
        left = [(size, count - 1)] * (count > 1) + left[1:]
    if not left:
        return runs
    low, found = max(left[0][0], -(-total // (shards - alone))), None
    high = low
    while (found := best_fit(left, high, shards - alone)) is None:
        high += max(1, high // 1000)
        low = high
    while low < high:
        middle = (low + high) // 2
        trial = best_fit(left, middle, shards - alone)
        if trial is None:
            low = middle + 1
        else:
            high, found = middle, trial
    return runs + [(s, c, b + alone) for s, c, b in found]


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest")),
                  "sized")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("total")), "groups")
    histogram = [(r["total"], r["n"]) for r in groups.groupBy("total").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs, seen = [], {}
    for size, count, shard in pack(histogram, shards):
        runs.append((size, seen.get(size, 0), seen.get(size, 0) + count, shard))
        seen[size] = seen.get(size, 0) + count
    table = spark.createDataFrame(runs, "total long, low long, high long, shard int")
    n_groups = sum(c for _, c in histogram)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(1 + n_groups // BUCKET_ROWS))
    numbered = ordinal(groups, ["total"], bucket, [F.col("digest")], "number")
    placed = (numbered.join(if_small(table, len(runs)), "total").filter("number > low and number <= high")
              .select("digest", "shard"))
    n_rows = rows.count()
    slots = ordinal(rows.join(placed, "digest"), ["shard"], F.pmod(F.xxhash64("doc_id"), F.lit(1 + n_rows // BUCKET_ROWS)),
                    [F.col("doc_id"), F.col("digest")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
