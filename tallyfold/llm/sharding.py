"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Groups are equal texts and stay whole. A group larger than an equal share of what is
left fills a shard of its own. The others are ordered by a 64-bit hash of the text; the
smallest capacity with which a greedy pass places them in the other shards is found by
binary search, and of the cuts that keep every shard within it each is made as near as
possible to an equal share of what follows. The driver never sees the groups: it holds
sizes of hash ranges, and only ranges that may hold a large group or in which a cut can
fall are divided further.

Cases: a null text is a group of its own (size 1, as an empty text); an empty table
gives an empty result; repeated rows are rows like others and share their text's
shard; further columns are not read; with fewer groups than shards some stay empty.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import cut

#: Bits of the hash that divide the whole table, and that divide each range further.
FIRST_BITS, MORE_BITS = 12, 6
#: Ranges below this part of an equal share need no division for a balanced cut.
NEAR = 1024
#: Rows that one window of the slot numbering may hold on average.
ROWS_PER_WINDOW = 20_000


@dataclass(frozen=True)
class Range:
    """Groups with hashes from `low` to `high`; `bits` of the hash name the range. `atomic`: one group."""

    low: int
    high: int
    bits: int
    size: int

    @property
    def atomic(self) -> bool:
        return self.low == self.high


def _greedy(sizes: Sequence[int], capacity: int, shards: int) -> list[int] | None:
    """The first index behind each shard when every shard takes as many whole sizes as fit; None if `shards` are too few."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    ends, at = [], 0
    while at < len(sizes):
        end = bisect.bisect_right(sums, sums[at] + capacity) - 1
        if end == at or len(ends) == shards:
            return None
        ends.append(end)
        at = end
    return ends


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The smallest capacity with which the greedy pass places all `sizes`, in their order, in `shards` shards."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _greedy(sizes, middle, shards) is not None else (middle + 1, high)
    return low


def _loose(ranges: Sequence[Range], capacity: int, shards: int) -> list[int] | None:
    """As `_greedy`, but ranges of several groups may be cut anywhere: no real cut at this capacity lies behind these."""
    ends, used, count = [], 0, 1
    for i, r in enumerate(ranges):
        rest = r.size
        if r.atomic and rest > capacity:
            return None
        while used + rest > capacity:
            if not r.atomic:
                rest -= capacity - used
            ends.append(i)
            count, used = count + 1, 0
            if count > shards:
                return None
        used += rest
    return ends


def _loose_capacity(ranges: Sequence[Range], shards: int) -> int:
    total = sum(r.size for r in ranges)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _loose(ranges, middle, shards) is not None else (middle + 1, high)
    return low


def _open_ranges(ranges: Sequence[Range], shards: int) -> list[Range]:
    """The ranges in which a cut of the best partition can fall and that hold several groups."""
    high = smallest_capacity([r.size for r in ranges], shards)
    low = _loose_capacity(ranges, shards)
    if low == high:
        return []
    sizes, late = [r.size for r in ranges], _loose(ranges, high, shards) or []
    early, at, sums = [], 0, [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    for _ in range(shards):  # whole ranges only, at the lowest capacity: no real cut lies before these
        at = bisect.bisect_right(sums, sums[at] + low) - 1 if at < len(sizes) else at
        early.append(at)
    found: set[int] = set()
    for j, first in enumerate(early):
        last = late[j] if j < len(late) else len(ranges) - 1
        found.update(range(min(first, last), min(max(first, last), len(ranges) - 1) + 1))
    return [ranges[i] for i in sorted(found) if not ranges[i].atomic]


def balanced_ends(sizes: Sequence[int], capacity: int, shards: int) -> list[int]:
    """The first index behind each shard: none above `capacity`, each cut the one nearest to an equal share of what is left."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    earliest = [len(sizes)]  # where the last k shards may begin at the earliest
    for _ in range(shards):
        earliest.append(bisect.bisect_left(sums, sums[earliest[-1]] - capacity))
    ends, at = [], 0
    for left in range(shards, 0, -1):
        goal = sums[at] + (sums[-1] - sums[at]) / left
        end = bisect.bisect_left(sums, goal)
        if end > at and abs(sums[end - 1] - goal) <= abs(sums[min(end, len(sizes))] - goal):
            end -= 1
        low, high = max(at, earliest[left - 1]), bisect.bisect_right(sums, sums[at] + capacity) - 1
        at = min(max(end, low), high, len(sizes))
        ends.append(at)
    return ends


def _large(ranges: Sequence[Range], shards: int) -> tuple[list[Range], list[Range], int]:
    """Ranges above an equal share of what is left, each for a shard of its own; the other ranges; the shards left for these."""
    order, total, large = sorted(ranges, key=lambda r: (-r.size, r.low)), sum(r.size for r in ranges), []
    for r in order:
        left = shards - len(large)
        if left < 2 or r.size * left <= total:
            break
        large.append(r)
        total -= r.size
    names = {r.low for r in large}
    return large, [r for r in ranges if r.low not in names], shards - len(large)


def _cut_ranges(ranges: Sequence[Range], shards: int) -> list[Range]:
    """The ranges of several groups that hold an equal share at which a balanced cut is sought."""
    sizes = [r.size for r in ranges]
    found, at = set(), 0
    for end in balanced_ends(sizes, smallest_capacity(sizes, shards), shards)[:-1]:
        found.update(i for i in (end - 1, end) if at <= i < len(ranges))
        at = end
    share = sum(sizes) / max(1, shards)
    return [ranges[i] for i in sorted(found) if not ranges[i].atomic and ranges[i].size * NEAR > share]


def _ranges(rows: DataFrame, bits: int) -> list[Range]:
    prefix = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    found = rows.groupBy(prefix.alias("prefix")).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("size"))
    return [Range(r["low"], r["high"], bits, r["size"]) for r in found.collect()]


def _todo(ranges: Sequence[Range], shards: int) -> list[Range]:
    """Ranges that are divided next: those that may hold a large group first, then those of the cuts."""
    large, rest, left = _large(ranges, shards)
    if unclear := [r for r in large if not r.atomic]:
        return unclear
    return _open_ranges(rest, left) or _cut_ranges(rest, left)


def _cuts(rows: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Hashes of the groups with shards of their own, and those at which the other shards 1, 2, ... begin. What is collected is bounded by 2^FIRST_BITS and the ranges that are divided."""
    ranges = sorted(_ranges(rows, FIRST_BITS), key=lambda r: r.low)
    while todo := _todo(ranges, shards):
        bits = min(r.bits for r in todo)
        todo = [r for r in todo if r.bits == bits]
        spark = rows.sparkSession
        names = spark.createDataFrame([(r.low >> (64 - bits),) for r in todo], "prefix long")
        inside = rows.join(F.broadcast(names), F.shiftright("h", 64 - bits) == F.col("prefix"), "left_semi")
        gone = {(r.low, r.high) for r in todo}
        ranges = sorted([r for r in ranges if (r.low, r.high) not in gone] + _ranges(inside, min(64, bits + MORE_BITS)), key=lambda r: r.low)
    large, rest, left = _large(ranges, shards)
    sizes = [r.size for r in rest]
    ends = balanced_ends(sizes, smallest_capacity(sizes, left), left) if rest else []
    return [r.low for r in large], [rest[e].low for e in ends[:-1] if e < len(rest)]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; the law is `bytes`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.col("text").cast("string")).alias("h"),
            F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart, so that no window holds them all
        )
    )
    n = rows.count()
    large, begins = _cuts(rows, shards)
    shard = sum(((F.col("h") >= F.lit(b)).cast("int") for b in begins), F.lit(0))
    for k, h in enumerate(large):
        shard = F.when(F.col("h") == h, shards - 1 - k).otherwise(shard)
    windows = max(64, n // (shards * ROWS_PER_WINDOW))
    placed = rows.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(windows)).alias("part"))
    counts = placed.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
