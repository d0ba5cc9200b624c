"""Minimax contiguous sharding of atomic groups, in built-in functions only.

Equal texts form one atomic group. The groups are ordered by a hash of the text, their sizes are
summed along that order, and the smallest capacity is searched for which greedy filling needs no
more than the given number of shards; the order is cut there.

The driver never holds the groups. It holds cells: stretches of the order with their first and
last cumulative size. A greedy walk over cells is a pair of walks, one that stops at the start of
a cell it can't see into and one that goes as far as the cell allows; they bracket the true walk,
as a later start never ends earlier. Capacities that only one of the two walks can serve stay
open, the cells between the walks are split by one more aggregation, and the search goes on until
no capacity is open and the walks agree. The cells are bounded by the number of shards and the
fan-out of a split, whatever the input.

Defined results: a null text counts as no bytes and shares the group of the empty text; a group
larger than a fair share fills a shard that is as large as the group; with fewer groups than
shards the last shards stay empty; repeated rows are rows of one group, and take slots of their
own; rows with a null doc_id are placed like others; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.llm.common import partitions, stored, table

SHARDS = 24
OVERHEAD = 8
ROUGH = 1 << 16
SPLIT = 256


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h): h orders the groups and names one text each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("h"))


def summed(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """(h, size, total): every group with the sum of the sizes up to and with it.

    The order is that of h, which is uniform: sums run within buckets of h, and the buckets'
    own sums, one row each, are carried on top.
    """
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets).cast("int"))
    before = groups.groupBy("bucket").agg(F.sum("size").alias("n"))
    before = before.select("bucket", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("n")).alias("before"))
    inside = groups.withColumn("inside", F.sum("size").over(Window.partitionBy("bucket").orderBy("h")))
    return inside.join(before, "bucket").select("h", "size", (F.col("before") + F.col("inside")).alias("total"))


class Cells:
    """Stretches of the cumulative sizes, each up to its last group end. A cell is (end, n, level,
    slot): n groups end in it, and it is a slot of the even grid of its level."""

    def __init__(self, found: list[tuple[int, int, int, int]]):
        self.found = [(0, 1, 0, -1), *sorted(found)]
        self.end = [c[0] for c in self.found]

    def reach(self, x: int, far: bool) -> int:
        """The last group end at or before x, from below or from above where it isn't known."""
        k = bisect_right(self.end, x) - 1
        if far and k + 1 < len(self.end) and self.found[k + 1][1] > 1:
            return min(x, self.end[k + 1] - 1)
        return self.end[k]

    def walk(self, capacity: int, shards: int, far: bool) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity, far)
            cuts.append(at)
        return cuts

    def least(self, low: int, high: int, shards: int, far: bool) -> int:
        """The smallest capacity in [low, high] whose walk gets to the end."""
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, far)[-1] >= self.end[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def between(self, near: list[int], far: list[int]) -> set[int]:
        """The cells with more than one group in which a cut may lie."""
        held: set[int] = set()
        for a, b in zip(near, far, strict=True):
            k = bisect_right(self.end, a)
            while k < len(self.end) and self.end[k - 1] <= b:
                if self.found[k][1] > 1:
                    held.add(k)
                k += 1
        return held


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity, and the cumulative size at which each shard ends."""
    top = groups.agg(F.max("total"), F.max("size")).first()
    if top[0] is None:
        return 0, [0] * shards
    total, largest = int(top[0]), int(top[1])

    def slot(level: int):
        grid = ROUGH * SPLIT**level
        return F.floor((F.col("total") - 1).cast("decimal(38,0)") * F.lit(grid).cast("decimal(20,0)") / F.lit(total).cast("decimal(18,0)")).cast("long") if level else F.floor((F.col("total") - 1) / F.lit(total / grid)).cast("long")

    def look(level: int, inside: list[int] | None) -> list[tuple[int, int, int, int]]:
        """The cells of a level, of all groups or of those in some slots of the level before."""
        seen = groups if inside is None else groups.filter(slot(level - 1).isin(inside))
        found = seen.groupBy(slot(level).alias("slot")).agg(F.max("total").alias("end"), F.count("*").alias("n")).collect()
        return [(int(r["end"]), int(r["n"]), level, int(r["slot"])) for r in found]

    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    cells = Cells(look(0, None))
    while True:
        low, high = cells.least(low, high, shards, far=True), cells.least(low, high, shards, far=False)
        near, far = cells.walk(low, shards, far=False), cells.walk(high, shards, far=True)
        held = cells.between(near, far)
        if low == high and (near == far or not held):
            return low, near
        known = [c for k, c in enumerate(cells.found) if k and k not in held]
        for level in {cells.found[k][2] for k in held}:
            known += look(level + 1, [cells.found[k][3] for k in held if cells.found[k][2] == level])
        cells = Cells(known)


def slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with slot: 0, 1, ... within each shard, without gaps.

    Shards are dealt into parts by a hash of the row's key; rows are numbered within their part
    and the parts' counts, one row each, are carried on top.
    """
    parts = max(64, partitions(rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(shard, "part").agg(F.count("*").alias("n"))
    counts = counts.select(shard, "part", (F.sum("n").over(Window.partitionBy(shard).orderBy("part")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy(shard, "part").orderBy("doc_id", "h")))
    return numbered.join(counts, [shard, "part"]).withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long")).drop("part", "before", "place")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    rows = stored(keyed(docs), "sharding-rows")
    groups = stored(summed(rows), "sharding-groups")
    _, cuts = minimax_cuts(groups, shards)
    # one row for each shard at most: the hash of its last group
    last = groups.filter(F.col("total").isin([c for c in cuts if c])).select("h").collect()
    bounds = sorted(r["h"] for r in last)[:-1]
    shard = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col("h"))) if bounds else F.lit(0)
    placed = slots(rows.withColumn("shard", shard.cast("int")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
