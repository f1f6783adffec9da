"""Shards of nearly equal size: minimax contiguous partition of ordered atomic groups.

Groups of equal texts stay together. They are put in order, and the smallest capacity is searched for
which a greedy walk over the order needs no more shards than wanted; the order is then cut there.

The walk never sees the groups. Running totals are kept per block of a range partitioned table; the
driver holds one row per block (as many as shuffle partitions), and each step of a walk looks up, for
several capacities at once, the last group that still fits, in the few blocks where that can be.

Defined cases: a null text counts as the empty one; rows without an id come first, and texts that have
no id at all are one group; repeated rows are rows; an empty table gives an empty result; other columns
are ignored. Shards may stay empty when there are fewer groups than shards.
"""

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.schema import require_positive
from trafficlens.session import written

LAW = "bytes"
NO_ID = -(2**63)
# Capacities tried at once in a round of the search.
TRIED = 15


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_text"),
    )


class RunningTotals:
    """Sizes of ordered groups with running totals, searchable by total."""

    def __init__(self, groups: DataFrame):
        """`groups` has `gkey` (their order, unique) and `gsize`."""
        placed = groups.repartitionByRange("gkey").withColumn("block", F.spark_partition_id())
        placed = written(placed, "shard-groups")
        in_block = Window.partitionBy("block").orderBy("gkey").rowsBetween(Window.unboundedPreceding, 0)
        self.table = written(placed.withColumn("upto", F.sum("gsize").over(in_block)), "shard-totals", ["block"])
        # One row per block: bounded by the number of shuffle partitions.
        blocks = self.table.groupBy("block").agg(F.sum("gsize").alias("size"), F.max("gsize").alias("largest"))
        rows = blocks.orderBy("block").collect()
        self.blocks = [r["block"] for r in rows]
        self.starts = [0]
        for r in rows:
            self.starts.append(self.starts[-1] + r["size"])
        self.total = self.starts[-1]
        self.largest = max((r["largest"] for r in rows), default=0)

    def fitting(self, limits: list[int]) -> list[int]:
        """For each limit the largest running total that does not exceed it."""
        found = [self.total if limit >= self.total else None for limit in limits]
        asked = {}
        for i, limit in enumerate(limits):
            if found[i] is None:
                at = bisect_right(self.starts, limit) - 1
                asked[i] = (self.blocks[at], self.starts[at], limit - self.starts[at])
        if asked:
            fits = lambda block, inner: (F.col("block") == block) & (F.col("upto") <= inner)
            near = self.table.where(F.col("block").isin(sorted({b for b, _, _ in asked.values()})))
            row = near.agg(
                *[F.max(F.when(fits(b, inner), F.col("upto"))).alias(f"c{i}") for i, (b, _, inner) in asked.items()]
            ).first()
            for i, (_, start, _) in asked.items():
                found[i] = start + (row[f"c{i}"] or 0)
        return found

    def reaching(self, limit: int) -> int:
        """The smallest running total that is at least `limit` (0 to the total)."""
        at = bisect_left(self.starts, limit) - 1
        if at < 0 or limit <= 0:
            return 0
        block, start = self.blocks[at], self.starts[at]
        near = self.table.where((F.col("block") == block) & (F.col("upto") >= limit - start))
        return start + near.agg(F.min("upto")).first()[0]

    def large(self, count: int) -> list[tuple[int, int]]:
        """Start and end of the `count` largest groups, in running totals, by place."""
        rows = self.table.orderBy(F.desc("gsize"), "gkey").limit(count).select("block", "upto", "gsize").collect()
        start = dict(zip(self.blocks, self.starts))
        return sorted((start[r["block"]] + r["upto"] - r["gsize"], start[r["block"]] + r["upto"]) for r in rows)

    def even(self, capacity: int, shards: int) -> list[int]:
        """Where contiguous shards end that are as even as that allows and no larger than `capacity`, which is feasible.

        A group that is larger than an even share gets a shard of its own, and what lies between such groups is
        shared evenly among the other shards. No shard ends before the place from which the rest fits into
        the shards that are left.
        """
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.reaching(least[-1] - capacity))
        least.reverse()
        large, at, ends = self.large(shards), 0, []
        for i in range(shards - 1):
            ahead, left = [g for g in large if g[0] >= at], shards - i
            share, alone = _share(self.total - at, left, [b - a for a, b in ahead])
            start, end = next(((a, b) for a, b in ahead if b - a >= alone), (self.total, self.total))
            if start > at:
                parts = max(1, round((start - at) / max(share, 1)))
                end = start if parts == 1 else self.fitting([at + (start - at) // parts])[0]
            if end <= at < self.total:  # a group that does not fit into an even part
                end = self.reaching(at + 1)
            if end - at > capacity:
                end = self.fitting([at + capacity])[0]
            at = max(end, least[i])
            ends.append(at)
        return [*ends, self.total]

    def walk(self, capacities: list[int], shards: int) -> list[list[int]]:
        """Where greedy shards of each capacity end."""
        ends = [[] for _ in capacities]
        at = [0] * len(capacities)
        for _ in range(shards):
            at = self.fitting([a + c for a, c in zip(at, capacities)])
            for i, end in enumerate(at):
                ends[i].append(end)
        return ends

    def smallest_capacity(self, shards: int) -> int:
        low = max(self.largest, -(-self.total // shards))
        high = -(-self.total // shards) + self.largest  # greedy shards each take at least total / shards
        while low < high:
            step = max(1, (high - low) // (TRIED + 1))
            tried = sorted({min(high - 1, low + step * k) for k in range(TRIED)})
            works = [ends[-1] >= self.total for ends in self.walk(tried, shards)]
            first = works.index(True) if True in works else len(tried)
            high = tried[first] if first < len(tried) else high
            low = tried[first - 1] + 1 if first else low
        return low

    def last_keys(self, ends: list[int]) -> list[int | None]:
        """The key of the group at which each running total is reached; None before the first."""
        keys = {}
        inner = {}
        for end in set(ends):
            if end:
                at = bisect_right(self.starts, end - 1) - 1
                inner[end] = (self.blocks[at], end - self.starts[at])
        if inner:
            pick = {e: F.max(F.when((F.col("block") == b) & (F.col("upto") == i), F.col("gkey"))) for e, (b, i) in inner.items()}
            row = self.table.where(F.col("block").isin(sorted({b for b, _ in inner.values()}))).agg(
                *[c.alias(f"k{e}") for e, c in pick.items()]
            ).first()
            keys = {e: row[f"k{e}"] for e in pick}
        return [keys.get(end) for end in ends]


def _share(total: int, shards: int, large: list[int]) -> tuple[float, float]:
    """An even share of what is left when each group above it has a shard of its own, and the least size of such
    a group (infinite without any)."""
    alone, kept = float("inf"), shards
    share = total / kept
    for size in sorted(large, reverse=True):
        if size <= share or kept == 1:
            break
        alone, kept, total = size, kept - 1, total - size
        share = total / kept
    return share, alone


def _shard_of(gkey: Column, cuts: list[int | None]) -> Column:
    """How many shards end before the group."""
    passed = [F.when(gkey > F.lit(cut), 1).otherwise(0) if cut is not None else F.lit(1) for cut in cuts]
    shard = F.lit(0)
    for one in passed:
        shard = shard + one
    return shard.cast("int")


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id, size, text_crc32, law, shard, slot, grown_shard`.

    `size` is the UTF-8 bytes of the text plus one; the largest shard is as small as contiguous shards of
    whole groups allow. `slot` numbers the rows of a shard from 0, in the order of groups and ids.
    """
    require_positive("shards", shards)
    sized = written(_sized(docs, id_col, text_col), "shard-sizes")
    group = sized.groupBy("_text").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("gkey"))
    # Rows are dealt by (group, id), so that a group which holds much of the table spreads over blocks.
    keyed = sized.join(group, "_text").drop("_text").repartitionByRange("gkey", "doc_id")
    rows = written(keyed.withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = RunningTotals(rows.groupBy("gkey").agg(F.sum("size").alias("gsize")))
    capacity = totals.smallest_capacity(shards)
    ends = totals.even(capacity, shards)
    cuts = totals.last_keys(ends[:-1])

    dealt = rows.withColumn("shard", _shard_of(F.col("gkey"), cuts))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per block and one more per cut, which bounds the broadcast.
    starts = F.broadcast(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "part").orderBy("gkey", "doc_id", "text_crc32", "size")
    return dealt.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
