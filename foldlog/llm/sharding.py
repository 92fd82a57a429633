"""Sharding by minimax contiguous partition of atomic groups.

Documents of equal text form a group that is never split. Groups are ordered by a 64-bit hash of the text;
a shard is a run of groups. The capacity is the smallest for which a greedy pass needs no more than the given
shards, found by binary search. The driver never holds the groups: it sees sums of blocks of the key space
(at most BLOCKS at a time), and asks for the groups of those blocks only in which a cut can fall.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlog.session import cut

#: Bits of the key that a refinement adds; at most 2**BITS blocks come to the driver in the first.
BITS = 16
#: Groups of the blocks asked for are fetched singly once they are no more than this.
FETCH = 500_000
#: Rows of one numbering bucket, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Item:
    """A run of the key order: `low` its first key, `weight` its bytes; atomic if it is one group."""

    low: int
    weight: int
    count: int
    largest: int
    level: int

    @property
    def last(self) -> int:
        """The last key of its block."""
        return self.low + (1 << (64 - self.level)) - 1

    @property
    def atomic(self) -> bool:
        return self.count == 1


def _reach(sums: list[int], start: int, capacity: int) -> int:
    """The furthest item boundary to which one shard from `start` comes."""
    return bisect_right(sums, sums[start] + capacity) - 1


def greedy(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Boundaries (as item positions) of the greedy pass; the last is len(items) if the capacity suffices."""
    out = [0]
    for _ in range(shards):
        out.append(_reach(sums, out[-1], capacity))
    return out[1:]


def smallest_capacity(weights: list[int], shards: int) -> int:
    """Binary search over capacities, each checked by the greedy pass."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    low, high = max([0, -(-sums[-1] // shards), *weights]), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(sums, middle, shards)[-1] == len(weights):
            high = middle
        else:
            low = middle + 1
    return low


def balanced_cuts(weights: list[int], shards: int, capacity: int) -> list[int]:
    """Boundaries of `shards` runs, none above the capacity, each as near to the mean of what is left as that allows."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    n = len(weights)
    least = [n]  # from the right: the first item from which the last k shards hold all
    for _ in range(shards):
        at = least[-1]
        k = at
        low, high = 0, at
        while low < high:
            k = (low + high) // 2
            if sums[at] - sums[k] <= capacity:
                high = k
            else:
                low = k + 1
        least.append(low)
    least = least[::-1]
    out, at = [], 0
    for k in range(shards):
        target = sums[at] + (sums[n] - sums[at]) / (shards - k)
        best = bisect_right(sums, target) - 1
        if best < n and sums[best + 1] - target < target - sums[best]:
            best += 1
        at = n if k == shards - 1 else min(max(best, least[k + 1], at), _reach(sums, at, capacity), n)
        out.append(at)
    return out


def _blocks(groups: DataFrame, level: int) -> list[Item]:
    """Sums of the groups by the first `level` bits of their key."""
    low = F.shiftleft(F.shiftright("key", 64 - level), 64 - level) if level < 64 else F.col("key")
    rows = groups.groupBy(low.alias("low")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.max("weight").alias("m"), F.min("key").alias("first")).collect()
    return sorted((Item(r.first if r.n == 1 else r.low, r.w, r.n, r.m, 64 if r.n == 1 else level) for r in rows), key=lambda x: x.low)


def _open(items: list[Item], shards: int, largest: int) -> list[tuple[int, int]]:
    """Runs of items, one at most for each shard, in which a cut may fall and that hold more than single groups."""
    weights, sums = [x.weight for x in items], [0]
    for w in weights:
        sums.append(sums[-1] + w)
    low = max(-(-sums[-1] // shards), largest)
    high = max(low, smallest_capacity(weights, shards))
    wide = max([x.weight for x in items if not x.atomic], default=0)
    marks = []
    for capacity in (low, high):
        marks += [[sums[k] for k in greedy(sums, capacity, shards)], [sums[k] for k in balanced_cuts(weights, shards, high)]]
    spans: list[list[int]] = []
    for k in range(shards):
        near = [m[k] for m in marks]
        a = max(bisect_right(sums, min(near) - wide * (k + 2)) - 1, 0)
        b = min(bisect_right(sums, max(near) + (high - low + wide) * (k + 2)), len(items))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans if not all(x.atomic for x in items[a:b])]


def partition_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1 to shards-1, and the capacity. groups: (key, weight), a row per group."""
    level = BITS
    items = _blocks(groups, level)
    if not items:
        return [], 0
    largest = max(x.largest for x in items)
    while todo := _open(items, shards, largest):
        level = 64 if sum(x.count for a, b in todo for x in items[a:b]) <= FETCH else min(64, level + BITS // 2)
        inside = reduce(or_, [F.col("key").between(items[a].low, items[b - 1].last) for a, b in todo])
        kept = [x for (_, a), (b, _) in zip([(0, 0), *todo], [*todo, (len(items), 0)]) for x in items[a:b]]
        items = sorted(kept + _blocks(groups.where(inside), level), key=lambda x: x.low)
    weights = [x.weight for x in items]
    capacity = smallest_capacity(weights, shards)
    cuts = balanced_cuts(weights, shards, capacity)[:-1]
    return [items[k].low if k < len(items) else None for k in cuts], capacity


def shard_by_bytes(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds to (id, size, text_crc32) of each row: law, shard, slot, grown_shard, capacity. Law: `bytes`.

    size is the UTF-8 bytes of the text plus 1; a null text counts as empty. Rows of equal text (equal 64-bit
    hash) share a shard, repeated rows too; a group larger than the mean makes its own shard as large as it,
    and the others share the rest evenly. slot numbers the rows of a shard from 0 without gaps, in an order
    of hash buckets of the id, so that no task numbers a whole shard. grown_shard is null: adding a shard moves
    every cut. With fewer groups than shards some shards stay empty. Empty in, empty out. Extra columns are
    not carried: join on the id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    groups = cut(slim.groupBy("key").agg(F.sum("size").alias("weight")))
    keys, capacity = partition_keys(groups, shards)
    shard = F.lit(0)
    for k in keys:
        shard = shard + (F.col("key") >= F.lit(k)).cast("int") if k is not None else shard
    buckets = max(1, -(-slim.count() // BUCKET_ROWS))
    placed = slim.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "size"), F.lit(buckets)))
    filled = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = filled.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key"))
    numbered = placed.withColumn("inside", inside).join(before.drop("n"), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
