"""Sharding (7): best-fit-decreasing bin packing of groups that stay whole.

Groups are the rows of equal texts. Packing goes in two steps, so that no task holds all of them. First each partition of the
groups, by decreasing size, fills small bins of one fixed capacity, the bundles; their number doesn't grow with the rows. Then the
bundles fill the shards. Both steps put an item into the tightest bin that still takes it, found in a balanced tree of the bins'
remaining capacities. The shards' capacity is the least at which the bundles need no more than the shards asked for; a group that is
larger than its fair share has a shard of its own, and the others share the rest evenly.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import checkpointed, shuffle_partitions

#: Bundles that would fill a shard, at least; groups that one task packs, at most on average.
BUNDLES, TASK_GROUPS = 256, 1_000_000
#: A group with more than this share of all rows gets its shard by a broadcast, not by a shuffle to one task. There are fewer than 1 / share.
HOT_SHARE, HOT_ROWS = 1 / 2000, 64


class Tree:
    """A balanced search tree of (remaining capacity, bin): sorted leaves of bounded length under a sorted index of their first items."""

    LEAF = 512

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.first: list[tuple[int, int]] = []

    def add(self, item: tuple[int, int]) -> None:
        i = max(0, bisect_left(self.first, item) - 1)
        if not self.leaves:
            self.leaves.append([])
            self.first.append(item)
        leaf = self.leaves[i]
        insort(leaf, item)
        self.first[i] = leaf[0]
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.first[i : i + 1] = [leaf[0], leaf[half]]

    def take_least(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that is size or more."""
        key = (size, -1)
        i = bisect_left(self.first, key)
        if i and self.leaves[i - 1][-1] >= key:
            i -= 1
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        item = leaf.pop(bisect_left(leaf, key))
        if leaf:
            self.first[i] = leaf[0]
        else:
            del self.leaves[i], self.first[i]
        return item


class Packer:
    """Best fit for items that come by decreasing size; an item larger than the capacity gets a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.bins = capacity, Tree(), 0

    def put(self, size: int) -> int:
        if size > self.capacity:
            self.bins += 1
            return self.bins - 1
        if (found := self.tree.take_least(size)) is None:
            self.bins += 1
            found = (self.capacity, self.bins - 1)
        if found[0] > size:
            self.tree.add((found[0] - size, found[1]))
        return found[1]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, by best fit decreasing; equal sizes in the order given."""
    packer, out = Packer(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = packer.put(sizes[i])
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """The bin of each item at the least capacity that needs no more than so many bins. An item over its fair share of what isn't placed
    yet, of the largest first, has a bin of its own."""
    out, rest = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, own = sum(sizes), 0
    while rest and own < shards - 1 and sizes[rest[0]] * (shards - own) > left:
        out[rest[0]] = own
        left, own, rest = left - sizes[rest[0]], own + 1, rest[1:]
    if not rest:
        return out
    low, bins = max(1, math.ceil(left / (shards - own))), None
    # From the mean on, the capacity grows by thousandths: best fit isn't monotone, so the first that fits is taken, not the middle.
    step, capacity, mine = max(1, low // 2000), low, [sizes[i] for i in rest]
    while capacity < left and max(bins := pack(mine, capacity)) >= shards - own:
        capacity += step
        step = max(step, (capacity - low) // 8)
    for i, b in zip(rest, bins if bins and capacity < left else pack(mine, max(left, 1)), strict=True):
        out[i] = own + b
    return evened(sizes, out, shards)


def evened(sizes: list[int], bins: list[int], shards: int) -> list[int]:
    """The bins after moves that each bring two of them nearer to each other: an item goes from a fuller bin to the emptiest one, the one
    that leaves the two most alike. The tightest bins are taken first in packing, so that some may have been left empty."""
    out, held = list(bins), [[] for _ in range(shards)]
    for i, b in enumerate(bins):
        held[b].append((sizes[i], i))
    load = [sum(s for s, _ in h) for h in held]
    for h in held:
        h.sort()
    while True:
        low = min(range(shards), key=lambda b: (load[b], b))
        best = None
        for b in range(shards):
            gap = load[b] - load[low]
            at = bisect_left(held[b], (gap // 2, -1))
            for k in (at - 1, at):
                if 0 <= k < len(held[b]) and 0 < held[b][k][0] < gap:
                    # By how much the larger of the two falls, the fullest bin first.
                    gain = (load[b], min(held[b][k][0], gap - held[b][k][0]))
                    if best is None or gain > best[0]:
                        best = (gain, b, k)
        if best is None:
            return out
        _, b, k = best
        item = held[b].pop(k)
        insort(held[low], item)
        load[b], load[low], out[item[1]] = load[b] - item[0], load[low] + item[0], low


def _per_part(capacity: int):
    """Puts the groups of each part, sorted by decreasing size, into bundles; a partition may hold several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, Packer] = {}
        for batch in batches:
            names = batch.schema.names
            parts = batch.column(names.index("part")).to_pylist()
            sizes = batch.column(names.index("bytes")).to_pylist()
            bins = [packers.setdefault(p, Packer(capacity)).put(s) for p, s in zip(parts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], names=[*names, "bin"])

    return run


def _numbered(first: dict[tuple[int, int], int]):
    """Adds each row's slot: rows are sorted by shard in each range; first: the slot of the first row of a shard in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            shard, at = batch.column(names.index("shard")).to_numpy(), batch.column(names.index("range"))[0].as_py()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            slots = np.empty(len(shard), np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = (at, int(shard[a]))
                start = used.get(key, first[key])
                slots[a:b] = np.arange(start, start + b - a)
                used[key] = start + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots)], names=[*names, "slot"])

    return run


def shard(docs: DataFrame, shards: int = 8, text: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """docs' doc_id with size long (UTF-8 bytes of the text and one), text_crc32, law, shard int, slot long and grown_shard (null).

    Rows of equal texts (null and empty are two texts) go to one shard, whatever their number. Slots count from 0 in each shard without
    gaps, by doc_id, null ones first, then by text. Repeated rows each get a slot. A shard is empty only where there are fewer groups than shards. The result is the same at every run up to the order
    of wholly equal rows. An empty table gives an empty table. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    body = F.col(text)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.encode(body, "UTF-8"))), F.lit(b"")).alias("same"),
    )
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("groups")).first()
    capacity = max(1, math.ceil(total.bytes / shards / bundles))
    parts = max(1, min(shuffle_partitions(spark), math.ceil(total.groups / 64)), math.ceil(total.groups / TASK_GROUPS))
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("same"), F.lit(parts)).cast("int")).repartition(parts, "part")
    dealt = dealt.sortWithinPartitions("part", F.desc("bytes"), "same")
    schema = dealt.withColumn("bin", F.lit(0).cast("long")).schema
    placed = checkpointed(dealt.mapInArrow(_per_part(capacity), schema).select("same", "rows", "bytes", F.concat_ws(":", "part", "bin").alias("bundle")))
    items = placed.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()  # about bundles * shards, at most parts more
    bins = pack_into([r.bytes for r in items], shards)
    where = spark.createDataFrame([(r.bundle, b) for r, b in zip(items, bins, strict=True)], "bundle string, shard int")
    placed = placed.join(F.broadcast(where), "bundle").select("same", "rows", "shard")
    hot_rows = max(HOT_ROWS, math.ceil(total.rows * HOT_SHARE))
    hot = placed.where(F.col("rows") > hot_rows).select("same", "shard")
    others = rows.join(F.broadcast(hot.select("same")), "same", "left_anti").join(placed.where(F.col("rows") <= hot_rows).select("same", "shard"), "same")
    put = rows.join(F.broadcast(hot), "same").unionByName(others)
    # Slots: rows are put in order by ranges, whose rows are counted by shard; wholly equal rows may be in several ranges.
    order = [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("same")]
    ranged = put.withColumn("of", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order, F.col("of"))
    ranged = checkpointed(ranged.sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("range")))
    first, used = {}, [0] * shards
    for r in ranged.groupBy("range", "shard").count().orderBy("range", "shard").collect():  # ranges * shards, at most
        first[r["range"], r["shard"]] = used[r["shard"]]
        used[r["shard"]] += r["count"]
    out = ranged.mapInArrow(_numbered(first), ranged.withColumn("slot", F.lit(0).cast("long")).schema)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
