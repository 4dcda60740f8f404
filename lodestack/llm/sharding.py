"""Sharding by longest-processing-time scheduling of groups that must stay together.

Rows with equal texts form a group.  Scheduling every group one by one would pass them all through
one place, so the scheduled items are bounded: each of the few groups that hold at least
1 / (shards * PER_SHARD) of all bytes is an item of its own, and all smaller groups are hashed into
bundles whose expected sizes halve from level to level.  Items are sorted by size and go to the
least-loaded shard through a heap; the last, smallest bundles level the loads.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.scratch import settle

SHARDS = 24
#: Bundles a level and shard; also the bound on groups that are items of their own.
PER_SHARD = 32
LEVELS = 10
#: Sub-ranges of a shard within which rows are numbered.
RANGES = 256


def longest_first(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """item -> shard: items by size descending, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = 8) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus ``overhead``; a null text counts as an empty one and shares
    its group.  slot numbers a shard's rows from 0 without gaps.  Equal rows are numbered in any
    order, which gives the same set of rows.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    rows = settle(rows, "sizes")
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // (shards * PER_SHARD)))
    # at most shards * PER_SHARD groups can be that large
    large = {bytes(r.key): r.bytes for r in groups.filter(F.col("bytes") >= least).collect()}
    bundles = LEVELS * shards * PER_SHARD
    draw = F.pmod(F.xxhash64(F.col("key")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    level = F.least(F.floor(-F.log2(1 - draw)), F.lit(LEVELS - 1))
    bundle = level * (shards * PER_SHARD) + F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(shards * PER_SHARD))
    sizes = groups.filter(F.col("bytes") < least).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    items: list[tuple[int, object]] = [(b, k) for k, b in large.items()]
    items += [(r.bytes, r.bundle) for r in sizes.collect()]  # at most LEVELS * shards * PER_SHARD rows
    assert len(items) <= bundles + shards * PER_SHARD
    placed = longest_first(items, shards)
    single = spark.createDataFrame([(bytearray(k), s) for k, s in placed.items() if isinstance(k, bytes)], "key binary, s1 int")
    shared = spark.createDataFrame([(k, s) for k, s in placed.items() if not isinstance(k, bytes)], "bundle long, s2 int")
    # both tables are bounded by the constants above, whatever the input
    out = rows.withColumn("bundle", bundle).join(F.broadcast(single), "key", "left").join(F.broadcast(shared), "bundle", "left")
    out = out.select("id", "size", "crc", F.coalesce("s1", "s2").alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(RANGES)).cast("int").alias("part"))
    out = settle(out, "placed")
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settle(counts.select("shard", "part", before.alias("base")), "starts")  # at most shards * RANGES rows
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "size", "crc")) - 1
    out = out.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))
