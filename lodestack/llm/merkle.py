"""Merkle manifest of a dataset: one hash tree per group of rows, and one over the groups' roots.

Leaves of a group are dealt by their place into aligned blocks of 256.  A block holds a level of its
tree as one string of hexadecimal digests, 64 characters each: two neighbouring nodes are a substring of
128 characters, whose SHA-256 is their parent, and the sibling of node i is the substring beside it.
The roots of blocks are the leaves of the next round, until every group has one node left; the groups'
roots, in the order of the groups, go through the same rounds.  Paths then come down again, each
block handing its own path to the nodes below it.

Places come from a sort by ranges of (group, order, digest), so no group is sorted in one task, and a
block is bounded, so no group is gathered.  Everything is columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.scratch import settle

#: Levels of a block, and characters of a digest.
LEVELS, WIDTH = 8, 64
STEP = "struct<is_left: boolean, sibling: string>"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its text, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return sha256(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def group_key(group: Column) -> Column:
    """The group as text that sorts bytewise, null first."""
    return F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string")))


def place(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within ``key``) by ``order``, nulls first.

    Equal rows are interchangeable; a number of their own lets the ranges part them."""
    spark = rows.sparkSession
    by = ["key", *order, "tie"]
    rows = settle(rows.withColumn("tie", F.monotonically_increasing_id()), "unplaced")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranges")
    runs = dealt.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and key
    starts = runs.select("part", "key", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(starts, ["part", "key"]).withColumn("pos", F.col("at") + F.col("shift")).drop("tie", "at", "part", "shift")


def parents(level: Column) -> Column:
    """The level above: a digest for every two neighbours, and for a last one alone."""
    n = F.ceil(F.length(level) / (2 * WIDTH)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: sha256(F.substring(level, i * (2 * WIDTH) + 1, F.lit(2 * WIDTH)))), "")


def height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(key, block, size, rows, levels) from nodes (key, pos, node, size, *carry): the rows of a block in
    order, and its levels as strings, the last of one digest."""
    row = F.struct("pos", *carry, F.col("node").alias("_node"))
    held = nodes.groupBy("key", F.shiftright("pos", LEVELS).alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(row)).alias("rows"))
    rounds = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, F.least(height(F.col("size")), F.lit(LEVELS)))
    first = F.array(F.array_join(F.transform("rows", lambda r: r["_node"]), ""))
    levels = F.aggregate(rounds, first, lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1)))))
    return held.withColumn("levels", levels)


def steps(levels: Column, i: Column) -> Column:
    """Path of node i through its block: on every level whether it is a right node (its sibling is on
    the left), and the sibling, empty at a last node that is alone."""
    def step(level: Column, k: Column) -> Column:
        # the level's place, not a power of two, comes in: half of i, k times
        at = F.floor(i / F.pow(F.lit(2), k)).cast("int")
        right = at % 2 == 1
        return F.struct(right.alias("is_left"), F.substring(level, F.when(right, at - 1).otherwise(at + 1) * WIDTH + 1, F.lit(WIDTH)).alias("sibling"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to along ``path``."""
    return F.aggregate(path, node, lambda acc, s: sha256(F.when(s["is_left"], F.concat(s["sibling"], acc)).otherwise(F.concat(acc, s["sibling"]))))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf on, as one string."""
    return F.array_join(F.transform(path, lambda s: s["sibling"]), "")


def climb(nodes: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, tops): the blocks of every round and (key, top), the node that is left of each key."""
    rounds, tops = [], []
    sized = nodes.join(nodes.groupBy("key").agg(F.count("*").alias("size")), "key")
    while True:
        done = settle(blocks(sized, carry if not rounds else []), "blocks")
        rounds.append(done)
        up = done.select("key", F.col("block").alias("pos"), F.element_at("levels", -1).alias("node"), F.col("size"))
        tops.append(up.filter(F.col("size") <= 1 << LEVELS).select("key", F.col("node").alias("top")))
        sized = up.filter(F.col("size") > 1 << LEVELS).withColumn("size", F.shiftright(F.col("size") + ((1 << LEVELS) - 1), LEVELS))
        if sized.isEmpty():
            break
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return rounds, top


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first round with ``path`` and the columns of ``above`` (key, path, ...), which has
    the path of each key's top."""
    rest = [c for c in above.columns if c not in ("key", "path")]
    path = above.select("key", F.lit(0).cast("bigint").alias("block"), "path", *rest)
    for k, done in reversed([*enumerate(rounds)]):
        # a key that ended in a lower round has one block there, whose path is its key's
        at = done.join(path, ["key", "block"])
        each = at.select("key", "path", "levels", *rest, F.posexplode("rows").alias("i", "r"))
        below = each.select("key", F.col("r.*"), F.concat(steps(F.col("levels"), F.col("i")), "path").alias("path"), *rest)
        if k == 0:
            return below
        ended = rounds[k - 1].filter(F.col("size") <= 1 << LEVELS).select("key")
        path = below.select("key", F.col("pos").alias("block"), "path", *rest)
        path = settle(path.unionByName(above.join(ended, "key", "left_semi").select("key", F.lit(0).cast("bigint").alias("block"), "path", *rest)), "paths")
    raise ValueError("no rounds")


def manifest(rows: DataFrame, group: str, order: str, node: str = "leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: ``order``, ``node``, ``carry``, and ``subroot``, ``root`` and ``path`` (array of
    struct is_left, sibling), which leads from the row's digest to the root.

    Rows are leaves of their group's tree, ascending by ``order`` (nulls first, ties by digest, and
    equal rows in any order); groups ascend bytewise, null first.  A group of one row is its own
    subroot.  An empty table gives no row.  Other columns are ignored.
    """
    own = [F.col(order).alias("o"), F.col(node).alias("node"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]]
    placed = place(rows.select(group_key(F.col(group)).alias("key"), *own), ["o", "node"])
    held = ["o", *[f"c{i}" for i in range(len(carry))]]
    rounds, tops = climb(placed, held)
    subroots = place(tops.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("top").alias("node")), ["of"])
    upper, root = climb(subroots, ["of"])
    above = descend(upper, root.select("key", F.array().cast(f"array<{STEP}>").alias("path"), F.col("top").alias("root")))
    above = settle(above.select(F.col("of").alias("key"), "path", F.col("_node").alias("subroot"), "root"), "subroots")
    out = descend(rounds, above)
    return out.select(F.col("o").alias(order), F.col("_node").alias(node), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "subroot", "root", "path")


def verified(entries: DataFrame, node: Column) -> DataFrame:
    """``entries`` of a manifest with ``folded_root``, which a row's present digest ``node`` leads to, and
    ``verified``, whether that is the root."""
    out = entries.withColumn("folded_root", fold(node, F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
