"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

A random map gives each of the 64 bit positions a vector of ``radius + 1`` bits.  For every
nonzero vector v the mask of v keeps the positions whose vector has an odd product with v.  Two
fingerprints that differ in at most ``radius`` positions leave at least one nonzero v orthogonal
to all differing positions, so they agree under the mask of that v: with 2^(radius+1) - 1 tables
no pair within the radius is missed.

Near copies differ in far more of their five-word shingles than of their words.  So ``similar_rows``
seeks candidates by fingerprints over distinct words, in several families with hashes of their own,
and links those whose five-word shingles are alike by at least ``SIMILARITY`` (Jaccard), which an exact
join within each group of candidates tells.  How many of all such pairs are found is tested.

Only distinct fingerprints enter the tables.  Inside a bucket of at most ``BUCKET`` members the
members are compared; a larger bucket is handled exactly and in linear size by single-bit flips:
two fingerprints within two bits share a neighbour one flip away, and any two that share such a
neighbour are within two bits, so linking every member to the smallest one of each neighbour
gives the same components.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from lodestack.scratch import arrow_batches, settle

BITS = 64
RADIUS = 2
#: Families of fingerprints for near copies; words in a compared shingle, and the least similarity.
FAMILIES, WORDS, SIMILARITY = 12, 5, 0.8
#: Rounds in which a group of candidates is compared with one of its texts.
STARS = 3
#: Buckets up to this size are compared pair by pair; larger ones go by flips.
BUCKET = 24


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = 11) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit integers."""
    rng = random.Random(seed)
    vectors = [i % (1 << (radius + 1)) for i in range(bits)]  # balanced, then shuffled
    rng.shuffle(vectors)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    return int(majority(np.array(hashes, dtype="<u8")))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")[0]


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Hashes of the distinct shingles of a whole text (fewer words: all of them), ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return sorted({xxhash.xxh64_intdigest(s, 42) for s in shingles})


def family_fingerprints(text: str | None, families: int = FAMILIES) -> list[int]:
    """One unsigned fingerprint a family over the distinct words of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * families
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in {*words}], dtype="<u8")
    out = []
    for f in range(families):
        x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * f + 1)) % (1 << 64))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(int(majority(x ^ (x >> np.uint64(32)))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint) per row: bit i of fp is 1 if set in over half of the shingle hashes.

    Null, empty and blank texts get fingerprint 0.  Null ids pass through.
    """
    def run(batches):
        for b in batches:
            fps = np.array([text_fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    with arrow_batches(docs.sparkSession, 512):
        return settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp bigint"), "fingerprints")


def close_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (family, a, b), a < b, whose components are those of all pairs within ``radius`` bits.

    ``fps`` has one row for each distinct (``family``, ``fp``).  Radius 1 or 2.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(covering_masks(radius))])
    rows = fps.select("family", "fp", F.explode(tables).alias("x")).select("family", "fp", "x.t", "x.k")
    at = ["family", "t", "k"]
    full = settle(rows.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    held = settle(rows.join(full, at), "members")
    small = held.filter(F.col("n") <= BUCKET)
    left, right = small.select(*at, F.col("fp").alias("a")), small.select(*at, F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, at).filter((F.col("a") < F.col("b")) & near).select("family", "a", "b")
    large = held.filter(F.col("n") > BUCKET).select("family", "fp").distinct()
    ones = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)]
    if radius == 2:
        flips = F.array(F.lit(0).cast("long"), *ones)
        around = large.select("family", "fp", F.explode(flips).alias("f")).select("family", "fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
        # at most 65 fingerprints surround any z, so these groups are bounded by construction
        stars = around.groupBy("family", "z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("bs")).filter(F.size("bs") > 1)
        linked = stars.select("family", "a", F.explode("bs").alias("b")).filter("a < b")
    else:
        out = large.select("family", F.col("fp").alias("b"), F.explode(F.array(*ones)).alias("f")).select("family", "b", F.col("b").bitwiseXOR(F.col("f")).alias("a"))
        linked = out.join(large.withColumnRenamed("fp", "a"), ["family", "a"]).filter("a < b").select("family", "a", "b")
    return pairs.unionByName(linked).distinct()


def contract(links: DataFrame) -> DataFrame:
    """Links with the same components and, in dense groups, far fewer: a node and its lower neighbours
    are all linked to the least of these, where links of many nodes fall together.

    A node has a bounded number of lower neighbours: flips and small buckets times families."""
    near = links.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("lower"))
    others = F.transform(F.filter("lower", lambda a: a != F.col("m")), lambda a: F.struct(F.col("m").alias("a"), a.alias("b")))
    return near.select(F.explode(F.concat(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b"))), others)).alias("e")).select("e.a", "e.b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): connected components of links (a, b); the label is the least node reached.

    Alternates neighbour minima with pointer jumping; every round is a table in the shared folder,
    so a lost executor costs a task and no round.  Ends when no label changes.
    """
    links = settle(contract(contract(links.select("a", "b").distinct())), "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = labels.join(seen, F.col("node") == F.col("a"), "left").join(hop, "label", "left")
        step = step.select("node", F.least("label", "m", "root").alias("next"), F.col("label").alias("was"))
        step = settle(step, "labels")
        labels = step.select("node", F.col("next").alias("label"))
        if step.filter("next < was").isEmpty():
            return labels


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """One row per input row: id, ``fp`` (bigint) and ``component_id``.

    ``component_id`` is the least id in the component of the row's fingerprint under links of at
    most ``radius`` differing bits; null ids are ignored unless a component has no other, which
    gives null.  Copies fold into their fingerprint before any link is sought.  Repeated rows are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    rows = fingerprints(docs, id_col, text_col, shingle)
    least = settle(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    labels = components(close_links(least.select(F.lit(0).alias("family"), "fp"), radius))
    roots = settle(labels.join(least, F.col("node") == F.col("fp")).groupBy("label").agg(F.min("first").alias("root")), "roots")
    linked = labels.join(roots, "label").select("node", "root")
    named = least.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    named = settle(named, "named")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_sets(texts: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(node, n, s): the distinct shingles of each text (node, t) as ascending hashes, and their number."""
    def run(batches):
        for b in batches:
            sets = [np.array(shingle_hashes(t, shingle), dtype="<u8").view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "s"])

    with arrow_batches(texts.sparkSession, 256):
        return settle(texts.select("node", "t").mapInArrow(run, "node long, n long, s array<long>"), "shingles")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (x, y) of nodes whose shingle sets have a Jaccard similarity of at least ``similarity``.
    Sizes that differ too much are told first."""
    size = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    whole = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))
    close = pairs.join(size("x"), "x").join(size("y"), "y").filter(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
    both = close.join(whole("x"), "x").join(whole("y"), "y").withColumn("i", F.size(F.array_intersect("sx", "sy")))
    return both.filter(F.col("i") >= similarity * (F.col("nx") + F.col("ny") - F.col("i"))).select("x", "y")


def verified_links(candidates: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) with the components of all pairs of nodes of one ``candidate`` group (node, group) whose
    sets are alike.  One exact rule for groups of any size.

    Two sets that are alike share one of their first shingles, in any order that is the same for all: of n
    shingles the first n - ceil(similarity * n) + 1.  The rarest in the group come first, so sets that
    differ rarely meet.  Groups of many near copies would still meet pair by pair, so before that
    ``STARS`` rounds compare a whole group with one of its sets, the one whose shingles are most common, and
    pairs that are linked through these need no comparison any more.

    Two sets share nothing before the first shingle at which they meet.  So a set with k shingles from there on
    has at most k in common with the other, which must not have over ``room`` = k * (1 + 1 / similarity) - n
    shingles.  A set that has as many rare shingles as edits bring meets none of its size.
    """
    each = candidates.join(sets, "node").select("group", "node", "n", F.explode("s").alias("s"))
    shared = each.groupBy("group", "s").agg(F.count("*").alias("df")).filter("df > 1")
    held = each.join(shared, ["group", "s"]).groupBy("group", "node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"), (F.sum("df") / F.col("n")).alias("common"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("own"))  # shingles that no other has come first
    room = lambda i: (F.size("own") - i) * (1 + 1 / similarity) - F.col("n") + 1e-6
    own = held.withColumn("first", first).filter("first > 0").select("group", "node", "n", "common", F.transform(F.slice("own", 1, F.col("first").cast("int")), lambda x, i: F.struct(x["s"].alias("s"), room(i).alias("room"))).alias("s"))
    own = settle(own, "prefixes")
    stars = None
    rest = own.select("group", "node", "common")
    for _ in range(STARS):
        pivots = rest.groupBy("group").agg(F.max_by("node", F.struct("common", "node")).alias("x"))
        pairs = own.select("group", F.col("node").alias("y")).join(pivots, "group").filter("x <> y").select("x", "y")
        pivots = settle(pivots, "pivots")
        found = settle(alike(pairs, sets, similarity), "stars")
        stars = found if stars is None else stars.unionByName(found)
        done = found.select(F.col("y").alias("node")).unionByName(pivots.select(F.col("x").alias("node"))).distinct()
        rest = settle(rest.join(done, "node", "left_anti"), "rest")
        if rest.isEmpty():
            break
    stars = stars.select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = own.select("group", "node", "n", "s").join(components(stars), "node", "left").withColumn("label", F.coalesce("label", "node"))
    lists = settle(labels.select("group", "node", "n", "label", F.explode("s").alias("s")).select("group", "node", "n", "label", "s.s", "s.room"), "lists")
    spans = F.min("n").alias("low"), F.max("room").alias("high")
    fits = lists.join(lists.groupBy("group", "s").agg(*spans), ["group", "s"]).filter("n <= high and low <= room").drop("low", "high")
    fits = settle(fits, "fitting")
    mixed = fits.groupBy("group", "s", "label").agg(F.count("*").alias("k"), *spans).groupBy("group", "s")
    mixed = mixed.agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels"), F.min("low").alias("low"), F.max("high").alias("high"))
    mixed = settle(mixed.filter("labels > 1").drop("labels"), "mixed")
    held = settle(fits.join(mixed, ["group", "s"]).filter("n <= high and low <= room").drop("low", "high"), "meeting")
    side = lambda c: [F.col(k).alias(k + c) for k in ("node", "n", "label", "room")]
    meet = held.filter("label <> most").select("group", "s", *side("x")).join(held.select("group", "s", *side("y")), ["group", "s"])
    meet = meet.filter((F.col("labelx") != F.col("labely")) & (F.col("nx") <= F.col("roomy")) & (F.col("ny") <= F.col("roomx"))).select(F.col("nodex").alias("x"), F.col("nodey").alias("y"))
    pairs = settle(meet.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    return settle(stars.unionByName(alike(pairs, sets, similarity).select(F.col("x").alias("a"), F.col("y").alias("b"))), "links")


def similar_rows(docs: DataFrame, text_col: str = "text", radius: int = RADIUS, families: int = FAMILIES, shingle: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of near copies.

    ``rows`` has one row per input row: the input columns in a struct ``doc`` and a number ``row`` that
    is unique, however ids and texts repeat.  ``groups`` has ``row`` and ``group``, which is equal for rows
    with the same words in the same order, and for rows linked, directly or through others.  Two texts are
    linked if their shingles have a Jaccard similarity of at least ``similarity`` and they are candidates:
    connected by fingerprints of one family that differ in at most ``radius`` bits, directly or through other
    texts.  So more rows never undo a link.  Null texts count as empty, and texts without words are
    one group.
    """
    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.array([family_fingerprints(t, families) for t in texts], dtype=np.uint64).reshape(-1, families).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()), 7) for t in texts], dtype=np.uint64).view(np.int64)
            ids = pa.array(np.arange(at, at + len(texts)))
            at += len(texts)
            yield pa.RecordBatch.from_arrays([ids, b.column(0), pa.array(nodes), pa.array(list(fps), pa.list_(pa.int64()))], names=["row", "doc", "node", "fps"])

    src = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("t"))
    with arrow_batches(docs.sparkSession, 256):
        schema = StructType().add("row", "long").add(src.schema["doc"]).add("node", "long").add("fps", ArrayType(LongType()))
        rows = settle(src.mapInArrow(run, schema), "fingerprinted")
    nodes = settle(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("fps").alias("fps")), "nodes")
    every = nodes.select("node", F.posexplode("fps").alias("family", "fp"))
    least = settle(every.groupBy("family", "fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "distinct")
    first = lambda fp, name: least.select("family", F.col("fp").alias(fp), F.col("first").alias(name))
    links = close_links(least.select("family", "fp"), radius).join(first("a", "x"), ["family", "a"]).join(first("b", "y"), ["family", "b"]).select("x", "y")
    same = every.join(least.filter("n > 1").select("family", "fp", "first"), ["family", "fp"]).select(F.col("first").alias("x"), F.col("node").alias("y"))
    links = links.unionByName(same).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    candidates = settle(components(links).withColumnRenamed("label", "group"), "candidates")
    texts = rows.select("row", F.col(f"doc.{text_col}").alias("t")).join(nodes.select("row", "node").join(candidates, "node"), "row")
    labels = components(verified_links(candidates, shingle_sets(texts, shingle), similarity))
    groups = rows.select("row", "node").join(labels, "node", "left").select("row", F.coalesce("label", "node").alias("group"))
    return rows.select("row", "doc"), settle(groups, "groups")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``: the one with the least id
    (nulls last), the first of those.  Which rows go is joined by row number, so no group of copies
    is gathered anywhere, and texts move at most once."""
    rows, groups = similar_rows(docs, text_col, **options)
    ranked = groups.join(rows.select("row", F.col(f"doc.{id_col}").alias("id")), "row")
    kept = ranked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row"))
    gone = settle(groups.select("row").join(kept, "row", "left_anti"), "copies")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def hex64(fp):
    """16 lowercase hex digits of a bigint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
