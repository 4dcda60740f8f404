"""Mixing sources to target weights by Pareto order sampling.

Targets in words come from source weights by water-filling under a repeat limit.  Inside a source a
document is expected ``copies = min(limit, level * weight)`` times, with the one level at which
the expected words add up to the target.  Its certain whole copies, the whole part, are allocated
first.  The rest of the target is drawn without replacement: documents are ranked by
Q = (u / (1 - u)) / (p / (1 - p)), with u a fixed hash of the id and p the fractional part, the
document's inclusion probability, and the lowest ranks are taken until the words are reached.  The
sample size is fixed in words.

Weights are read in steps of 1/16, so a source has at most 256 of them and levels are solved on
(source, weight) totals.  No source is ever sorted as a whole: Q is mapped into (0, 1), cut into
about sqrt(n) slots a source, and slot totals say which slots are taken whole; only the few slots
from the border on are ranked row by row.  Slot totals and border rows are both of size sqrt(n).

Border rule: below the border slot every document is taken.  From the border on, REACH slots are gone
through in order of Q, FILLS times, and what still fits in the remaining words is taken; then the one
document nearest in size to what remains is added if that brings the source closer to its target.
So a source misses its target by at most half the size of the smallest document that is left out
in those slots, or by the words of documents that FILLS passes did not reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.textops import id_text, word_count
from lodestack.scratch import settle

#: Weights of the sources in code-point order, repeating; null last.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Documents from so many words on have this weight: fragments say little, and the longest texts
#: would crowd out others.
LENGTH_WEIGHTS = ((0, 1.0), (64, 1.5), (256, 2.0), (1024, 1.5))
#: Steps of a weight, and the most of them.
STEPS, MOST = 16, 256
#: Slots from the border on whose documents may fill what is left, and times they are gone through.
REACH, FILLS = 8, 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size, n).

    A source's target is min(max_repeat * its size, level * its weight), with the one level at
    which targets add up to all sizes: the fixed point of resharing the excess by weight.  Works
    on one row per source.  Sources without words get target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(up), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(up), F.lit(0)),
    })
    # a source is full if the level, were it and all after it open, reaches its limit
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    per = per.withColumn("full", level * F.col("w") >= F.col("cap"))
    rest = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    per = per.withColumns({"rest": rest, "open_w": open_w})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("total") - F.col("rest")) / F.col("open_w") * F.col("w"))
    return per.select("source", "n", "source_size", target.alias("target"))


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) fixed by the key: 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def copy_plan(levels: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, steps, n, source_size, target, whole, p, left, share) from (source, steps, words) and targets.

    ``whole + p`` are the expected copies of a document with this weight, ``left`` the words of the
    source that are drawn, ``share`` their share of the words that have a chance.  Works on one row
    per source and weight.
    """
    some = levels.filter("words > 0").join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    down = Window.partitionBy("source").orderBy(F.desc("steps"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("words") * F.col("steps")).over(down.rowsBetween(0, Window.unboundedFollowing))
    # a weight is at the limit if the level, were it and all lower ones open, reaches it
    some = some.withColumn("level", (F.col("target") - before * max_repeat) / after)
    some = some.withColumn("full", (F.col("target") >= F.col("source_size") * max_repeat) | (F.col("level") * F.col("steps") >= max_repeat))
    level = F.max_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("steps"))).over(Window.partitionBy("source"))
    some = some.withColumn("copies", F.when(F.col("full"), F.lit(float(max_repeat))).otherwise(level * F.col("steps")))
    some = some.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.col("whole"))
    every = Window.partitionBy("source")
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)
    pool = F.sum(F.when(F.col("p") > 0, F.col("words")).otherwise(0)).over(every)
    some = some.withColumn("left", F.greatest(left, F.lit(0.0))).withColumn("pool", pool)
    share = F.when(F.col("pool") > 0, F.col("left") / F.col("pool")).otherwise(0.0)
    return some.select("source", "steps", "whole", "p", "left", F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9)).alias("share"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
        length_weights: tuple[tuple[int, float], ...] = LENGTH_WEIGHTS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken.

    A document's weight is that of its length times ``weight_col`` (null or missing: 1), between 1/16
    and 16.  Null texts have size 0; documents without words are never taken.  Null sources form one
    source, last in order.  Rows with equal ids draw the same number and are ordered by size; an
    empty table gives an empty result.  ``taken`` is ``copies * size`` with copies in 0..max_repeat.
    ``keep`` names columns that are passed on as the fields of one struct, ``kept``.
    """
    size = word_count(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), (F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)).alias("weight"), *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []))
    by_length = F.lit(1.0)
    for least, w in sorted(length_weights):
        by_length = F.when(F.col("size") >= least, F.lit(float(w))).otherwise(by_length)
    steps = F.least(F.greatest(F.floor(F.col("weight") * by_length * STEPS + 0.5), F.lit(1)), F.lit(MOST)).cast("long")
    base = settle(base.withColumn("steps", steps).drop("weight"), "sizes")
    levels = settle(base.groupBy("source", "steps").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "levels")
    targets = settle(source_targets(levels.withColumnRenamed("words", "size"), weights, max_repeat), "targets")
    plan = settle(copy_plan(levels, targets, max_repeat), "plan")
    rows = base.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    named = plan.withColumnsRenamed({"source": "of", "steps": "at"})
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("steps") == F.col("at")), "left").drop("of", "at", "steps")
    rows = rows.fillna(0, ["whole", "p", "left", "share"])  # sources without words
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(0))
    u, p = unit_hash(id_text(F.col("id")), seed), F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = rows.withColumn("q", (u / (1 - u)) / (p / (1 - p))).withColumn("slots", F.ceil(F.sqrt("n")).cast("long"))
    # ranks over the source's mean odds spread about as u does, which maps them into slots
    even = F.col("q") * (F.col("share") / (1 - F.col("share")))
    rows = rows.withColumn("slot", F.least(F.floor(even / (1 + even) * F.col("slots")), F.col("slots") - 1))
    rows = rows.withColumn("open", (F.col("size") > 0) & (F.col("left") > 0) & (F.col("p") > 0))
    rows = settle(rows, "ranked")

    some = rows.filter("open")
    slots = some.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("slot"))
    border = slots.withColumn("upto", run).filter(F.col("upto") > F.col("left"))
    border = border.groupBy("source").agg(F.min("slot").alias("border"), F.min(F.col("upto")).alias("upto"), F.min_by("words", "slot").alias("words"))
    border = settle(border.select("source", "border", (F.col("upto") - F.col("words")).alias("before")), "border")

    joined = rows.join(border.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    below = F.col("open") & (F.col("border").isNull() | (F.col("slot") < F.col("border")))
    at_border = F.col("open") & F.col("slot").between(F.col("border"), F.col("border") + REACH - 1)
    edge = joined.filter(at_border).withColumn("room", F.col("left") - F.col("before")).withColumn("in", F.lit(False))
    order = Window.partitionBy("source").orderBy("q", "id", "size")
    for _ in range(FILLS):
        fits = ~F.col("in") & (F.col("size") <= F.col("room"))
        edge = edge.withColumn("run", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.withColumn("new", fits & (F.col("run") <= F.col("room")))
        got = F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
        edge = edge.withColumn("got", got).withColumns({"in": F.col("in") | F.col("new"), "room": F.col("room") - F.col("got")})
    apart = F.when(~F.col("in"), F.abs(F.col("size") - F.col("room")))
    nearest = F.row_number().over(Window.partitionBy("source").orderBy(apart.asc_nulls_last(), "q", "id", "size")) == 1
    edge = edge.withColumn("near", nearest & (apart < F.col("room")))
    edge = edge.withColumn("in", F.col("in") | F.coalesce("near", F.lit(False)))
    cols = ["id", "source", "size", "source_size", "target", "copies", *(["kept"] if keep else [])]
    plain = joined.filter(~F.coalesce(at_border, F.lit(False))).withColumn("copies", F.col("whole") + F.when(below, 1).otherwise(0)).select(*cols)
    done = plain.unionByName(edge.withColumn("copies", F.col("whole") + F.when(F.col("in"), 1).otherwise(0)).select(*cols))
    return done.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))
