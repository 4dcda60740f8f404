"""Upserts, appends, pruning and idempotent commands over file tables.

File tables have no MERGE.  A merge is one aggregation over old and new rows keyed by the entity,
so each side is shuffled once and several new rows of a key fold in sequence order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_filled(column: str, seq: str = "seq") -> Column:
    """The newest non-blank value; '' if there is none."""
    return F.coalesce(F.max_by(column, F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(seq))), F.lit(""))


def upsert_datasets(old: DataFrame, new: DataFrame, key: str, fill: list[str], replace: list[str], seen: str, seq: str = "seq") -> DataFrame:
    """Key-wise merge: a non-blank newer value wins, ``replace`` columns are always the newest,
    first_seen is kept and last_seen advances.  ``old`` has the result's columns and a seq below
    every new one."""
    rows = old.withColumnRenamed("last_seen", seen).unionByName(new.withColumn("first_seen", F.col(seen)))
    aggs = [last_filled(c, seq).alias(c) for c in fill] + [F.max_by(c, seq).alias(c) for c in replace]
    return rows.groupBy(key).agg(*aggs, F.min("first_seen").alias("first_seen"), F.max(seen).alias("last_seen"), F.max(seq).alias(seq))


def evidence_priority(obs: DataFrame, key: str, column: str, kind: str, strong: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """A value backed by strong evidence replaces; any other only fills a gap.

    So the newest strong value wins, and without one the oldest value stays."""
    filled = F.coalesce(F.col(column), F.lit("")) != ""
    best = F.max_by(column, F.when(filled & F.col(kind).isin(*strong), F.col(seq)))
    gap = F.min_by(column, F.when(filled, F.col(seq)))
    return obs.groupBy(key).agg(F.coalesce(best, gap, F.lit("")).alias(column))


def merge_maps(old: Column, new: Column) -> Column:
    """Object merge in which empty new values never overwrite."""
    keep = F.map_filter(new, lambda _, v: F.coalesce(v, F.lit("")) != "")
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(keep, k)), keep)


def upsert_distributions(obs: DataFrame, keys: list[str], evidence: list[str], validation: list[str], checked: str, seq: str = "seq") -> DataFrame:
    """Evidence is always the newest; validation columns only change where a check was made."""
    aggs = [F.max_by(c, seq).alias(c) for c in evidence]
    done = F.when(F.col(checked), F.col(seq))
    return obs.groupBy(*keys).agg(*aggs, *[F.max_by(c, done).alias(c) for c in validation], F.max(done).alias("checked_seq"))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Existing rows stay; of several new rows of a key the first is inserted."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    rest = [c for c in incoming.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(position, *rest)).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(first, allowMissingColumns=True)


def append_observations(obs: DataFrame, path: str) -> None:
    """Observations are append-only, known datasets included."""
    obs.write.mode("append").parquet(path)


def upsert_traces(traces: DataFrame, keys: list[str], arrival: str, content: list[str]) -> DataFrame:
    return traces.groupBy(*keys).agg(F.max_by(F.struct(*content), F.struct(arrival, *content)).alias("_t")).select(*keys, "_t.*")


def idempotent_commands(commands: DataFrame, keys: list[str], fingerprint: str, order: str) -> DataFrame:
    """The first command of a key is applied; later ones replay it or conflict with it."""
    first = commands.groupBy(*keys).agg(F.min(order).alias("_first"), F.min_by(fingerprint, order).alias("_print"))
    out = commands.join(first, keys)
    verdict = F.when(F.col(order) == F.col("_first"), "applied").when(F.col(fingerprint) == F.col("_print"), "replayed").otherwise("conflict")
    return out.withColumn("verdict", verdict).drop("_first", "_print")


def charge_once(attempts: DataFrame, keys: list[str], charged: DataFrame) -> DataFrame:
    return attempts.select(*keys).distinct().join(charged.select(*keys), keys, "left_anti")


def eligible_for_pruning(df: DataFrame, time: str, before: Column, terminal: Column, blockers: DataFrame, key: str, blocker_key: str) -> DataFrame:
    """Old terminal rows that nothing live depends on."""
    old = df.filter((F.col(time) < before) & terminal)
    return old.join(blockers.select(F.col(blocker_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def prune(df: DataFrame, eligible: DataFrame, key: str, batch: int | None = None, order: str | None = None) -> DataFrame:
    """The rows that remain; with ``batch`` only the oldest so many eligible rows go."""
    gone = eligible.orderBy(order or key, key).limit(batch) if batch else eligible
    return df.join(gone.select(key), key, "left_anti")


def apply_decision(candidates: DataFrame, decisions: DataFrame, key: str, version: str) -> DataFrame:
    """Status from the decision of the same version; stale decisions are ignored."""
    d = decisions.select(key, F.col(version).alias("_v"), F.col("accepted").alias("_a"))
    j = candidates.join(d, (candidates[key] == d[key]) & (candidates[version] == d["_v"]), "left").drop(d[key])
    return j.withColumn("status", F.when(F.col("_a"), "accepted").when(~F.col("_a"), "rejected").otherwise(F.col("status"))).drop("_v", "_a")
