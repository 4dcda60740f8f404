"""Reports over jobs, attempts, events and validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retry_lineage(jobs: DataFrame, group: str, job: str, status: str, failed: str = "error") -> DataFrame:
    """``jobs`` with root_id: a job after a failed one of its group belongs to that one's lineage."""
    by = Window.partitionBy(group).orderBy(job)
    rows = jobs.withColumn("_prev", F.lag(status).over(by))
    rows = rows.withColumn("_line", F.sum(F.when(F.col("_prev") == failed, 0).otherwise(1)).over(by))
    return rows.withColumn("root_id", F.min(job).over(Window.partitionBy(group, "_line"))).drop("_prev", "_line")


def lineage_rows(jobs: DataFrame, rows: DataFrame, job: str) -> DataFrame:
    """``rows`` of every job in the lineage of a job: (root_id, row columns), by the jobs' root_id."""
    return rows.join(jobs.select(job, "root_id"), job)


def retry_eligibility(searches: DataFrame, published: DataFrame, key: str, status: Column, complete: Column, due: Column) -> DataFrame:
    """Finished searches that may run again: nothing published, failed or partly done with discovery
    incomplete, and due."""
    open_ = (status == "error") | ((status == "partial") & ~complete)
    return searches.filter(open_ & due).join(published.select(key).distinct(), key, "left_anti")


def due_backlog(rows: DataFrame, queue: str, next_retry: str, order: list[str], now: Column, n: int) -> DataFrame:
    """The ``n`` oldest items of each queue whose retry time (null: at once) has come, with their place."""
    due = rows.filter(F.coalesce(F.col(next_retry), now) <= now)
    return due.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy(*order))).filter(F.col("place") <= n)


def group_attempts(attempts: DataFrame, job: str, claim: str, attempt: str, available: Column) -> DataFrame:
    """(job, claim, checks_recorded, available_checks, case_id): attempts of one claim of a job
    together, attempts without a claim each alone."""
    of = F.coalesce(F.concat(F.lit("claim:"), F.col(claim)), F.concat(F.lit("unknown:"), F.col(attempt).cast("string")))
    g = attempts.groupBy(F.col(job), of.alias("claim")).agg(F.count("*").alias("checks_recorded"), F.count_if(available).alias("available_checks"))
    return g.withColumn("case_id", F.sha2(F.concat_ws("/", F.col(job).cast("string"), "claim"), 256))


def merge_provenance(evidence: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, evidence): the distinct evidence objects (structs of ``fields``) of every key, sorted."""
    return evidence.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("evidence"))


def operation_stats(events: DataFrame, kind: str, duration: str, slow: float, ended: DataFrame, key: str) -> DataFrame:
    """(kind, n, mean_duration, p95, slow, unmatched): durations per kind, and events whose key has
    no row in ``ended``."""
    e = events.join(ended.select(key).distinct().withColumn("_ended", F.lit(True)), key, "left")
    return e.groupBy(kind).agg(F.count("*").alias("n"), F.avg(duration).alias("mean_duration"), F.percentile(duration, 0.95).alias("p95"), F.count_if(F.col(duration) > slow).alias("slow"), F.count_if(F.col("_ended").isNull()).alias("unmatched"))


def validation_breakdown(checks: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """Counts per status as columns; statuses that do not occur count 0."""
    return checks.groupBy(by).pivot(status, values).agg(F.count(F.lit(1))).na.fill(0, values)


def discovery_completeness(warnings: DataFrame, key: str, incomplete: Column) -> DataFrame:
    """(key, complete): complete unless any of its warnings says otherwise."""
    return warnings.groupBy(key).agg((~F.bool_or(F.coalesce(incomplete, F.lit(False)))).alias("complete"))


def local_result_union(parts: list[DataFrame], key: str, item: str) -> DataFrame:
    """(key, ids): distinct ids of each key, those of an earlier part first, ascending inside a part."""
    rows = None
    for i, p in enumerate(parts):
        part = p.select(key, item, F.lit(i).alias("_part"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(key, item).agg(F.min("_part").alias("_part"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_part", item))), lambda x: x[item]).alias("ids"))


def ordered_codes(rows: DataFrame, key: str, code: str, order: str) -> DataFrame:
    """(key, codes): distinct codes of each key by first appearance."""
    first = rows.groupBy(key, code).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", code))), lambda x: x[code]).alias("codes"))


def duplicate_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def attempt_audit(results: DataFrame, runs: DataFrame, run: str, voter: str, order: list[str], token: str, content: list[str]) -> DataFrame:
    """``results`` with verdict: repeat of the voter's result before it, stale where the token is not
    that of the run (``runs``: run, token), else valid."""
    w = Window.partitionBy(run, voter).orderBy(*order)
    body = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    current = runs.select(run, F.col(token).alias("_token"))
    rows = results.join(current, run, "left").withColumn("_print", body)
    verdict = F.when(F.col("_print") == F.lag("_print").over(w), "repeat").when(~F.col(token).eqNullSafe(F.col("_token")), "stale").otherwise("valid")
    return rows.withColumn("verdict", verdict).drop("_token", "_print")
