"""Progress and outcome rules of searches, collections and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failures that a later attempt may clear, and the attempts they get. Fixed values.
TRANSIENT = ("llm_timeout", "llm_network_error", "llm_rate_limited", "llm_unavailable")
MAX_ATTEMPTS, INVALID_ATTEMPTS, WINDOW_SECONDS = 3, 2, 120


def collection_outcome(errors: Column, verified: Column, saved: Column) -> Column:
    return F.when((errors > 0) | ~F.coalesce(verified, F.lit(False)), "incomplete").when(saved > 0, "results").otherwise("empty")


def candidate_flags(status: Column, waiting: Column, job_status: Column, job_outcome: Column) -> Column:
    """One of active, queued, waiting, blocked, incomplete or completed for a candidate and its job."""
    by_job = F.when(job_status == "running", "active").when(job_status == "waiting_retry", "waiting").when(job_status == "queued", "queued").when(job_status == "failed", "blocked").when(job_outcome.isin("results", "empty"), "completed").otherwise("incomplete")
    return (F.when(status == "classifying", "active").when((status == "queued") & waiting, "waiting").when(status == "queued", "queued").when(status == "pending", "incomplete")
            .when(status == "error", "blocked").when(status == "rejected", "completed").when(status == "accepted", by_job))


def search_outcome(candidates: DataFrame, search: str, state: Column, results: Column, discovery_complete: Column) -> DataFrame:
    """(search, execution_status, outcome, results) from per-candidate states."""
    s = candidates.withColumn("_s", state)
    g = s.groupBy(search).agg(*[F.bool_or(F.col("_s") == x).alias(x) for x in ("active", "queued", "waiting", "blocked", "incomplete", "completed")], F.sum(results).cast("bigint").alias("results"), F.bool_and(F.coalesce(discovery_complete, F.lit(False))).alias("_all"))
    failed = F.col("blocked") & ~F.col("completed") & (F.col("results") == 0)
    status = F.when(F.col("active"), "running").when(F.col("queued"), "queued").when(F.col("waiting"), "waiting_retry").when(failed, "failed").otherwise("finished")
    partial = F.col("incomplete") | F.col("blocked") | ~F.col("_all")
    outcome = F.when(status.isin("finished", "failed"), F.when(partial | (status == "failed"), "incomplete").when(F.col("results") > 0, "results").otherwise("empty"))
    return g.select(search, status.alias("execution_status"), outcome.alias("outcome"), "results")


def follow_up_state(status: Column, auto_retry: Column, saved: Column) -> tuple[Column, Column]:
    """(execution state, public state) of a candidate's job; a null status means no job."""
    state = F.when(status.isNull(), "collection_not_scheduled").when(status == "pending", "queued").when(status == "running", "running").when((status == "error") & auto_retry, "waiting_retry").when(status == "error", "failed").otherwise("finished")
    public = F.when(status == "error", "error").when((status == "done") & (saved > 0), "saved").when(status == "done", "empty")
    return state, public


def attempt_limit(code: Column) -> Column:
    return F.when(code.isin(*TRANSIENT), MAX_ATTEMPTS).when(code == "llm_invalid_response", INVALID_ATTEMPTS).otherwise(1)


def retry_rounds(attempts: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """Round number (0-based), seconds since the first claim, and whether that is in the window."""
    w = Window.partitionBy(*keys)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.min(F.col(time).cast("timestamp")).over(w))
    out = attempts.withColumns({"round": F.row_number().over(w.orderBy(time, order)) - 1, "elapsed_us": seconds})
    return out.withColumn("in_window", F.col("elapsed_us") < WINDOW_SECONDS * 1_000_000)


def retry_verdicts(attempts: DataFrame, keys: list[str], time: str, order: str, code: str) -> DataFrame:
    """Is each failure retryable, and after how many microseconds is it due.

    The delay is 2 s after the first round and 5 s later, stretched by up to a quarter with a
    factor fixed by the attempt's key, so reruns agree.
    """
    r = retry_rounds(attempts, keys, time, order)
    limit = attempt_limit(F.col(code))
    base = F.when(F.col("round") == 0, 2_000_000).otherwise(5_000_000)
    delay = base + F.floor(base * (F.pmod(F.col(order), F.lit(100)) / 400.0)).cast("long")
    due_ok = F.col("elapsed_us") + delay < WINDOW_SECONDS * 1_000_000
    retry = (F.col("round") + 1 < MAX_ATTEMPTS) & (limit > 1) & (F.col("round") + 1 < limit) & due_ok
    return r.withColumns({"retry": retry, "due_in_us": F.when(retry, delay)})


def error_taxonomy(attempts: DataFrame, rules: DataFrame, cause: str) -> DataFrame:
    """Code, phase and retryability of every cause; unknown causes are processing failures."""
    out = attempts.join(rules, cause, "left")
    return out.withColumns({"code": F.coalesce("code", F.lit("processing_failed")), "phase": F.coalesce("phase", F.lit("processing")), "retryable": F.coalesce("retryable", F.lit(False))})
