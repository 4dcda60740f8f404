"""Streaming queries over the events table, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.plans.base import query
from lodestack.streaming import jobs as J


def events(t):
    return J.file_stream(t.spark, f"{t.dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("quota_usage_stream", """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events, m GROUP BY 1, 2, m.w HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= m.w""")
def _(t):
    out = J.run_to_table(J.quota_usage_stream(events(t), "ts", ["event_type"]), "usage")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("quota_admit_stream", """WITH RECURSIVE r AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS owner_id, date_trunc('day', ts) AS d, event_id % 3 + 1 AS amount, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT request_id, owner_id, d, rn, amount <= 4 AS ok, CASE WHEN amount <= 4 THEN amount ELSE 0 END AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.request_id, r.owner_id, r.d, r.rn, f.used + r.amount <= 4, CASE WHEN f.used + r.amount <= 4 THEN f.used + r.amount ELSE f.used END FROM f JOIN r ON r.owner_id = f.owner_id AND r.d = f.d AND r.rn = f.rn + 1)
SELECT owner_id, request_id, ok AS admitted FROM f""")
def _(t):
    e = events(t).select(F.col("user_id").cast("string").alias("owner_id"), F.col("event_id").alias("request_id"), F.unix_micros("ts").alias("ts_us"), (F.col("event_id") % 3 + 1).alias("amount"))
    return J.run_to_table(J.quota_admit_stream(e, 4, 86_400_000_000), "admitted")


@query("command_dedup_stream", "SELECT user_id, event_type, count(DISTINCT 1) AS n FROM events GROUP BY user_id, event_type")
def _(t):
    out = J.run_to_table(J.command_dedup_stream(events(t), "ts", ["user_id", "event_type"], "400 days"), "commands")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("command_conflict_stream", """WITH c AS (SELECT event_id, user_id || '/' || event_type AS command_key, event_id % 2 AS p, first_value(event_id % 2) OVER w AS f, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id AS command_id, command_key, CASE WHEN rn = 1 THEN 'accepted' WHEN p = f THEN 'replay' ELSE 'conflict' END AS outcome FROM c""")
def _(t):
    e = events(t).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("command_key"), F.col("event_id").alias("command_id"), F.unix_micros("ts").alias("ts_us"), (F.col("event_id") % 2).cast("string").alias("fingerprint"), "ts")
    return J.run_to_table(J.command_outcome_stream(e, "ts", 400 * 86_400_000), "outcomes")


@query("job_state_stream", "SELECT user_id AS job_id, max(event_id) AS version, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def _(t):
    e = events(t).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"))
    out = J.run_to_table(J.job_state_stream(e), "states")
    return out.groupBy("job_id").agg(F.max("version").alias("version"), F.max_by("status", "version").alias("status"))


@query("stalled_work_stream", """WITH RECURSIVE m AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS mark FROM events),
r AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS fin, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type <> 'error') AS rn FROM events, m WHERE epoch_us(ts) // 1000 <= mark),
f AS (SELECT user_id, rn, CASE WHEN NOT fin THEN ms END AS opened, CAST(NULL AS BIGINT) AS late FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.rn, CASE WHEN fin THEN NULL WHEN f.opened IS NULL OR r.ms > f.opened + 300000 THEN r.ms ELSE f.opened END, CASE WHEN r.ms > f.opened + 300000 THEN f.opened END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
SELECT user_id AS work_id, late AS started_ms FROM f WHERE late IS NOT NULL
UNION ALL SELECT user_id, opened FROM (SELECT user_id, arg_max(coalesce(opened, -1), rn) AS opened FROM f GROUP BY user_id), m WHERE opened >= 0 AND opened + 300000 <= mark""")
def _(t):
    e = events(t).select(F.col("user_id").alias("work_id"), F.when(F.col("event_type") == "error", "finished").otherwise("started").alias("kind"), F.unix_millis("ts").alias("ms"), "ts")
    return J.run_to_table(J.stalled_work_stream(e, "ts"), "stalled")


@query("catalog_upsert_stream", """SELECT dataset_url, coalesce(arg_max(title, seq) FILTER (WHERE title <> ''), '') AS title, arg_max(evidence_kind, seq) AS source, min(observed_at) AS first_seen FROM pv_obs GROUP BY dataset_url""", "pv_obs")
def _(t):
    class Streamed:
        pass

    s = Streamed()
    s.events = J.file_stream(t.spark, f"{t.dir}/events.parquet")
    from lodestack.plans.base import observations

    o = observations(s).withColumnRenamed("evidence_kind", "source").drop("checked_now", "probability")
    return J.catalog_upsert_stream(o).select("dataset_url", "title", "source", "first_seen")
