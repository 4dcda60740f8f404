"""Merge, outcome, quota and retry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import merge as M
from lodestack.operators import outcomes as O
from lodestack.operators import quotas as Q
from lodestack.operators import tables as T
from lodestack.plans.base import jobs, observations, query, requests


@query("upsert_datasets", """SELECT dataset_url, coalesce(arg_max(title, seq) FILTER (WHERE title <> ''), '') AS title, coalesce(arg_max(publisher, seq) FILTER (WHERE publisher <> ''), '') AS publisher,
arg_max(evidence_kind, seq) AS source, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM pv_obs GROUP BY dataset_url""", "pv_obs")
def _(t):
    o = observations(t).withColumnRenamed("evidence_kind", "source").drop("checked_now", "probability")
    cut = F.col("seq") < 500
    empty = o.limit(0).withColumns({"first_seen": F.col("observed_at"), "last_seen": F.col("observed_at")}).drop("observed_at")
    args = ("dataset_url", ["title", "publisher"], ["source"], "observed_at")
    old = M.upsert_datasets(empty, o.filter(cut), *args)
    return M.upsert_datasets(old, o.filter(~cut), *args).drop("seq")


@query("evidence_priority", """SELECT dataset_url, coalesce(arg_max(publisher, seq) FILTER (WHERE publisher <> '' AND evidence_kind = 'page'), arg_min(publisher, seq) FILTER (WHERE publisher <> ''), '') AS publisher FROM pv_obs GROUP BY dataset_url""", "pv_obs")
def _(t):
    return M.evidence_priority(observations(t), "dataset_url", "publisher", "evidence_kind", ("page", "adapter"))


@query("merge_identity", """WITH p AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 0) AS a, arg_max(CASE WHEN event_id % 4 = 1 THEN '' ELSE event_type END, event_id) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY user_id)
SELECT user_id, coalesce(nullif(b, ''), a) AS kind, 'x' AS fixed FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    e = F.col("event_id")
    blank = F.when(e % 4 == 1, "").otherwise(F.col("event_type"))
    p = t.events.groupBy("user_id").agg(F.max_by("event_type", F.when(e % 2 == 0, e)).alias("a"), F.max_by(blank, F.when(e % 2 == 1, e)).alias("b")).filter("a is not null and b is not null")
    m = M.merge_maps(F.create_map(F.lit("kind"), F.col("a"), F.lit("fixed"), F.lit("x")), F.create_map(F.lit("kind"), F.col("b")))
    return p.select("user_id", m["kind"].alias("kind"), m["fixed"].alias("fixed"))


@query("upsert_distributions", """SELECT dataset_url, publisher, arg_max(title, seq) AS title, arg_max(probability, seq) FILTER (WHERE checked_now) AS probability, max(seq) FILTER (WHERE checked_now) AS checked_seq FROM pv_obs GROUP BY dataset_url, publisher""", "pv_obs")
def _(t):
    return M.upsert_distributions(observations(t), ["dataset_url", "publisher"], ["title"], ["probability"], "checked_now")


@query("insert_new_candidates", """WITH u AS (SELECT split_part(url, '?', 1) AS url, page_id FROM pages)
SELECT url, min(page_id) FILTER (WHERE page_id % 3 = 0) AS page_id FROM u WHERE page_id % 3 = 0 GROUP BY url
UNION ALL SELECT url, min(page_id) FROM u WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM u WHERE page_id % 3 = 0) GROUP BY url""")
def _(t):
    u = t.pages.select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), "page_id")
    old = u.filter("page_id % 3 = 0").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return M.insert_new(old, u.filter("page_id % 3 <> 0"), ["url"], "page_id")


@query("upsert_traces", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(t):
    return M.upsert_traces(t.events, ["user_id", "event_type"], "event_id", ["value", "event_id"])


@query("idempotent_commands", """WITH c AS (SELECT *, request_id % 2 AS print FROM pv_requests), f AS (SELECT owner_id, operation, min(request_id) AS first_id, arg_min(print, request_id) AS p FROM c GROUP BY owner_id, operation)
SELECT request_id, CASE WHEN request_id = first_id THEN 'applied' WHEN print = p THEN 'replayed' ELSE 'conflict' END AS verdict FROM c JOIN f USING (owner_id, operation)""", "pv_requests")
def _(t):
    c = requests(t).withColumn("print", F.sha2((F.col("request_id") % 2).cast("string"), 256))
    return M.idempotent_commands(c, ["owner_id", "operation"], "print", "request_id").select("request_id", "verdict")


@query("close_stale_runs", "SELECT job_id, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status, CASE WHEN status = 'running' THEN 'processing_interrupted' END AS code FROM pv_jobs", "pv_jobs")
def _(t):
    return T.close_stale(jobs(t), "status", ("running",), "processing_interrupted").select("job_id", "status", "code")


@query("complete_discovery", "SELECT candidate_id AS search_id, count(*) AS candidates, 'published' AS state FROM pv_jobs WHERE status <> 'error' GROUP BY candidate_id", "pv_jobs")
def _(t):
    from lodestack.scratch import new_path
    from lodestack.sources.exports import read_catalog, write_catalog

    found = jobs(t).filter("status <> 'error'")
    sessions = found.select("candidate_id").distinct().withColumn("state", F.lit("published"))
    root = new_path(t.spark, "discovery")
    write_catalog({"candidates": found, "sessions": sessions}, root)
    c, s = read_catalog(t.spark, root, "candidates"), read_catalog(t.spark, root, "sessions")
    return c.groupBy("candidate_id").agg(F.count("*").alias("candidates")).join(s, "candidate_id").select(F.col("candidate_id").alias("search_id"), "candidates", "state")


@query("apply_decision", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 'queued' WHEN o_totalprice > 200000 THEN 'accepted' ELSE 'rejected' END AS status FROM orders""")
def _(t):
    c = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(2).alias("version"), F.lit("queued").alias("status"))
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 == 0, 1).otherwise(2).alias("version"), (F.col("o_totalprice") > 200000).alias("accepted"))
    return M.apply_decision(c, d, "id", "version").select("id", "status")


@query("prune", """SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O'))""")
def _(t):
    old = M.eligible_for_pruning(t.orders, "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "F", t.lineitem.filter("l_linestatus = 'O'"), "o_orderkey", "l_orderkey")
    return M.prune(t.orders, old, "o_orderkey").select("o_orderkey")


RETRY = """WITH a AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'llm_timeout' WHEN 1 THEN 'llm_invalid_response' WHEN 2 THEN 'persistence_failed' ELSE 'llm_rate_limited' END AS code,
  row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS round, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, event_type, date_trunc('day', ts)) AS elapsed FROM events)"""


@query("retry_rounds", RETRY + " SELECT event_id, CAST(round AS INTEGER) AS round, elapsed AS elapsed_us, elapsed < 120000000 AS in_window FROM a")
def _(t):
    e = t.events.withColumn("day", F.date_trunc("day", "ts"))
    return O.retry_rounds(e, ["user_id", "event_type", "day"], "ts", "event_id").select("event_id", "round", "elapsed_us", "in_window")


@query("retry_verdicts", RETRY + """, b AS (SELECT *, CASE WHEN round = 0 THEN 2000000 ELSE 5000000 END AS base, CASE WHEN code IN ('llm_timeout', 'llm_rate_limited') THEN 3 WHEN code = 'llm_invalid_response' THEN 2 ELSE 1 END AS lim FROM a),
c AS (SELECT *, base + CAST(floor(base * ((event_id % 100) / 400.0::DOUBLE)) AS BIGINT) AS delay FROM b),
d AS (SELECT *, round + 1 < 3 AND lim > 1 AND round + 1 < lim AND elapsed + delay < 120000000 AS retry FROM c)
SELECT event_id, retry, CASE WHEN retry THEN delay END AS due_in_us FROM d""")
def _(t):
    e = t.events.withColumns({"day": F.date_trunc("day", "ts"), "code": F.element_at(F.array(*map(F.lit, ("llm_timeout", "llm_invalid_response", "persistence_failed", "llm_rate_limited"))), (F.col("event_id") % 4 + 1).cast("int"))})
    return O.retry_verdicts(e, ["user_id", "event_type", "day"], "ts", "event_id", "code").select("event_id", "retry", "due_in_us")


@query("charge_once", "SELECT DISTINCT owner_id, operation FROM pv_requests WHERE (owner_id, operation) NOT IN (SELECT owner_id, operation FROM pv_requests WHERE request_id < 50)", "pv_requests")
def _(t):
    r = requests(t)
    return M.charge_once(r, ["owner_id", "operation"], r.filter("request_id < 50"))


@query("attempt_audit", r"""SELECT event_id, CASE WHEN value = lag(value) OVER w THEN 'repeat' WHEN event_id % 6 = 0 OR user_id NOT IN (SELECT c_custkey FROM customer) THEN 'stale' ELSE 'valid' END AS verdict FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def _(t):
    from lodestack.operators.reports import attempt_audit

    token = F.when(F.col("event_id") % 6 == 0, F.lit("old")).otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string")))
    runs = t.customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"))
    rows = t.events.withColumn("token", token)
    return attempt_audit(rows, runs, "user_id", "event_type", ["ts", "event_id"], "token", ["value"]).select("event_id", "verdict")


# outcomes


@query("search_outcome", """WITH c AS (SELECT o_custkey AS search_id, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '2-HIGH' THEN 'rejected' WHEN '3-MEDIUM' THEN 'error' ELSE 'accepted' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS js, o_orderkey % 2 AS saved, o_orderkey % 11 <> 0 AS complete FROM orders),
s AS (SELECT *, CASE WHEN status = 'error' THEN 'blocked' WHEN status = 'rejected' THEN 'completed' WHEN js = 'running' THEN 'active' WHEN js = 'failed' THEN 'blocked' ELSE 'completed' END AS st FROM c),
g AS (SELECT search_id, bool_or(st = 'active') AS a, bool_or(st = 'blocked') AS b, bool_or(st = 'completed') AS d, CAST(sum(saved) AS BIGINT) AS results, bool_and(complete) AS ok FROM s GROUP BY search_id),
x AS (SELECT *, CASE WHEN a THEN 'running' WHEN b AND NOT d AND results = 0 THEN 'failed' ELSE 'finished' END AS es FROM g)
SELECT search_id, es AS execution_status, CASE WHEN es = 'running' THEN NULL WHEN b OR NOT ok OR es = 'failed' THEN 'incomplete' WHEN results > 0 THEN 'results' ELSE 'empty' END AS outcome, results FROM x""")
def _(t):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    status = F.when(p == "2-HIGH", "rejected").when(p == "3-MEDIUM", "error").otherwise("accepted")
    job = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    state = O.candidate_flags(status, F.lit(False), job, F.lit("results"))
    return O.search_outcome(t.orders.withColumnRenamed("o_custkey", "search_id"), "search_id", state, k % 2, k % 11 != 0)


@query("follow_up_state", """SELECT c_custkey AS candidate_id, CASE WHEN status IS NULL THEN 'collection_not_scheduled' WHEN status = 'running' THEN 'running' WHEN status = 'error' AND c_custkey % 2 = 0 THEN 'waiting_retry' WHEN status = 'error' THEN 'failed' ELSE 'finished' END AS state,
CASE WHEN status = 'error' THEN 'error' WHEN status = 'done' AND c_custkey % 3 > 0 THEN 'saved' WHEN status = 'done' THEN 'empty' END AS public_state
FROM customer LEFT JOIN (SELECT candidate_id, arg_max(status, job_id) AS status FROM pv_jobs GROUP BY candidate_id) j ON candidate_id = c_custkey""", "pv_jobs")
def _(t):
    latest = T.latest_per(jobs(t), ["candidate_id"], ["job_id"])
    c = t.customer.join(latest, F.col("candidate_id") == F.col("c_custkey"), "left")
    state, public = O.follow_up_state(F.col("status"), F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3)
    return c.select(F.col("c_custkey").alias("candidate_id"), state.alias("state"), public.alias("public_state"))


@query("error_taxonomy", """SELECT event_id, CASE event_type WHEN 'error' THEN 'repository_timeout' WHEN 'click' THEN 'repository_http_error' ELSE 'processing_failed' END AS code,
CASE event_type WHEN 'error' THEN 'read' WHEN 'click' THEN 'request' ELSE 'processing' END AS phase, event_type = 'error' AS retryable FROM events""")
def _(t):
    rules = t.spark.createDataFrame([("error", "repository_timeout", "read", True), ("click", "repository_http_error", "request", False)], "event_type string, code string, phase string, retryable boolean")
    return O.error_taxonomy(t.events, rules, "event_type").select("event_id", "code", "phase", "retryable")


# quotas


@query("quota_replay", """WITH r AS (SELECT request_id, row_number() OVER (PARTITION BY owner_id, operation, date_trunc('day', ts) ORDER BY ts, request_id) AS rn, ts FROM pv_requests)
SELECT request_id, rn <= 1 AS admitted, CASE WHEN rn > 1 THEN greatest(1, CAST(ceil((epoch_us(date_trunc('day', ts)) + 86400000000 - epoch_us(ts)) / 1000000.0) AS BIGINT)) END AS retry_after FROM r""", "pv_requests")
def _(t):
    return Q.quota_replay_units(requests(t), ["owner_id", "operation"], "ts", "request_id", 1, "day").select("request_id", "admitted", "retry_after")


@query("quota_replay_amounts", """WITH RECURSIVE r AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS owner_id, date_trunc('day', ts) AS d, CAST(event_id % 3 + 1 AS INT) AS amount, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT request_id, owner_id, d, rn, amount <= 4 AS ok, CASE WHEN amount <= 4 THEN amount ELSE 0 END AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.request_id, r.owner_id, r.d, r.rn, f.used + r.amount <= 4, CASE WHEN f.used + r.amount <= 4 THEN f.used + r.amount ELSE f.used END FROM f JOIN r ON r.owner_id = f.owner_id AND r.d = f.d AND r.rn = f.rn + 1)
SELECT request_id, ok AS admitted FROM f""")
def _(t):
    return Q.quota_replay(requests(t), ["owner_id"], "ts", "request_id", "amount", 4, "day").select("request_id", "admitted")


@query("quota_replay_all", """WITH r AS (SELECT request_id, owner_id, CAST(owner_id AS BIGINT) % 7 AS client, date_trunc('day', ts) AS d, ts FROM pv_requests),
a AS (SELECT *, row_number() OVER (PARTITION BY client, d, owner_id ORDER BY ts, request_id) <= 2 AS fits FROM r),
b AS (SELECT *, fits AND sum(CAST(fits AS INT)) OVER (PARTITION BY client, d ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) <= 20 AS charged FROM a)
SELECT request_id, charged AND sum(CAST(charged AS INT)) OVER (PARTITION BY d ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) <= 100 AS admitted FROM b""", "pv_requests")
def _(t):
    r = requests(t).withColumn("client", (F.col("owner_id").cast("int") % 7).cast("string"))
    return Q.quota_replay_all(r, "client", "owner_id", "ts", "request_id", 2, 20, 100)


@query("capacity_replay", "SELECT request_id, 10 + row_number() OVER (PARTITION BY operation ORDER BY ts, request_id) <= 100 AS admitted FROM pv_requests", "pv_requests")
def _(t):
    return Q.capacity_replay(requests(t), "operation", "ts", "request_id", 100, 10).select("request_id", "admitted")


@query("client_networks", r"""SELECT sha256('key' || CASE WHEN user_id % 2 = 0 THEN '10.0.' || user_id % 7 || '.' || user_id % 3 ELSE '2001:0db8:000' || user_id % 5 || ':0001::/64' END) AS network, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    u = F.col("user_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda k: (u % k).cast("string")
    four = text("10.0.", n(7), ".", n(3))
    ip = F.when(u % 4 == 0, four).when(u % 4 == 1, text("2001:db8:", n(5), ":1:", u.cast("string"), "::1")).when(u % 4 == 2, text("::ffff:", four)).otherwise(text("2001:0DB8:", n(5), ":0001::9"))
    return t.events.groupBy(Q.client_network(ip, "key").alias("network")).agg(F.count("*").alias("n"))


@query("next_allowed", r"""SELECT event_type AS provider, max(greatest(CASE event_id % 5 WHEN 0 THEN ts + to_seconds(event_id % 100) WHEN 1 THEN TIMESTAMP '2024-01-10 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-10 06:00:00' WHEN 3 THEN TIMESTAMP '2024-01-10 12:00:00' END, ts)) FILTER (WHERE event_id % 5 < 4) AS next_allowed FROM events GROUP BY event_type""")
def _(t):
    e = F.col("event_id")
    dates = {1: "Wed, 10 Jan 2024 00:00:00 GMT", 2: "Wednesday, 10-Jan-24 06:00:00 GMT", 3: "Wed Jan 10 12:00:00 2024"}
    header = F.when(e % 5 == 0, (e % 100).cast("string")).otherwise("soon")
    for k, d in dates.items():
        header = F.when(e % 5 == k, d).otherwise(header)
    r = t.events.select(F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("received"), header.alias("header"))
    return Q.next_allowed(r, "provider", "received", "header").withColumn("next_allowed", F.col("next_allowed").cast("timestamp_ntz"))
