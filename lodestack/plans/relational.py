"""Joins, windows, paging, sets and the simpler aggregates over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import records as R
from lodestack.operators import reports as P
from lodestack.operators import tables as T
from lodestack.plans.base import halves, jobs, observations, query

W = Window


@query("candidates_with_query", "SELECT o_orderkey AS candidate_id, c_name AS query, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("candidate_id"), F.col("c_name").alias("query"), F.col("o_orderstatus").alias("status"))


@query("datasets_with_children", """SELECT o_orderkey AS dataset_id, CAST(count(l_orderkey) AS INTEGER) AS n_children,
coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_discount DESC, l_partkey, l_linenumber, l_suppkey), '') AS children
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _(t):
    order = F.struct(-F.col("l_discount"), "l_partkey", "l_linenumber", "l_suppkey")
    out = T.with_children(t.orders.select(F.col("o_orderkey").alias("dataset_id")), t.lineitem.withColumnRenamed("l_orderkey", "dataset_id"), "dataset_id", order, ["l_partkey"])
    return out.select("dataset_id", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: c["l_partkey"].cast("string")), ",").alias("children"))


@query("catalog_by_ids", """SELECT p_partkey AS id, p_name AS title, CAST(count(l_orderkey) AS INTEGER) AS n_children, coalesce(min(l_orderkey), 0) AS first_child FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
WHERE p_partkey IN (SELECT DISTINCT n_nationkey * 7 FROM nation) AND p_partkey > 0 GROUP BY p_partkey, p_name""")
def _(t):
    ids = t.nation.select((F.col("n_nationkey") * 7).cast("bigint").alias("id"))
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    lines = t.lineitem.select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber")
    out = R.catalog_by_ids(parts, ids, "id", lines, F.struct("l_orderkey", "l_linenumber"), ["l_orderkey"])
    first = F.coalesce(F.try_element_at(F.col("children"), F.lit(1))["l_orderkey"], F.lit(0))
    return out.select("id", "title", F.size("children").alias("n_children"), first.alias("first_child"))


@query("latest_job_per_candidate", "SELECT candidate_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY job_id DESC) AS rn FROM pv_jobs) WHERE rn = 1", "pv_jobs")
def _(t):
    return T.latest_per(jobs(t), ["candidate_id"], ["job_id"]).select("candidate_id", "job_id", "status")


@query("existing_results", """WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
SELECT c_custkey AS candidate_id, s_suppkey AS dataset_id FROM c JOIN supplier ON s_nationkey = c_nationkey
UNION SELECT c_custkey, s_suppkey FROM c JOIN supplier ON s_suppkey = c_custkey""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("url"), F.col("c_custkey").alias("source_url"))
    d = t.supplier.select(F.col("s_nationkey").alias("url"), F.col("s_suppkey").alias("dataset_id"))
    return R.existing_results(c, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("candidate_id")), d, t.supplier.select(F.col("s_suppkey").alias("source_url"), F.col("s_suppkey").alias("dataset_id")))


@query("observations_with_url", "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS dataset_url, l_shipdate AS observed_at FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t):
    out = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_name").alias("dataset_url"), F.col("l_shipdate").alias("observed_at")).orderBy(F.desc("observed_at"), "l_orderkey", "l_linenumber")


@query("latest_search_with_candidates", """SELECT c_nationkey AS owner_id, max(c_custkey) AS search_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey""")
def _(t):
    live = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return T.latest_per(live.select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"]).select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("search_id"))


@query("orphan_validations", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def _(t):
    return t.lineitem.join(t.part.filter("p_size > 10"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("duplicate_validations", """SELECT regexp_extract(url, '^[^/]*//[^/]*') AS url, CASE WHEN length(html) > 5000 THEN 'LONG' ELSE 'SHORT' END AS format, count(*) AS n FROM pages GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    rows = t.pages.select(F.substring_index("url", "/", 3).alias("url"), F.when(F.length("html") > 5000, "LONG").otherwise("SHORT").alias("format"))
    return P.duplicate_rows(rows, ["url", "format"])


@query("plan_collection", """WITH c AS (SELECT o_orderkey AS candidate_id, o_custkey AS url FROM orders WHERE o_orderstatus = 'F'),
d AS (SELECT c_custkey AS url, c_custkey + 1000000 AS dataset_id FROM customer WHERE c_custkey % 5 = 0),
a AS (SELECT o_custkey AS url, max(o_orderkey) AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 0 GROUP BY o_custkey),
j AS (SELECT c.*, dataset_id, job_id FROM c LEFT JOIN d USING (url) LEFT JOIN a USING (url)),
f AS (SELECT url, min(candidate_id) AS opener FROM j WHERE dataset_id IS NULL AND job_id IS NULL GROUP BY url)
SELECT candidate_id, url, CASE WHEN dataset_id IS NOT NULL THEN 'already_collected' WHEN job_id IS NOT NULL THEN 'join_active' WHEN candidate_id = opener THEN 'new_job' ELSE 'share_new_job' END AS action,
coalesce(dataset_id, job_id, opener) AS target FROM j LEFT JOIN f USING (url)""")
def _(t):
    c = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("url"))
    d = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("url"), (F.col("c_custkey") + 1000000).alias("dataset_id"))
    a = t.orders.filter("o_orderstatus = 'O' and o_custkey % 3 = 0").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("job_id"))
    return T.plan_collection(c, d, a)


@query("compare_snapshots", """WITH b AS (SELECT * FROM pv_halves WHERE side = 'before'), a AS (SELECT * FROM pv_halves WHERE side = 'after')
SELECT coalesce(a.user_id, b.user_id) AS user_id, b.n AS n_before, a.n AS n_after,
CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' WHEN a.n = b.n AND a.last_event = b.last_event THEN 'same' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN a ON a.user_id = b.user_id""", "pv_halves")
def _(t):
    h = halves(t)
    out = T.compare_snapshots(h.filter("side = 'before'").drop("side"), h.filter("side = 'after'").drop("side"), "user_id")
    return out.select("user_id", F.col("before.n").alias("n_before"), F.col("after.n").alias("n_after"), "change")


@query("candidate_counts", "SELECT c_custkey AS search_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def _(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("search_id"), F.coalesce("n", F.lit(0)).alias("n"))


@query("enrich_from_repository", """WITH r AS (SELECT dataset_url, publisher, min(seq) AS first_seq FROM pv_obs WHERE publisher <> '' AND evidence_kind = 'repository' GROUP BY dataset_url, publisher),
f AS (SELECT dataset_url, arg_min(publisher, first_seq) AS found, string_agg(publisher, ',' ORDER BY first_seq) AS evidence FROM r GROUP BY dataset_url),
p AS (SELECT dataset_url, arg_max(CASE WHEN seq % 2 = 0 THEN '' ELSE publisher END, seq) AS publisher FROM pv_obs WHERE evidence_kind = 'page' GROUP BY dataset_url)
SELECT p.dataset_url, coalesce(nullif(p.publisher, ''), f.found, '') AS publisher, coalesce(f.evidence, '') AS evidence FROM p LEFT JOIN f ON f.dataset_url = p.dataset_url""", "pv_obs")
def _(t):
    o = observations(t)
    blank = F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("publisher"))
    pages = o.filter("evidence_kind = 'page'").groupBy("dataset_url").agg(F.max_by(blank, F.col("seq")).alias("publisher"))
    found = o.filter("evidence_kind = 'repository'").select("dataset_url", "publisher", "seq")
    out = R.enrich_from_repository(pages, found, "dataset_url", ["publisher"], "seq")
    values = F.flatten(F.transform("evidence", lambda e: e["values"]))
    return out.select("dataset_url", "publisher", F.array_join(values, ",").alias("evidence"))


@query("retry_lineage", """WITH j AS (SELECT *, lag(status) OVER (PARTITION BY candidate_id ORDER BY job_id) AS prev FROM pv_jobs),
r AS (SELECT *, sum(CASE WHEN prev = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY candidate_id ORDER BY job_id) AS g FROM j)
SELECT job_id, candidate_id, min(job_id) OVER (PARTITION BY candidate_id, g) AS root_id FROM r""", "pv_jobs")
def _(t):
    return P.retry_lineage(jobs(t), "candidate_id", "job_id", "status").select("job_id", "candidate_id", "root_id")


@query("doc_access_rights", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))""")
def _(t):
    owned = t.customer.join(t.nation.filter("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return t.orders.join(owned, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey")


@query("owned_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("retry_eligibility", """SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_custkey % 2 = 1)) AND o_orderdate <= TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderstatus") == "F", "partial").otherwise("done")
    due = F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz")
    published = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.retry_eligibility(t.orders, published, "o_orderkey", status, F.col("o_custkey") % 2 == 0, due).select("o_orderkey")


@query("scope_resources", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey = 1""")
def _(t):
    known = t.part.filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return R.scope_resources(t.lineitem, known, "l_partkey", F.col("l_suppkey") == 1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("merge_record_metadata", """SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), s_name, '') AS title, concat_ws(' ', p_type, s_name) AS text
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 100""")
def _(t):
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("text"))
    records = p.select("p_partkey", (F.col("p_partkey") % 100).alias("s_suppkey")).join(t.supplier, "s_suppkey").select("p_partkey", F.col("s_name").alias("title"), F.col("s_name").alias("text"))
    return R.merge_record_metadata(p, records, "p_partkey", ["title"], ["text"])


# windows


@query("bounded_checks", "SELECT l_orderkey, l_partkey, l_suppkey, rank, total FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem) WHERE rank <= 3")
def _(t):
    return T.bounded_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_partkey", "l_suppkey", "rank", "total")


@query("previous_attempt", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events")
def _(t):
    return t.events.select("event_id", F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous_id"))


@query("result_positions", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS INTEGER) AS position FROM orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")) - 1).alias("position"))


@query("dedupe_then_cap", """WITH d AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY user_id) > 3 AS limited FROM d)
SELECT user_id, event_type, event_id, value, place, limited FROM r WHERE place <= 3""")
def _(t):
    return T.dedupe_then_cap(t.events, "user_id", ["event_type"], "event_id", ["value"], 3)


@query("select_resources", """WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag = 'N' AS ok, row_number() OVER w AS "check",
  coalesce(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_partkey, l_suppkey, CAST("check" AS INTEGER) AS "check", ok AS kept, n > 3 AS limited FROM r WHERE "check" <= 3 AND before_n < 1""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", (F.col("l_returnflag") == "N").alias("ok"))
    return T.select_resources(rows, "l_orderkey", [F.desc("l_discount"), "l_linenumber", "l_partkey", "l_suppkey"], "ok").select("l_orderkey", "l_partkey", "l_suppkey", "check", "kept", "limited")


@query("method_fallback", """WITH s AS (SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS stop FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN s USING (l_orderkey) WHERE stop IS NULL OR l_linenumber <= stop""")
def _(t):
    return T.method_fallback(t.lineitem.withColumn("ends", F.col("l_returnflag") == "A"), "l_orderkey", "l_linenumber", "ends").select("l_orderkey", "l_linenumber", "l_partkey")


@query("cycle_attempts", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type, event_id % 4 ORDER BY ts, event_id) AS INTEGER) AS attempt, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS overall FROM events")
def _(t):
    e = t.events.withColumn("cycle", F.col("event_id") % 4)
    one, every = W.partitionBy("user_id", "event_type", "cycle").orderBy("ts", "event_id"), W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select("event_id", F.row_number().over(one).alias("attempt"), F.row_number().over(every).alias("overall"))


@query("due_backlog", """SELECT o_orderstatus AS queue, o_orderkey AS job_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_custkey % 2 = 1 OR o_orderdate <= TIMESTAMP '1999-06-01') WHERE rn <= 20""")
def _(t):
    retry = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate"))
    rows = t.orders.select(F.col("o_orderstatus").alias("queue"), F.col("o_orderkey").alias("job_id"), "o_orderdate", retry.alias("next_retry"))
    return P.due_backlog(rows, "queue", "next_retry", ["o_orderdate", "job_id"], F.lit("1999-06-01").cast("timestamp_ntz"), 20).select("queue", "job_id", "place")


# order, limit, paging


@query("read_after", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def _(t):
    cursor = (F.lit("1998-01-01").cast("timestamp_ntz"), 500)
    return T.read_after(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", cursor, 50)


@query("numbered_pages", """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, CAST(i // 20 AS INTEGER) AS page, CAST(i % 20 AS INTEGER) AS pos, (i // 20 + 1) * 20 < n AS has_more FROM r""")
def _(t):
    return T.numbered_pages(t.events.select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), "event_id"], 20).drop("ts")


@query("vote_history_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END DESC NULLS LAST, event_type DESC, event_id DESC) AS INTEGER) AS place FROM events")
def _(t):
    at = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    w = W.partitionBy("user_id").orderBy(at.desc_nulls_last(), F.desc("event_type"), F.desc("event_id"))
    return t.events.select("event_id", F.row_number().over(w).alias("place"))


@query("evidence_snapshots", """SELECT conv_id, turn, sha256(CAST(json_object('conv_id', conv_id, 'role', role, 'text', text, 'turn', turn) AS VARCHAR)) AS checksum FROM conversations""")
def _(t):
    from lodestack.scratch import new_path
    from lodestack.sources import snapshots as S

    fields, path = ["conv_id", "turn", "role", "text"], new_path(t.spark, "snapshots")
    S.append_snapshots(t.conversations.filter("turn % 2 = 0"), fields, path)
    S.append_snapshots(t.conversations.filter("turn % 2 = 1"), fields, path)
    sound, damaged = S.read_snapshots(t.spark, path, fields)
    return sound.select("conv_id", "turn", F.col("sha256").alias("checksum")).unionByName(damaged.select("conv_id", "turn", F.lit("damaged").alias("checksum")))


@query("newest_snapshots", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS rn FROM conversations WHERE conv_id % 9 <> 0) WHERE rn <= 200")
def _(t):
    from lodestack.scratch import new_path
    from lodestack.sources import snapshots as S

    fields, path = ["conv_id", "turn", "role", "text"], new_path(t.spark, "snapshots")
    S.append_snapshots(t.conversations.filter("conv_id % 9 <> 0"), fields, path)
    # rows that were changed after capture keep a checksum that no longer fits
    changed = t.conversations.filter("conv_id % 9 = 0").withColumn("sha256", T.evidence_checksum(fields)).withColumn("text", F.lit("changed"))
    changed.write.mode("append").parquet(path)
    sound, _ = S.read_snapshots(t.spark, path, fields)
    return S.newest_snapshots(sound, "role", ["conv_id", "turn"], 200).select("conv_id", "turn")


# sets


@query("union_ids", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("id")).union(t.supplier.select("s_nationkey")).distinct()


@query("backlog_union", "SELECT 'orders' AS queue, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
def _(t):
    a = t.orders.filter("o_orderstatus = 'O'").select(F.lit("orders").alias("queue"), F.col("o_orderkey").alias("id"))
    return a.unionByName(t.lineitem.filter("l_linestatus = 'O'").select(F.lit("lineitem").alias("queue"), F.col("l_orderkey").alias("id")))


@query("key_universe", "SELECT user_id FROM pv_halves WHERE side = 'before' AND n > 2 UNION SELECT user_id FROM pv_halves WHERE side = 'after'", "pv_halves")
def _(t):
    h = halves(t)
    return h.filter("side = 'before' and n > 2").select("user_id").union(h.filter("side = 'after'").select("user_id")).distinct().orderBy("user_id")


@query("orphan_keys", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id")).subtract(t.lineitem.filter("l_quantity > 40").select("l_partkey"))


@query("combine_providers", """WITH p AS (SELECT source AS provider, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS r, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT provider, CASE WHEN right(provider, 1) = '3' THEN -1 ELSE r END AS provider_rank, CASE WHEN right(provider, 1) = '3' THEN 0 ELSE n END AS n, CASE WHEN right(provider, 1) = '3' THEN 'incomplete' ELSE '' END AS warning FROM p""")
def _(t):
    rows_of = t.documents.filter("source is not null").select("doc_id", F.col("source").alias("provider"))
    names = rows_of.select("provider").distinct()
    ranks = names.withColumn("provider_rank", F.row_number().over(Window.orderBy("provider")) - 1)  # one row a provider
    rows, warnings = T.combine_providers(rows_of, ranks, names.withColumn("ok", F.substring("provider", -1, 1) != "3"))
    shown = rows.groupBy("provider", "provider_rank").agg(F.count("*").alias("n")).withColumn("warning", F.lit(""))
    return shown.unionByName(warnings.select("provider", F.lit(-1).alias("provider_rank"), F.lit(0).cast("bigint").alias("n"), F.col("code").alias("warning")))


@query("shared_sources", "SELECT lang AS label FROM documents INTERSECT SELECT CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END FROM labels")
def _(t):
    return t.documents.select(F.col("lang").alias("label")).intersect(t.labels.select(F.when(F.col("quality") == 1, "en").otherwise("fr")))


# aggregates


@query("collection_outcome", """SELECT l_orderkey AS job_id, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'incomplete' WHEN count(*) FILTER (WHERE l_returnflag = 'N') > 0 THEN 'results' ELSE 'empty' END AS outcome FROM lineitem GROUP BY l_orderkey""")
def _(t):
    from lodestack.operators.outcomes import collection_outcome

    return t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.count_if(F.col("l_returnflag") == "N").alias("saved")).select("job_id", collection_outcome(F.col("errors"), F.lit(True), F.col("saved")).alias("outcome"))


@query("collection_counters", """SELECT l_orderkey AS job_id, count(*) AS discovered, count(*) FILTER (WHERE l_quantity > 5) AS analyzed, count(*) FILTER (WHERE l_returnflag = 'N') AS accepted, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) FILTER (WHERE l_discount = 0) AS invalid FROM lineitem GROUP BY l_orderkey""")
def _(t):
    c = F.count_if
    return t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("discovered"), c(F.col("l_quantity") > 5).alias("analyzed"), c(F.col("l_returnflag") == "N").alias("accepted"), c(F.col("l_returnflag") == "R").alias("rejected"), c(F.col("l_discount") == 0).alias("invalid"))


@query("dedupe_diagnostics", "SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def _(t):
    return T.first_position_last_content(t.events, ["user_id", "event_type"], "event_id", ["value"])


@query("group_attempts", """SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown:' || o_orderkey ELSE 'claim:' || o_orderkey % 3 END AS claim, count(*) AS checks_recorded, count(*) FILTER (WHERE o_orderstatus = 'F') AS available_checks,
sha256(o_custkey || '/' || CASE WHEN o_orderkey % 5 = 0 THEN 'unknown:' || o_orderkey ELSE 'claim:' || o_orderkey % 3 END) AS case_id FROM orders GROUP BY 1, 2, 5""")
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("job_id"), F.when(k % 5 != 0, (k % 3).cast("string")).alias("claim"), k.alias("attempt"), "o_orderstatus")
    return P.group_attempts(rows, "job_id", "claim", "attempt", F.col("o_orderstatus") == "F")


@query("queue_backlog", "SELECT o_orderstatus AS queue, count(*) AS queued, min(o_orderdate) AS oldest FROM orders GROUP BY o_orderstatus")
def _(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("queue")).agg(F.count("*").alias("queued"), F.min("o_orderdate").alias("oldest"))


@query("merge_provenance", "SELECT dataset_url, string_agg(v, ',' ORDER BY v) AS evidence FROM (SELECT DISTINCT dataset_url, evidence_kind || ':' || publisher AS v FROM pv_obs WHERE publisher <> '') GROUP BY dataset_url", "pv_obs")
def _(t):
    o = observations(t).filter("publisher <> ''")
    out = P.merge_provenance(o, "dataset_url", ["evidence_kind", "publisher"])
    return out.select("dataset_url", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["evidence_kind"], e["publisher"])), ",").alias("evidence"))


@query("active_workload", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS candidates, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS jobs")
def _(t):
    a = t.orders.filter("o_orderstatus in ('O', 'P')").agg(F.count("*").alias("candidates"))
    return a.crossJoin(t.lineitem.filter("l_linestatus = 'O'").agg(F.count("*").alias("jobs")))  # two one-row frames


@query("datasets_per_job", "SELECT l_orderkey AS job_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS dataset_ids FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def _(t):
    ids = F.array_sort(F.collect_set("l_partkey"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("dataset_ids"))


@query("operation_stats", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_duration, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (WHERE value > 50) AS slow,
count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error')) AS unmatched FROM events e GROUP BY event_type""")
def _(t):
    out = P.operation_stats(t.events, "event_type", "value", 50, t.events.filter("event_type = 'error'"), "user_id")
    return out.withColumns({"mean_duration": F.round("mean_duration", 6), "p95": F.round("p95", 6)})


@query("retention_report", """SELECT 'orders' AS "table", count(*) AS eligible FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'""")
def _(t):
    old = F.lit("1997-01-01").cast("timestamp_ntz")
    from lodestack.operators.merge import eligible_for_pruning

    o = eligible_for_pruning(t.orders, "o_orderdate", old, F.col("o_orderstatus") == "F", t.lineitem.filter("l_linestatus = 'O'"), "o_orderkey", "l_orderkey")
    return o.agg(F.lit("orders").alias("table"), F.count("*").alias("eligible")).unionByName(t.lineitem.filter(F.col("l_shipdate") < old).agg(F.lit("lineitem").alias("table"), F.count("*").alias("eligible")))


@query("discovery_completeness", "SELECT user_id, NOT bool_or(event_type = 'error') AS complete FROM events GROUP BY user_id")
def _(t):
    return P.discovery_completeness(t.events, "user_id", F.col("event_type") == "error")


@query("local_result_union", """WITH r AS (SELECT o_custkey AS search_id, o_orderkey AS id, 0 AS src FROM orders UNION ALL SELECT o_custkey, l_partkey, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT search_id, id, min(src) AS src FROM r GROUP BY search_id, id)
SELECT search_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY src, id) AS ids FROM f GROUP BY search_id""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("id"))
    found = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("search_id"), F.col("l_partkey").alias("id"))
    return P.local_result_union([o, found], "search_id", "id").select("search_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("error_codes_per_candidate", "SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS codes FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def _(t):
    return P.ordered_codes(t.events, "user_id", "event_type", "event_id").select("user_id", F.array_join("codes", ",").alias("codes"))


@query("assemble_listing", """WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS pages, count(DISTINCT CASE WHEN l_linenumber = 2 AND l_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS totals,
  max(CASE WHEN l_linenumber = 2 AND l_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS more, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS files FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_orderkey AS record, coalesce(n, 0) AS items, CASE WHEN n <> pages THEN 'repeated_page' WHEN totals > 1 THEN 'changed_total' WHEN coalesce(more, 0) = 1 OR o_orderkey % 5 = 0 THEN 'wrong_total' ELSE 'ok' END AS verdict, files FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT record, items, verdict, CASE WHEN verdict = 'ok' THEN coalesce(files, '') ELSE '' END AS files FROM v""")
def _(t):
    declared = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t.orders.join(declared, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("record"), (F.coalesce("n", F.lit(0)) + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("declared"))
    size = F.count("*").over(W.partitionBy("l_orderkey"))
    pages = t.lineitem.select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("page"), (size + F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 7 == 0), 1).otherwise(0)).alias("total"), F.array("l_partkey").alias("items"))
    out = R.assemble_listing(o, pages, "record", "declared", "page", "total", "items")
    return out.select("record", F.col("items").cast("bigint").alias("items"), "verdict", F.coalesce(F.array_join(F.transform("files", lambda x: x.cast("string")), ","), F.lit("")).alias("files"))


@query("audit_contracts", """SELECT o_orderkey AS id, 'price_range' AS rule FROM orders WHERE o_totalprice < 0 OR o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'status_enum' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_custkey, 'unique' FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT o_orderkey, 'foreign' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    o = t.orders.withColumnRenamed("o_orderkey", "id")
    rules = T.audit_rules(o, "id", {"price_range": (F.col("o_totalprice") < 0) | (F.col("o_totalprice") > 400000), "status_enum": ~F.col("o_orderstatus").isin("F", "O")})
    unique = T.audit_unique(t.orders.select(F.col("o_custkey").alias("id")), "id")
    return rules.unionByName(unique).unionByName(T.audit_foreign(o, "id", "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey"))


@query("export_report", """SELECT j.candidate_id AS search_id, count(*) AS n_jobs, count(*) FILTER (WHERE status = 'done') AS done, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS jobs FROM pv_jobs j GROUP BY 1""", "pv_jobs")
def _(t):
    from lodestack.sources.exports import report_documents

    docs = report_documents(jobs(t), "candidate_id")
    return docs.select(F.col("candidate_id").alias("search_id"), "summary.n_jobs", "summary.done", F.array_join(F.transform("jobs", lambda j: j["job_id"].cast("string")), ",").alias("jobs"))


@query("scope_to_candidate", "SELECT candidate_id, count(*) FILTER (WHERE job_id % 2 = 0) AS n FROM pv_jobs GROUP BY candidate_id", "pv_jobs")
def _(t):
    from lodestack.sources.exports import report_documents

    return report_documents(jobs(t), "candidate_id").select("candidate_id", F.size(F.filter("jobs", lambda j: j["job_id"] % 2 == 0)).cast("bigint").alias("n"))


@query("scan_events_log", "SELECT event_type AS event, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def _(t):
    from lodestack.sources.logs import parse_event_log

    lines = t.events.select(F.to_json(F.struct(F.col("event_type").alias("event"), F.get_json_object("props", "$.k").cast("long").alias("retry_count"))).alias("value"))
    return parse_event_log(lines).groupBy("event").agg(F.count("*").alias("n"), F.sum("retry_count").alias("total"))
