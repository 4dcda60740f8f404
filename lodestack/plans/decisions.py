"""Vote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import votes as V
from lodestack.plans.base import query, votes

GOOD = "status = 'succeeded'"
YES = "status = 'succeeded' AND label IN ('relevant', 'somewhat_relevant')"
DECIDED = f"""
d AS (SELECT item_id, count(*) FILTER (WHERE {GOOD}) AS successes, count(*) FILTER (WHERE {YES}) AS accepts,
  coalesce(string_agg(voter_id, ',' ORDER BY voter_order) FILTER (WHERE {YES}), '') AS yv,
  coalesce(string_agg(voter_id, ',' ORDER BY voter_order) FILTER (WHERE {GOOD} AND label NOT IN ('relevant', 'somewhat_relevant')), '') AS nv,
  coalesce(string_agg(voter_id, ',' ORDER BY voter_order) FILTER (WHERE status <> 'succeeded'), '') AS fv
  FROM pv_votes GROUP BY item_id)"""
ENSEMBLE = f"""WITH {DECIDED}
SELECT item_id, CASE WHEN successes < 3 THEN 'incomplete' WHEN accepts >= 2 THEN 'accepted' ELSE 'rejected' END AS decision,
  CASE WHEN successes < 3 THEN 'classification_incomplete' WHEN accepts >= 2 THEN 'enough_accept_votes' WHEN successes - accepts >= 2 THEN 'rejected_by_majority' ELSE 'insufficient_accept_votes' END AS decision_reason,
  successes, accepts, successes - accepts AS rejects,
  CASE WHEN successes < 3 THEN '' WHEN accepts >= 2 THEN yv ELSE nv END AS supporting, fv AS failed_voters FROM d"""
SUPPORT = f"""
t AS (SELECT item_id, count(*) FILTER (WHERE {GOOD}) AS s, count(*) FILTER (WHERE {YES}) AS y FROM pv_votes GROUP BY item_id),
sup AS (SELECT v.* FROM pv_votes v JOIN t USING (item_id) WHERE s >= 3 AND {GOOD} AND ((label IN ('relevant', 'somewhat_relevant')) = (y >= 2))),
lc AS (SELECT item_id, label, count(*) AS n FROM sup GROUP BY item_id, label),
won AS (SELECT item_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC,
  CASE label WHEN 'not_relevant' THEN 1 WHEN 'insufficient_information' THEN 2 WHEN 'somewhat_relevant' THEN 3 ELSE 4 END) AS rn FROM lc) WHERE rn = 1)"""


@query("vote_ensemble", ENSEMBLE, "pv_votes")
def _(t):
    return V.vote_ensemble(votes(t))


@query("vote_ensemble_expr", f"""SELECT source, count(*) FILTER (WHERE status = 'succeeded') AS successes, count(*) FILTER (WHERE {YES}) AS accepts
FROM pv_votes JOIN documents ON doc_id = item_id GROUP BY source""", "pv_votes")
def _(t):
    e = V.ensemble_expr()
    v = votes(t).join(t.documents.select(F.col("doc_id").alias("item_id"), "source"), "item_id")
    return v.groupBy("source").agg(e["successes"].alias("successes"), e["accepts"].alias("accepts"))


@query("majority_label", f"WITH {SUPPORT} SELECT item_id, label, n AS label_votes FROM won", "pv_votes")
def _(t):
    return V.majority_label(votes(t))


@query("decision_reason_text", f"""WITH {SUPPORT},
r AS (SELECT s.item_id, s.voter_order, CASE WHEN s.voter_order = 1 AND s.item_id % 2 = 0 THEN '' ELSE s.voter_id || ' says ' || s.label END AS reason,
  CASE WHEN s.item_id % 3 = 0 THEN ['size', s.voter_id] ELSE ['size'] END AS missing FROM sup s JOIN won w ON w.item_id = s.item_id AND w.label = s.label),
m AS (SELECT item_id, voter_order, pos, item FROM (SELECT item_id, voter_order, unnest(missing) AS item, generate_subscripts(missing, 1) AS pos FROM r)),
f AS (SELECT item_id, item, min(voter_order * 100 + pos) AS place FROM m GROUP BY item_id, item),
mm AS (SELECT item_id, string_agg(item, '|' ORDER BY place) AS missing FROM f GROUP BY item_id)
SELECT r.item_id, coalesce(arg_min(reason, voter_order) FILTER (WHERE reason <> ''), '') AS reason, any_value(mm.missing) AS missing FROM r JOIN mm ON mm.item_id = r.item_id GROUP BY r.item_id""", "pv_votes")
def _(t):
    v = votes(t)
    reason = F.when((F.col("voter_order") == 1) & (F.col("item_id") % 2 == 0), "").otherwise(F.concat("voter_id", F.lit(" says "), "label"))
    missing = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("size"), "voter_id")).otherwise(F.array(F.lit("size")))
    return V.decision_reason_text(v.withColumns({"reason": reason, "missing_information": missing}))


@query("vote_progress", "SELECT item_id, count(*) AS total, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'error') AS failed FROM pv_votes GROUP BY item_id", "pv_votes")
def _(t):
    return V.vote_progress(votes(t))


@query("memoised_votes", """WITH good AS (SELECT DISTINCT item_id, voter_id FROM pv_votes WHERE status = 'succeeded' AND item_id % 4 <> 0),
w AS (SELECT item_id, voter_id FROM pv_votes)
SELECT w.voter_id, count(*) FILTER (WHERE g.item_id IS NOT NULL) AS reused, count(*) FILTER (WHERE g.item_id IS NULL) AS to_score FROM w LEFT JOIN good g USING (item_id, voter_id) GROUP BY w.voter_id""", "pv_votes")
def _(t):
    v = votes(t)
    reused, missing = V.memoised_votes(v.select("item_id", "voter_id"), v.filter("item_id % 4 <> 0"), ["item_id", "voter_id"])
    rows = reused.select("voter_id", F.lit(1).alias("r")).unionByName(missing.select("voter_id", F.lit(0).alias("r")))
    return rows.groupBy("voter_id").agg(F.sum("r").cast("bigint").alias("reused"), F.sum(1 - F.col("r")).cast("bigint").alias("to_score"))


@query("redact_failures", "SELECT item_id, coalesce(string_agg(voter_id || ':processing_failed', ',' ORDER BY voter_order) FILTER (WHERE status <> 'succeeded'), '') AS failures FROM pv_votes GROUP BY item_id", "pv_votes")
def _(t):
    return V.redact_failures(votes(t), F.lit("processing_failed"))


@query("check_vote_response", """WITH b AS (SELECT item_id, voter_id,
  CASE item_id % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '{"label":"relevant","reason":""}' WHEN 2 THEN '{"label":"' || coalesce(label, 'other') || '","reason":"because"}'
  ELSE '{"label":"relevant","reason":"because","missing_information":["size"]}' END AS body FROM pv_votes),
c AS (SELECT *, item_id % 4 = 2 AND json_extract_string(CASE WHEN item_id % 4 = 0 THEN '{}' ELSE body END, '$.label') IN ('relevant', 'somewhat_relevant', 'not_relevant', 'insufficient_information') AS ok FROM b)
SELECT item_id, voter_id, CASE WHEN ok THEN 'succeeded' ELSE 'error' END AS status, CASE WHEN ok THEN json_extract_string(body, '$.label') END AS label, CASE WHEN NOT ok THEN 'llm_invalid_response' END AS code FROM c""", "pv_votes")
def _(t):
    k = F.col("item_id") % 4
    body = F.when(k == 0, "not json").when(k == 1, '{"label":"relevant","reason":""}').when(k == 2, F.concat(F.lit('{"label":"'), F.coalesce("label", F.lit("other")), F.lit('","reason":"because"}'))).otherwise('{"label":"relevant","reason":"because","missing_information":["size"]}')
    return V.check_vote_response(votes(t).select("item_id", "voter_id", body.alias("body"))).drop("body")


@query("audit_decisions", f"""WITH {DECIDED},
s AS (SELECT item_id, accepts >= 2 AS accepted, CASE WHEN item_id % 10 = 0 THEN 'relevant' WHEN accepts >= 2 THEN 'relevant' ELSE 'not_relevant' END AS label,
  CASE WHEN item_id % 15 = 0 THEN 9 ELSE accepts END AS accepts_stored, CASE WHEN item_id % 7 = 0 THEN 2 ELSE 3 END AS total, accepts AS real FROM d)
SELECT item_id, 'label_mismatch' AS rule FROM s WHERE accepted <> (label = 'relevant')
UNION ALL SELECT item_id, 'accept_count' FROM s WHERE accepts_stored <> real
UNION ALL SELECT item_id, 'total_count' FROM s WHERE total <> 3
UNION ALL SELECT item_id, 'count_bounds' FROM s WHERE accepts_stored > total""", "pv_votes")
def _(t):
    v, i = votes(t), F.col("item_id")
    d = V.vote_ensemble(v)
    stored = d.select("item_id", (F.col("accepts") >= 2).alias("accepted"), F.when((i % 10 == 0) | (F.col("accepts") >= 2), "relevant").otherwise("not_relevant").alias("label"), F.when(i % 15 == 0, 9).otherwise(F.col("accepts")).alias("accepts"), F.when(i % 7 == 0, 2).otherwise(3).alias("total"))
    return V.audit_decisions(stored, v)


@query("attempt_models", """SELECT item_id, voter_id, CASE voter_id WHEN 'a_quality' THEN 'small' WHEN 'b_toxic' THEN 'large' END AS model FROM pv_votes""", "pv_votes")
def _(t):
    v = votes(t).withColumn("run_id", F.col("item_id"))
    entry = "array<struct<voter_id:string,model:string>>"
    listed = F.from_json(F.lit('[{"voter_id":"a_quality","model":"small"},{"voter_id":"b_toxic","model":"large"},{"voter_id":"a_quality","model":"later"}]'), entry)
    config = v.select("run_id").distinct().withColumn("voters", listed)
    return V.attempt_models(v.select("run_id", "item_id", "voter_id"), config).select("item_id", "voter_id", "model")


@query("score_votes", """SELECT 'c_length' AS voter_id, 'succeeded' AS status, CASE WHEN length(coalesce(text, '')) >= 1000 THEN 'relevant' ELSE 'not_relevant' END AS label, count(*) AS n FROM documents GROUP BY 3
UNION ALL SELECT 'z_broken', 'error', NULL, count(*) FROM documents""")
def _(t):
    from lodestack.functions.voters import score_votes

    rules = {"c_length": lambda texts: ["relevant" if len(x or "") >= 1000 else "not_relevant" for x in texts], "z_broken": lambda texts: [1 / 0 for _ in texts]}
    return score_votes(t.documents.select(F.col("doc_id").alias("item_id"), "text"), "text", rules).groupBy("voter_id", "status", "label").agg(F.count("*").alias("n"))
