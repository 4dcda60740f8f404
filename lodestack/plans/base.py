"""Registration of queries and the stand-in views that both engines compute from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (query, oracle SQL or None)
REGISTRY: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Parquet tables of one directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register ``f(tables) -> DataFrame``; ``views`` names stand-in views that the SQL uses."""
    def wrap(f: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        full = sql and (sql if not views else "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split()) + (", " + sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else " " + sql))
        REGISTRY[name] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), full)
        return f

    return wrap


VIEWS = {
    "pv_votes": """
SELECT d.doc_id AS item_id, 'a_quality' AS voter_id, 1 AS voter_order,
  CASE WHEN l.doc_id IS NULL THEN 'error' ELSE 'succeeded' END AS status,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'relevant' ELSE 'not_relevant' END AS label
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
UNION ALL
SELECT d.doc_id, 'b_toxic', 2, CASE WHEN l.doc_id IS NULL THEN 'error' ELSE 'succeeded' END,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 0 THEN 'somewhat_relevant' ELSE 'not_relevant' END
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
UNION ALL
SELECT d.doc_id, 'c_length', 3, 'succeeded',
  CASE WHEN d.n_chars >= 1000 THEN 'relevant' WHEN d.n_chars >= 200 THEN 'insufficient_information' ELSE 'not_relevant' END
FROM documents d""",
    "pv_requests": """
SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS owner_id, event_type AS operation, ts, CAST(event_id % 3 + 1 AS INT) AS amount FROM events""",
    "pv_obs": """
SELECT 'https://example.org/' || CAST(user_id AS VARCHAR) AS dataset_url, event_id AS seq, ts AS observed_at,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 't' || CAST(event_id AS VARCHAR) END AS title,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS publisher,
  CASE WHEN event_id % 5 = 0 THEN 'page' ELSE 'repository' END AS evidence_kind,
  event_id % 7 = 0 AS checked_now, value AS probability
FROM events""",
    "pv_jobs": """
SELECT o_orderkey AS job_id, o_custkey AS candidate_id, o_orderdate AS updated_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status
FROM orders""",
    "pv_scores": "SELECT l_orderkey AS page_id, l_linenumber AS node, CAST(l_quantity AS INT) % 4 AS score FROM lineitem",
    "pv_halves": """
SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS side,
  COUNT(*) AS n, MAX(event_id) AS last_event
FROM events GROUP BY 1, 2""",
    "pv_probes": """
SELECT event_id AS probe_id,
  CASE event_id % 8 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 206 WHEN 4 THEN 500 ELSE 200 END AS status_code,
  CASE event_id % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html' ELSE 'text/csv' END AS mime,
  CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '<html><body>please log in</body></html>' ELSE 'a,b' || chr(10) || '1,2' || chr(10) END AS body,
  CAST(user_id AS VARCHAR) AS host, value AS probability
FROM events""",
}


def votes(t: Tables) -> DataFrame:
    """Three rule voters per document; a document without label fails two of them."""
    d = t.documents.join(t.labels.withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    found = F.when(F.col("labelled").isNull(), "error").otherwise("succeeded")
    quality = F.when(F.col("labelled").isNull(), None).when(F.col("quality") == 1, "relevant").otherwise("not_relevant")
    toxic = F.when(F.col("labelled").isNull(), None).when(F.col("toxic") == 0, "somewhat_relevant").otherwise("not_relevant")
    length = F.when(F.col("n_chars") >= 1000, "relevant").when(F.col("n_chars") >= 200, "insufficient_information").otherwise("not_relevant")

    def row(voter: str, order: int, status, label):
        return F.struct(F.lit(voter).alias("voter_id"), F.lit(order).alias("voter_order"), status.alias("status"), label.alias("label"))

    each = F.array(row("a_quality", 1, found, quality), row("b_toxic", 2, found, toxic), row("c_length", 3, F.lit("succeeded"), length))
    return d.select(F.col("doc_id").alias("item_id"), F.explode(each).alias("v")).select("item_id", "v.*")


def requests(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("owner_id"), F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 + 1).cast("int").alias("amount"))


def observations(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")).alias("dataset_url"), e.alias("seq"), F.col("ts").alias("observed_at"),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("t"), e.cast("string"))).alias("title"), F.when(e % 3 == 0, "").otherwise(F.col("event_type")).alias("publisher"),
        F.when(e % 5 == 0, "page").otherwise("repository").alias("evidence_kind"), (e % 7 == 0).alias("checked_now"), F.col("value").alias("probability"))


def jobs(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    return t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderdate").alias("updated_at"), status.alias("status"))


def scores(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("node"), (F.col("l_quantity").cast("int") % 4).alias("score"))


def halves(t: Tables) -> DataFrame:
    side = F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), "before").otherwise("after")
    return t.events.groupBy("user_id", side.alias("side")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def probes(t: Tables) -> DataFrame:
    e = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, (401, 404, 403, 206, 500, 200, 200, 200))), (e % 8 + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, ("application/json", "text/html", "text/csv"))), (e % 3 + 1).cast("int"))
    body = F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, "<html><body>please log in</body></html>").otherwise("a,b\n1,2\n")
    return t.events.select(e.alias("probe_id"), code.alias("status_code"), mime.alias("mime"), body.alias("body"), F.col("user_id").cast("string").alias("host"), F.col("value").alias("probability"))
