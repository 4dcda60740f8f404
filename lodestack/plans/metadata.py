"""Metadata, evidence and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import metadata as D
from lodestack.operators import records as R
from lodestack.operators import tables as T
from lodestack.plans.base import observations, query


@query("bound_candidates", "SELECT doc_id, md5(left(text, 500)) AS title, md5(left(text, 20000)) AS description, CAST(least(len(string_split(text, ' ')), 100) AS INTEGER) AS n_keywords FROM documents")
def _(t):
    d = t.documents.select("doc_id", F.col("text").alias("title"), F.col("text").alias("description"), F.split("text", " ").alias("keywords"))
    return D.bound_candidates(d, "keywords").select("doc_id", F.md5("title").alias("title"), F.md5("description").alias("description"), F.size("keywords").alias("n_keywords"))


@query("bound_metadata_bytes", """WITH RECURSIVE r AS (SELECT doc_id, left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 3000) AS a, left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 700) AS b, 0 AS i FROM documents
UNION ALL SELECT doc_id, CASE WHEN length(a) >= length(b) THEN left(a, length(a) // 2) ELSE a END, CASE WHEN length(a) >= length(b) THEN b ELSE left(b, length(b) // 2) END, i + 1 FROM r WHERE length(a) + length(b) + 15 > 1000 AND i < 24)
SELECT doc_id, arg_max(length(a), i) AS a_chars, arg_max(length(b), i) AS b_chars FROM r GROUP BY doc_id""")
def _(t):
    flat = F.regexp_replace("text", "[^a-zA-Z ]", "")
    m = F.create_map(F.lit("a"), F.substring(flat, 1, 3000), F.lit("b"), F.substring(flat, 1, 700))
    out = t.documents.select("doc_id", D.bound_bytes(m, 1000).alias("m"))
    return out.select("doc_id", F.length(F.col("m")["a"]).cast("bigint").alias("a_chars"), F.length(F.col("m")["b"]).cast("bigint").alias("b_chars"))


@query("metadata_contract", """SELECT doc_id, CASE WHEN trim(source) = '' THEN 'NA' ELSE trim(source) END AS title, CASE WHEN lang = 'en' THEN 'NA' ELSE lang || ', x' END AS geography, 'NA' AS license FROM documents""")
def _(t):
    places = F.array(F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit(" "), "lang")), F.when(F.col("lang") == "en", " ").otherwise("x"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")))
    m = D.metadata_contract({"Title": F.col("source"), "Geography": D.joined(places)})
    out = t.documents.select("doc_id", m.alias("m"))
    return out.select("doc_id", F.col("m")["Title"].alias("title"), F.col("m")["Geography"].alias("geography"), F.col("m")["Sharing license"].alias("license"))


@query("page_from_candidate", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS title, md5(text) AS text, CASE WHEN doc_id % 3 = 0 THEN 'Chad|Mali' ELSE '' END AS places FROM documents""")
def _(t):
    meta = F.create_map(F.lit("Title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("NA"), F.lit("Geography"), F.when(F.col("doc_id") % 3 == 0, "Chad, Mali,").otherwise("NA"))
    d = t.documents.select("doc_id", meta.alias("metadata"), F.col("lang").alias("title"), F.lit("u").alias("url"), F.col("text").alias("description"))
    out = R.page_from_candidate(d)
    return out.select("doc_id", F.col("page_title").alias("title"), F.md5("page_text").alias("text"), F.array_join("places", "|").alias("places"))


@query("search_terms", r"""WITH w AS (SELECT item_id, unnest(string_split_regex(trim(text), '\s+')) AS w, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) AS i FROM (SELECT item_id, 'Data ' || text || ' databases, the dataset!' AS text FROM benchmark)),
b AS (SELECT *, lower(regexp_replace(regexp_replace(w, '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '')) AS bare FROM w)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS terms FROM b WHERE bare NOT IN ('data', 'dataset', 'database') AND regexp_replace(bare, 's$', '') NOT IN ('data', 'dataset', 'database') GROUP BY item_id""")
def _(t):
    return t.benchmark.select("item_id", D.search_terms(F.concat(F.lit("Data "), "text", F.lit(" databases, the dataset!"))).alias("terms"))


@query("sanitize_trace", """SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN event_type END AS status, CASE WHEN floor(value) BETWEEN 0 AND 50 THEN CAST(floor(value) AS INTEGER) END AS resource_count, CASE WHEN event_id % 2 = 0 THEN 'https://x.example/f?id=' || event_id ELSE '' END AS url FROM events""")
def _(t):
    e = F.col("event_id")
    rows = t.events.select("event_id", F.col("event_type").alias("status"), F.floor("value").cast("int").alias("resource_count"), F.when(e % 2 == 0, F.concat(F.lit("https://x.example/f?token=1&id="), e.cast("string"))).otherwise("file:///etc").alias("url"))
    return D.sanitize_trace(rows, {"status": ("click", "error")}, {"resource_count": (0, 50)}, ["url"])


@query("public_labels", r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS label, CASE WHEN p_partkey % 3 < 2 THEN '0000000a-0000-4000-8000-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') END AS uuid,
CASE WHEN p_partkey % 3 < 2 THEN CAST('2024-01-0' || (p_partkey % 9 + 1) || ' 10:00:00' AS TIMESTAMP) END AS at FROM part""")
def _(t):
    k, name, key = F.col("p_partkey") % 3, F.col("p_name"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    label = D.public_label(F.when(k == 0, F.concat(F.lit("http://"), name)).otherwise(name))
    ident = D.public_identifier(F.when(k == 0, F.concat(F.lit("{0000000A-0000-4000-8000-"), key, F.lit("}"))).when(k == 1, F.concat(F.lit("0000000a000040008000"), key)).otherwise(name))
    day = F.concat(F.lit("2024-01-0"), (F.col("p_partkey") % 9 + 1).cast("string"))
    at = D.public_timestamp(F.when(k == 0, F.concat(day, F.lit("T12:00:00+02:00"))).when(k == 1, F.concat(day, F.lit("T10:00:00Z"))).otherwise(F.concat(day, F.lit("T10:00:00"))))
    return t.part.select("p_partkey", label.alias("label"), ident.alias("uuid"), at.cast("timestamp_ntz").alias("at"))


@query("rebuild_diagnostics", """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN event_type ELSE 'processing_failed' END AS code, CASE event_type WHEN 'error' THEN 'It failed.' WHEN 'click' THEN 'It clicked.' ELSE 'Processing could not be completed.' END AS message FROM r WHERE rn <= 20""")
def _(t):
    messages = t.spark.createDataFrame([("error", "It failed."), ("click", "It clicked.")], "code string, message string")
    return D.rebuild_diagnostics(t.events.select("event_id", "user_id", F.col("event_type").alias("code")), messages, "code", "event_id", "user_id").select("event_id", "code", "message")


@query("history_filter", "SELECT doc_id FROM documents WHERE source = 'src1' AND text ILIKE '%THE%' AND lang = 'en'")
def _(t):
    from lodestack.operators.history import history_filter

    return history_filter(t.documents, "source", "src1", "text", "THE", "lang", "en").select("doc_id")


@query("bounded_payload", r"""SELECT doc_id, CAST(least(length(text), 4000) AS INTEGER) AS chars, CAST(least(length(text), 500) AS INTEGER) AS title, CAST(least(length(text), 2000) AS INTEGER) AS description, CAST(least(len(string_split(text, chr(10))), 20) AS INTEGER) AS heads,
CAST(least(length(text), 500) AS INTEGER) AS meta_title, CAST(least(length(text), 1000) AS INTEGER) AS meta_other, CAST(least(len(string_split(text, ' ')), 10) AS INTEGER) AS resources, CAST(least(length(text), 300) AS INTEGER) AS anchor FROM documents""")
def _(t):
    d, words = t.documents, F.split("text", " ")
    resources = F.transform(F.slice(words, 1, 30), lambda w: F.struct(w.alias("url"), F.lit("CSV").alias("format"), F.lit(0.9).alias("probability"), F.col("text").alias("anchor"), F.lit("text/csv").alias("mime_type"), F.col("text").alias("nearby_text")))
    payload = D.bounded_payload({"url": F.col("source"), "title": F.col("text"), "meta_description": F.col("text"), "text": F.col("text")}, F.split("text", "\n"), F.create_map(F.lit("Title"), F.col("text"), F.lit("Disease(s)"), F.col("text")), resources)
    p = d.select("doc_id", payload.alias("p"))
    size = lambda c: F.length(c)
    return p.select("doc_id", size("p.page.text").alias("chars"), size("p.page.title").alias("title"), size("p.page.meta_description").alias("description"), F.size("p.page.headings").alias("heads"), size(F.col("p.page.metadata")["Title"]).alias("meta_title"), size(F.col("p.page.metadata")["Disease(s)"]).alias("meta_other"), F.size("p.distributions").alias("resources"), size(F.col("p.distributions")[0]["anchor"]).alias("anchor"))


@query("clean_string_arrays", """WITH i AS (SELECT conv_id, trim(unnest([role, ' ' || role || ' ', '  ', CAST(turn AS VARCHAR)])) AS x, turn FROM conversations)
SELECT conv_id, turn, CAST(count(DISTINCT x) AS INTEGER) AS n_clean, 1::BIGINT AS n_blank FROM i WHERE x <> '' GROUP BY conv_id, turn""")
def _(t):
    items = F.array("role", F.concat(F.lit(" "), "role", F.lit(" ")), F.lit("  "), F.col("turn").cast("string"))
    blank = F.size(F.filter(items, lambda x: F.trim(x) == "")).cast("bigint")
    return t.conversations.select("conv_id", "turn", F.size(D.clean_strings(items)).alias("n_clean"), blank.alias("n_blank"))


# evidence and vocabulary


@query("doi_groups", """SELECT '10.1234/c' || o_custkey AS doi, count(*) AS records FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY 1""")
def _(t):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    v = F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/C"), c)).when(k == 1, F.concat(F.lit("doi: 10.1234/c"), c)).when(k == 2, F.concat(F.lit(" 10.1234%2Fc"), c)).when(k == 3, F.concat(F.lit("http://dx.doi.org/10.1234/c"), c)).otherwise("11.x/none")
    return t.orders.select(D.normalize_doi(v).alias("doi")).filter("doi is not null").groupBy("doi").agg(F.count("*").alias("records"))


@query("tag_terms", r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS line, CASE WHEN doc_id % 4 = 0 THEN [' der x ', ' que '] ELSE [] END AS subjects FROM documents),
b AS (SELECT DISTINCT array_to_string(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')[1:12], ' ') AS term, 'passage' AS kind FROM benchmark),
v AS (SELECT * FROM (VALUES ('license', 'legal'), ('the', 'word'), ('and', 'word'), ('der', 'word'), ('que', 'word'), ('x que', 'word'), ('of the', 'phrase'), ('de la', 'phrase')) AS v(term, kind) UNION ALL SELECT * FROM b WHERE term <> ''),
h AS (SELECT doc_id, kind, term, 1 AS rank FROM d, v WHERE contains(line, ' ' || term || ' ') UNION ALL SELECT doc_id, kind, term, 0 FROM d, v WHERE len(list_filter(subjects, lambda s: contains(s, ' ' || term || ' '))) > 0),
r AS (SELECT *, min(rank) OVER (PARTITION BY doc_id, kind) AS best FROM h)
SELECT doc_id, kind, string_agg(term, ',' ORDER BY term) AS terms FROM r WHERE rank = best GROUP BY doc_id, kind""")
def _(t):
    fixed = t.spark.createDataFrame([("license", "legal"), ("The", "word"), ("and", "word"), ("der", "word"), ("que", "word"), ("x que", "word"), ("of the", "phrase"), ("De la", "phrase")], "term string, kind string")
    passages = t.benchmark.select(F.array_join(F.slice(F.split(D.normalized(F.col("text")), " "), 1, 12), " ").alias("term"), F.lit("passage").alias("kind"))
    subjects = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("Der x"), F.lit("que"))).otherwise(F.array().cast("array<string>"))
    return D.tag_terms(t.documents.withColumn("subjects", subjects), fixed.unionByName(passages), "doc_id", "text", "subjects")


@query("dataset_sizes", r"""WITH d AS (SELECT doc_id, text || ' We saw 1,2' || (10 + doc_id % 90) || ' patients and 5 Records, n = 7 records.' AS text FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b([0-9][0-9,]*)\s+(patients|records)\b', 1)) AS n, unnest(regexp_extract_all(text, '(?i)\b([0-9][0-9,]*)\s+(patients|records)\b', 2)) AS unit FROM d)
SELECT doc_id, lower(unit) AS unit, max(CAST(replace(n, ',', '') AS BIGINT)) AS largest, CAST(sum(CAST(replace(n, ',', '') AS BIGINT)) AS BIGINT) AS total FROM m GROUP BY 1, 2""")
def _(t):
    text = F.concat("text", F.lit(" We saw 1,2"), (10 + F.col("doc_id") % 90).cast("string"), F.lit(" patients and 5 Records, n = 7 records."))
    return D.dataset_sizes(t.documents.withColumn("text", text), "doc_id", "text", ("patients", "records"))


@query("geography_index", r"""WITH g AS (SELECT event_id, event_type, CAST(floor(value - 50) AS INTEGER) AS lat, CAST(floor(value * 2 - 100) AS INTEGER) AS lon FROM events),
p AS (SELECT event_id, CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN lat || ', ' || lon END AS place FROM g UNION ALL SELECT event_id, event_type FROM g UNION ALL SELECT event_id, 'Lake' FROM g WHERE event_id % 2 = 0
UNION ALL SELECT event_id, (lat - 60) || ', 170 to ' || lat || ', -170' FROM g WHERE lat - 60 BETWEEN -90 AND 90 AND lat BETWEEN -90 AND 90)
SELECT place, count(DISTINCT event_id) AS n FROM p WHERE place IS NOT NULL GROUP BY place""")
def _(t):
    e, lat, lon = F.col("event_id"), F.col("value") - 50, F.col("value") * 2 - 100
    whole = lambda c: F.floor(c).cast("int")
    point, box = D.geo_point(whole(lat), whole(lon)), D.geo_box(whole(lat) - 60, F.lit(170), whole(lat), F.lit(-170))
    places = F.when(e % 2 == 0, F.array(F.lit(" "), F.lit("Lake"), F.lit("Lake "))).otherwise(F.array().cast("array<string>"))
    rows = D.geography_index(t.events, "event_id", places, F.array("event_type"), point, box)
    return rows.groupBy("place").agg(F.count("*").alias("n"))


@query("publication_dates", """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'issued' WHEN o_orderkey % 3 = 1 THEN 'available' ELSE 'created' END AS rule, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1""")
def _(t):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    entry = lambda kind, rank, when: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.when(when, d).alias("date"))
    dates = t.orders.select("o_orderkey", F.explode(F.array(entry("created", 3, F.lit(True)), entry("issued", 1, k == 0), entry("available", 2, k <= 1))).alias("d")).select("o_orderkey", "d.*")
    return D.publication_dates(dates, "o_orderkey").groupBy("rule").agg(F.count("*").alias("n"), F.max("date").alias("latest"))


@query("best_texts", """SELECT conv_id, arg_min(md5(text), (CASE role WHEN 'assistant' THEN 0 ELSE 1 END) * 100000 + turn) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def _(t):
    return R.best_texts(t.conversations, "conv_id", "text", "role", "turn", "assistant").select("conv_id", F.md5("text").alias("digest"))


@query("license_index", "SELECT event_type AS license, count(DISTINCT user_id) AS records FROM events GROUP BY event_type")
def _(t):
    lists = t.events.groupBy("user_id").agg(F.collect_list("event_type").alias("rights"), F.first("event_type").alias("license"))
    return R.license_index(lists, "user_id", ["rights"], ["license"]).groupBy("license").agg(F.count("*").alias("records"))


@query("modality_index", "SELECT CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'tabular' ELSE 'images' END AS modality, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') GROUP BY 1")
def _(t):
    modes = t.spark.createDataFrame([("economy", "tabular"), ("Standard", "tabular"), ("promo", "images")], "token string, modality string")
    return R.modality_index(t.part, "p_partkey", "p_type", modes).groupBy("modality").agg(F.count("*").alias("n"))


@query("evidence_table", "SELECT dataset_url, 'publisher' AS field, count(DISTINCT publisher) AS n_values, count(*) AS n_evidence FROM pv_obs WHERE publisher <> '' GROUP BY dataset_url UNION ALL SELECT dataset_url, 'title', count(DISTINCT title), count(*) FROM pv_obs WHERE title <> '' GROUP BY dataset_url", "pv_obs")
def _(t):
    o = observations(t).select("dataset_url", "publisher", "title")
    return D.evidence_conflicts(o.unpivot("dataset_url", ["publisher", "title"], "field", "value"), ["dataset_url", "field"])


@query("fingerprints", "SELECT count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text, lang HAVING count(*) > 1")
def _(t):
    g = t.documents.groupBy(T.evidence_checksum(["text", "lang"]).alias("print")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.filter("copies > 1").select("copies", "first_doc")


@query("select_dataset_node", """WITH m AS (SELECT page_id, max(score) AS top FROM pv_scores GROUP BY page_id),
w AS (SELECT s.page_id, m.top, count(*) AS n, min(node) AS node FROM pv_scores s JOIN m ON m.page_id = s.page_id AND s.score = m.top GROUP BY s.page_id, m.top)
SELECT page_id, CASE WHEN top > 0 AND n = 1 THEN node END AS node, top = 0 OR n > 1 AS ambiguous FROM w""", "pv_scores")
def _(t):
    from lodestack.operators.jsonld import select_best_node
    from lodestack.plans.base import scores

    return select_best_node(scores(t), "page_id", "node", "score")
