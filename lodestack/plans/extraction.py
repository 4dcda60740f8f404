"""URL, page, resource and probe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import access as A
from lodestack.functions import html as H
from lodestack.functions import resources as R
from lodestack.functions import urls as U
from lodestack.operators import tables as T
from lodestack.plans.base import probes, query

CANON = r"""p AS (SELECT page_id, html, url, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)\??([^#]*)', 1)) AS sch, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)\??([^#]*)', 2)) AS hst,
  regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)\??([^#]*)', 3) AS pth, array_to_string(list_filter(string_split(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)\??([^#]*)', 4), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')), '&') AS q FROM pages),
c AS (SELECT *, sch || '://' || hst || CASE WHEN pth = '' THEN '/' ELSE pth END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM p)"""


@query("canonical_urls", f"WITH {CANON} SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY canonical")
def _(t):
    return t.pages.groupBy(U.canonical(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("url_quality", r"""WITH u AS (SELECT CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN replace(url, 'http', 'ftp') WHEN 3 THEN url || ' x' WHEN 4 THEN replace(url, '://', '://me@') WHEN 5 THEN replace(url, '/', chr(92)) WHEN 6 THEN regexp_replace(url, '://([^/]*)', '://\1:99999') ELSE 'http:///x' END AS url FROM pages),
r AS (SELECT CASE WHEN trim(url) = '' THEN 'blank' WHEN contains(url, chr(92)) THEN 'backslash' WHEN regexp_matches(trim(url), '\s') THEN 'whitespace' WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'not_http' WHEN contains(url, '@') THEN 'userinfo' WHEN url = 'http:///x' THEN 'no_host' WHEN regexp_matches(url, ':99999') THEN 'bad_port' END AS reason FROM u)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def _(t):
    u, k = F.col("url"), F.col("page_id") % 8
    v = F.when(k == 0, u).when(k == 1, "").when(k == 2, F.replace(u, F.lit("http"), F.lit("ftp"))).when(k == 3, F.concat(u, F.lit(" x"))).when(k == 4, F.replace(u, F.lit("://"), F.lit("://me@"))).when(k == 5, F.replace(u, F.lit("/"), F.lit("\\"))).when(k == 6, F.regexp_replace(u, "://([^/]*)", "://$1:99999")).otherwise("http:///x")
    return t.pages.select(U.problem(v).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("dataset_urls", f"WITH {CANON} SELECT CASE WHEN page_id % 2 = 0 THEN sch || '://' || hst || '/main' ELSE canonical END AS dataset_url, count(*) AS pages FROM c GROUP BY 1")
def _(t):
    declared = F.when(F.col("page_id") % 4 == 0, "/main").when(F.col("page_id") % 4 == 2, F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")), F.lit("/main#x"))).when(F.col("page_id") % 4 == 1, "https://elsewhere.example/").otherwise("")
    return t.pages.groupBy(U.dataset_url(F.col("url"), declared).alias("dataset_url")).agg(F.count("*").alias("pages"))


@query("redact_url_log", r"""WITH q AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END AS u FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages)),
k AS (SELECT page_id, unnest(string_split(regexp_extract(u || 'id=' || page_id || '&token=s', '\?(.*)$', 1), '&')) AS pair FROM q)
SELECT lower(split_part(pair, '=', 1)) AS dropped, count(*) AS n FROM k WHERE lower(split_part(pair, '=', 1)) NOT IN ('persistentid', 'fileid', 'version', 'format', 'id') GROUP BY 1""")
def _(t):
    u = F.regexp_replace("url", "#.*$", "")
    u = F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("id="), F.col("page_id").cast("string"), F.lit("&token=s"))
    return t.pages.select(F.explode(U.dropped_keys(u)).alias("dropped")).groupBy("dropped").agg(F.count("*").alias("n"))


@query("redacted_urls", f"WITH {CANON} SELECT page_id, sch || '://' || hst || CASE WHEN pth = '' THEN '/' ELSE pth END || '?id=' || page_id AS url FROM c")
def _(t):
    u = F.regexp_replace("url", "[?#].*$", "")
    return t.pages.select("page_id", U.redacted(F.concat(F.replace(u, F.lit("://"), F.lit("://me:pw@")), F.lit("?ref=x&id="), F.col("page_id").cast("string"), F.lit("&key=s#f"))).alias("url"))


LINKS = CANON + r""",
a AS (SELECT page_id, sch, hst, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>')) AS tag FROM c),
l AS (SELECT page_id, sch, hst, replace(regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1), '&amp;', '&') AS href FROM a),
f AS (SELECT page_id, hst, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN sch || '://' || hst || href END AS link FROM l WHERE href <> '' AND NOT regexp_matches(lower(href), '^(mailto|tel|javascript|data):'))"""


@query("extract_links", f"WITH {LINKS} SELECT page_id, count(*) AS links, count(*) FILTER (WHERE regexp_extract(link, '://([^/?#]*)', 1) = hst) AS same_domain FROM f GROUP BY page_id")
def _(t):
    return H.extract_links(t.pages).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if("same_domain").alias("same_domain"))


@query("page_to_links", f"WITH {LINKS} SELECT regexp_extract(link, '://([^/?#]*)', 1) AS host, count(*) AS n FROM f GROUP BY 1")
def _(t):
    each = t.pages.select(F.explode(H.page_to_links("html", "url")).alias("r"))
    return each.groupBy(U.host(F.col("r.link")).alias("host")).agg(F.count("*").alias("n"))


@query("scan_pages", r"""SELECT page_id, url, md5(html) AS digest FROM pages WHERE url IS NOT NULL AND html IS NOT NULL""")
def _(t):
    pages = H.scan_pages(t.spark, f"{t.dir}/pages.parquet")
    return pages.select("page_id", "url", F.md5("html").alias("digest"))


#: Entities that the test pages use, as patterns: most need no semicolon.  The ampersand goes last.
ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&apos;", "'"), ("&nbsp;?", " "), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&"))


def _text_sql(x: str) -> str:
    for a, b in ENTITIES:
        x = f"regexp_replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?is)<svg\b.*?</svg\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query("visible_text", f"SELECT page_id, md5(trim(regexp_replace({_text_sql(BARE)}, '\\s+', ' ', 'g'))) AS digest FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(H.visible_text(F.col("html"))).alias("digest"))


@query("extract_page_fields", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<h2\b[^>]*>(.*?)</h2\s*>', 1)) AS INTEGER) AS n_h2,
md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS h1, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS title,
'Press & Co' AS publisher, 'Chad|Mali' AS geography, CASE WHEN page_id % 3 = 0 THEN '10.1234/p' || page_id ELSE '' END AS doi FROM pages""")
def _(t):
    k = F.col("page_id") % 3
    extra = F.concat(F.lit('<meta content="Press &amp; Co" name="Publisher"><meta name="author" content="Other"><meta property="dcterms:spatial" content="Chad; Mali, Chad">'),
                     F.when(k == 0, F.concat(F.lit("<meta name='citation_doi' content='https://doi.org/10.1234/P"), F.col("page_id").cast("string"), F.lit("'>"))).otherwise('<meta name="citation_doi" content="none">'))
    f = H.page_fields(t.pages.withColumn("html", F.concat(extra, "html")))
    return f.select("page_id", F.size(H.element_texts(F.col("html"), "h2")).alias("n_h2"), F.md5("h1").alias("h1"), F.md5("title").alias("title"), "publisher", F.array_join("geography", "|").alias("geography"), "doi")


@query("page_defaults", r"""WITH f AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, md5(CASE WHEN page_id % 3 <> 0 AND title <> '' THEN title ELSE h1 END) AS title FROM f""")
def _(t):
    from lodestack.operators.metadata import first_filled

    f = H.page_fields(t.pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?is)<title.*?</title>", "<title> </title>")).otherwise(F.col("html"))))
    return f.select("page_id", F.md5(first_filled("title", "h1", "og_title")).alias("title"))


@query("limits_audit", r"SELECT 'links' AS rule, count(*) AS n FROM pages WHERE len(regexp_extract_all(lower(html), '<a\s')) > 10 HAVING count(*) > 0 UNION ALL SELECT 'html_chars', count(*) FROM pages WHERE length(html) > 5000 HAVING count(*) > 0")
def _(t):
    return H.limits_audit(t.pages, max_chars=5000, max_links=10).groupBy("rule").agg(F.count("*").alias("n"))


@query("landing_barriers", r"""WITH p AS (SELECT page_id, lower(html) AS h FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'restricted' WHEN 1 THEN 'restricted' WHEN 2 THEN 'unconfirmed' END AS status FROM p""")
def _(t):
    k, h = F.col("page_id") % 4, F.col("html")
    page = F.when(k == 0, F.concat(h, F.lit('<form action="/x"><input name=p type="password"></form>'))).when(k == 1, F.concat(h, F.lit("<p>Please log\n in</p>"))).when(k == 2, F.concat(h, F.lit('<div class="x g-recaptcha"></div>'))).otherwise(F.concat(h, F.lit("<script>please log in</script>")))
    return t.pages.select("page_id", H.landing_barrier(page).alias("status"))


def _says(wordings):
    return f"regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(w.replace(chr(39), chr(39) * 2) for w in wordings)})([^\\p{{L}}\\p{{N}}_]|$)')"


@query("access_barriers", f"""WITH d AS (SELECT doc_id, regexp_replace(lower(text || CASE doc_id % 5 WHEN 0 THEN ' Permission_denied.' WHEN 1 THEN ' checking  your browser' WHEN 2 THEN ' the permission was denied' WHEN 3 THEN ' an expired API-key;' ELSE '' END), '[_\\-\\s]+', ' ', 'g') AS line FROM documents)
SELECT doc_id, CASE WHEN {_says(A.RESTRICTED)} THEN 'restricted' WHEN {_says(A.CHALLENGE)} THEN 'unconfirmed' END AS status FROM d""")
def _(t):
    k = F.col("doc_id") % 5
    said = F.when(k == 0, " Permission_denied.").when(k == 1, " checking  your browser").when(k == 2, " the permission was denied").when(k == 3, " an expired API-key;").otherwise("")
    return t.documents.select("doc_id", A.barrier(F.concat("text", said)).alias("status"))


@query("candidate_resources", r"""WITH n AS (SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '' WHEN 3 THEN '.pdf' ELSE '.zip' END AS ext FROM part)
SELECT p_partkey AS page, CASE ext WHEN '.csv' THEN 'CSV' WHEN '.json' THEN 'JSON' WHEN '.zip' THEN 'ZIP' ELSE 'UNKNOWN' END AS format,
CAST(CASE WHEN ext = '' THEN 0 ELSE 55 END + 30 + 5 AS INTEGER) AS percent FROM n WHERE ext <> '.pdf'""")
def _(t):
    k = F.col("p_partkey") % 5
    ext = F.when(k == 0, ".csv").when(k == 1, ".json").when(k == 2, "").when(k == 3, ".pdf").otherwise(".zip")
    links = t.part.select(F.col("p_partkey").alias("page"), F.concat(F.lit("https://x.example/data/"), F.replace("p_name", F.lit(" "), F.lit("-")), ext).alias("link"), F.lit("download file").alias("anchor"), F.lit(True).alias("same_domain"))
    out = R.candidate_resources(links)
    return out.select("page", "format", F.round(F.col("probability") * 100).cast("int").alias("percent"))


@query("rank_resources", """WITH r AS (SELECT l_orderkey AS page, l_partkey % 3 AS link, l_returnflag AS format, max(l_discount) AS probability FROM lineitem GROUP BY 1, 2, 3) SELECT page, 'u' || link AS link, format, probability FROM r""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("u"), (F.col("l_partkey") % 3).cast("string")).alias("link"), F.col("l_returnflag").alias("format"), F.col("l_discount").alias("probability"), F.col("l_linenumber").alias("pos"))
    return R.rank_resources(rows, "page").drop("pos").orderBy("page", F.desc("probability"), "link")


@query("page_resources", r"""SELECT page_id, page_id || '.csv' AS file, 'CSV' AS format, CAST(95 AS INTEGER) AS percent FROM pages WHERE page_id % 6 <> 3
UNION ALL SELECT page_id, page_id || '.csv', 'CSV', CAST(80 AS INTEGER) FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, page_id || '.zip', 'ZIP', CAST(90 AS INTEGER) FROM pages WHERE page_id % 3 <> 0""")
def _(t):
    from lodestack.operators import jsonld as J
    from lodestack.plans.repositories import jsonld_pages

    pages = jsonld_pages(t)
    more = F.concat(F.lit('<a href="../a/../files/'), F.col("page_id").cast("string"), F.lit('.zip">download data</a><a href="/x/'), F.col("page_id").cast("string"), F.lit('.csv">data file</a>'))
    pages = pages.withColumn("html", F.concat("html", more))
    merged = J.merge_nodes(J.nodes(H.jsonld_blocks(pages), "page_id"), "page_id")
    scores = J.dataset_scores(merged, "page_id", pages.select("page_id", F.lit(None).cast("string").alias("doi")), pages.select("page_id", "url"), pages.select("page_id", F.when(F.col("page_id") % 6 == 0, "#d").alias("native_id")))
    node = J.select_best_node(scores.withColumnRenamed("id", "node"), "page_id", "node", "score").join(scores.groupBy("page_id").agg(F.count("*").alias("datasets")), "page_id")
    out = R.page_resources(H.extract_links(pages), J.schema_resources(merged, "page_id"), node, "page_id")
    return out.filter(F.col("format").isin("CSV", "ZIP")).select("page_id", F.regexp_extract("link", "[^/]*$", 0).alias("file"), "format", F.round(F.col("probability") * 100).cast("int").alias("percent"))


@query("usable_resources", f"WITH {LINKS} SELECT page_id, count(*) AS n FROM f WHERE NOT regexp_matches(lower(regexp_extract(link, '://[^/?#]*([^?#]*)', 1)), '\\.(pdf|html|htm|png|jpg|jpeg|gif|svg)$') GROUP BY page_id")
def _(t):
    rows = H.extract_links(t.pages).withColumn("mime", F.lit("text/csv; charset=utf-8"))
    return R.usable_resources(rows, "link", "mime").groupBy("page_id").agg(F.count("*").alias("n"))


@query("source_identity", f"WITH {CANON} SELECT CASE WHEN ends_with(hst, '.example.com') THEN 'com platform' WHEN ends_with(hst, '.example.org') THEN 'org platform' ELSE '' END AS platform, count(*) AS pages FROM c GROUP BY 1")
def _(t):
    from lodestack.operators.metadata import source_identity

    known = t.spark.createDataFrame([("example.com", "com platform"), ("example.org", "org platform")], "domain string, platform string")
    return source_identity(t.pages, known, "url").groupBy("platform").agg(F.count("*").alias("pages"))


@query("route_records", f"WITH {CANON} SELECT page_id, CASE WHEN ends_with(hst, '.example.com') AND regexp_matches(pth, '^/fr/') THEN 'french' WHEN ends_with(hst, '.example.com') THEN 'com' WHEN ends_with(hst, '.example.net') THEN 'net' END AS connector FROM c WHERE ends_with(hst, '.example.com') OR ends_with(hst, '.example.net')")
def _(t):
    from lodestack.operators.metadata import route_records

    rules = t.spark.createDataFrame([(0, "french", "example.com", "^/fr/"), (1, "com", "example.com", ""), (2, "net", "example.net", "")], "priority int, connector string, domain string, path_rule string")
    return route_records(t.pages, rules, "page_id", "url").select("page_id", "connector")


@query("filter_candidates", f"WITH {CANON} SELECT CASE WHEN page_id % 6 = 0 THEN 'rejected' WHEN page_id % 6 = 1 THEN 'rejected' ELSE 'kept' END AS verdict, count(*) AS n FROM c GROUP BY 1")
def _(t):
    from lodestack.operators.metadata import filter_candidates

    k = F.col("page_id") % 6
    rows = t.pages.select("page_id", F.when(k == 0, " ").otherwise("a title").alias("title"), F.when(k == 1, F.concat("url", F.lit("\0"))).otherwise(F.col("url")).alias("url"))
    return filter_candidates(rows, "title", "url", ["title"]).groupBy("verdict").agg(F.count("*").alias("n"))


# probes

PAIRED = """s AS (SELECT *, event_type AS x FROM pv_probes JOIN events ON event_id = probe_id)"""


@query("pair_probes", "SELECT h.probe_id, h.probe_id + 1 AS get_id, h.status_code AS head_code, g.status_code AS get_code FROM pv_probes h JOIN pv_probes g ON g.probe_id = h.probe_id + 1 WHERE h.probe_id % 2 = 0 AND (h.status_code IN (403, 405, 501) OR h.status_code BETWEEN 200 AND 399)", "pv_probes")
def _(t):
    from lodestack.operators.probes import pair_probes

    p = probes(t).withColumns({"url": F.floor(F.col("probe_id") / 2), "method": F.when(F.col("probe_id") % 2 == 0, "HEAD").otherwise("GET")})
    out = pair_probes(p, "url").filter("get_code is not null")
    return out.select((F.col("url") * 2).alias("probe_id"), (F.col("url") * 2 + 1).alias("get_id"), "head_code", "get_code")


@query("access_status", """WITH p AS (SELECT *, CASE WHEN mime = 'application/json' AND probe_id % 5 = 0 THEN '{"results":[' || body || ', {"x": ' WHEN mime = 'application/json' AND probe_id % 5 = 1 THEN '{"count":1,"message":"Please sign in","error":"n' WHEN mime = 'application/json' AND probe_id % 5 = 2 THEN '{"results":[{"x":' ELSE body END AS seen FROM pv_probes)
SELECT probe_id, CASE WHEN status_code = 401 THEN 'restricted' WHEN status_code = 404 THEN 'unavailable' WHEN status_code = 500 THEN 'unconfirmed' WHEN seen LIKE '<html>%please log in%' THEN 'restricted' WHEN status_code = 403 THEN 'unconfirmed'
  WHEN regexp_matches(seen, '"error":"[^"]*$') OR (regexp_matches(seen, '^[{]"results":.[{]') AND NOT regexp_matches(seen, '[}],')) THEN 'unconfirmed' ELSE 'available' END AS status FROM p""", "pv_probes")
def _(t):
    k, is_json = F.col("probe_id") % 5, F.col("mime") == "application/json"
    seen = F.when(is_json & (k == 0), F.concat(F.lit('{"results":['), "body", F.lit(', {"x": '))).when(is_json & (k == 1), '{"count":1,"message":"Please sign in","error":"n').when(is_json & (k == 2), '{"results":[{"x":').otherwise(F.col("body"))
    want = F.when(F.col("mime") == "text/csv", "CSV").when(is_json, "JSON").otherwise("UNKNOWN")
    return probes(t).select("probe_id", A.access_status(F.col("status_code"), F.col("mime"), seen, F.lit(""), want, is_json & (k <= 2), F.lit(True)).alias("status"))


@query("sniff_formats", r"""SELECT CASE event_id % 3 WHEN 0 THEN 'JSON' WHEN 1 THEN 'UNKNOWN' ELSE 'CSV' END AS format, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    return probes(t).groupBy(A.sniff(F.col("body").cast("binary")).alias("format")).agg(F.count("*").alias("n"))


@query("sniff_files", """WITH n AS (SELECT count(DISTINCT r_regionkey) AS n FROM region) SELECT format, claimed, format <> claimed AS mismatch, n FROM n, (VALUES ('CSV', 'CSV'), ('TSV', 'CSV'), ('JSON', 'JSON'), ('PARQUET', 'PARQUET'), ('GZ', 'GZ')) AS v(format, claimed)""")
def _(t):
    from lodestack.scratch import new_path
    from lodestack.sources.files import sniff_files

    root = new_path(t.spark, "files")
    each = t.region.withColumn("k", F.col("r_regionkey")).repartition("k").write.partitionBy("k")  # a file a region
    each.csv(f"{root}/commas", header=True)
    each.csv(f"{root}/tabs", header=True, sep="\t")
    each.json(f"{root}/objects")
    each.parquet(f"{root}/columns")
    each.csv(f"{root}/packed", header=True, compression="gzip")
    return sniff_files(t.spark, root).groupBy("format", "claimed", "mismatch").agg(F.count("*").alias("n"))


@query("plausible_tables", r"""WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(text, '. ', '.' || chr(10)), '"[^"]*"', 'q', 'g'), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
w AS (SELECT doc_id, len(lines) AS n, list_distinct(list_transform(lines, lambda x: len(string_split(x, ',')))) AS widths FROM l)
SELECT doc_id, n >= 2 AND len(widths) = 1 AND widths[1] >= 2 AS plausible FROM w""")
def _(t):
    text = F.regexp_replace("text", r"\. ", ".\n")
    return t.documents.select("doc_id", A.plausible_table(text, ",").alias("plausible"))


@query("format_changes", """SELECT 'CSV' AS claimed, CASE WHEN probe_id % 3 = 2 THEN 'CSV' WHEN probe_id % 3 = 0 THEN 'JSON' ELSE 'CSV' END AS resolved, count(*) AS n FROM pv_probes GROUP BY 1, 2""", "pv_probes")
def _(t):
    from lodestack.operators.probes import resolved_format

    p = probes(t).withColumn("claimed", F.lit("CSV"))
    r = resolved_format(A.sniff(F.col("body").cast("binary")), F.when(F.col("mime") == "application/json", "JSON").otherwise("UNKNOWN"), F.col("claimed"))
    return p.groupBy("claimed", r.alias("resolved")).agg(F.count("*").alias("n"))


@query("total_sizes", r"""SELECT probe_id, CASE probe_id % 6 WHEN 0 THEN probe_id + 100 WHEN 3 THEN probe_id WHEN 5 THEN NULL ELSE CASE WHEN probe_id + 5 >= 6 THEN probe_id + 5 END END AS bytes FROM pv_probes""", "pv_probes")
def _(t):
    i = F.col("probe_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    rng = F.when(i % 6 == 0, text("bytes 0-99/", (i + 100).cast("string"))).when(i % 6 == 1, "bytes 5-2/99").when(i % 6 == 2, "bytes */123").otherwise("")
    code = F.when(i % 6 <= 2, 206).otherwise(200)
    length = F.when(i % 6 == 3, i.cast("string")).otherwise("-")
    got = F.create_map(F.lit("etag"), F.lit("a"), F.lit("content-type"), F.lit("text/csv"))
    head = F.when(i % 6 == 5, F.create_map(F.lit("etag"), F.lit("b"))).otherwise(F.create_map(F.lit("etag"), F.lit("a")))
    same = A.head_matches(F.lit(200), F.lit("u"), F.lit("u"), head, got)
    return probes(t).select("probe_id", A.total_size(code, rng, length, (i + 5).cast("string"), same, F.lit(6)).alias("bytes"))


@query("json_payload_check", r"""WITH e AS (SELECT event_id, '{"data":[' || props || ',' || props || ']}' AS whole, props FROM events),
b AS (SELECT event_id, event_id % 8 > 3 AS cut, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '{"status":"failed","message":"no"}' WHEN 2 THEN '{"data":[],"count":0}' WHEN 3 THEN '{broken' WHEN 4 THEN left(whole, length(props) + 14) WHEN 5 THEN left(whole, 9 + length(props) // 2) WHEN 6 THEN '{"data":[' || props || '],"status":"fai' ELSE '{"data":[' || props || '],"error":"x"' END AS body FROM e),
r AS (SELECT *, cut AND regexp_matches(body, '"(error|errors|success|status)"\s*:?\s*("[^"]*)?$') AS lost, CASE WHEN cut THEN list_concat([left(body, i) || '}' FOR i IN range(1, length(body) + 1) IF json_valid(left(body, i) || '}')], [left(body, i) || ']}' FOR i IN range(1, length(body) + 1) IF json_valid(left(body, i) || ']}')]) WHEN json_valid(body) THEN [body] ELSE [] END AS docs FROM b),
j AS (SELECT event_id, lost, len(docs) AS n, len(list_filter(docs, lambda d: (json_extract_string(d, '$.status') = 'failed' OR json_extract_string(d, '$.error') <> ''))) AS failures,
  len(list_filter(docs, lambda d: CASE WHEN json_exists(d, '$.data') THEN json_array_length(d, '$.data') > 0 ELSE len(json_keys(d)) > 0 END)) AS filled FROM r)
SELECT CASE WHEN lost OR n = 0 THEN NULL WHEN failures > 0 THEN 'error' WHEN filled > 0 THEN 'data' ELSE 'empty' END AS evidence, count(*) AS n FROM j GROUP BY 1""")
def _(t):
    k, p = F.col("event_id") % 8, F.col("props")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    whole = text('{"data":[', p, ",", p, "]}")
    body = (F.when(k == 0, p).when(k == 1, '{"status":"failed","message":"no"}').when(k == 2, '{"data":[],"count":0}').when(k == 3, "{broken")
            .when(k == 4, F.substring(whole, F.lit(1), F.length(p) + 14)).when(k == 5, F.substring(whole, F.lit(1), 9 + F.floor(F.length(p) / 2).cast("int")))
            .when(k == 6, text('{"data":[', p, '],"status":"fai')).otherwise(text('{"data":[', p, '],"error":"x"')))
    return t.events.groupBy(A.json_evidence(body, k > 3).alias("evidence")).agg(F.count("*").alias("n"))


@query("keep_validated", """WITH r AS (SELECT probe_id, host, status_code = 200 AS ok, probability, row_number() OVER w AS "check", coalesce(sum(CASE WHEN status_code = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY probability DESC, probe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pv_probes WINDOW w AS (PARTITION BY host ORDER BY probability DESC, probe_id))
SELECT probe_id, ok AS kept FROM r WHERE "check" <= 3 AND b < 1""", "pv_probes")
def _(t):
    p = probes(t).withColumn("ok", F.col("status_code") == 200)
    return T.select_resources(p, "host", [F.desc("probability"), "probe_id"], "ok").select("probe_id", "kept")


@query("validation_breakdown", "SELECT mime, count(*) FILTER (WHERE status_code = 200) AS available, count(*) FILTER (WHERE status_code IN (401, 403)) AS restricted, count(*) FILTER (WHERE status_code = 404) AS unavailable FROM pv_probes GROUP BY mime", "pv_probes")
def _(t):
    s = F.when(F.col("status_code") == 200, "available").when(F.col("status_code").isin(401, 403), "restricted").when(F.col("status_code") == 404, "unavailable")
    out = probes(t).withColumn("s", s).groupBy("mime").pivot("s", ["available", "restricted", "unavailable"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


@query("validation_view", "SELECT probe_id, CASE WHEN status_code = 200 THEN '' ELSE 'validation_failed' END AS code, CASE WHEN status_code = 200 THEN '' ELSE 'HTTP ' || status_code END AS error FROM pv_probes", "pv_probes")
def _(t):
    from lodestack.operators.probes import validation_view

    p = probes(t).withColumns({"ok": F.col("status_code") == 200, "error": F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))})
    return validation_view(p, "ok", "error").select("probe_id", "code", "error")
