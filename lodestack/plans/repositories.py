"""Repository payload queries: payloads are built from orders and their line items, then scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import html as H
from lodestack.functions.voters import Registry
from lodestack.operators import jsonld as J
from lodestack.plans.base import query
from lodestack.sources import repositories as S


def with_files(t, file, name="files"):
    """Orders with an array of file structs from their line items."""
    key = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    li = t.lineitem.withColumn("key", key).dropDuplicates(["l_orderkey", "key"])
    files = li.groupBy("l_orderkey").agg(F.collect_list(file).alias(name))
    return t.orders.join(files, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("id", F.col("o_orderkey").cast("string"))


FILES = """li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY l_orderkey)"""
TWO_THIRDS = f"WITH {FILES} SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'identity_mismatch' END AS rejected, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE n END AS INTEGER) AS files FROM orders JOIN n ON l_orderkey = o_orderkey"


def shown(df):
    return df.select(F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1).cast("bigint").alias("id"), "rejected", F.size("resources").alias("files"))


def wrong(c):
    """The id a payload claims: every third is another record's."""
    return F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(c)


def zenodo(t):
    o = with_files(t, F.struct("key", F.struct(F.concat(F.lit("https://z.example/f/"), "key").alias("self")).alias("links")))
    meta = F.struct(F.col("o_orderpriority").alias("title"), F.lit("open").alias("access_right"))
    return o.select(F.concat(F.lit("https://z.example/records/"), "id").alias("url"), F.to_json(F.struct(wrong(F.col("id")).alias("id"), meta.alias("metadata"), "files")).alias("body"))


def figshare(t):
    o = with_files(t, F.struct(F.col("key").alias("id"), F.col("key").alias("name"), F.concat(F.lit("https://f.example/"), "key").alias("download_url")))
    return o.select(F.concat(F.lit("https://f.example/articles/d/t/"), "id").alias("url"), F.to_json(F.struct(wrong(F.col("id")).alias("id"), F.lit("1").alias("version"), F.col("o_orderpriority").alias("title"), "files")).alias("body"))


@query("scan_zenodo", TWO_THIRDS)
def _(t):
    return shown(S.scan_zenodo(zenodo(t)))


@query("scan_figshare", TWO_THIRDS)
def _(t):
    return shown(S.scan_figshare(figshare(t)))


@query("scan_dataverse", TWO_THIRDS)
def _(t):
    o = with_files(t, F.struct(F.col("key").alias("label"), F.lit(False).alias("restricted"), F.struct(F.col("key").alias("id"), F.col("key").alias("filename")).alias("dataFile")))
    pid = F.concat(F.lit("doi:10.7910/DVN/"), "id")
    version = F.struct(F.lit(1).alias("versionNumber"), F.lit(0).alias("versionMinorNumber"), "files")
    body = F.to_json(F.struct(F.lit("OK").alias("status"), F.struct("id", wrong(pid).alias("persistentId"), version.alias("latestVersion")).alias("data")))
    return shown(S.scan_dataverse(o.select(F.concat(F.lit("https://d.example/dataset.xhtml?persistentId="), F.url_encode(pid)).alias("url"), body.alias("body"))))


@query("scan_inveniordm", TWO_THIRDS)
def _(t):
    o = with_files(t, F.struct("key", F.lit("completed").alias("status"), F.struct(F.concat(F.lit("https://i.example/"), "key").alias("content")).alias("links")))
    entries = F.map_from_arrays(F.transform("files", lambda f: f["key"]), F.col("files"))
    record = F.struct(wrong(F.col("id")).alias("id"), F.lit(True).alias("is_published"), F.struct(F.lit("public").alias("files")).alias("access"), F.struct(F.col("o_orderpriority").alias("title")).alias("metadata"))
    return shown(S.scan_inveniordm(o.select(F.concat(F.lit("https://i.example/records/"), "id").alias("url"), F.to_json(F.struct(record.alias("record"), F.struct(entries.alias("entries")).alias("files"))).alias("body"))))


@query("scan_dryad", f"WITH {FILES} SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'version_mismatch' END AS rejected, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS files FROM orders LEFT JOIN n ON l_orderkey = o_orderkey")
def _(t):
    def doc(df, **links):
        inner = F.concat_ws(",", *[F.concat(F.lit(f'"{k.replace("_", ":")}":{{"href":"'), v, F.lit('"}')) for k, v in links.items()])
        return F.concat(F.lit('{"_links":{'), inner, F.lit("}"), df, F.lit("}"))

    o = t.orders.withColumn("id", F.col("o_orderkey").cast("string"))
    at = lambda p: F.concat(F.lit(p), "id")
    datasets = o.select(F.concat(F.lit("https://dryad.example/dataset/doi:10.5061/d."), "id").alias("url"), doc(F.concat(F.lit(',"identifier":"doi:10.5061/d.'), "id", F.lit('","visibility":"public"')), self=at("/d/"), stash_version=at("/v/")).alias("body"))
    versions = o.select(doc(F.lit(',"title":"t","versionNumber":1'), self=at("/v/"), stash_dataset=F.when(F.col("o_orderkey") % 3 == 0, "/d/none").otherwise(at("/d/"))).alias("body"))
    li = t.lineitem.select("l_orderkey", F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key")).distinct()
    files = li.select(doc(F.concat(F.lit(',"path":"'), "key", F.lit('"')), self=F.concat(F.lit("/f/"), F.col("l_orderkey").cast("string"), F.lit("-"), "key"), stash_version=F.concat(F.lit("/v/"), F.col("l_orderkey").cast("string"))).alias("body"))
    return shown(S.scan_dryad(datasets, versions, files))


@query("scan_dspace", """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'), n AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'identity_mismatch' END AS rejected, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS files FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def _(t):
    o = t.orders.withColumn("id", F.col("o_orderkey").cast("string"))
    meta = F.create_map(F.lit("dc.title"), F.array(F.struct(F.lit("t").alias("value"))))
    items = o.select(F.concat(F.lit("https://s.example/items/"), "id").alias("url"), F.to_json(F.struct(F.col("id").alias("uuid"), F.lit(True).alias("inArchive"), (F.col("o_orderkey") % 3 == 0).alias("withdrawn"), meta.alias("metadata"))).alias("body"))
    li = t.lineitem.withColumn("name", F.when(F.col("l_returnflag") == "N", "ORIGINAL").otherwise("THUMBNAIL")).withColumn("bundle", F.concat_ws("/", F.col("l_orderkey").cast("string"), "name"))
    bundles = li.select(F.col("l_orderkey").cast("string").alias("item"), F.col("bundle").alias("uuid"), "name").distinct()
    key = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    bitstreams = li.select("bundle", key.alias("uuid"), F.lit("f.csv").alias("name"), F.lit(1).cast("bigint").alias("size")).distinct()
    return shown(S.scan_dspace(items, bundles, bitstreams))


@query("scan_datacite_dump", """SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS publisher, CASE doc_id % 4 WHEN 0 THEN 'no_attributes' WHEN 1 THEN 'no_title_or_url' ELSE '' END AS rejected, count(*) AS n FROM documents GROUP BY 1, 2""")
def _(t):
    k = F.col("doc_id") % 4
    attributes = F.struct(F.when(k == 2, F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))).alias("url"), F.when(k == 3, F.concat(F.lit("10.1234/"), F.col("doc_id").cast("string"))).alias("doi"), F.array(F.struct(F.when(k == 3, " ").otherwise(F.col("lang")).alias("title"))).alias("titles"), F.col("source").alias("publisher"))
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(k != 0, attributes).alias("attributes"))
    bodies = t.documents.groupBy("source", (F.col("doc_id") % 50).alias("page")).agg(F.collect_list(item).alias("data")).select(F.to_json(F.struct("data")).alias("body"))
    return S.scan_datacite_dump(bodies).groupBy("publisher", F.coalesce("rejected", F.lit("")).alias("rejected")).agg(F.count("*").alias("n"))


@query("unify_records", f"WITH {FILES} SELECT p AS platform, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS records, count(*) AS payloads FROM orders JOIN n ON l_orderkey = o_orderkey CROSS JOIN (VALUES ('zenodo'), ('figshare')) AS v(p) GROUP BY p")
def _(t):
    connectors = Registry("connector")
    connectors.register("zenodo", S.scan_zenodo)
    connectors.register("figshare", S.scan_figshare)
    every = S.unify_records(connectors.apply("zenodo", zenodo(t)), connectors.apply("figshare", figshare(t)))
    return every.groupBy("platform").agg(F.count_if(F.col("rejected").isNull()).alias("records"), F.count("*").alias("payloads"))


@query("register_connector", f"WITH {FILES} SELECT p AS connector, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS records FROM orders JOIN n ON l_orderkey = o_orderkey CROSS JOIN (VALUES ('figshare'), ('own')) AS v(p) GROUP BY p")
def _(t):
    connectors = Registry("connector")
    connectors.register("figshare", S.scan_figshare)
    connectors.register("own", lambda payloads: S.scan_zenodo(payloads).withColumn("platform", F.lit("own")))
    rows = S.unify_records(connectors.apply("figshare", figshare(t)), connectors.apply("own", zenodo(t)))
    return rows.groupBy(F.col("platform").alias("connector")).agg(F.count_if(F.col("rejected").isNull()).alias("records"))


@query("register_provider", "SELECT 'labels' AS provider, count(*) AS n FROM labels WHERE quality = 1 UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def _(t):
    from lodestack.operators.tables import combine_providers, provider_results
    from lodestack.scratch import new_path
    from lodestack.sources.providers import register_provider

    root = new_path(t.spark, "provider")
    t.labels.select("doc_id", "quality").write.parquet(root)  # what the provider answers, a file a page

    def pages(options):
        import os

        path = options["path"].removeprefix("file://").removeprefix("file:")
        return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet"))

    def read(options, page, wanted):
        import pyarrow.parquet as pq

        rows = pq.read_table(page, filters=[(c, "=", v) for c, v in wanted.items()] or None)
        yield from zip(*(rows.column(c).to_pylist() for c in ("doc_id", "quality")), strict=True)

    register_provider(t.spark, "labels_provider", "doc_id long, quality int", pages, read)
    readers = Registry("provider")
    readers.register("labels", lambda: t.spark.read.format("labels_provider").option("path", root).load().filter("quality = 1").select(F.col("doc_id").alias("id")))
    readers.register("benchmark", lambda: t.benchmark.select(F.col("item_id").alias("id")))
    status = t.spark.range(1).select(F.lit("labels").alias("provider"), F.lit(True).alias("ok"))
    rows, _w = combine_providers(*provider_results({n: readers.apply(n) for n in ("labels", "benchmark")}), status)
    return rows.groupBy("provider").agg(F.count("*").alias("n"))


# JSON-LD


def jsonld_pages(t):
    """Pages with a graph of a dataset, its publisher and, on every third page, a second dataset."""
    i = F.col("page_id").cast("string")
    data = F.concat(F.lit('{"@id":"#d","@type":"Dataset","name":"Data '), i, F.lit('","publisher":{"@id":"#p"},"mainEntityOfPage":"x","distribution":[{"contentUrl":"https://x.example/'), i, F.lit('.csv","encodingFormat":"text/csv"}]}'))
    other = F.when(F.col("page_id") % 3 == 0, ',{"@id":"#e","@type":"Dataset","name":"Other","mainEntityOfPage":"y"}').otherwise("")
    graph = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@graph":['), data, other, F.lit(',{"@id":"#p","@type":"Organization","name":"Press","parent":{"@id":"#d"}},{"@id":"#d","name":"Later '), i, F.lit('"}]}</script><script type="application/ld+json">{bad</script>'))
    return t.pages.select("page_id", "url", F.concat("html", graph).alias("html"))


@query("extract_jsonld", "SELECT page_id, true AS valid, count(*) AS n FROM pages GROUP BY page_id UNION ALL SELECT page_id, false, count(*) FROM pages GROUP BY page_id")
def _(t):
    return H.jsonld_blocks(jsonld_pages(t)).groupBy("page_id", "valid").agg(F.count("*").alias("n"))


@query("jsonld_resolve", "SELECT page_id, 'Later ' || page_id AS name, 'Press' AS publisher_name FROM pages")
def _(t):
    merged = J.merge_nodes(J.nodes(H.jsonld_blocks(jsonld_pages(t)), "page_id"), "page_id")
    found = J.resolve_references(merged, "page_id").filter("id = '#d'")
    name = F.max(F.when((F.col("path") == "") & (F.col("key") == "name"), F.col("value")))
    press = F.max(F.when((F.col("path") == "publisher") & (F.col("key") == "name"), F.col("value")))
    return found.groupBy("page_id").agg(name.alias("name"), press.alias("publisher_name"))


@query("jsonld_dataset", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '#d' END AS node, page_id % 3 = 0 AS ambiguous FROM pages")
def _(t):
    pages = jsonld_pages(t)
    merged = J.merge_nodes(J.nodes(H.jsonld_blocks(pages), "page_id"), "page_id")
    scores = J.dataset_scores(merged, "page_id", pages.select("page_id", F.lit(None).cast("string").alias("doi")), pages.select("page_id", "url"))
    return J.select_best_node(scores.withColumnRenamed("id", "node"), "page_id", "node", "score")


@query("jsonld_fields", "SELECT page_id, 'Later ' || page_id AS title FROM pages")
def _(t):
    merged = J.merge_nodes(J.nodes(H.jsonld_blocks(jsonld_pages(t)), "page_id"), "page_id")
    return J.dataset_fields(merged, "page_id").filter("id = '#d'").select("page_id", "title")


@query("schema_resources", "SELECT page_id, 'https://x.example/' || page_id || '.csv' AS link, 'text/csv' AS mime, 0.95::DOUBLE AS probability FROM pages")
def _(t):
    merged = J.merge_nodes(J.nodes(H.jsonld_blocks(jsonld_pages(t)), "page_id"), "page_id")
    return J.schema_resources(merged, "page_id").select("page_id", "link", "mime", "probability")


@query("write_catalog", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t):
    from lodestack.scratch import new_path
    from lodestack.sources.exports import read_catalog, write_catalog

    root = new_path(t.spark, "catalogue")
    write_catalog({"orders": t.orders.limit(0)}, root)
    write_catalog({"orders": t.orders}, root, {"orders": ["o_orderstatus"]})
    return read_catalog(t.spark, root, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("append_observations", "SELECT dataset_url, count(*) AS n FROM pv_obs GROUP BY dataset_url", "pv_obs")
def _(t):
    from lodestack.operators.merge import append_observations
    from lodestack.plans.base import observations
    from lodestack.scratch import new_path

    path = new_path(t.spark, "observations")
    append_observations(observations(t).filter("seq % 2 = 0"), path)
    append_observations(observations(t).filter("seq % 2 = 1"), path)
    return t.spark.read.parquet(path).groupBy("dataset_url").agg(F.count("*").alias("n"))
