"""JSON-LD graphs as node tables: merging, local references, choice of the dataset node, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.metadata import normalize_doi


def nodes(blocks: DataFrame, page: str, body: str = "body") -> DataFrame:
    """(page, pos, id, key, value): one row per property of every node of valid blocks.

    A block is an object, an object with @graph, or an array of objects."""
    text = F.trim(F.col(body))
    graph = F.get_json_object(text, "$['@graph']")
    listed = F.when(F.startswith(text, F.lit("[")), text).when(graph.isNotNull(), graph).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    entries = F.from_json(listed, "array<string>")
    each = blocks.filter(F.try_parse_json(body).isNotNull()).select(page, "block", F.posexplode(entries).alias("n", "_entry"))
    each = each.withColumn("node", F.from_json("_entry", "map<string,string>")).filter("node is not null")
    each = each.withColumn("id", F.coalesce(F.try_element_at("node", F.lit("@id")), F.concat_ws("/", F.lit("_"), F.col("block").cast("string"), F.col("n").cast("string"))))
    return each.select(page, (F.col("block") * 100_000 + F.col("n")).alias("pos"), "id", F.explode("node").alias("key", "value")).filter("key <> '@id'")


def merge_nodes(rows: DataFrame, page: str) -> DataFrame:
    """Nodes of one page with the same id become one; a later value of a key wins."""
    return rows.groupBy(page, "id", "key").agg(F.max_by("value", "pos").alias("value"))


def resolve_references(merged: DataFrame, page: str, depth: int = 4) -> DataFrame:
    """(page, id, path, key, value): properties reached through local @id references.

    A reference is a value that is an object with nothing but @id.  Paths end at cycles and at
    ``depth``; references that leave the page stay as they are."""
    ref = F.get_json_object("value", "$['@id']")
    rows = merged.withColumn("ref", F.when(F.size(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))) == 1, ref))
    out = rows.select(page, "id", F.lit("").alias("path"), "key", "value", "ref", F.array("id").alias("seen"))
    found, edge = out, out
    target = rows.select(F.col(page).alias("_p"), F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("ref").alias("_ref"))
    for _ in range(depth):
        hop = edge.filter("ref is not null").join(target, (F.col(page) == F.col("_p")) & (F.col("ref") == F.col("_id"))).filter(~F.array_contains("seen", F.col("ref")))
        edge = hop.select(page, "id", F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("_key").alias("key"), F.col("_value").alias("value"), F.col("_ref").alias("ref"), F.concat("seen", F.array("ref")).alias("seen"))
        found = found.unionByName(edge)
    return found.drop("ref", "seen")


def dataset_scores(merged: DataFrame, page: str, doi: DataFrame, url: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """Identity score of each Dataset node: 8 for the page's DOI, 4 for one of the page's own
    identifiers (``native``: page, native_id), 2 for mainEntity, 1 for its url."""
    typed = merged.groupBy(page, "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    own = typed.filter(F.coalesce(F.try_element_at("m", F.lit("@type")), F.lit("")).rlike(r"\bDataset\b"))
    j = own.join(doi, page, "left").join(url, page, "left")
    if native is None:
        j = j.withColumn("natives", F.array().cast("array<string>"))
    else:
        j = j.join(native.groupBy(page).agg(F.collect_set("native_id").alias("natives")), page, "left")
    named = F.concat_ws(" ", F.try_element_at("m", F.lit("identifier")), F.try_element_at("m", F.lit("sameAs")), "id")
    has_doi = F.col("doi").isNotNull() & F.contains(F.lower(named), F.col("doi"))
    values = F.array_compact(F.array(F.col("id"), *[F.try_element_at("m", F.lit(k)) for k in ("identifier", "sameAs", "url")]))
    values = F.flatten(F.transform(values, lambda v: F.coalesce(F.when(F.startswith(F.trim(v), F.lit("[")), F.from_json(v, "array<string>")), F.array(F.coalesce(F.get_json_object(v, "$.value"), v)))))
    known = F.coalesce(F.arrays_overlap(values, "natives"), F.lit(False))
    score = F.when(has_doi, 8).otherwise(0) + F.when(known, 4).otherwise(0) + F.when(F.try_element_at("m", F.lit("mainEntityOfPage")).isNotNull(), 2).otherwise(0) + F.when(F.try_element_at("m", F.lit("url")) == F.col("url"), 1).otherwise(0)
    return j.select(page, "id", score.alias("score"))


def select_best_node(scores: DataFrame, page: str, node: str, score: str) -> DataFrame:
    """The one node with the greatest positive score; a tie or zero is ambiguous.

    Counts of the maximum combine in one aggregation per score and one per page."""
    per = scores.groupBy(page, score).agg(F.count("*").alias("n"), F.min(node).alias("_node"))
    top = per.groupBy(page).agg(F.max_by(F.struct("n", "_node", score), F.col(score)).alias("t"))
    sure = (F.col(f"t.{score}") > 0) & (F.col("t.n") == 1)
    return top.select(page, F.when(sure, F.col("t._node")).alias(node), (~sure).alias("ambiguous"))


def dataset_fields(merged: DataFrame, page: str) -> DataFrame:
    """Title, publisher, date, license, DOI, size and geography of each node by key preference."""
    m = merged.groupBy(page, "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))

    def pick(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.try_element_at("m", F.lit(k))), F.lit("")) for k in keys])

    def named(c: Column) -> Column:
        return F.coalesce(F.get_json_object(c, "$.name"), c)

    return m.select(page, "id", pick("name", "headline").alias("title"), named(pick("publisher", "provider", "creator")).alias("publisher"), pick("datePublished", "dateCreated", "dateModified").alias("date"), named(pick("license")).alias("license"), normalize_doi(F.coalesce(pick("identifier"), pick("sameAs"), F.lit(""))).alias("doi"), pick("contentSize", "size").alias("size"), named(pick("spatialCoverage", "spatial")).alias("geography"))


def schema_resources(merged: DataFrame, page: str) -> DataFrame:
    """Distribution entries of every node: url, mime and the fixed probability 0.95."""
    raw = merged.filter("key = 'distribution'")
    listed = F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    each = raw.select(page, "id", F.explode(F.from_json(listed, "array<struct<contentUrl:string,url:string,encodingFormat:string,name:string>>")).alias("d"))
    return each.select(page, "id", F.coalesce("d.contentUrl", "d.url").alias("link"), F.coalesce("d.encodingFormat", F.lit("")).alias("mime"), F.lit(0.95).alias("probability")).filter("link is not null")
