"""Format guesses and scores of links, and the resources of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import urls as U
from lodestack.scratch import let

#: Data file extensions and their formats, in order. Fixed values.
FORMATS = {
    ".csv": "CSV", ".tsv": "TSV", ".tab": "TSV", ".xls": "XLS", ".xlsx": "XLSX", ".json": "JSON", ".jsonl": "JSONL", ".xml": "XML",
    ".parquet": "PARQUET", ".zip": "ZIP", ".gz": "GZ", ".sav": "SAV", ".dta": "DTA", ".sas7bdat": "SAS7BDAT", ".geojson": "GEOJSON",
}
#: Extensions that never hold data, and words that hint at a download. Fixed values.
EXCLUDED = (".pdf", ".html", ".htm", ".png", ".jpg", ".jpeg", ".gif", ".svg")
TERMS = ("api", "data", "dataset", "download", "export", "file", "resource", "resources", "telecharger")
THRESHOLD = 0.35


def path_extension(url: Column) -> Column:
    """The longest known or excluded suffix of the path, '' if none."""
    def longest(p: Column) -> Column:
        out = F.lit("")
        for ext in sorted([*FORMATS, *EXCLUDED], key=len):
            out = F.when(F.endswith(p, F.lit(ext)), F.lit(ext)).otherwise(out)
        return out

    return let(F.lower(U.path(url)), longest)


def looks_like_api(url: Column, anchor: Column) -> Column:
    u, a = F.lower(url), F.lower(anchor)
    return F.contains(u, F.lit("/api/")) | F.startswith(a, F.lit("api/")) | F.contains(u, F.lit("format=json")) | F.contains(u, F.lit("export?"))


def format_guess(url: Column, anchor: Column, mime: Column) -> Column:
    """By path suffix, then by a whole word of the media type, then API markers, then query values."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    by_path = F.try_element_at(known, path_extension(url))
    by_mime = F.coalesce(*[F.when(F.lower(mime).rlike(rf"\b{e[1:]}\b"), F.lit(f)) for e, f in FORMATS.items()])
    values = F.transform(F.split(U.query_string(url), "&"), lambda p: F.lower(F.regexp_replace(p, "^[^=]*=", "")))
    by_query = F.array_max(F.transform(values, lambda v: F.try_element_at(known, F.concat(F.lit("."), F.regexp_extract(v, r"([a-z0-9]+)$", 1)))))
    return F.coalesce(by_path, by_mime, F.when(looks_like_api(url, anchor), "API"), by_query, F.lit("UNKNOWN"))


def score(url: Column, anchor: Column, nearby: Column, same_domain: Column, format_name: Column) -> Column:
    """Evidence that a link is a data resource, at most 1."""
    words = F.lower(F.concat_ws(" ", url, anchor, nearby))
    hits = F.size(F.filter(F.array(*map(F.lit, TERMS)), lambda w: F.contains(words, w)))
    total = F.when(format_name != "UNKNOWN", 55).otherwise(0) + F.when(looks_like_api(url, anchor), 35).otherwise(0) + F.least(F.lit(30), hits * 10) + F.when(same_domain, 5).otherwise(0)
    return F.least(F.lit(100), total) / F.lit(100.0)


def candidate_resources(links: DataFrame) -> DataFrame:
    """Links that may be data: adds format and probability; excluded and weak ones go."""
    rows = links.filter(~path_extension(F.col("link")).isin(*EXCLUDED))
    rows = rows.withColumn("format", format_guess(F.col("link"), F.col("anchor"), F.lit("")))
    rows = rows.withColumn("probability", score(F.col("link"), F.col("anchor"), F.lit(""), F.col("same_domain"), F.col("format")))
    return rows.filter(F.col("probability") >= THRESHOLD)


def rank_resources(rows: DataFrame, page: str, url: str = "link") -> DataFrame:
    """The best row of each (page, canonical url, format), best first."""
    rest = [c for c in rows.columns if c not in (page, url, "format")]
    best = rows.groupBy(page, url, "format").agg(F.max_by(F.struct(*rest), F.struct("probability", F.expr("-pos"))).alias("_b"))
    return best.select(page, url, "format", "_b.*")


def usable_resources(rows: DataFrame, url: str, mime: str) -> DataFrame:
    """Without excluded extensions, PDF and HTML media types."""
    kind = F.lower(F.trim(F.split_part(F.col(mime), F.lit(";"), F.lit(1))))
    return rows.filter(~path_extension(F.col(url)).isin(*EXCLUDED) & ~kind.isin("application/pdf", "text/html"))


def page_resources(links: DataFrame, schema: DataFrame, nodes: DataFrame, page: str) -> DataFrame:
    """Resources of each page, best first: entries of its dataset node and links that may be data.

    ``links`` is the page's links, ``schema`` its schema entries (page, id, link, mime, probability) and
    ``nodes`` one row per page with Dataset nodes: the chosen node, whether the choice is ambiguous
    and how many nodes there are.  An ambiguous page gives nothing; a page with several datasets gives only
    entries of the chosen one, as its links may belong to another."""
    chosen = nodes.select(page, F.col("node").alias("_node"), F.col("ambiguous").alias("_ambiguous"), F.col("datasets").alias("_n"))
    own = schema.join(chosen, page).filter(~F.col("_ambiguous") & (F.col("id") == F.col("_node")))
    own = own.withColumn("format", format_guess(F.col("link"), F.lit(""), F.col("mime")))
    entries = usable_resources(own, "link", "mime").select(page, "link", "format", F.col("probability").cast("double").alias("probability"), F.lit(-1).alias("pos"))
    free = links.join(chosen, page, "left").filter(F.coalesce(~F.col("_ambiguous") & (F.col("_n") <= 1), F.lit(True)))
    found = candidate_resources(free).select(page, "link", "format", F.col("probability").cast("double").alias("probability"), "pos")
    return rank_resources(entries.unionByName(found), page)
