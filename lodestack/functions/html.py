"""Page rules: links, fields, visible text, JSON-LD blocks, barriers, limits.

A page is read once by the state machine of ``markup``, which takes broken markup too; what was found in it
is judged in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import urls as U
from lodestack.functions.markup import page

MAX_LINKS, MAX_JSONLD = 2000, 32
#: Links to these are none. A fixed pattern.
NO_LINK = "^(mailto|tel|javascript|data):"


def visible_text(html: Column) -> Column:
    """Text without hidden elements, comments and tags; entities decoded, spaces collapsed."""
    return page(html, "text")["text"]


def plain_text(text: Column) -> Column:
    """Visible text of a description whose markup may itself be escaped."""
    return page(text, "text", escaped=True)["text"]


def element_texts(html: Column, tag: str) -> Column:
    """Texts of all h2 or h3 elements, in order; '' for one without text."""
    return F.transform(F.filter(page(html, "headings")["headings"], lambda h: h["tag"] == tag), lambda h: h["text"])


#: Names of meta elements that give the publisher, and names, properties and item properties that
#: give places. Fixed values.
PUBLISHER = ("publisher", "author", "citation_publisher")
PLACES = ("citation_country", "country", "countries", "coverage", "dc.coverage", "dc:coverage", "dcterms.coverage", "dcterms:coverage", "dcterms.spatial", "dcterms:spatial", "geo.country")
PLACE_ITEMS = ("country", "spatialcoverage", "contentlocation")


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, headings, descriptive fields, publisher, places and DOI of every page as columns.

    Places are split at commas and semicolons; the last citation DOI that is one counts."""
    from lodestack.operators.metadata import clean_strings, normalize_doi

    rows = pages.withColumn("_p", page(F.col(html), "title", "h1", "headings", "metas", "canonical"))
    rows = rows.withColumn("_m", F.filter(F.col("_p.metas"), lambda m: m["content"] != ""))
    of = lambda tag: F.filter("_p.headings", lambda h: (h["tag"] == tag) & (h["text"] != ""))
    heads = F.concat(of("h2"), of("h3"))
    first = lambda ok: F.coalesce(F.try_element_at(F.filter("_m", ok), F.lit(1))["content"], F.lit(""))
    place = lambda m: m["name"].isin(*PLACES) | m["property"].isin(*PLACES) | m["itemprop"].isin(*PLACE_ITEMS)
    dois = F.filter(F.transform(F.filter("_m", lambda m: m["name"] == "citation_doi"), lambda m: normalize_doi(m["content"])), lambda d: d.isNotNull())
    return rows.withColumns({
        "title": F.col("_p.title"), "h1": F.col("_p.h1"), "headings": F.transform(heads, lambda h: h["text"]),
        "description": first(lambda m: m["name"] == "description"), "og_title": first(lambda m: m["property"] == "og:title"), "og_description": first(lambda m: m["property"] == "og:description"),
        "publisher": first(lambda m: m["name"].isin(*PUBLISHER)), "geography": clean_strings(F.flatten(F.transform(F.filter("_m", place), lambda m: F.split(m["content"], "[,;]")))),
        "doi": F.coalesce(F.try_element_at(dois, F.lit(-1)), F.lit("")), "canonical": F.col("_p.canonical")}).drop("_m", "_p")


def scan_pages(spark: SparkSession, path: str, columns: tuple[str, ...] = ("page_id", "url", "html")) -> DataFrame:
    """Crawled pages with only the columns that are asked for; rows without url or html go."""
    rows = spark.read.parquet(path).select(*columns)
    for c in {"url", "html"} & set(columns):
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def page_to_links(html: str, url: str) -> Column:
    """The links of one page as an array of structs (pos, link, anchor), for LATERAL use on any table."""
    found = F.slice(page(F.col(html), "links")["links"], 1, MAX_LINKS)
    rows = F.transform(found, lambda a, i: F.struct(i.alias("pos"), a["href"].alias("href"), a["anchor"].alias("anchor")))
    rows = F.filter(rows, lambda r: (r["href"] != "") & ~F.lower(r["href"]).rlike(NO_LINK))
    rows = F.transform(rows, lambda r: F.struct(r["pos"].alias("pos"), U.canonical(r["href"], F.col(url)).alias("link"), r["anchor"].alias("anchor")))
    return F.filter(rows, lambda r: U.problem(r["link"]).isNull())


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", limit: int = MAX_LINKS) -> DataFrame:
    """One row per link: page columns, pos, link (canonical), anchor, extension, same_domain.

    Only http links; at most ``limit`` link elements of a page are read, in order."""
    keep = [c for c in pages.columns if c != html]
    each = pages.select(*keep, F.posexplode(F.slice(page(F.col(html), "links")["links"], 1, limit)).alias("pos", "_a"))
    each = each.filter((F.col("_a.href") != "") & ~F.lower("_a.href").rlike(NO_LINK))
    each = each.withColumn("link", U.canonical(F.col("_a.href"), F.col(url))).filter(U.problem(F.col("link")).isNull())
    extension = F.lower(F.regexp_extract(U.path(F.col("link")), r"(\.[A-Za-z0-9]+)$", 1))
    return each.select(*keep, "pos", "link", F.col("_a.anchor").alias("anchor"), extension.alias("extension"), (U.host(F.col("link")) == U.host(F.col(url))).alias("same_domain"))


def jsonld_blocks(pages: DataFrame, html: str = "html", limit: int = MAX_JSONLD) -> DataFrame:
    """One row per JSON-LD block: page columns, block, body, valid."""
    keep = [c for c in pages.columns if c != html]
    each = pages.select(*keep, F.posexplode(F.slice(page(F.col(html), "jsonld")["jsonld"], 1, limit)).alias("block", "body"))
    return each.withColumn("valid", F.try_parse_json("body").isNotNull())


def landing_barrier(html: Column) -> Column:
    """restricted for a password form, unconfirmed for a captcha or barrier text, else null."""
    from lodestack.functions.access import barrier

    seen = page(html, "text", "password", "captcha")
    return F.when(seen["password"], "restricted").otherwise(F.coalesce(barrier(seen["text"]), F.when(seen["captcha"], "unconfirmed")))


def limits_audit(pages: DataFrame, html: str = "html", max_chars: int = 2_000_000, max_links: int = MAX_LINKS, max_blocks: int = MAX_JSONLD) -> DataFrame:
    """(page columns, rule) for every limit that a page exceeds."""
    h = F.lower(F.col(html))
    rules = {"html_chars": F.length(html) > max_chars, "links": F.regexp_count(h, F.lit("<a\\s")) > max_links, "jsonld": F.regexp_count(h, F.lit("application/ld\\+json")) > max_blocks}
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return pages.select(*[c for c in pages.columns if c != html], F.explode(broken).alias("rule"))
