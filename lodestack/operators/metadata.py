"""Record metadata: contracts, bounds, evidence, identity, dates, vocabulary indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import urls as U
from lodestack.functions.phrases import built
from lodestack.scratch import arrow_batches, settle

#: The ten metadata fields in order, and the mark of a missing one. Fixed values.
FIELDS = ("Title", "Geography", "Date of publication", "Dataset URL", "Disease(s)", "Size of dataset", "Demographic information", "Sharing license", "Modality of data", "Description of dataset")
MISSING = "NA"
#: Greatest lengths of candidate fields. Fixed values.
LIMITS = {"title": 500, "url": 2083, "description": 20_000, "source": 100, "publisher": 500, "date": 100, "doi": 500}
#: Vocabulary terms, about, that a task holds at once.
PART = 200_000
MAX_KEYWORDS, MAX_KEYWORD_CHARS, MAX_BYTES = 100, 200, 100_000


def first_filled(*columns: str) -> Column:
    """First non-blank column, trimmed; '' if all are blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def clean_strings(items: Column) -> Column:
    """Trimmed, non-blank, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def metadata_contract(values: dict[str, Column]) -> Column:
    """The ten-field map; text is trimmed, arrays are cleaned and joined, blanks are NA."""
    def text(c: Column | None) -> Column:
        return F.lit(MISSING) if c is None else F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(MISSING))

    return F.create_map(*[x for f in FIELDS for x in (F.lit(f), text(values.get(f)))])


def joined(items: Column) -> Column:
    return F.array_join(clean_strings(items), ", ")


def bound_candidates(rows: DataFrame, keywords: str | None = None) -> DataFrame:
    """Cut every known field to its limit, and keywords to 100 of 200 characters."""
    out = rows.withColumns({c: F.substring(c, 1, n) for c, n in LIMITS.items() if c in rows.columns})
    if keywords:
        out = out.withColumn(keywords, F.transform(F.slice(keywords, 1, MAX_KEYWORDS), lambda k: F.substring(k, 1, MAX_KEYWORD_CHARS)))
    return out


def bound_bytes(metadata: Column, limit: int = MAX_BYTES, rounds: int = 24) -> Column:
    """While the compact JSON is too large, halve the longest value (first key on ties)."""
    def size(m: Column) -> Column:
        return F.octet_length(F.to_json(m))

    def halve(m: Column, _: Column) -> Column:
        longest = F.array_max(F.transform(F.map_values(m), lambda v: F.length(v)))
        key = F.array_min(F.map_keys(F.map_filter(m, lambda k, v: F.length(v) == longest)))
        return F.when(size(m) <= limit, m).otherwise(F.transform_values(m, lambda k, v: F.when(k == key, F.substring(v, F.lit(1), F.floor(F.length(v) / 2).cast("int"))).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), metadata, halve)


def filter_candidates(rows: DataFrame, title: str, url: str, texts: list[str]) -> DataFrame:
    """All rows with verdict kept or rejected: a title, a usable url of at most 2083 characters,
    and valid text without NUL everywhere."""
    ok = F.lit(True)
    for c in {title, url, *texts}:
        ok = ok & F.is_valid_utf8(F.coalesce(c, F.lit(""))) & ~F.contains(F.coalesce(c, F.lit("")), F.lit("\0"))
    ok = ok & (F.trim(title) != "") & U.problem(F.col(url)).isNull() & (F.length(url) <= LIMITS["url"])
    return rows.withColumn("verdict", F.when(F.coalesce(ok, F.lit(False)), "kept").otherwise("rejected"))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def source_identity(pages: DataFrame, platforms: DataFrame, url: str) -> DataFrame:
    """Platform of every page by the longest listed domain of its host; '' if none is listed.

    An equi-join on the host's domains, so the dimension may be of any size."""
    each = pages.select(U.host(F.col(url)).alias("_host")).distinct().withColumn("domain", F.explode(_suffixes(F.col("_host"))))
    hosts = each.join(platforms, "domain").groupBy("_host").agg(F.max_by("platform", F.length("domain")).alias("platform"))
    out = pages.withColumn("_host", U.host(F.col(url))).join(hosts, "_host", "left")
    return out.withColumn("platform", F.coalesce("platform", F.lit(""))).drop("_host")


def route_records(records: DataFrame, rules: DataFrame, key: str, url: str) -> DataFrame:
    """The first matching rule (priority, connector, domain, path_rule) of every url."""
    each = records.withColumn("domain", F.explode(_suffixes(U.host(F.col(url)))))
    hit = each.join(rules, "domain").filter((F.col("path_rule") == "") | F.regexp_like(U.path(F.col(url)), F.col("path_rule")))
    return hit.groupBy(key).agg(F.min_by("connector", "priority").alias("connector"))


def normalize_doi(value: Column) -> Column:
    """Lower-cased DOI without resolver or prefix; null if it is none."""
    raw = F.coalesce(F.try_url_decode(F.trim(value)), F.trim(value))
    bare = F.lower(F.regexp_replace(raw, r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S+$"), bare)


def evidence_conflicts(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of a record with more than one distinct non-blank value."""
    filled = evidence.filter(F.coalesce("value", F.lit("")) != "")
    return filled.groupBy(*keys).agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_evidence"))


def publication_dates(dates: DataFrame, key: str) -> DataFrame:
    """One date per record from rows (kind, rank, date): the best rank that has a date."""
    good = dates.filter("date is not null")
    return good.groupBy(key).agg(F.min_by(F.struct("kind", "date"), F.struct("rank", "date")).alias("_d")).select(key, F.col("_d.kind").alias("rule"), F.col("_d.date").alias("date"))


def normalized(text: Column) -> Column:
    """Words of a text side by side: lower-cased, without markup, other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "<[^>]*>", " ")), r"[^\p{L}\p{N}]+", " "))


def tag_terms(docs: DataFrame, vocabulary: DataFrame, key: str, text: str, subjects: str | None = None, part: int = PART) -> DataFrame:
    """(key, kind, terms): whole-word vocabulary terms (term, kind) of every document, of any number of words.

    Where a document's ``subjects`` (array) hold terms of a kind, only those count for the kind; a term does
    not reach from one subject into the next.  The vocabulary is dealt into parts of about ``part`` terms, and
    an automaton of each part reads every text once, so nothing is made per word of a text."""
    spark = docs.sparkSession
    terms = vocabulary.select(normalized(F.col("term")).alias("term"), "kind").filter("term <> ''")
    terms = settle(terms.groupBy("term").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), "terms")
    parts = max(1, -(-terms.count() // part))
    own = F.transform(F.coalesce(F.col(subjects), F.array().cast("array<string>")), normalized) if subjects else F.array().cast("array<string>")
    lines = docs.select(F.col(key).alias("key"), normalized(F.coalesce(F.col(text), F.lit(""))).alias("text"), own.alias("subjects"))
    kind = dict(docs.dtypes)[key]

    def finder(name: str, rows: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases, listed = built(name, rows), rows.value
            for b in batches:
                at, ranks, kinds, found = [], [], [], []
                for i, (text, heads) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    here = {n for h in heads if h for n in phrases.find(h.split(" "))}
                    for rank, ns in ((0, here), (1, phrases.find(text.split(" ")))):
                        for n in ns:
                            for k in listed[n][1]:
                                at.append(i)
                                ranks.append(rank)
                                kinds.append(k)
                                found.append(listed[n][0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(ranks, pa.int32()), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["key", "rank", "kind", "term"])

        return run

    hit = None
    with arrow_batches(spark, 256):
        for i in range(parts):
            rows = spark.sparkContext.broadcast([(r.term, r.kinds) for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect()])  # about ``part`` terms
            found = settle(lines.mapInArrow(finder(uuid4().hex, rows), f"key {kind}, rank int, kind string, term string"), "tagged")
            hit = found if hit is None else hit.unionByName(found)
            rows.unpersist()
    best = hit.groupBy("key", "kind", "rank").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))
    return best.groupBy(F.col("key").alias(key), "kind").agg(F.min_by("terms", "rank").alias("terms"))


def dataset_sizes(docs: DataFrame, key: str, text: str, units: tuple[str, ...]) -> DataFrame:
    """Mentions such as "1,200 patients" or "n = 50 records" per document and unit."""
    pattern = rf"(?i)\b([0-9][0-9,]*)\s+({'|'.join(units)})\b"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("unit"))
    each = docs.select(key, F.explode(found).alias("m")).select(key, F.replace(F.col("m.n"), F.lit(","), F.lit("")).try_cast("bigint").alias("n"), F.lower(F.col("m.unit")).alias("unit"))
    return each.filter("n is not null").groupBy(key, "unit").agg(F.max("n").alias("largest"), F.sum("n").alias("total"))


def coordinate(value: Column, maximum: int) -> Column:
    """A number within its bounds from text or number, else null."""
    n = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) <= maximum), n)


def geo_point(lat: Column, lon: Column) -> Column:
    """"lat, lon" of a point inside the bounds, else null."""
    ok = coordinate(lat, 90).isNotNull() & coordinate(lon, 180).isNotNull()
    return F.when(ok, F.concat_ws(", ", F.trim(lat.cast("string")), F.trim(lon.cast("string"))))


def geo_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    """"south, west to north, east" of a box inside the bounds; west may exceed east (antimeridian)."""
    return F.when(coordinate(south, 90) <= coordinate(north, 90), F.concat(geo_point(south, west), F.lit(" to "), geo_point(north, east)))


def geography_index(records: DataFrame, key: str, places: Column, countries: Column, point: Column | None = None, box: Column | None = None) -> DataFrame:
    """(key, place): places, countries, point and box of every record, each once, blanks left out."""
    every = F.concat(F.coalesce(places, F.array().cast("array<string>")), F.coalesce(countries, F.array().cast("array<string>")), F.array(*[c for c in (point, box) if c is not None]).cast("array<string>"))
    return records.select(key, F.explode(clean_strings(every)).alias("place"))


def search_terms(text: Column) -> Column:
    """Query words without generic catalogue terms and their plurals; words keep their form."""
    generic = ("data", "dataset", "database")
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.array_join(F.filter(words, lambda w: ~bare(w).isin(*generic) & ~F.regexp_replace(bare(w), "s$", "").isin(*generic)), " ")


#: Greatest lengths and numbers of the classifier's input. Fixed values.
PAYLOAD = {"url": 2000, "short": 500, "description": 2000, "text": 4000, "value": 1000, "context": 300, "format": 100, "headings": 20, "distributions": 10}


def bounded_payload(page: dict[str, Column], headings: Column, metadata: Column, distributions: Column) -> Column:
    """The classifier's input: page fields by name, headings, metadata and distributions (structs of
    url, format, probability, anchor, mime_type, nearby_text), all cut to their limits."""
    kind = {"url": "url", "canonical_url": "url", "meta_description": "description", "og_description": "description", "text": "text"}
    cut = lambda c, k: F.substring(c, 1, PAYLOAD[k])
    limit = lambda k: F.when(k == "Description of dataset", PAYLOAD["description"]).when(k == "Dataset URL", PAYLOAD["url"]).when(k == "Title", PAYLOAD["short"]).otherwise(PAYLOAD["value"])
    fields = [cut(c, kind.get(n, "short")).alias(n) for n, c in page.items()]
    heads = F.transform(F.slice(headings, 1, PAYLOAD["headings"]), lambda h: cut(h, "short"))
    meta = F.transform_values(metadata, lambda k, v: F.substring(v, F.lit(1), limit(k)))
    parts = {"url": "url", "format": "format", "anchor": "context", "mime_type": "format", "nearby_text": "context"}
    resources = F.transform(F.slice(distributions, 1, PAYLOAD["distributions"]), lambda d: F.struct(d["probability"].alias("probability"), *[cut(d[n], k).alias(n) for n, k in parts.items()]))
    return F.struct(F.struct(*fields, heads.alias("headings"), meta.alias("metadata")).alias("page"), resources.alias("distributions"))


def public_label(value: Column, maximum: int = 200) -> Column:
    """The value if it is a plain label, else ''."""
    ok = value.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._:/+()-]*$") & (F.length(value) <= maximum) & ~F.contains(value, F.lit("://"))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise("")


def public_identifier(value: Column) -> Column:
    """A UUID in its plain form, from any of its spellings, else null."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"^(?i:urn:uuid:)", ""), r"[{}-]", ""))
    cut = [F.substring(bare, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *cut))


def public_timestamp(value: Column) -> Column:
    """An ISO timestamp of at most 64 characters that names its zone, as a timestamp, else null."""
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$") & (F.length(value) <= 64)
    return F.when(zoned, F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def sanitize_trace(traces: DataFrame, enums: dict[str, tuple[str, ...]], ranges: dict[str, tuple[int, int]], urls: list[str]) -> DataFrame:
    """Unknown enum values and out-of-range counters become null; urls are redacted."""
    cols = {c: F.when(F.col(c).isin(*v), F.col(c)) for c, v in enums.items()}
    cols |= {c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items()}
    cols |= {c: F.when(U.problem(F.col(c)).isNull(), U.redacted(F.col(c))).otherwise("") for c in urls}
    return traces.withColumns(cols)


def rebuild_diagnostics(rows: DataFrame, messages: DataFrame, code: str, position: str, key: str, limit: int = 20) -> DataFrame:
    """Unknown codes become processing_failed, messages come from the table, at most 20 a record."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(position))
    out = rows.withColumn("_n", rank).filter(F.col("_n") <= limit).drop("_n")
    known = messages.select(F.col("code").alias("_code"), "message")
    out = out.join(known, F.col(code) == F.col("_code"), "left")
    return out.withColumns({code: F.when(F.col("_code").isNull(), "processing_failed").otherwise(F.col(code)), "message": F.coalesce("message", F.lit("Processing could not be completed."))}).drop("_code")
