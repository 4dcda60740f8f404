"""Records, pages and listings: lookup, scoping, merging, enrichment, and per-record indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.metadata import MISSING
from lodestack.operators.tables import with_children

#: Most ids in one lookup, and most items in one listing. Fixed values.
MAX_IDS, MAX_ITEMS = 100, 10_000


def catalog_by_ids(datasets: DataFrame, ids: DataFrame, key: str, children: DataFrame, order: Column, fields: list[str], most: int = MAX_IDS) -> DataFrame:
    """Datasets of at most ``most`` positive ids (the greatest), newest id first, children nested.

    ``ids`` and ``children`` have the column ``key``.  Missing ids are left out; both sides are cut
    down to the ids before anything is gathered."""
    wanted = ids.filter(F.col(key) > 0).select(key).distinct().orderBy(F.desc(key)).limit(most)
    own = datasets.join(wanted, key, "left_semi")
    return with_children(own, children.join(wanted, key, "left_semi"), key, order, fields).orderBy(F.desc(key))


def assemble_listing(records: DataFrame, pages: DataFrame, key: str, declared: str, page: str, total: str, items: str, most: int = MAX_ITEMS) -> DataFrame:
    """(key, items, verdict, files) of paginated listings.

    ``pages`` has one row per page with its number, the total it states and an array of items; a
    record declares its own total.  A listing is rejected when a page comes twice, the stated total
    changes between pages, the items are not as many as stated and declared, or are too many; only
    accepted listings have files, in page order."""
    size = F.size(F.coalesce(F.col(items), F.array()))
    held = pages.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct(page).alias("_pages"), F.count_distinct(total).alias("_totals"), F.max(total).alias("_total"),
                                  F.sum(size).alias("_items"), F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(items).alias("i")))).alias("_files"))
    j = records.select(key, declared).join(held, key, "left").withColumn("items", F.coalesce("_items", F.lit(0)))
    verdict = (F.when(F.col("_n") != F.col("_pages"), "repeated_page").when(F.col("_totals") > 1, "changed_total").when(F.col("items") > most, "too_many")
               .when((F.col("items") != F.coalesce("_total", F.lit(0))) | (F.col("items") != F.col(declared)), "wrong_total").otherwise("ok"))
    files = F.flatten(F.transform("_files", lambda x: x["i"]))
    return j.withColumn("verdict", verdict).select(key, "items", "verdict", F.when(F.col("verdict") == "ok", files).alias("files"))


def page_from_candidate(candidates: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Page fields rebuilt from a candidate's ten-field metadata map.

    The candidate's own title, url and description fill what the map lacks; places are split at commas."""
    own = lambda name: F.nullif(F.trim(F.coalesce(F.try_element_at(metadata, F.lit(name)), F.lit(""))), F.lit(MISSING))
    filled = lambda name, c: F.coalesce(F.nullif(own(name), F.lit("")), F.col(c), F.lit(""))
    places = F.filter(F.transform(F.split(F.coalesce(own("Geography"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return candidates.withColumns({"page_title": filled("Title", "title"), "page_url": filled("Dataset URL", "url"), "page_text": filled("Description of dataset", "description"), "places": places})


def scope_resources(files: DataFrame, known: DataFrame, url: str, belongs: Column) -> DataFrame:
    """Files of the requested version: those whose url the record lists, else those that ``belongs`` names."""
    listed = known.select(url).distinct().withColumn("_listed", F.lit(True))
    return files.join(listed, url, "left").filter(F.col("_listed") | belongs).drop("_listed")


def merge_record_metadata(pages: DataFrame, records: DataFrame, key: str, fields: list[str], texts: list[str]) -> DataFrame:
    """Pages with blank ``fields`` filled from their record and ``texts`` of both joined by a space.

    A page without a record stays as it is."""
    other = records.select(key, *[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*fields, *texts])])
    j = pages.join(other, key, "left")
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}"), F.lit("")) for c in fields}
    both = {c: F.concat_ws(" ", F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(f"_{c}"), F.lit(""))) for c in texts}
    return j.withColumns(filled | both).select(*pages.columns)


def enrich_from_repository(pages: DataFrame, found: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Blank page fields filled with the earliest value that a repository states for the page's dataset.

    Conflicting values are kept as evidence: ``evidence`` has (field, distinct values in order) of all
    fields, and a field with several values is still filled with the first."""
    state = [F.min_by(c, F.when(F.trim(c) != "", F.col(order))).alias(f"_{c}") for c in fields]
    held = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda x: x["v"])).alias(f"_all_{c}") for c in fields]
    j = pages.join(found.groupBy(key).agg(*state, *held), key, "left")
    evidence = F.array_compact(F.array(*[F.when(F.size(f"_all_{c}") > 0, F.struct(F.lit(c).alias("field"), F.col(f"_all_{c}").alias("values"))) for c in fields]))
    out = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}"), F.lit("")) for c in fields}
    return j.withColumns(out | {"evidence": evidence}).select(*pages.columns, "evidence")


def existing_results(candidates: DataFrame, jobs: DataFrame, datasets: DataFrame, observations: DataFrame) -> DataFrame:
    """(candidate_id, dataset_id) for candidates (candidate_id, url, source_url) without a job: datasets
    at their url, and datasets that were observed at their source url."""
    free = candidates.join(jobs.select("candidate_id").distinct(), "candidate_id", "left_anti")
    by_url = free.join(datasets.select("url", "dataset_id"), "url").select("candidate_id", "dataset_id")
    seen = free.join(observations.select("source_url", "dataset_id").distinct(), "source_url").select("candidate_id", "dataset_id")
    return by_url.union(seen).distinct()


def best_texts(texts: DataFrame, key: str, text: str, kind: str, pos: str, preferred: str) -> DataFrame:
    """The first non-blank text of the preferred kind of each record, else its first non-blank one."""
    filled = texts.filter(F.trim(text) != "")
    return filled.groupBy(key).agg(F.min_by(F.col(text), F.struct(F.when(F.col(kind) == preferred, 0).otherwise(1), F.col(pos))).alias(text))


def license_index(records: DataFrame, key: str, lists: list[str], singles: list[str]) -> DataFrame:
    """(key, license): every license of a record once, from array and single fields, trimmed."""
    every = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists], F.array(*[F.col(c) for c in singles])))
    each = records.select(key, F.explode(every).alias("license")).select(key, F.trim("license").alias("license"))
    return each.filter(F.coalesce("license", F.lit("")) != "").dropDuplicates()


def modality_index(records: DataFrame, key: str, formats: str, modes: DataFrame) -> DataFrame:
    """(key, modality): modalities (token, modality) of the words in a record's format texts."""
    tokens = records.select(key, F.explode(F.array_distinct(F.split(F.lower(formats), r"[^a-z0-9]+"))).alias("token"))
    return tokens.join(modes.select(F.lower("token").alias("token"), "modality").distinct(), "token").select(key, "modality").distinct()
