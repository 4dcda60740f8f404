"""Repository payloads to one common record schema.

Input: payloads(url, body, ...) with one JSON document per row.  Each scan parses with an explicit
schema, checks that the document belongs to the requested record, and returns every input row with
either a record or the reason it was rejected, so rejects can be counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import urls as U
from lodestack.functions.html import plain_text
from lodestack.operators.metadata import normalize_doi

FILE = "struct<link:string,name:string,mime:string,size:bigint,restricted:boolean>"
RECORD = ("url", "platform", "kind", "native_id", "persistent_id", "version", "title", "description", "publisher", "publication_date", "license", "doi", "resources", "rejected")
MAX_FILES = 10_000


def _t(c: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def _finish(df: DataFrame, platform: str, values: dict[str, Column], rejected: Column) -> DataFrame:
    """Common columns; values of rejected rows are blank."""
    cols = [F.col("url"), F.lit(platform).alias("platform")]
    for name in RECORD[2:-2]:
        v = values.get(name, F.lit(""))
        cols.append(F.when(rejected.isNull(), v).otherwise("").alias(name))
    files = values["resources"].cast(f"array<{FILE}>")
    return df.select(*cols, F.when(rejected.isNull(), files).otherwise(F.array().cast(f"array<{FILE}>")).alias("resources"), rejected.alias("rejected"))


def _file(link: Column, name: Column, mime: Column, size: Column, restricted: Column) -> Column:
    return F.struct(link.alias("link"), name.alias("name"), mime.alias("mime"), size.cast("bigint").alias("size"), F.coalesce(restricted, F.lit(False)).alias("restricted"))


def _bad_files(files: Column, key) -> Column:
    """Missing listing, too many files, or a blank or repeated key."""
    keys = F.transform(files, key)
    return files.isNull() | (F.size(files) > MAX_FILES) | F.exists(keys, lambda k: F.coalesce(k, F.lit("")) == "") | (F.size(F.array_distinct(keys)) != F.size(keys))


def scan_datacite_dump(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Rows of index responses {"data": [{id, attributes}]}: one row per listed record.

    A record without attributes, or without any title or url, is kept with its reject reason; a
    body that is no such response gives one row with reason ``invalid_response``."""
    attributes = "doi string, url string, titles array<struct<title:string>>, descriptions array<struct<description:string,descriptionType:string>>, publisher string, publicationYear string, dates array<struct<date:string,dateType:string>>, subjects array<struct<subject:string>>"
    items = F.from_json(F.get_json_object(body, "$.data"), f"array<struct<id:string,attributes:struct<{', '.join(x.replace(' ', ':', 1) for x in attributes.split(', '))}>>>")
    each = bodies.select(F.posexplode_outer(F.when(F.startswith(F.get_json_object(body, "$.data"), F.lit("[")), items)).alias("pos", "r"))
    a = lambda f: F.col(f"r.attributes.{f}")
    doi = F.coalesce(normalize_doi(F.coalesce(a("doi"), F.col("r.id"))), F.lit(""))
    own = U.canonical(a("url"))
    url = F.when(a("url").isNotNull() & U.problem(a("url")).isNull(), own).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    first = F.coalesce(F.try_element_at(F.filter(F.transform(a("titles"), lambda x: _t(x["title"])), lambda x: x != ""), F.lit(1)), F.lit(""))
    title = F.when(first != "", first).otherwise(url)
    abstracts = F.filter(a("descriptions"), lambda x: (x["descriptionType"] == "Abstract") & (_t(x["description"]) != ""))
    others = F.filter(a("descriptions"), lambda x: _t(x["description"]) != "")
    text = F.coalesce(F.try_element_at(abstracts, F.lit(1))["description"], F.try_element_at(others, F.lit(1))["description"], F.lit(""))
    dates = F.coalesce(F.try_element_at(F.filter(a("dates"), lambda d: d["dateType"] == "Issued"), F.lit(1)), F.try_element_at(a("dates"), F.lit(1)))
    keywords = F.coalesce(F.array_distinct(F.filter(F.transform(a("subjects"), lambda s: _t(s["subject"])), lambda s: s != "")), F.array().cast("array<string>"))
    rejected = F.when(F.col("pos").isNull(), "invalid_response").when(F.col("r.attributes").isNull(), "no_attributes").when((title == "") | (url == ""), "no_title_or_url")
    return each.select("pos", title.alias("title"), plain_text(text).alias("description"), url.alias("url"), F.lit("DataCite").alias("source"), _t(a("publisher")).alias("publisher"), F.coalesce(F.nullif(_t(a("publicationYear")), F.lit("")), dates["date"], F.lit("")).alias("date"), doi.alias("doi"), keywords.alias("keywords"), rejected.alias("rejected"))


def scan_zenodo(payloads: DataFrame) -> DataFrame:
    """Records whose id, or concept id for a DOI url, is the requested one; one file or all."""
    schema = "id string, conceptrecid string, conceptdoi string, doi string, metadata struct<title:string,description:string,publication_date:string,version:string,access_right:string,publisher:string,license:struct<id:string>>, files array<struct<key:string,size:bigint,mimetype:string,links:struct<self:string,content:string>>>"
    p = payloads.withColumn("r", F.from_json("body", schema))
    wanted = F.regexp_extract("url", r"(?:/records?/|zenodo\.)([0-9]+)", 1)
    file = F.coalesce(F.try_url_decode(F.regexp_extract("url", r"/files/([^/?#]+)", 1)), F.lit(""))
    concept = F.lower("url").rlike("/doi/") & (F.col("r.conceptrecid") == wanted)
    files = F.filter("r.files", lambda f: (file == "") | (f["key"] == file))
    closed = F.col("r.metadata.access_right").isin("restricted", "closed", "embargoed")
    resources = F.transform(files, lambda f: _file(F.coalesce(f["links"]["content"], f["links"]["self"]), f["key"], _t(f["mimetype"]), f["size"], closed))
    rejected = F.when(F.col("r").isNull() | F.col("r.id").isNull(), "invalid_response").when(~((F.col("r.id") == wanted) | F.coalesce(concept, F.lit(False))), "identity_mismatch").when(_t(F.col("r.metadata.title")) == "", "no_title").when(F.coalesce(_bad_files(F.col("r.files"), lambda f: f["key"]), F.lit(True)), "invalid_files").when((file != "") & (F.size(files) == 0), "file_missing")
    doi = F.coalesce(normalize_doi(_t(F.col("r.doi"))), F.lit(""))
    return _finish(p, "zenodo", {"kind": F.when(file != "", "file").otherwise("dataset"), "native_id": F.when(file != "", F.concat_ws("/", "r.id", F.lit("files"), file)).otherwise(F.col("r.id")), "persistent_id": F.when(file == "", doi).otherwise(""), "version": _t(F.col("r.metadata.version")), "title": F.when(file != "", file).otherwise(_t(F.col("r.metadata.title"))), "description": plain_text(_t(F.col("r.metadata.description"))), "publisher": _t(F.col("r.metadata.publisher")), "publication_date": _t(F.col("r.metadata.publication_date")), "license": _t(F.col("r.metadata.license.id")), "doi": F.when(file == "", doi).otherwise(""), "resources": resources}, rejected)


def scan_figshare(payloads: DataFrame) -> DataFrame:
    """Articles whose id, and version where the url pins one, is the requested one."""
    schema = "id string, version string, doi string, title string, description string, published_date string, publisher string, license struct<name:string>, is_embargoed boolean, files array<struct<id:string,name:string,size:bigint,mimetype:string,download_url:string>>"
    p = payloads.withColumn("r", F.from_json("body", schema))
    wanted, pinned = F.regexp_extract("url", r"/([0-9]+)(?:/[0-9]+)?/?(?:[?#].*)?$", 1), F.regexp_extract("url", r"/[0-9]+/([0-9]+)/?(?:[?#].*)?$", 1)
    resources = F.transform("r.files", lambda f: _file(f["download_url"], f["name"], _t(f["mimetype"]), f["size"], F.col("r.is_embargoed")))
    rejected = F.when(F.col("r").isNull() | F.col("r.id").isNull(), "invalid_response").when((F.col("r.id") != wanted) | F.col("r.version").isNull() | ((pinned != "") & (F.col("r.version") != pinned)), "identity_mismatch").when(_t(F.col("r.title")) == "", "no_title").when(F.coalesce(_bad_files(F.col("r.files"), lambda f: f["id"]), F.lit(True)), "invalid_files")
    doi = F.coalesce(normalize_doi(_t(F.col("r.doi"))), F.lit(""))
    return _finish(p, "figshare", {"kind": F.lit("dataset"), "native_id": F.col("r.id"), "persistent_id": doi, "version": F.col("r.version"), "title": _t(F.col("r.title")), "description": plain_text(_t(F.col("r.description"))), "publisher": _t(F.col("r.publisher")), "publication_date": _t(F.col("r.published_date")), "license": _t(F.col("r.license.name")), "doi": doi, "resources": resources}, rejected)


def scan_dataverse(payloads: DataFrame) -> DataFrame:
    """Datasets (latest version with its files) or single files, checked against persistentId."""
    data_file = "dataFile:struct<id:string,filename:string,contentType:string,persistentId:string,filesize:bigint>"
    schema = f"status string, data struct<id:string,persistentId:string,label:string,restricted:boolean,{data_file},latestVersion:struct<versionNumber:int,versionMinorNumber:int,releaseTime:string,license:struct<name:string>,metadataBlocks:struct<citation:struct<fields:array<struct<typeName:string,value:string>>>>,files:array<struct<label:string,restricted:boolean,{data_file}>>>>"
    p = payloads.withColumn("r", F.from_json("body", schema))
    is_file = F.contains(F.col("url"), F.lit("/file.xhtml"))
    pid = F.coalesce(F.try_url_decode(F.regexp_extract("url", r"[?&]persistentId=([^&#]*)", 1)), F.lit(""))
    one = F.array(F.struct(F.col("r.data.label").alias("label"), F.col("r.data.restricted").alias("restricted"), F.col("r.data.dataFile").alias("dataFile")))
    files = F.when(is_file, one).otherwise(F.col("r.data.latestVersion.files"))
    origin = F.concat(F.lit("https://"), U.host(F.col("url")))
    resources = F.transform(files, lambda f: _file(F.concat(origin, F.lit("/api/access/datafile/"), f["dataFile"]["id"]), F.coalesce(F.nullif(_t(f["dataFile"]["filename"]), F.lit("")), _t(f["label"])), _t(f["dataFile"]["contentType"]), f["dataFile"]["filesize"], f["restricted"]))
    fields = F.map_from_entries(F.coalesce(F.col("r.data.latestVersion.metadataBlocks.citation.fields"), F.array().cast("array<struct<typeName:string,value:string>>")))
    cite = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    found = F.when(is_file, F.col("r.data.dataFile.persistentId")).otherwise(F.col("r.data.persistentId"))
    persistent = F.coalesce(F.nullif(_t(found), F.lit("")), pid)
    rejected = F.when(F.coalesce(F.col("r.status"), F.lit("")) != "OK", "invalid_response").when((pid != "") & (persistent != pid), "identity_mismatch").when(F.coalesce(_bad_files(files, lambda f: f["dataFile"]["id"]), F.lit(True)), "invalid_files")
    v = F.col("r.data.latestVersion")
    title = F.when(cite("title") != "", cite("title")).otherwise(F.coalesce(F.try_element_at(resources, F.lit(1))["name"], F.lit("")))
    return _finish(p, "dataverse", {"kind": F.when(is_file, "file").otherwise("dataset"), "native_id": F.when(is_file, F.col("r.data.dataFile.id")).otherwise(F.col("r.data.id")), "persistent_id": persistent, "version": F.when(v["versionNumber"].isNotNull(), F.concat_ws(".", v["versionNumber"].cast("string"), F.coalesce(v["versionMinorNumber"], F.lit(0)).cast("string"))).otherwise(""), "title": title, "description": plain_text(cite("dsDescription")), "publisher": cite("publisher"), "publication_date": _t(v["releaseTime"]), "license": _t(v["license"]["name"]), "doi": F.coalesce(normalize_doi(persistent), F.lit("")), "resources": resources}, rejected)


def scan_inveniordm(payloads: DataFrame) -> DataFrame:
    """Published records whose files are all completed; hidden or non-public files are restricted."""
    schema = "record struct<id:string,is_published:boolean,access:struct<files:string>,pids:struct<doi:struct<identifier:string>>,versions:struct<index:string>,metadata:struct<title:string,description:string,publisher:string,publication_date:string,rights:array<struct<id:string>>>>, files struct<entries:map<string,struct<key:string,status:string,mimetype:string,size:bigint,links:struct<content:string>,access:struct<hidden:boolean>>>>"
    p = payloads.withColumn("r", F.from_json("body", schema))
    entries = F.map_values("r.files.entries")
    wanted = F.regexp_extract("url", r"/records/([^/?#]+)", 1)
    closed = F.coalesce(F.col("r.record.access.files"), F.lit("")) != "public"
    resources = F.transform(entries, lambda f: _file(f["links"]["content"], f["key"], _t(f["mimetype"]), f["size"], closed | F.coalesce(f["access"]["hidden"], F.lit(False))))
    bad = F.coalesce(_bad_files(entries, lambda f: f["key"]), F.lit(True)) | F.exists(entries, lambda f: F.coalesce(f["status"], F.lit("")) != "completed") | F.exists(F.map_entries("r.files.entries"), lambda e: e["key"] != e["value"]["key"])
    m = F.col("r.record.metadata")
    rejected = F.when(F.col("r.record").isNull(), "invalid_response").when((F.col("r.record.id") != wanted) | ~F.coalesce(F.col("r.record.is_published"), F.lit(False)), "identity_mismatch").when(_t(m["title"]) == "", "no_title").when(bad, "invalid_files")
    doi = F.coalesce(normalize_doi(_t(F.col("r.record.pids.doi.identifier"))), F.lit(""))
    return _finish(p, "inveniordm", {"kind": F.lit("dataset"), "native_id": F.col("r.record.id"), "persistent_id": doi, "version": _t(F.col("r.record.versions.index")), "title": _t(m["title"]), "description": plain_text(_t(m["description"])), "publisher": _t(m["publisher"]), "publication_date": _t(m["publication_date"]), "license": _t(F.try_element_at(m["rights"], F.lit(1))["id"]), "doi": doi, "resources": resources}, rejected)


def scan_dryad(datasets: DataFrame, versions: DataFrame, files: DataFrame) -> DataFrame:
    """Dataset, version and file payload tables that agree by their links.

    datasets(url, body), versions(body), files(body): HAL documents whose _links name each other."""
    def read(payloads: DataFrame, links: str, fields: str) -> DataFrame:
        """Payloads with ``r``, read once; what is no JSON object has no fields."""
        linked = ",".join(f"`{k}`:struct<href:string>" for k in links.split())
        own = ",".join(f"{k} string" for k in fields.split())
        return payloads.withColumn("r", F.from_json(F.when(F.col("body").rlike(r"^\s*\{"), F.col("body")), f"_links struct<{linked}>,{own}"))

    link = lambda name: F.col(f"r._links.`{name}`.href")
    d = read(datasets, "self stash:version", "identifier visibility license").select("url", "r.identifier", "r.visibility", "r.license", link("stash:version").alias("v"), link("self").alias("self"))
    v = read(versions, "self stash:dataset", "title abstract publicationDate versionNumber").select(link("self").alias("v"), link("stash:dataset").alias("of"), "r.title", "r.abstract", F.col("r.publicationDate").alias("date"), F.col("r.versionNumber").alias("number"))
    f = read(files, "self stash:version", "path mimeType size").select(link("stash:version").alias("v"), link("self").alias("link"), F.col("r.path").alias("name"), F.col("r.mimeType").alias("mime"), F.col("r.size").try_cast("bigint").alias("size"))
    listed = f.groupBy("v").agg(F.sort_array(F.collect_list(F.struct(F.concat("link", F.lit("/download")).alias("link"), "name", "mime", "size"))).alias("files"))
    j = d.join(v, "v", "left").join(listed, "v", "left")
    resources = F.transform(F.coalesce("files", F.array().cast("array<struct<link:string,name:string,mime:string,size:bigint>>")), lambda x: _file(x["link"], x["name"], _t(x["mime"]), x["size"], F.coalesce(F.col("visibility"), F.lit("")) != "public"))
    doi = normalize_doi(F.col("identifier"))
    rejected = F.when(doi.isNull() | (doi != F.coalesce(normalize_doi(F.regexp_extract("url", r"(10\.[^?#]+)", 1)), F.lit(""))), "identity_mismatch").when(F.col("of").isNull() | (F.col("of") != F.col("self")), "version_mismatch").when(_t(F.col("title")) == "", "no_title")
    return _finish(j, "dryad", {"kind": F.lit("dataset"), "native_id": doi, "persistent_id": doi, "version": _t(F.col("number")), "title": _t(F.col("title")), "description": plain_text(_t(F.col("abstract"))), "publisher": F.lit("Dryad"), "publication_date": _t(F.col("date")), "license": _t(F.col("license")), "doi": doi, "resources": resources}, rejected)


def scan_dspace(items: DataFrame, bundles: DataFrame, bitstreams: DataFrame) -> DataFrame:
    """Archived, not withdrawn items with the bitstreams of their ORIGINAL bundles.

    items(url, body), bundles(item, uuid, name), bitstreams(bundle, uuid, name, size)."""
    schema = "uuid string, inArchive boolean, withdrawn boolean, metadata map<string,array<struct<value:string>>>"
    i = items.withColumn("r", F.from_json("body", schema))
    held = bundles.filter("name = 'ORIGINAL'").select("item", F.col("uuid").alias("bundle")).join(bitstreams, "bundle").groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("uuid"), "name", "size"))).alias("files"))
    j = i.join(held, F.col("r.uuid") == F.col("item"), "left")
    value = lambda k: _t(F.try_element_at(F.try_element_at("r.metadata", F.lit(k)), F.lit(1))["value"])
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    resources = F.transform(F.coalesce("files", F.array().cast("array<struct<uuid:string,name:string,size:bigint>>")), lambda x: _file(F.concat(root, F.lit("/core/bitstreams/"), x["uuid"], F.lit("/content")), x["name"], F.lit(""), x["size"], F.lit(False)))
    wanted = F.regexp_extract("url", r"/items/([^/?#]+)", 1)
    rejected = F.when(F.col("r.uuid").isNull(), "invalid_response").when((F.col("r.uuid") != wanted) | ~F.coalesce(F.col("r.inArchive"), F.lit(False)) | F.coalesce(F.col("r.withdrawn"), F.lit(False)), "identity_mismatch").when(value("dc.title") == "", "no_title")
    doi = F.coalesce(normalize_doi(value("dc.identifier.doi")), normalize_doi(value("dc.identifier.uri")), F.lit(""))
    return _finish(j, "dspace", {"kind": F.lit("dataset"), "native_id": F.col("r.uuid"), "persistent_id": doi, "title": value("dc.title"), "description": plain_text(value("dc.description.abstract")), "publisher": value("dc.publisher"), "publication_date": value("dc.date.issued"), "license": value("dc.rights"), "doi": doi, "resources": resources}, rejected)


def unify_records(*frames: DataFrame) -> DataFrame:
    """All platforms under the common schema; columns a platform lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
