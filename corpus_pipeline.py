"""The corpus pipeline: language ID, near-duplicates, personal data, mixing and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents.  All but the last keep the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import language, mixing, packing, pii, simhash
from lodestack.llm.textops import id_crc
from lodestack.scratch import new_path, settle


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told (no letters); fill a null lang with the prediction.

    Without any label to learn from, all documents with letters stay."""
    profiles = settle(language.prototypes(docs.filter(id_crc(F.col("doc_id")) % 3 != 1)), "profiles")
    found = language.identify(docs, profiles, keep=tuple(docs.columns))
    told, pred = F.col("lang_pred") != language.UNKNOWN, F.col("lang_pred")
    if profiles.isEmpty():
        told, pred = F.coalesce(F.col("kept.text").rlike(r"\p{L}"), F.lit(False)), F.lit(None).cast("string")
    return found.filter(told).select(*[F.coalesce("kept.lang", pred).alias("lang") if c == "lang" else F.col(f"kept.`{c}`") for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the least doc_id, nulls last.

    Different documents stay whatever their ids are, equal and null ones included."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind; n_chars follows the new text."""
    out = pii.redact(docs, pii.extract(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mixture takes it; the mixture carries the documents
    along, so rows with equal or null ids are repeated each on their own."""
    taken = mixing.mix(docs, keep=tuple(docs.columns)).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("kept", F.col("copies").cast("int"))).alias("kept")).select("kept.*")


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the mixture: one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
