"""Versioned catalogue tables and nested exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report_documents(jobs: DataFrame, key: str) -> DataFrame:
    """One nested document per search: a summary and its jobs in order."""
    rest = [c for c in jobs.columns if c != key]
    held = jobs.groupBy(key).agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "done").alias("done"), F.array_sort(F.collect_list(F.struct(*rest))).alias("jobs"))
    return held.select(key, F.struct("n_jobs", "done").alias("summary"), "jobs")


def export_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def write_catalog(frames: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write all tables of a version, then publish it by a one-row pointer table.

    Readers follow the newest pointer, so they see all tables of a version or none.
    """
    version = uuid.uuid4().hex
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        writer = df.write
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{root}/versions/{version}/{name}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/pointer")
    return version


def read_catalog(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}/{name}")
