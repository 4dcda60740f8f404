"""Append-only snapshots of evidence documents, with a checksum that is verified on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.operators.tables import evidence_checksum


def append_snapshots(rows: DataFrame, fields: list[str], path: str) -> None:
    """Add rows with their checksum to the store; nothing that is stored is ever rewritten."""
    rows.withColumn("sha256", evidence_checksum(fields)).write.mode("append").parquet(path)


def read_snapshots(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, damaged rows): what was changed after capture no longer fits its checksum."""
    rows = spark.read.parquet(path)
    sound = F.coalesce(F.col("sha256") == evidence_checksum(fields), F.lit(False))
    return rows.filter(sound), rows.filter(~sound)


def newest_snapshots(rows: DataFrame, owner: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each owner."""
    w = Window.partitionBy(owner).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")
