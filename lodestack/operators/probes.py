"""Operators over recorded probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_probes(probes: DataFrame, url: str) -> DataFrame:
    """One row per url with its HEAD and, where the HEAD called for it, its GET.

    One aggregation instead of a self join: each probe row is read and shuffled once."""
    def of(method: str, column: str) -> Column:
        return F.max_by(column, F.when(F.col("method") == method, F.col("probe_id")))

    out = probes.groupBy(url).agg(of("HEAD", "status_code").alias("head_code"), of("GET", "status_code").alias("_get"))
    needed = F.col("head_code").isin(403, 405, 501) | F.col("head_code").between(200, 399)
    return out.select(url, "head_code", F.when(needed, F.col("_get")).alias("get_code"))


def resolved_format(sniffed: Column, by_header: Column, claimed: Column) -> Column:
    """Sample evidence first, then headers, then the claim."""
    return F.coalesce(F.nullif(sniffed, F.lit("UNKNOWN")), F.nullif(by_header, F.lit("UNKNOWN")), claimed)


def validation_view(rows: DataFrame, ok: str, error: str) -> DataFrame:
    return rows.withColumns({"code": F.when(F.col(ok), "").otherwise("validation_failed"), error: F.when(F.col(ok), "").otherwise(F.col(error))})
