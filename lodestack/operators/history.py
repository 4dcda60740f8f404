"""Filters over histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_filter(df: DataFrame, owner_col: str, owner: str, text_col: str, contains: str | None = None, origin_col: str | None = None, origin: str | None = None) -> DataFrame:
    """Rows of one owner, optionally with a case-insensitive substring and an origin."""
    df = df.filter(F.col(owner_col) == owner)
    if contains:
        escaped = contains.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        df = df.filter(F.col(text_col).ilike(f"%{escaped}%"))
    if origin is not None:
        df = df.filter(F.col(origin_col) == origin)
    return df
