"""Column expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts as the empty text."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    pieces = F.split(F.trim(flat), " +", -1)
    return F.when(F.trim(flat) == "", F.lit(0)).otherwise(F.size(pieces)).cast("long")


def id_text(doc_id: Column) -> Column:
    """The id as text; a null id stays distinguishable from any other."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))
