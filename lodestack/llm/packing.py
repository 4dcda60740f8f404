"""Conflict-constrained best-fit packing of token sequences into bins of fixed capacity.

Documents are dealt by hash, repeated rows by their number too, into packing groups of a bounded number
of pieces, so no source, family of copies or repeated row ever lands in one task.  Inside a group, pieces go longest first.  Open bins are
kept in order of residual room, each with a bitmap of the sources and a bitmap of the duplicate
clusters it holds.  The search starts at the first bin whose residual is at least the piece's
length and moves on to the successor while a bitmap shows a conflict, so the tightest compatible
bin is taken; without one a new bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.textops import word_count
from lodestack.scratch import settle, ship

CAPACITY = 2048
#: Mean number of pieces in a packing group.
GROUP = 4096


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (length, source, cluster), with lengths in descending order.

    Bins are numbered as they open.  No bin holds two pieces of one source or of one cluster;
    source or cluster -1 conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if room > length:
            insort(order, (room - length, b))
        out.append(b)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin (long), bin_pos, source.

    A document's length is its words plus one end mark; a document longer than ``capacity`` is cut
    into pieces of ``capacity`` and a rest.  Null texts count as empty (length 1).  The duplicate
    cluster is that of equal texts.  Pieces of one source or cluster never share a bin; null
    sources count as one source.  Repeated rows are packed as separate documents.  An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), (word_count(F.col(text_col)) + 1).alias("length"), F.xxhash64(text).alias("cluster"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / capacity))))
    rows = settle(rows.select("id", "source", "cluster", "piece", F.least(F.col("length") - F.col("piece") * capacity, F.lit(capacity)).alias("n")), "pieces")
    groups = max(1, -(-rows.count() // group))
    # equal rows are counted and numbered, so that many of them are dealt over all groups too
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_rows")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).drop("_rows")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "cluster", "piece", "copy"), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "cluster", "id", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        s = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        c = pd.factorize(pdf["cluster"])[0]
        bins = pd.Series(best_fit(list(zip(pdf["n"].tolist(), s.tolist(), c.tolist(), strict=True)), capacity))
        pdf["pos"] = bins.groupby(bins).cumcount().astype("int32")
        pdf["bin"] = bins + (int(key[0]) << 24)
        return pdf[["id", "source", "piece", "n", "bin", "pos"]]

    out = rows.groupBy("g").applyInPandas(run, f"id string, source {dict(rows.dtypes)['source']}, piece long, n long, bin long, pos int")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("source").alias(source_col), F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.col("n").alias("n_tokens"), "bin", F.col("pos").alias("bin_pos"))
