"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND.

Each shard holds the documents of one input split.  A posting list is stored in blocks with the
greatest term frequency and least document length of each block, which bound any score inside.
Document frequencies, the number of documents and the mean length are global, so scores do not
depend on sharding and merging the shards' top-k is exact.  A term's contribution is rounded to
whole millionths before adding, so sums and ties are the same in any order of terms.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.subwords import words
from lodestack.scratch import arrow_batches, settle, ship

K1, B, UNIT = 1.2, 0.75, 1_000_000
BLOCK = 64
#: Words after which a shard is closed.
SHARD = 3_000_000
#: Queries that are answered together in one task.
QUERIES = 256
#: Most tasks that answer queries; a task may hold several shards.
TASKS = 4096


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows (shard, term, docs, tfs, max_tf, min_dl), written to the shared folder.

    The row with a null term holds a shard's document ids (order: ascending, nulls last) and, as
    ``tfs``, their lengths.  Every row of ``docs`` is indexed, null texts with length 0.
    """
    kind: list[pa.DataType] = []  # of the ids

    def shard_of(ids, lens, place, term_of, at_doc, at_term, at_tf):
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0)), dtype=np.int64)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order))
        doc, term, tf = rank[np.concatenate(at_doc)], np.concatenate(at_term), np.concatenate(at_tf)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[first, len(term)])
        dl = np.array(lens, dtype=np.int32)[order]
        per = -(-sizes // BLOCK)
        block_first = np.repeat(first, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * BLOCK
        max_tf = np.maximum.reduceat(tf, block_first) if len(tf) else tf
        min_dl = np.minimum.reduceat(dl[doc], block_first) if len(tf) else tf
        names = list(term_of)
        offs = pa.array(np.r_[first, len(term)], pa.int32())
        blocks = pa.array(np.r_[0, np.cumsum(per)], pa.int32())
        arrays = [pa.array(np.full(len(first), place, dtype=np.int64)), pa.array([names[t] for t in term[first]], pa.binary()), pa.array([None] * len(first), pa.list_(kind[0]))]
        arrays += [pa.ListArray.from_arrays(o, pa.array(v, pa.int32())) for o, v in ((offs, doc), (offs, tf), (blocks, max_tf), (blocks, min_dl))]
        fields = ["shard", "term", "ids", "docs", "tfs", "max_tf", "min_dl"]
        yield pa.RecordBatch.from_arrays(arrays, names=fields)
        own = [ids[i] for i in order]
        none = pa.array([[]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([None], pa.binary()), pa.array([own], pa.list_(kind[0])), none, pa.array([dl.tolist()], pa.list_(pa.int32())), none, none], names=fields)

    def run(batches):
        place, held = TaskContext.get().partitionId() << 20, 0
        fresh = lambda: ([], [], {}, [], [], [])
        ids, lens, term_of, at_doc, at_term, at_tf = fresh()
        for b in batches:
            kind[:] = [b.schema.field(0).type]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t)
                terms = np.array([term_of.setdefault(w, len(term_of)) for w in ws], dtype=np.int32)
                got, tf = np.unique(terms, return_counts=True)
                at_doc.append(np.full(len(got), len(ids), dtype=np.int32))
                at_term.append(got)
                at_tf.append(tf.astype(np.int32))
                ids.append(i)
                lens.append(len(ws))
                held += len(ws) + 1
                if held >= SHARD:
                    yield from shard_of(ids, lens, place, term_of, at_doc, at_term, at_tf)
                    place, held = place + 1, 0
                    ids, lens, term_of, at_doc, at_term, at_tf = fresh()
        if ids:
            yield from shard_of(ids, lens, place, term_of, at_doc, at_term, at_tf)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    with arrow_batches(docs.sparkSession, 512):
        return settle(src.mapInArrow(run, f"shard long, term binary, ids array<{dict(src.dtypes)['id']}>, docs array<int>, tfs array<int>, max_tf array<int>, min_dl array<int>"), "index")


def impact(tf: np.ndarray, dl: np.ndarray, idf: float, qtf: int, mean: float) -> np.ndarray:
    """A term's contribution in millionths."""
    part = idf * qtf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / mean))
    return np.floor(part * UNIT + 0.5).astype(np.int64)


class Cursor:
    """A posting list with block bounds, read block by block."""

    def __init__(self, docs, tfs, max_tf, min_dl, dl, idf, qtf, mean):
        self.docs, self.tfs, self.dl, self.args = docs, tfs, dl, (idf, qtf, mean)
        self.bounds = impact(max_tf.astype(float), min_dl.astype(float), *self.args)
        self.last = docs[np.minimum(np.arange(len(max_tf)) * BLOCK + BLOCK - 1, len(docs) - 1)]
        self.top, self.at, self.block, self.done = int(self.bounds.max()), 0, -1, len(docs)
        self.doc = int(docs[0])

    def bound(self, doc: int) -> tuple[int, int]:
        """(bound, last document) of the block that would hold ``doc``."""
        i = self.at // BLOCK
        if self.last[i] < doc:
            i += int(np.searchsorted(self.last[i:], doc))
        return (int(self.bounds[i]), int(self.last[i])) if i < len(self.last) else (0, 1 << 60)

    def seek(self, doc: int) -> None:
        """Move to the first posting at or after ``doc``."""
        i = self.at // BLOCK
        if self.last[i] < doc:
            i += int(np.searchsorted(self.last[i:], doc))
            if i >= len(self.last):
                self.at, self.doc = self.done, 1 << 60
                return
            self.at = i * BLOCK
        end = min(self.done, i * BLOCK + BLOCK)
        self.at += int(np.searchsorted(self.docs[self.at : end], doc))
        self.doc = int(self.docs[self.at])

    def value(self) -> int:
        """Contribution at the current posting; its block is scored when first needed."""
        i = self.at // BLOCK
        if i != self.block:
            lo, hi = i * BLOCK, min(self.done, i * BLOCK + BLOCK)
            self.block, self.scores = i, impact(self.tfs[lo:hi].astype(float), self.dl[self.docs[lo:hi]].astype(float), *self.args)
        return int(self.scores[self.at - i * BLOCK])


def block_max_wand(cursors: list[Cursor], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) with score over 0; equal scores go to the lower document."""
    heap: list[tuple[int, int]] = []
    floor = 0
    live = list(cursors)
    while live:
        live.sort(key=lambda c: c.doc)
        while live and live[-1].doc == 1 << 60:
            live.pop()
        total, pivot = 0, -1
        for i, c in enumerate(live):
            total += c.top
            if total > floor:
                pivot = i
                break
        if pivot < 0:
            break
        doc = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == doc:
            pivot += 1
        bounds = [c.bound(doc) for c in live[: pivot + 1]]
        if sum(b for b, _ in bounds) > floor:
            if live[0].doc == doc:
                got = sum(c.value() for c in live[: pivot + 1])
                if got > floor:
                    heapq.heappush(heap, (got, -doc))
                    if len(heap) > k:
                        heapq.heappop(heap)
                    if len(heap) == k:
                        floor = heap[0][0]
                for c in live[: pivot + 1]:
                    c.seek(doc + 1)
            else:
                for c in live[: pivot + 1]:
                    if c.doc < doc:
                        c.seek(doc)
                        break
        else:
            nxt = min(last for _, last in bounds) + 1
            if pivot + 1 < len(live):
                nxt = min(nxt, live[pivot + 1].doc)
            for c in live[: pivot + 1]:
                c.seek(max(nxt, doc + 1) if c.doc <= doc else nxt)
    return [(s, -d) for s, d in sorted(heap, reverse=True)]


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of every query; where the query's own
    id is called doc_id, the documents are in ``found_id``.

    Query texts are taken whole; repeated words count.  Documents that share no term with a query
    are no result.  Equal scores are ordered by id, null ids last.  Null or empty queries and empty
    indexes give no rows; rows with one query id are one query of all their words.
    """
    ship(index.sparkSession)
    heads = index.filter("term is null")
    n, total, shards = heads.agg(F.sum(F.size("ids")), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).first()
    n, mean = int(n or 0), float(total or 0) / max(1, n or 0) or 1.0
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = queries.select(F.col(query_id).alias("q"), F.explode(F.split(lower, r"[\x20\x09-\x0D]+")).alias("w")).filter("w != ''")
    terms = terms.groupBy("q", F.col("w").cast("binary").alias("term")).agg(F.count("*").alias("qtf"))
    blocks = max(1, -(-queries.count() // QUERIES))
    terms = settle(terms.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))), "terms")
    # few bytes but much work: as many tasks as there are shards and blocks, not as bytes would give
    tasks = min(TASKS, max(1, shards * blocks))
    hits = settle(index.join(terms.select("term").distinct(), "term", "left_semi"), "hits")
    df = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    asked = terms.join(df, "term").withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    wanted = terms.select("term", "block").distinct()
    left = hits.join(wanted, "term")
    places = settle(left.select("shard", "block").distinct(), "places")
    left = left.unionByName(heads.join(places, "shard"))
    right = places.join(asked, "block")

    def run(key: tuple, lists: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        head = lists[lists["term"].isna()].iloc[0]
        dl, ids = np.asarray(head["tfs"]), head["ids"]
        held = {bytes(r.term): r for r in lists[lists["term"].notna()].itertuples()}
        for q, own in ask.groupby("q", sort=False):
            cursors = []
            for r in own.itertuples():
                p = held.get(bytes(r.term))
                if p is not None:
                    cursors.append(Cursor(np.asarray(p.docs), np.asarray(p.tfs), np.asarray(p.max_tf), np.asarray(p.min_dl), dl, r.idf, int(r.qtf), mean))
            out += [(q, ids[d], s) for s, d in block_max_wand(cursors, k)]
        found = pd.DataFrame(out, columns=["q", "doc", "s"])
        return found.astype({"doc": "Int64"}) if whole else found

    kind, doc_kind = dict(terms.dtypes)["q"], dict(index.dtypes)["ids"][len("array<") : -1]
    whole = doc_kind in ("bigint", "int", "smallint", "tinyint")
    left, right = left.repartition(tasks, "shard", "block"), right.repartition(tasks, "shard", "block")
    got = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, f"q {kind}, doc {doc_kind}, s long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.col("doc").asc_nulls_last()))
    got = got.withColumn("rank", rank).filter(F.col("rank") <= k)
    return got.select(F.col("q").alias(query_id), "rank", F.col("doc").alias("found_id" if query_id == "doc_id" else "doc_id"), (F.col("s") / UNIT).alias("score"))
