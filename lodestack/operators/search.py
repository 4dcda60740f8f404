"""Weighted full-text search over posting lists.

Postings are (doc, term, position, weight); queries are a table of (query, term, role, position).  A
posting list holds the places of one term in one document.  Lists are stored document by document, so what
is gathered for a query and a document is gathered in one task, and a list is moved once for all queries.
Blocks of documents and a directory of the blocks of each term, with their numbers and bounds, tell which
are needed.  Every query of a batch runs in the same job, and nothing is crossed.

Queries with required terms begin with their rarest one; the others only look documents up that are left.
Top documents are ranked with bounds: a document, or a block of documents, whose bound does not reach the
k-th best of a first few is never ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.stems import english_stem
from lodestack.scratch import arrow_batches, setting, settle

#: Documents, about, of a block; distance between fields in positions.
BLOCK, FIELD = 512, 1 << 40
#: First documents that are ranked to find a query's threshold, as a multiple of k, and blocks they come from.
FIRST, FIRST_BLOCKS = 4, 4
#: What the bounds of a document are made of.
BOUNDED = ("n", "mass", "most", "lo", "hi")

#: Weights of title, description, publisher and place, platform and url words. Fixed values.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def stem_vocabulary(postings: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms only.

    The vocabulary is stored before it is stemmed: a join on stems would else be pushed below the
    distinct, and every posting be stemmed."""
    return settle(postings.select("term").distinct(), "vocabulary").withColumn("stem", english_stem("term"))


def posting_lists(postings: DataFrame, docs: int | None = None) -> DataFrame:
    """(doc, term, block, n, mass, most, lo, hi, occ): the places of a term in a document, ascending, as structs
    of position and weight; their number, the sum and the maximum of their weights, the first and last place.  ``docs``: about how many
    documents there are, counted if not given.  Lists are returned as they are.

    Postings are dealt by document, so all lists of a document are stored together."""
    if "occ" in postings.columns:
        return postings
    if docs is None:
        docs = postings.select(F.approx_count_distinct("doc")).first()[0]
    block = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-docs // BLOCK)))).cast("int")
    lists = postings.repartition("doc").sortWithinPartitions("doc", "term").groupBy("doc", "term").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"), F.max("weight").alias("most"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("occ"))
    with setting(postings.sparkSession, "spark.sql.execution.replaceHashWithSortAgg", True):  # sorted once, then folded row by row
        return settle(lists.withColumn("block", block), "lists")


def directory(lists: DataFrame) -> DataFrame:
    """(term, block, df, top): the blocks of each term, its documents there, and the greatest mass of one."""
    return settle(lists.groupBy("term", "block").agg(F.count("*").alias("df"), F.max("mass").alias("top")), "directory")


def lists_of(lists: DataFrame, asked: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """(query, doc, term, *columns) of the lists that ``pairs`` (query, doc) have of the asked (query, term).

    A document's queries meet its lists at once, so a list is moved once, by its document, for all of them."""
    by_term = asked.groupBy("term").agg(F.collect_set("query").alias("_asked"))
    by_doc = pairs.groupBy("doc").agg(F.collect_set("query").alias("_queries"))
    held = lists.select("doc", "term", *columns).join(by_term.select("term"), "term", "left_semi").join(by_doc, "doc").join(by_term, "term")
    return held.select(F.explode(F.array_intersect("_asked", "_queries")).alias("query"), "doc", "term", *columns)


def prepare(postings: DataFrame, queries: DataFrame, docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists, queries) by stems, and only of stems that a query asks for, stored for reuse.  ``docs``: about how
    many documents there are; without it the postings are stored to be counted.

    Terms become stems on both sides, so variants of a word match each other.  The vocabulary is cut
    to the asked stems first; the postings then meet only the few terms that are left."""
    asked = settle(queries.withColumn("term", english_stem("term")), "asked")
    wanted = stem_vocabulary(postings).join(asked.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    held = postings.join(settle(wanted, "variants"), "term").select("doc", F.col("stem").alias("term"), "pos", "weight")
    return posting_lists(held if docs is not None else settle(held, "postings"), docs), asked


def build_postings(catalog: DataFrame, key: str, fields: dict[str, str], stop_words: DataFrame | None = None) -> DataFrame:
    """(doc, term, pos, weight) from fields by weight class; classes follow each other in position."""
    parts = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(WEIGHTS[w]).alias("weight"), tokens(F.col(c)).alias("words")) for i, (c, w) in enumerate(fields.items())])
    each = catalog.select(F.col(key).alias("doc"), F.explode(parts).alias("p")).select("doc", "p.f", "p.weight", F.posexplode("p.words").alias("i", "term"))
    out = each.select("doc", "term", (F.col("f") * F.lit(FIELD) + F.col("i")).alias("pos"), "weight")
    return out.join(stop_words, "term", "left_anti") if stop_words is not None else out


def required(queries: DataFrame) -> DataFrame:
    return queries.filter("role in ('must', 'phrase')").select("query", "term").distinct()


def optional(queries: DataFrame) -> DataFrame:
    """Terms of queries that require none."""
    return queries.filter("role = 'any'").select("query", "term").distinct().join(required(queries).select("query").distinct(), "query", "left_anti")


def match_required(lists: DataFrame, where: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc) with all required terms: the documents of the rarest, of which the others leave some."""
    need = required(queries)
    sizes = where.groupBy("term").agg(F.sum("df").alias("df"))
    sized = need.join(sizes, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = sized.groupBy("query").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.min("df").alias("least"), F.count("*").alias("need")).filter("least > 0")
    first = settle(first, "rarest")
    found = settle(lists.select("doc", "term").join(first.select("query", "term"), "term").select("query", "doc"), "found")
    rest = need.join(first.select("query", "term"), ["query", "term"], "left_anti").join(first.select("query"), "query", "left_semi")
    more = lists_of(lists, settle(rest, "rest"), found).groupBy("query", "doc").agg(F.count("*").alias("got"))
    full = more.join(first.select("query", "need"), "query").filter("got = need - 1").select("query", "doc")
    return found.join(first.filter("need = 1").select("query"), "query", "left_semi").unionByName(full)


def match_phrases(lists: DataFrame, queries: DataFrame, matched: DataFrame) -> DataFrame:
    """``matched`` without documents that have a phrase's terms, but nowhere side by side in order: the
    places of every term, moved back by its place in the phrase, have one in common."""
    phrase = queries.filter("role = 'phrase'").select("query", "term", F.col("position").cast("bigint").alias("at")).distinct()
    asked = phrase.groupBy("query").agg(F.count("*").alias("all"))
    moved = lists_of(lists, phrase.select("query", "term"), matched, "occ").join(phrase, ["query", "term"])
    each = F.struct(F.size("occ").alias("n"), F.transform("occ", lambda o: o["pos"].cast("bigint") - F.col("at")).alias("starts"))
    starts = moved.select("query", "doc", each.alias("s")).groupBy("query", "doc").agg(F.array_sort(F.collect_list("s")).alias("each"))  # shortest first
    common = F.aggregate(F.slice("each", 2, F.size("each")), F.col("each")[0]["starts"], lambda acc, x: F.array_intersect(acc, x["starts"]))
    held = starts.join(asked, "query").filter((F.size("each") == F.col("all")) & (F.size(common) > 0)).select("query", "doc")
    return matched.join(asked.select("query"), "query", "left_anti").unionByName(held)


def without_excluded(lists: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (query, doc, ...) whose document has no term that the query excludes."""
    terms = queries.filter("role = 'not'").select("query", "term").distinct()
    bad = lists_of(lists, terms, pairs.join(terms.select("query"), "query", "left_semi")).select("query", "doc").distinct()
    return pairs.join(bad, ["query", "doc"], "left_anti")


def match_terms(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc) where all must terms occur, no not term does, phrase terms are adjacent in
    order, and, for queries with any terms only, at least one occurs."""
    lists = posting_lists(postings)
    where = directory(lists)
    must = match_phrases(lists, queries, settle(match_required(lists, where, queries), "required"))
    some = lists.select("doc", "term").join(optional(queries), "term").select("query", "doc").distinct()
    return without_excluded(lists, queries, settle(must.unionByName(some), "matched"))


def fold(terms: np.ndarray, pos: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of cover parts, in millionths, of each of ``rows`` rows from all occurrences of its terms.

    At every occurrence, once all terms have been seen, the cover reaches back to the oldest of the last
    places of all terms: the first occurrence that its term does not repeat up to here.  As that place
    never moves back, a running maximum of the next places finds it by bisection for all at once."""
    order = np.lexsort((pos, row))
    terms, pos, weight, row = terms[order], pos[order], weight[order], row[order]
    n = len(pos)
    end = np.cumsum(np.bincount(row, minlength=rows))[row]  # where the row's occurrences end
    by_term = np.lexsort((np.arange(n), terms))  # terms are numbered over all rows
    after = end.copy()
    same = terms[by_term][:-1] == terms[by_term][1:]
    after[by_term[:-1][same]] = by_term[1:][same]
    new = np.ones(n, dtype=bool)
    new[by_term[1:][same]] = False
    at = np.cumsum(new)
    row_start = end - np.bincount(row, minlength=rows)[row]
    seen = at - (at[row_start] - 1)
    k = np.bincount(row[new], minlength=rows)[row]
    start = np.searchsorted(np.maximum.accumulate(after), np.arange(n), side="right")
    full = seen == k
    start = np.minimum(start, n - 1)
    first = np.ones(n, dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | ~full[:-1] | (pos[start[1:]] > pos[start[:-1]])
    gap = np.maximum(pos - pos[start] + 1 - k, 0)
    part = np.floor(weight * 1_000_000 / (1 + gap))
    return np.bincount(row, np.where(full & first, part, 0), minlength=rows)


def cover_ranks(held: DataFrame) -> DataFrame:
    """(query, doc, rank) from (query, doc, terms), an array with the occurrences of each term of the query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outer = b.column(2)
            inner = outer.flatten()
            places = inner.flatten()
            per_row, per_term = np.diff(np.asarray(outer.offsets)), np.diff(np.asarray(inner.offsets))
            row = np.repeat(np.arange(len(per_row)), per_row)
            ranks = fold(np.repeat(np.arange(len(per_term)), per_term), np.asarray(places.field("pos")).astype(np.int64), np.asarray(places.field("weight")), np.repeat(row, per_term), b.num_rows) if len(places) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ranks / 1_000_000)], names=["query", "doc", "rank"])

    kinds = dict(held.dtypes)
    with arrow_batches(held.sparkSession, 512):
        return settle(held.select("query", "doc", "terms").mapInArrow(run, f"query {kinds['query']}, doc {kinds['doc']}, rank double"), "ranks")


def gathered(lists: DataFrame, queries: DataFrame, matched: DataFrame) -> DataFrame:
    """(query, doc, terms) of matched documents: the lists of all terms that count for the query."""
    terms = queries.filter("role <> 'not'").select("query", "term").distinct()
    return lists_of(lists, terms, matched, "occ").groupBy("query", "doc").agg(F.collect_list("occ").alias("terms"))


def cover_density(postings: DataFrame, queries: DataFrame, matched: DataFrame) -> DataFrame:
    """(query, doc, rank): how close a query's terms stand in each matched document.

    At every occurrence the cover reaches back to the oldest of the last positions of all terms that
    the document has; each cover that begins later than the one before adds the weight of its last
    word / (1 + words in it that are no term)."""
    lists = posting_lists(postings)
    return cover_ranks(gathered(lists, queries, matched))


def bounds(hits: DataFrame) -> DataFrame:
    """(query, doc, bound) from lists met (query, doc, n, mass, most, lo, hi).

    A cover adds the weight of one occurrence, each ends at another one, and while the rarest term's last
    place stays, a cover can begin later once for every term: so no rank exceeds the mass of all
    occurrences, nor terms times the rarest term's occurrences times the greatest weight.  And every cover
    reaches from a last place to a first place at least, which divides its part."""
    gap = F.greatest(F.max("lo") - F.min("hi") + 1 - F.count("*"), F.lit(0))
    each = hits.groupBy("query", "doc").agg(F.sum("mass").alias("mass"), (F.count("*") * F.min("n") * F.max("most")).alias("covers"), gap.alias("gap"))
    return each.select("query", "doc", (F.least("mass", "covers") / (1 + F.col("gap")) + 1e-6).alias("bound"))


def rank_top(postings: DataFrame, queries: DataFrame, updated: DataFrame, k: int) -> DataFrame:
    """``rank_catalog`` of all matched documents, of which most are never ranked.

    The documents with the best bounds give each query a threshold, its k-th best rank so far.  Blocks
    whose terms' greatest masses do not add up to it are not opened; documents below it are not folded."""
    lists = posting_lists(postings)
    where = directory(lists)
    terms, some = queries.filter("role <> 'not'").select("query", "term").distinct(), optional(queries)
    must = match_phrases(lists, queries, settle(match_required(lists, where, queries), "required"))
    must = settle(bounds(lists_of(lists, terms, settle(without_excluded(lists, queries, settle(must, "matched")), "kept"), *BOUNDED)), "bounded")
    blocks = settle(some.join(where, "term").groupBy("query", "block").agg((F.sum("top") + 1e-6).alias("bound")), "blocks")

    def opened(chosen: DataFrame) -> DataFrame:
        """Bounds of the documents of chosen (query, block), for queries without required terms."""
        chosen = settle(chosen, "chosen")
        hits = lists.select("term", "block", "doc", *BOUNDED).join(chosen.select("block").distinct(), "block", "left_semi").join(some, "term").join(chosen, ["query", "block"], "left_semi")
        return without_excluded(lists, queries, settle(bounds(hits), "opened"))

    def best(rows: DataFrame, by: str, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), *[c for c in ("block", "doc") if c in rows.columns]))
        return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")

    tried = best(must.unionByName(opened(best(blocks, "bound", FIRST_BLOCKS).select("query", "block"))), "bound", FIRST * k).select("query", "doc")
    tried = settle(tried, "tried")
    known = cover_ranks(gathered(lists, queries, tried))
    line = best(known, "rank", k).groupBy("query").agg(F.min("rank").alias("line"), F.count("*").alias("n")).filter(F.col("n") == k).select("query", "line")
    line = settle(line, "thresholds")

    def reach(rows: DataFrame) -> DataFrame:
        return rows.join(line, "query", "left").filter(F.col("line").isNull() | (F.col("bound") >= F.col("line")))

    left = reach(must).select("query", "doc").unionByName(reach(opened(reach(blocks).select("query", "block"))).select("query", "doc"))
    left = settle(left.join(tried, ["query", "doc"], "left_anti"), "left")
    return rank_catalog(known.unionByName(cover_ranks(gathered(lists, queries, left))), updated, k)


def rank_catalog(ranked: DataFrame, updated: DataFrame, k: int) -> DataFrame:
    """Top k documents of each query: rank, then newest, then id."""
    rows = ranked.join(updated, "doc")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), F.desc("updated"), "doc"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def local_first(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, route): 'none' without terms, 'local' with a hit, else 'online'."""
    terms = queries.groupBy("query").agg(F.count("term").alias("n"))
    found = hits.select("query").distinct().withColumn("hit", F.lit(True))
    j = terms.join(found, "query", "left")
    return j.select("query", F.when(F.col("n") == 0, "none").when(F.col("hit"), "local").otherwise("online").alias("route"))
