"""Cover ranks against a plain walk, and pruned ranking against ranking everything."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestack.operators import search as S


def walk(occurrences):
    """Sum of cover parts in millionths of [(position, term, weight)]."""
    last, before, total = {}, -1, 0
    k = len({t for _, t, _ in occurrences})
    for pos, term, weight in sorted(occurrences):
        last[term] = pos
        if len(last) == k and min(last.values()) > before:
            before = min(last.values())
            total += int(np.floor(weight * 1_000_000 / (1 + max(pos - before + 1 - k, 0))))
    return total


def test_fold_is_the_walk():
    rng = random.Random(2)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 8)):
            places = rng.sample(range(120), rng.randint(1, 40))
            rows.append([(p, rng.randrange(rng.randint(1, 6)), rng.choice((1.0, 0.4, 0.2, 0.1))) for p in places])
        flat = [(r, *o) for r, row in enumerate(rows) for o in row]
        rng.shuffle(flat)
        row, pos, term, weight = (np.array(c) for c in zip(*flat, strict=True))
        got = S.fold(row * 100 + term, pos, weight, row, len(rows))
        assert got.tolist() == [walk(r) for r in rows]


def catalogue(spark, docs, words, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        for i in range(rng.randint(1, 60)):
            w = rng.choices(range(words), [1 / (1 + x) for x in range(words)])[0]
            rows.append((d, f"t{w}", i, rng.choice((1.0, 0.4))))
        rows.append((d, "every", 100, 0.4))
    return spark.createDataFrame(rows, "doc long, term string, pos long, weight double"), rows


QUERIES = [
    ("any", "t0", "any", 0), ("any", "t3", "any", 1), ("any", "every", "any", 2), ("must", "t0", "must", 0), ("must", "every", "must", 1), ("rare", "t29", "must", 0), ("rare", "every", "must", 1),
    ("not", "every", "any", 0), ("not", "t1", "any", 1), ("not", "t0", "not", 2), ("phrase", "t0", "phrase", 0), ("phrase", "t1", "phrase", 1), ("none", "missing", "must", 0), ("none", "t0", "must", 1), ("only", "t0", "not", 0),
    ("gap", "t0", "phrase", 0), ("gap", "t0", "phrase", 2),
]


def test_matches_by_brute_force(spark):
    postings, rows = catalogue(spark, 300, 30)
    queries = spark.createDataFrame(QUERIES, "query string, term string, role string, position int")
    docs = {}
    for d, t, i, _ in rows:
        docs.setdefault(d, {}).setdefault(t, set()).add(i)
    want = set()
    for q in {q for q, *_ in QUERIES}:
        own = [(t, r, at) for name, t, r, at in QUERIES if name == q]
        need = {t for t, r, _ in own if r in ("must", "phrase")}
        phrase = [(t, at) for t, r, at in own if r == "phrase"]
        for d, terms in docs.items():
            ok = need <= set(terms) if need else any(t in terms for t, r, _ in own if r == "any")
            if ok and phrase:
                ok = any(all(s + at in terms[t] for t, at in phrase) for s in range(-5, 105))
            if ok and not any(t in terms for t, r, _ in own if r == "not"):
                want.add((q, d))
    assert {tuple(r) for r in S.match_terms(postings, queries).collect()} == want


def test_pruned_ranking_is_the_whole_ranking(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    postings, _ = catalogue(spark, 900, 30, 3)
    queries = spark.createDataFrame(QUERIES, "query string, term string, role string, position int")
    lists = S.posting_lists(postings)
    assert lists.select("block").distinct().count() > 10
    updated = spark.range(900).select(F.col("id").alias("doc"), (F.col("id") * 7 % 50).alias("updated"))
    matched = S.match_terms(lists, queries)
    whole = S.rank_catalog(S.cover_density(lists, queries, matched), updated, 5).select("query", "doc", "rank", "place")
    folded = Counter()
    real = S.cover_ranks

    def counted(held):
        out = real(held)
        folded["rows"] += out.count()
        return out

    monkeypatch.setattr(S, "cover_ranks", counted)
    got = S.rank_top(lists, queries, updated, 5).select("query", "doc", "rank", "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert folded["rows"] < 0.8 * matched.count()


def test_a_term_in_every_document_is_many_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 20)
    postings, _ = catalogue(spark, 400, 30, 5)
    lists = S.posting_lists(postings)
    sizes = [r.df for r in S.directory(lists).filter("term = 'every'").collect()]
    assert sum(sizes) == 400 and max(sizes) < 60
    assert S.posting_lists(postings.limit(0)).count() == 0
    empty = S.match_terms(postings.limit(0), spark.createDataFrame(QUERIES, "query string, term string, role string, position int"))
    assert empty.count() == 0


def test_words_are_stemmed_once_and_lists_lie_by_document(spark):
    postings, _ = catalogue(spark, 300, 30)
    asked = spark.createDataFrame([("t1",), ("every",)], "stem string")
    wanted = S.stem_vocabulary(postings).join(asked, "stem", "left_semi")
    # a distinct in the same plan lets the join, and with it the stemmer, be pushed below it to every posting
    assert "Aggregate [term" not in wanted._jdf.queryExecution().optimizedPlan().toString()
    lists = S.posting_lists(postings, 300)
    files = lists.select("doc", F.input_file_name().alias("file")).groupBy("doc").agg(F.count_distinct("file").alias("files"))
    assert files.filter("files > 1").count() == 0
    assert lists.select("doc", "term").distinct().count() == lists.count() == postings.select("doc", "term").distinct().count()


def test_stop_words_do_not_move_the_postings(spark):
    from lodestack.plans.base import Tables
    from lodestack.plans.search import postings
    from tests.conftest import SF

    plan = postings(Tables(spark, SF))[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lists_of_pairs(spark):
    postings, rows = catalogue(spark, 60, 8)
    lists = S.posting_lists(postings, 60)
    asked = spark.createDataFrame([("a", "t0"), ("a", "t1"), ("a", "t1"), ("b", "t1"), ("b", "every"), ("c", "none")], "query string, term string")
    pairs = spark.createDataFrame([("a", d) for d in range(0, 60, 2)] + [("b", d) for d in range(0, 60, 3)] + [("b", 0), ("c", 1)], "query string, doc long")
    held = {(d, t) for d, t, *_ in rows}
    want = {(q, d, t) for q, d in map(tuple, pairs.collect()) for a, t in map(tuple, asked.collect()) if a == q and (d, t) in held}
    got = [tuple(r) for r in S.lists_of(lists, asked, pairs).collect()]
    assert set(got) == want and len(got) == len(want)
