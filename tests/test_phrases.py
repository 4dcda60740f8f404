"""The phrase automaton against plain substring search, and tagging with many and long terms."""

import random

from lodestack.functions.phrases import Phrases
from lodestack.operators.metadata import tag_terms


def test_every_phrase_is_found():
    rng = random.Random(5)
    for _ in range(300):
        word = lambda: rng.choice("abc")
        phrases = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 20))})
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
        line = f" {' '.join(text)} "
        assert Phrases(phrases).find(text) == {i for i, p in enumerate(phrases) if f" {p} " in line}


def test_long_terms_parts_and_subjects(spark):
    long = " ".join(f"w{i}" for i in range(40))
    vocabulary = spark.createDataFrame([(long, "long"), ("W3 w4", "short"), ("w39", "short"), ("one-two", "pair"), ("two three", "pair"), ("w3 w4", "other"), ("--", "none")], "term string, kind string")
    docs = spark.createDataFrame([(1, f"x {long.upper()} y", ["one, two", "three"]), (2, None, None), (3, "one <b>two</b> three", [None, "w3 W4"]), (1, "one two", [])], "id long, text string, subjects array<string>")
    want = {(1, "long"): long, (1, "short"): "w3 w4,w39", (1, "other"): "w3 w4", (1, "pair"): "one two", (3, "pair"): "one two,two three", (3, "short"): "w3 w4", (3, "other"): "w3 w4"}
    for part in (2, 100):
        assert {(r.id, r.kind): r.terms for r in tag_terms(docs, vocabulary, "id", "text", "subjects", part).collect()} == want
    assert tag_terms(docs.limit(0), vocabulary, "id", "text").count() == 0 and tag_terms(docs, vocabulary.limit(0), "id", "text").count() == 0


def test_a_large_vocabulary_in_one_pass(spark):
    """No row per word: rows are made for matches only."""
    vocabulary = spark.range(60_000).selectExpr("concat('term', id, ' of ', id % 97, ' parts') AS term", "concat('k', id % 3) AS kind")
    docs = spark.range(300).selectExpr("id", "concat_ws(' ', repeat('filler words here ', 200), 'term', concat('term', id * 7), 'of', id * 7 % 97, 'parts') AS text")
    got = {r.id: (r.kind, r.terms) for r in tag_terms(docs, vocabulary, "id", "text").collect()}
    assert got == {i: (f"k{i * 7 % 3}", f"term{i * 7} of {i * 7 % 97} parts") for i in range(300)}
