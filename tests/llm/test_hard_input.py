"""Inputs that once took quadratic time or memory: long texts, many letters, many equal rows."""

import hashlib
import random
import resource
import time

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import language, packing, pii
from tests.llm.test_operators import plain_spans


def test_a_text_of_many_identifiers(spark):
    """A log of 100,000 identifiers: linear, and the same as the plain rule."""
    rng = random.Random(1)
    lines = [f"user word{i} wrote mail{i}@example{i % 7}.org from 10.0.{i % 256}.{rng.randrange(300)} today" for i in range(50_000)]
    text = "\n".join(lines)
    start = time.time()
    row = pii.digest(pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    assert time.time() - start < 240
    want = plain_spans(text)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and len(want) > 90_000


def test_pieces_change_nothing(spark, monkeypatch):
    """Small pieces give the spans, patterns and redactions of the whole text."""
    rng = random.Random(2)
    bits = ["call +1 (743) 555-3824 now", "my card 4111 1111 1111 1111 ok", "é mail a@b.co und", "the mailbox: someone@localhost here", "1 2 3", "x"] + [f"mailbox: user{i}@ex{i}.org end" for i in range(6)]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").cache()

    def run():
        found = pii.extract(frame)
        return sorted(map(str, pii.digest(found).collect())), sorted(map(str, pii.redact(frame, found).collect()))

    whole = run()
    monkeypatch.setattr(pii, "PIECE", 60)
    monkeypatch.setattr(pii, "CUT", pii.CUT.replace("16384", "60"))
    assert run() == whole
    assert any("<CARD>" in r for r in whole[1])


def test_many_distinct_letters_in_bounded_memory():
    rng = np.random.default_rng(0)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 400_000)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    vectors, has = language.bundle([text, "abc"])
    assert has.all() and vectors[0].any()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # kB


def test_blocks_of_grams_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij klmnop一丁丂") for _ in range(rng.randrange(400))) for _ in range(40)]
    whole, _ = language.bundle(texts)
    monkeypatch.setattr(language, "GRAMS", 7)
    assert np.array_equal(language.bundle(texts)[0], whole)


def test_repeated_rows_are_dealt_over_all_groups(spark):
    same = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("s").alias("source"))
    start = time.time()
    out = packing.pack(same, group=2000)
    rows = out.groupBy(F.shiftright("bin", 24).alias("g")).count().collect()
    assert time.time() - start < 120
    assert sum(r["count"] for r in rows) == 40_000 and max(r["count"] for r in rows) < 4000
    assert out.select("bin").distinct().count() == 40_000  # one cluster and source: no two in a bin
