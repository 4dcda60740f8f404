"""The pipeline's stages against plain restatements of their decisions."""

from collections import Counter

import corpus_pipeline as P
import __spark_entry__
from tests.conftest import SF
from tests.llm.test_operators import check_bins, plain_groups, plain_spans


def test_stages_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:2]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns, name
        kept = out
    before = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text)}
    want = set(plain_groups(before).values())
    assert {r.doc_id for r in kept.collect()} == want
    clean = P.redact_personal_data(spark, kept, SF).cache()
    for r in clean.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    mixed = P.mix_sources(spark, clean, SF).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and mixed.columns == docs.columns
    packed = P.pack_bins(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    text = {r.doc_id: r.text for r in mixed.collect()}
    check_bins([(r.bin, r.n_tokens, r.source, text[r.doc_id]) for r in packed], 2048)


def test_run_and_registration(spark):
    assert P.run(spark, SF).count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11))


def test_stages_on_odd_input(spark, odd, nothing):
    for name, stage in P.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, nothing, SF).count() == 0, name


def test_no_document_is_lost_to_its_id(spark):
    """Documents are told apart by their texts, however ids repeat or are null."""
    words = [" ".join(f"{c}{i}{j}" for j in range(60)) for i, c in enumerate("abcdef")]
    rows = [(1, words[0]), (1, words[1]), (None, words[2]), (None, words[3]), (3, words[4]), (4, words[4]), (None, words[4]), (None, words[5]), (None, words[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.keep_one_of_near_duplicates(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", words[0]), ("1", words[1]), ("None", words[2]), ("None", words[3]), ("3", words[4]), ("None", words[5])])
    assert P.redact_personal_data(spark, docs, SF).count() == len(rows)
    mixed = Counter((r.doc_id, r.text) for r in P.mix_sources(spark, docs, SF).collect())
    assert set(mixed) == set(rows) and max(mixed.values()) <= 3 * 2


def test_stages_keep_their_rows_on_odd_input(spark, odd):
    rows = odd.collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    assert P.keep_known_languages(spark, odd, SF).count() == len(lettered)
    groups = plain_groups({i: r.text for i, r in enumerate(rows)})
    assert P.keep_one_of_near_duplicates(spark, odd, SF).count() == len(set(groups.values()))
    assert P.redact_personal_data(spark, odd, SF).count() == len(rows)
    mixed = P.mix_sources(spark, odd, SF).collect()
    assert all(any(c.strip() for c in r.text or "") for r in mixed)
    assert len({(r.bin, r.bin_pos) for r in P.pack_bins(spark, odd, SF).collect()}) == P.pack_bins(spark, odd, SF).count()


def test_language_stage_without_labels(spark, odd):
    from pyspark.sql import functions as F

    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = P.keep_known_languages(spark, rows, SF).collect()
    assert sorted(str(r.text) for r in kept) == sorted(str(r.text) for r in rows.collect() if any(c.isalpha() for c in r.text or ""))
