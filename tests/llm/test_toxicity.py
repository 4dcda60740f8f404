"""Toxicity: held-out accuracy on planted texts, the label model on votes of known making, counts by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import registry, toxicity
from lodestack.llm.textops import id_crc
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed=1):
    """Texts of invented words; toxic ones hold some words that begin with one of two stems."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprstv" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [word() for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(("zwakk", "qorrum")) + word())
        docs.append((i, " ".join(words), "xx", "s", len(words)))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
        docs[-1] += (toxic,)
    return docs, labels


@pytest.fixture(scope="module")
def planted(spark):
    docs, labels = corpus(2500)
    truth = {d[0]: d[5] for d in docs}
    return spark.createDataFrame([d[:5] for d in docs], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_texts_are_told(planted):
    docs, labels, truth = planted
    part = id_crc(F.col("doc_id")) % 4
    got = toxicity.toxicity(docs, labels, part != 2).join(docs.select("doc_id", part.alias("part")), "doc_id").collect()
    held = [r for r in got if r.part == 2]
    toxic, clean = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert len(got) == 2500 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.score >= 0.3 for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.score >= 0.3 for r in clean) <= 0.02 * len(clean)


def test_scores_depend_on_text_alone(spark, planted):
    docs, labels, _ = planted
    keep = id_crc(F.col("doc_id")) % 4 != 2
    learned = toxicity.learn(docs, labels, keep)
    moved = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("yy").alias("lang")).repartition(3)
    a = {r.doc_id: r.score for r in toxicity.score(docs, learned).collect()}
    assert a == {r.doc_id - 10_000: r.score for r in toxicity.score(moved, learned).collect()}


def test_copies_and_held_out_labels_change_nothing(spark, planted):
    docs, labels, truth = planted
    part = id_crc(F.col("doc_id")) % 4
    entries, base, _ = toxicity.learn(docs, labels, part != 2)
    copies = docs.filter("doc_id = 0").crossJoin(spark.range(1200).select(F.lit(1).alias("x"))).drop("x")
    lies = labels.join(docs.select("doc_id", part.alias("part")), "doc_id").select("doc_id", "quality", F.when(F.col("part") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    again = toxicity.learn(docs.unionByName(copies), lies, part != 2)
    assert (entries, base) == again[:2]


def test_associations_are_counts_of_texts(spark, planted):
    docs, labels, _ = planted
    rows = docs.join(labels, "doc_id").select("text", "toxic").limit(300).cache()
    n, t = Counter(), Counter()
    for r in rows.collect():
        found = {f for w in set(r.text.split()) for f in [f"{w}$", *[w[:k] for k in (4, 5, 6, 7) if len(w) > k]]}
        n.update(found)
        t.update(found if r.toxic else ())
    got = {r.feature: (r.toxic, r.n) for r in toxicity.associations(rows).collect()}
    assert got == {f: (t[f], c) for f, c in n.items() if c >= toxicity.SUPPORT}


def test_label_model_finds_accuracies_and_correlations(spark):
    """Voters 0 and 1 copy each other; 2, 3 and 4 are independent; labels are known for a fifth."""
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.2
    v = np.zeros((len(y), toxicity.VOTERS), dtype=bool)
    hit = [0.6, 0.6, 0.8, 0.7, 0.5]
    for j in (0, 2, 3, 4):
        v[:, j] = rng.random(len(y)) < np.where(y, hit[j], 0.1)
    v[:, 1] = np.where(rng.random(len(y)) < 0.95, v[:, 0], ~v[:, 0])
    votes = (v * (1 << np.arange(toxicity.VOTERS, dtype=np.int64))).sum(axis=1)
    given = np.where(rng.random(len(y)) < 0.2, y, -1)
    rows = [(int(a), int(b), n) for (a, b), n in Counter(zip(votes.tolist(), given.tolist(), strict=True)).items()]
    model = toxicity.estimate(spark.createDataFrame(rows, "votes long, given long, n long"), 0.3)
    assert abs(model.prior - 0.2) < 0.02
    assert model.parents[1] == 0 or model.parents[0] == 1
    j, p = (1, 0) if model.parents[1] == 0 else (0, 1)
    assert all(model.tables[j][k][s, s] > 0.9 for k in (0, 1) for s in (0, 1)), "a copy"
    for k in (2, 3, 4):
        table = model.tables[k][1] if model.parents[k] in (-1, *range(5)) else None
        assert table is None or np.abs(table[:, 1] - hit[k]).max() < 0.1
    told = model.posterior(votes, np.full(len(y), -1))
    assert ((told > 0.5) == y).mean() > 0.93


def test_regression_is_at_its_minimum():
    rng = np.random.default_rng(0)
    at = [rng.choice(50, 6, replace=False) for _ in range(300)]
    values = [rng.random(6) for _ in at]
    target = np.array([0.9 if 3 in a else 0.1 for a in at])
    w = toxicity.regression(at, values, target, 500)
    x = np.zeros((300, len(w) - 1))
    for i, (a, v) in enumerate(zip(at, values, strict=True)):
        x[i, a] = v
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - target) + toxicity.PENALTY * w[:-1]).max() < 0.05 and abs((p - target).sum()) < 0.05


def test_query_and_odd_input(spark, odd, nothing):
    got = registry.op11_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, 1), (1, 0, 1), (5, 1, 0), (None, 1, 1), (7, 0, None), (99, 1, 1)], none.schema)
    for frame in (odd, nothing):
        for labels in (none, some):
            rows = toxicity.toxicity(frame, labels, F.lit(True)).collect()
            assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)


def test_fixed_voters_work_without_labels(spark):
    docs = [(i, "you stupid worthless moron, what a pathetic idiot" if i % 10 == 0 else f"a quiet note on gardens {i} and the weather of spring", "en", "s", 1) for i in range(400)]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).collect()}
    assert min(got[i] for i in range(0, 400, 10)) > max(s for i, s in got.items() if i % 10)
