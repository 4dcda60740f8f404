"""Whitening against exact fractions and numpy on the same vectors."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import registry, whitening
from tests.conftest import SF


def plain(vectors):
    """(n, S, V as exact fractions, x) of plain lists of floats."""
    dims = max(map(len, vectors))
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] + [100_000] * (dims - len(v)) for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(dims)] for i in range(dims)]
    return n, s, np.array([[float(c) for c in row] for row in cov]), centred


def check(got, ids, vectors, components=8):
    n, _, v, centred = plain(vectors)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, min(components, len(v)) + 1))
    for k, rows in by.items():
        assert set(rows) == set(ids)
        w = np.array([rows[i].whitened for i in ids])
        want = (np.array(centred, dtype=float) / n) @ basis[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-6
        for i, c in zip(ids, centred, strict=True):
            assert (rows[i].n, rows[i].deviation) == (n, sum(a * a for a in c))
            assert rows[i].explained == pytest.approx(values[k - 1] / np.trace(v), rel=1e-9)
            assert rows[i].identity_error < 1e-9


def test_query_is_the_plain_rule(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(registry.op13_whitening(spark, SF).collect(), [r.vec_id for r in good], [r.embedding for r in good])


def test_covariances_are_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, r)) for r in rng.normal(2, 50, (300, 5)) @ rng.normal(0, 1, (5, 5))]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    rows = whitening.usable(frame, "vec_id", "embedding")
    n, total = whitening.sums(rows, 5)
    v, _ = whitening.covariance(rows, n, total)
    assert np.array_equal(v, plain(vectors)[2])  # bit by bit


def test_bad_vectors_go_and_odd_ones_are_defined(spark):
    rng = np.random.default_rng(5)
    good = [[float(c) for c in r] for r in rng.normal(0, 1, (50, 3))] + [[1.0], [], [2.0, -1.0]]
    bad = [None, [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [1.0, float("inf"), 0.0]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(good + bad)], "vec_id long, embedding array<double>, n int")
    check(whitening.whiten(frame).collect(), range(len(good)), good)


def test_huge_entries_and_no_spread(spark):
    frame = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (None, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert len(got) == 10 and all(r.n == 5 for r in got) and any(r.deviation is None for r in got)
    flat = whitening.whiten(spark.createDataFrame([(i, [1.5, 2.5]) for i in range(4)], "vec_id long, embedding array<float>")).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat} == {(0.0, 0.0, 0, 1.0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(none.unionByName(spark.createDataFrame([(1, None)], none.schema))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [])], none.schema)).count() == 0


def test_order_does_not_matter(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, other = (whitening.sums(whitening.usable(f, "vec_id", "embedding"), 64) for f in (frame, frame.repartition(7, F.rand(1))))
    assert one == other
