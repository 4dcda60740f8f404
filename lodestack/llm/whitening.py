"""Whitening of vectors by covariances that are recovered from variances (polarisation).

Entries become whole numbers.  For every dimension i and every sum of two dimensions i + j the squared
centred values are added up exactly; since var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of
these variances are all cross-covariances.  They are assembled to a matrix of D x D numbers, whose
eigenvectors whiten the vectors.

Tasks centre on whole numbers next to the mean, m = round(S / n), and the rest is set right exactly: with
y = x - m and T = sum of y, the sum of (n x - S)^2 is n (n sum(y^2) - T^2).  Sums are whole numbers of
any size, as text where they leave a task, so they do not depend on order or partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.scratch import arrow_batches, settle

#: Scale and shift of entries, and components that are returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Scaled entries are held within these whole numbers, which doubles represent exactly.
MOST = 1 << 52
#: Vectors that a task works on at once.
ROWS = 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, c array<double>) of the rows whose vector is not null and has only finite entries."""
    c = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), c.alias("c")).filter(F.col("c").isNotNull() & finite)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """The entries as whole numbers, (rows, dims); entries that a shorter vector lacks are zeros."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    lens = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lens), dims))
    out[np.arange(dims) < lens[:, None]] = flat
    return np.clip(np.floor(out * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def exact(y: np.ndarray, terms: int, factor: int = 1) -> np.ndarray:
    """``y * factor`` in a type that holds the sum of ``terms`` squares of sums of two of them."""
    most = int(np.abs(y).max(initial=0)) * factor
    return y * factor if (2 * most) ** 2 * max(terms, 1) < 1 << 63 else y.astype(object) * factor


def sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            x = whole(b.column(1), dims)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, exact(x, len(x)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[*map(str, total)]])], names=["n", "total"])

    with arrow_batches(vectors.sparkSession, ROWS):
        rows = vectors.mapInArrow(run, "n long, total array<string>").collect()  # one row of D numbers a partition, summed below
    return sum(r.n for r in rows), [sum(int(r.total[i]) for r in rows) for i in range(dims)]


def pair_squares(vectors: DataFrame, centre: list[int]) -> DataFrame:
    """(i, j, part): for i < j the sum of (y_i + y_j)^2, for i = j of y_i^2, exact."""
    dims, at = len(centre), np.array(centre, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[0] * (dims - i) for i in range(dims)]
        for b in batches:
            y = whole(b.column(1), dims) - at
            y = exact(y, len(y))
            for i in range(dims):
                z = y[:, i:] + y[:, i : i + 1]
                z[:, 0] = y[:, i]
                got[i] = [a + int(s) for a, s in zip(got[i], (z * z).sum(axis=0), strict=True)]
        ij = [(i, j) for i in range(dims) for j in range(i, dims)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ij], pa.int32()), pa.array([j for _, j in ij], pa.int32()), pa.array([str(v) for row in got for v in row])], names=["i", "j", "part"])

    with arrow_batches(vectors.sparkSession, ROWS):
        parts = vectors.mapInArrow(run, "i int, j int, part string").withColumn("part", F.col("part").cast("decimal(38,0)"))
        return settle(parts.groupBy("i", "j").agg(F.sum("part").alias("part")), "squares")


def covariance(vectors: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """(V, centre): the covariance of all dimensions, each entry the nearest double of the exact fraction."""
    dims = len(total)
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]
    got = {(r.i, r.j): int(r.part) for r in pair_squares(vectors, centre).collect()}  # D (D + 1) / 2 rows
    var = [n * got[i, i] - rest[i] ** 2 for i in range(dims)]  # n^2 times the variance
    v = np.empty((dims, dims))
    for i in range(dims):
        v[i, i] = var[i] / (n * n)
        for j in range(i + 1, dims):
            both = n * got[i, j] - (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - var[i] - var[j]) / (2 * n * n)
    return v, centre


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    Vectors that are null or have null or non-finite entries go.  All others count, repeated rows and
    null ids included; a vector shorter than the longest has zeros for the rest, and scaled entries are
    held within 2^52.  There are as many components as dimensions, at most ``components``.  A component
    without spread (an eigenvalue that is zero to rounding) has whitened 0 and explained its share;
    ``identity_error`` then is 1.  ``deviation`` is null where it does not fit a long.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vec_col)
    dims = rows.agg(F.max(F.size("c"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    n, total = sums(rows, dims)
    v, centre = covariance(rows, n, total)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:components].clip(min=0), basis[:, ::-1][:, :components]
    trace = float(np.trace(v))
    spread = values > dims * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    onto = np.where(spread, basis / np.sqrt(np.where(spread, values, 1)), 0)
    at, rest = np.array(centre, dtype=np.int64), [s - n * m for s, m in zip(total, centre, strict=True)]
    mean_rest = np.array([r / n for r in rest])  # what the means have over the whole centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = whole(b.column(1), dims) - at
            z = exact(y, dims, n) - np.array(rest, dtype=object if max(map(abs, rest), default=0) >> 62 else np.int64)
            far = [int(d) for d in (z * z).sum(axis=1)]
            w = (y - mean_rest) @ onto
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d if d < 1 << 63 else None for d in far], pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    with arrow_batches(spark, ROWS):
        made = settle(rows.mapInArrow(run, f"id {kind}, deviation long, w array<double>"), "whitened")
    error = identity_error(made, n, len(values))
    each = made.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(e) / trace if trace else 0.0) for e in values]), F.col("k") + 1)
    out = each.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
    return out


def identity_error(made: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` (divisor n) minus the identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = np.asarray(b.column(0).flatten(), dtype=np.float64).reshape(-1, k)
            total += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["total", "square"])

    with arrow_batches(made.sparkSession, ROWS):
        parts = made.select("w").mapInArrow(run, "total array<double>, square array<double>").collect()  # k + k^2 numbers a partition
    mean = np.sum([r.total for r in parts], axis=0) / n
    cov = np.sum([r.square for r in parts], axis=0).reshape(k, k) / n - np.outer(mean, mean)  # the means are zero to rounding
    return float(np.abs(cov - np.eye(k)).max())
