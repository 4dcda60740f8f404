"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by its code point.  An n-gram of letters is
bound by multiplying the vectors of its letters, each permuted (rolled) by its place; a document
is the sum of its n-gram vectors, and a language prototype the sum over its training documents.
A document gets the language whose prototype has the largest cosine with it.

Prototypes are sums of integers, so they do not depend on the order of rows.  Their number is the
number of distinct labels, not of documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.scratch import arrow_batches, settle

DIM = 1024
N = 3
UNKNOWN = "und"
#: Characters that are counted together in one matrix product.
BLOCK = 200_000
#: Distinct n-grams, at most, whose vectors are held at once.
GRAMS = 8192


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


@lru_cache(maxsize=8192)
def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The +1 / -1 vector of a code point; 32 stands for any run of non-letters."""
    return (np.random.default_rng([17, code]).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """One row per n-gram given as rows of code points."""
    codes, where = np.unique(grams, return_inverse=True)
    where = where.reshape(grams.shape)
    table = np.stack([letter_vector(int(c), dim) for c in codes])
    n = grams.shape[1]
    out = table[where[:, n - 1]]
    for i in range(n - 1):
        out = out * np.roll(table, n - 1 - i, axis=1)[where[:, i]]
    return out


def _codes(text: str | None) -> np.ndarray:
    """Lower-cased code points with each run of non-letters as one space; empty without letters."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = _letters()[raw]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint32)
    codes = np.where(is_letter, raw, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of non-letters
    codes = codes[keep]
    edge = np.array([32], dtype=codes.dtype)
    return np.concatenate([edge[: int(codes[0] != 32)], codes, edge[: int(codes[-1] != 32)]])


def bundle(texts: list[str | None], dim: int = DIM, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has_letters): the sum of n-gram vectors of each text, exact integers in float32."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        sizes = np.array([len(c) - n + 1 for _, c in held])
        whole = np.concatenate([c for _, c in held]).astype(np.int64)
        alphabet, dense = np.unique(whole, return_inverse=True)
        starts = np.concatenate([np.arange(at, at + k) for at, k in zip(np.cumsum(sizes + n - 1) - (sizes + n - 1), sizes, strict=True)])
        key = dense[starts]
        for i in range(1, n):
            key = key * len(alphabet) + dense[starts + i]
        if len(alphabet) ** n <= 1 << 20:  # a lookup table is faster than sorting
            seen = np.zeros(len(alphabet) ** n, dtype=np.int32)
            seen[key] = 1
            grams = np.flatnonzero(seen)
            seen[grams] = np.arange(len(grams))
            where = seen[key]
        else:
            grams, where = np.unique(key, return_inverse=True)
        parts = np.stack([alphabet[(grams // len(alphabet) ** (n - 1 - i)) % len(alphabet)] for i in range(n)], axis=1)
        rows = np.repeat(np.arange(len(held)), sizes)
        step = max(1, min(GRAMS, (1 << 22) // max(1, len(held))))  # so the count matrix and the table of grams stay small
        at_rows = [i for i, _ in held]
        for lo in range(0, len(grams), step):
            hi = min(len(grams), lo + step)
            pick = (where >= lo) & (where < hi) if step < len(grams) else slice(None)
            counts = np.bincount(rows[pick] * (hi - lo) + (where[pick] - lo), minlength=len(held) * (hi - lo)).reshape(len(held), hi - lo)
            out[at_rows] += counts.astype(np.float32) @ gram_vectors(parts[lo:hi], dim)
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        c = _codes(t)
        has[i] = len(c) > 0
        if len(c) >= n:
            held.append((i, c))
            size += len(c)
        if size > BLOCK:
            flush()
            size = 0
    flush()
    return out, has


def prototypes(docs: DataFrame, text_col: str = "text", label_col: str = "lang", dim: int = DIM, n: int = N) -> DataFrame:
    """(label, i, v): the prototype vector of each non-null label, from all rows of ``docs``.

    Each task sends one partial vector a label, and Spark adds them.
    """
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            labels = b.column(1).to_pylist()
            vectors, _ = bundle(b.column(0).to_pylist(), dim, n)
            for name in set(labels):
                part = vectors[[i for i, x in enumerate(labels) if x == name]].sum(axis=0, dtype=np.float64).astype(np.int64)
                sums[name] = sums[name] + part if name in sums else part
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim, pa.string()), pa.array(range(dim), pa.int32()), pa.array(v)], names=["label", "i", "v"])

    parts = docs.filter(F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).mapInArrow(run, "label string, i int, v long")
    with arrow_batches(docs.sparkSession, 512):
        return settle(parts.groupBy("label", "i").agg(F.sum("v").alias("v")), "profiles")


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, n: int = N, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id with lang_pred and score for every row, and ``keep`` columns in a struct ``kept``.

    The score is the cosine with the best prototype, cut to 0..1.  A null text, one without
    letters, or an empty set of profiles gives ``und`` with score 0.  Ties go to the label that is
    first in code-point order.
    """
    spark = docs.sparkSession
    got: dict[str, np.ndarray] = {}
    for r in profiles.collect():  # labels x dim numbers, whatever the number of documents
        got.setdefault(r.label, np.zeros(dim))[r.i] = r.v
    names = sorted(got)
    norm = [np.linalg.norm(got[k]) or 1.0 for k in names]
    shared = spark.sparkContext.broadcast((names, np.array([got[k] / x for k, x in zip(names, norm, strict=True)]).reshape(len(names), dim)))

    def run(batches):
        labels, proto = shared.value
        for b in batches:
            vectors, has = bundle(b.column(0).to_pylist(), dim, n)
            pred, score = [UNKNOWN] * len(has), np.zeros(len(has))
            if labels:
                length = np.linalg.norm(vectors.astype(np.float64), axis=1)
                cos = np.round(vectors.astype(np.float64) @ proto.T / np.maximum(length, 1e-9)[:, None], 9)
                best = cos.argmax(axis=1)
                for i in np.flatnonzero(has):
                    pred[i], score[i] = labels[best[i]], min(1.0, max(0.0, float(cos[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names[1:], "lang_pred", "score"])

    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"), *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []))
    schema = StructType(src.schema.fields[1:]).add("lang_pred", "string").add("score", "double")
    with arrow_batches(spark, 512):
        return settle(src.mapInArrow(run, schema), "identified").withColumnRenamed("id", id_col)
