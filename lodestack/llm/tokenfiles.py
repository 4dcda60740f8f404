"""Token-id files: tokenised documents as independently decodable entropy-coded blocks.

Documents are range-partitioned by id and encoded in id order into blocks of whole documents.  Token
frequencies over all blocks give one shared table, and every block is coded by ``rans``.  A file is
a Parquet file of block rows (part, block, before, n_ids, ids, lens, words, points, sums): ``before``
counts the ids of the part that come earlier, so a reader finds any document from small columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import rans, subwords
from lodestack.scratch import arrow_batches, new_path, settle

END = 2
#: Ids after which a block is closed; a block holds whole documents.
BLOCK = 1 << 18
#: Blocks in an Arrow batch; a block has half a megabyte of ids.
BATCH = 8


def write_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END) -> tuple[str, np.ndarray]:
    """Write the files; return their path and the token counts behind the shared table.

    Null texts count as empty, which still gets its end id.  Order is by id, nulls first; rows with
    equal ids are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    path = vocabulary or subwords.default_path()
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    mark = np.array([end], dtype="<u2").tobytes()
    id_type = pa.int64() if kind == "bigint" else None

    def blocks(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, lens, raw, size = [], [], [], 0
        memo = subwords.memo(path)

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(id_type)) if id_type else pa.array([ids]), pa.array([lens], pa.list_(pa.int32())), pa.array([b"".join(raw)], pa.binary())],
                names=["part", "block", "before", "n_ids", "ids", "lens", "raw"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = memo.ids(t) + mark
                ids.append(i)
                lens.append(len(got) // 2)
                raw.append(got)
                size += len(got) // 2
                if size >= BLOCK:
                    yield row()
                    block, before = block + 1, before + size
                    ids, lens, raw, size = [], [], [], 0
        if ids:
            yield row()

    head = f"part int, block int, before long, n_ids long, ids array<{kind}>, lens array<int>"
    with arrow_batches(spark, 256):
        staged = settle(rows.mapInArrow(blocks, f"{head}, raw binary"), "ids")

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, dtype="<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["token", "n"])

    counts = np.zeros(1 << 16, dtype=np.int64)
    with arrow_batches(spark, BATCH):
        for r in staged.select("raw").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
            counts[r.token] = r.n  # at most 65536 rows
    shared = spark.sparkContext.broadcast(counts)

    def code(batches):
        table = rans.Table(shared.value)
        for b in batches:
            coded = [rans.encode(np.frombuffer(x, dtype="<u2"), table) for x in b.column(6).to_pylist()]
            cols = list(zip(*coded, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *[pa.array(c, pa.binary()) for c in cols]], names=[*b.schema.names[:6], "words", "points", "sums"])

    out = new_path(spark, "tokens")
    with arrow_batches(spark, BATCH):
        staged.mapInArrow(code, f"{head}, words binary, points binary, sums binary").write.option("compression", "uncompressed").parquet(out)
    return out, counts


def read_files(spark: SparkSession, path: str, counts: np.ndarray) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.parquet(path)
    kind = dict(files.dtypes)["ids"][len("array<") : -1]
    shared = spark.sparkContext.broadcast(counts)

    def documents(batches):
        table = rans.Table(shared.value)
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                n = col["n_ids"][i].as_py()
                ids = rans.decode(col["words"][i].as_py(), col["points"][i].as_py(), col["sums"][i].as_py(), n, table).astype("<u4")
                lens = np.array(col["lens"][i].as_py(), dtype=np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
                start = ends - lens + col["before"][i].as_py()
                yield pa.RecordBatch.from_arrays([col["ids"].slice(i, 1).flatten(), pa.array([col["part"][i].as_py()] * len(lens), pa.int32()), pa.array(start), pa.array(lens), pa.array(crc, pa.int64())], names=["id", "part", "start", "n_tokens", "ids_crc32"])

    with arrow_batches(spark, BATCH):
        rows = settle(files.mapInArrow(documents, f"id {kind}, part int, start long, n_tokens long, ids_crc32 long"), "decoded")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a file part
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", base.alias("base"))
    return rows.join(parts, "part").select("id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all documents as token files and return what reading them back shows."""
    path, counts = write_files(docs, id_col, text_col, vocabulary)
    return read_files(docs.sparkSession, path, counts).withColumnRenamed("id", id_col)
