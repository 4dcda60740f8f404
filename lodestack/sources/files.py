"""Scans of files by ranges of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.file_bytes import format_of
from lodestack.functions.resources import FORMATS, path_extension
from lodestack.scratch import arrow_batches

#: Bytes that are read of a file's beginning, and of its end.
SAMPLE = 65_536


def byte_ranges(path: str, length: int, sample: int = SAMPLE) -> tuple[bytes, bytes]:
    """The first and the last ``sample`` bytes of a file in any store that pyarrow opens by its address."""
    import pyarrow.fs as fs

    store, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        head = f.read(min(sample, length))
        f.seek(max(0, length - sample))
        return head, f.read(min(sample, length))


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, claimed, mismatch) of every file below a path or pattern, by its bytes against its
    extension.  Spark lists the files; tasks read two ranges of each, so a file's size does not matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [format_of(*byte_ranges(p, n), n) for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["path", "format"])

    claimed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), path_extension(F.col("path"))), F.lit("UNKNOWN"))
    with arrow_batches(spark, 256):
        out = files.mapInArrow(run, "path string, format string").withColumn("claimed", claimed)
    return out.withColumn("mismatch", F.col("format") != F.col("claimed"))
