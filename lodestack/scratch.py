"""Places and helpers for intermediate tables that must outlive a lost executor.

Lineage is cut by writing Parquet below the folder that ``spark.checkpoint.dir`` names.  Every
executor and the driver can read it, so no step depends on one machine's disk.  Only in
local mode without the setting (tests) a temporary folder is made and set.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, created and set only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so Python tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestack_sent", False):
        return
    root = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "lodestack_src.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(at))
    sc._lodestack_sent = True


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting for the jobs that run inside the block; the former value comes back afterwards."""
    was = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Ready the session for Python tasks that run inside the block, with Arrow batches of ``rows``
    rows; few where a row may be very long."""
    ship(spark)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, which is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
