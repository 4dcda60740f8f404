"""JSON-lines operational logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_LOG = "event string, outcome string, duration double, retry_count long, correlation_id string, ts timestamp"


def scan_events_log(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan with the explicit schema; lines that are no JSON objects come with null fields."""
    return spark.read.schema(EVENT_LOG).json(path)


def stream_events_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_LOG).json(path)


def parse_event_log(lines: DataFrame) -> DataFrame:
    """The same records from a column of lines."""
    return lines.select(F.from_json("value", EVENT_LOG).alias("e")).select("e.*")
