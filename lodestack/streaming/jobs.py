"""Structured Streaming forms of quotas, commands, job states and catalogue upserts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestack.operators import merge as M
from lodestack.scratch import new_path, ship

# the driver's own state worker does not see shipped files, so the processors travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a table, in the table's own schema.

    The path is given as a pattern, because a stream over a plain path wants a directory."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run all available input into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, log = new_path(spark, label), new_path(spark, f"{label}-log")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def quota_usage_stream(requests: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Requests per tumbling window and key; windows later than the watermark are dropped."""
    w = requests.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "n")


class Admit(StatefulProcessor):
    """Greedy admission per key; an older timestamp counts in the newest window."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "window long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window, used = self.state.get() if self.state.exists() else (-1, 0)
        # a key's rows of one batch come in chunks, which are not in order among themselves
        pdf = pd.concat(rows).sort_values(["ts_us", "request_id"], kind="stable")
        out = []
        for request, at, amount in zip(pdf["request_id"], pdf["ts_us"], pdf["amount"], strict=True):
            own = int(at) // self.micros
            if own > window:
                window, used = own, 0
            ok = used + int(amount) <= self.limit
            used += int(amount) if ok else 0
            out.append((key[0], int(request), ok))
        self.state.update((window, used))
        yield pd.DataFrame(out, columns=["owner_id", "request_id", "admitted"])

    def close(self) -> None:
        pass


def quota_admit_stream(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """(owner_id, request_id, admitted) of a stream with ts_us, request_id and amount."""
    ship(requests.sparkSession)
    return requests.groupBy("owner_id").transformWithStateInPandas(Admit(limit, window_us), "owner_id string, request_id long, admitted boolean", "Append", "None")


def command_dedup_stream(commands: DataFrame, time: str, keys: list[str], retention: str = "1 day") -> DataFrame:
    """The first command of a key within the retention window."""
    return commands.withWatermark(time, retention).dropDuplicatesWithinWatermark(keys)


#: Groups that the keys of commands and of work are dealt into by a hash.
KEY_GROUPS = 16_384


def command_outcomes(retention_ms: int):
    """First command of a key is accepted; the same one again is a replay, another one a conflict.

    Keys are judged a group at a time: a call, a frame and a state for every key would cost far more than its rows."""
    def judge(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()  # no row is older, so a key whose time it has passed is forgotten for all
        known = {k: (first, until) for k, first, until in zip(*state.get, strict=True) if until > now} if state.exists else {}
        # rows of one batch come in chunks, which are not in order among themselves
        columns = ("ts_us", "command_id", "command_key", "fingerprint")
        rows = [] if state.hasTimedOut else [r for pdf in chunks for r in zip(*(pdf[c].tolist() for c in columns), strict=True)]
        rows.sort(key=lambda r: r[:2])
        outcomes = []
        for at, _id, key, mark in rows:
            if key in known:
                outcomes.append("replay" if mark == known[key][0] else "conflict")
            else:
                known[key] = (mark, at // 1000 + retention_ms)
                outcomes.append("accepted")
        left = {k: v for k, v in known.items() if v[1] > now}
        if left:
            state.update((list(left), [first for first, _ in left.values()], [until for _, until in left.values()]))
            state.setTimeoutTimestamp(min(until for _, until in left.values()))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame({"command_key": [r[2] for r in rows], "command_id": [r[1] for r in rows], "outcome": outcomes})

    return judge


def command_outcome_stream(commands: DataFrame, time: str, retention_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """(command_key, command_id, outcome) of commands with command_key, command_id, ts_us, fingerprint and
    ``time``; a key is forgotten the retention time after its first command, in event time."""
    ship(commands.sparkSession)
    dealt = commands.withWatermark(time, late).withColumn("key_group", F.pmod(F.xxhash64("command_key"), F.lit(KEY_GROUPS))).groupBy("key_group")
    return dealt.applyInPandasWithState(command_outcomes(retention_ms), "command_key string, command_id long, outcome string", "keys array<string>, firsts array<string>, untils array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class LatestState(StatefulProcessor):
    """Keeps the newest version of a job; older versions are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get()[0] if self.state.exists() else -1
        for pdf in rows:
            fresh = pdf[pdf["version"] > best].sort_values("version")
            if len(fresh):
                best = int(fresh["version"].iloc[-1])
                yield pd.DataFrame({"job_id": [key[0]], "version": [best], "status": [fresh["status"].iloc[-1]]})
        self.state.update((best,))

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame) -> DataFrame:
    """(job_id, version, status) whenever a newer version of a job arrives."""
    ship(events.sparkSession)
    return events.groupBy("job_id").transformWithStateInPandas(LatestState(), "job_id long, version long, status string", "Append", "None")


def stalled_work(deadline_ms: int):
    """Work that was not finished within its deadline, by event time.

    Rows wait until the watermark has passed them and are then folded in order of time (at one time finished
    first), so order, chunks and batches of arrival do not matter.  A start opens work until it is finished or its
    deadline has passed; starts of open work do not count.  Works are judged a group at a time, as commands are."""
    def judge(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        works, times, kinds, held, since = state.get if state.exists else ([], [], [], [], [])
        rows, opened = list(zip(times, kinds, works, strict=True)), dict(zip(held, since, strict=True))
        if not state.hasTimedOut:
            rows += [(int(ms), str(kind), work) for pdf in chunks for ms, kind, work in zip(*(pdf[c].tolist() for c in ("ms", "kind", "work_id")), strict=True)]
        due, late = sorted((r for r in rows if r[0] <= mark), key=lambda r: r[:2]), []
        for at, kind, work in due:
            if work in opened and opened[work] + deadline_ms < at:
                late.append((work, opened.pop(work)))
            if kind == "finished":
                opened.pop(work, None)
            else:
                opened.setdefault(work, at)
        late += [(work, at) for work, at in opened.items() if at + deadline_ms <= mark]  # the mark itself tells that nothing came up to it
        opened = {work: at for work, at in opened.items() if at + deadline_ms > mark}
        rest = [r for r in rows if r[0] > mark]
        if rest or opened:
            state.update(([r[2] for r in rest], [r[0] for r in rest], [r[1] for r in rest], list(opened), list(opened.values())))
            # a group wakes when the watermark is past this, so at the next row's or deadline's own time
            state.setTimeoutTimestamp(max(1, min([r[0] for r in rest] + [at + deadline_ms for at in opened.values()]) - 1))
        elif state.exists:
            state.remove()
        if late:
            yield pd.DataFrame(late, columns=["work_id", "started_ms"])

    return judge


def stalled_work_stream(events: DataFrame, time: str, deadline_s: int = 300, late: str = "1 minute") -> DataFrame:
    """(work_id, started_ms) of work that was not finished within its deadline; events has work_id, kind
    (started or finished), ms and time.  Rows later than the watermark are dropped."""
    ship(events.sparkSession)
    # ids travel as text, since pandas has no long that may be null
    dealt = events.select(F.col("work_id").cast("string").alias("work_id"), "kind", "ms", time).withWatermark(time, late)
    dealt = dealt.withColumn("key_group", F.pmod(F.xxhash64("work_id"), F.lit(KEY_GROUPS))).groupBy("key_group")
    out = dealt.applyInPandasWithState(stalled_work(deadline_s * 1000), "work_id string, started_ms long", "works array<string>, times array<long>, kinds array<string>, held array<string>, since array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("work_id").cast("long").alias("work_id"), "started_ms")


#: Rows, about, of a part of a streamed catalogue's base; share of the base's rows, and number of rows, that deltas
#: may have before they are folded into a new base.
PART_ROWS, SHARE, LEAST = 1_000_000, 0.5, 100_000


def _entries(spark: SparkSession, root: str, upto: int | None = None) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """((version, rows) of the newest base, (-1, 0) if there is none; those of the deltas after it)."""
    log = spark.read.parquet(f"{root}/manifest").groupBy("kind", "version").agg(F.max("rows").alias("rows"))
    if upto is not None:
        log = log.filter(F.col("version") <= upto)
    best = log.filter("kind = 'base'").agg(F.max_by(F.struct("version", "rows"), "version")).first()[0]
    base = (best.version, best.rows) if best else (-1, 0)
    deltas = log.filter((F.col("kind") == "delta") & (F.col("version") > base[0])).orderBy("version").collect()  # a row a batch since the base
    return base, [(r.version, r.rows) for r in deltas]


def _folded(spark: SparkSession, root: str, base: int, deltas: list[int], schema: StructType) -> DataFrame:
    """The catalogue of a base and the observations of deltas after it."""
    new = spark.read.schema(schema).parquet(*[f"{root}/delta/version={v}" for v in deltas]) if deltas else spark.createDataFrame([], schema)
    old = spark.read.parquet(f"{root}/base/version={base}") if base >= 0 else new.limit(0).withColumns({"first_seen": F.col("observed_at"), "last_seen": F.col("observed_at")}).drop("observed_at")
    return M.upsert_datasets(old, new, "dataset_url", ["title", "publisher"], ["source"], "observed_at")


def read_streamed_catalog(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """A streamed catalogue as of its last batch; ``schema`` is that of its observations."""
    base, deltas = _entries(spark, root)
    return _folded(spark, root, base[0], [v for v, _ in deltas], schema)


def catalog_upsert_stream(observations: DataFrame, root: str | None = None) -> DataFrame:
    """Fold observations into a catalogue below ``root`` and return it.

    A micro-batch only writes its own rows, as a delta under its number, and notes it in a manifest.  Once the
    deltas are more than a share of the base, the batch folds them into a new base, whose number of
    parts doubles as it grows; so the work of all foldings is in proportion to the rows that came.  State and
    progress lie below ``root``, so a stream that is started again with the same root goes on where it was,
    and a batch that is run again writes the same versions."""
    spark = observations.sparkSession
    root, schema = root or new_path(spark, "catalogue"), observations.schema
    spark.createDataFrame([], "version long, kind string, rows long").write.mode("append").parquet(f"{root}/manifest")

    def note(spark: SparkSession, version: int, kind: str, rows: int) -> None:
        spark.createDataFrame([(version, kind, rows)], "version long, kind string, rows long").coalesce(1).write.mode("append").parquet(f"{root}/manifest")

    def fold(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/delta/version={version}")
        note(spark, version, "delta", spark.read.schema(schema).parquet(f"{root}/delta/version={version}").count())
        (base, size), deltas = _entries(spark, root, version)
        if sum(n for _, n in deltas) > max(LEAST, SHARE * size):
            rows = _folded(spark, root, base, [v for v, _ in deltas], schema)
            parts = 1 << max(0, (size + sum(n for _, n in deltas)) // PART_ROWS).bit_length()
            rows.repartition(parts, F.xxhash64("dataset_url")).write.mode("overwrite").parquet(f"{root}/base/version={version}")
            note(spark, version, "base", spark.read.parquet(f"{root}/base/version={version}").count())

    q = observations.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_streamed_catalog(spark, root, schema)
