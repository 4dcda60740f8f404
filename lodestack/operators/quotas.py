"""Replays of request logs against quotas and capacities.

Fixed windows are truncated UTC minutes or days.  Admission is greedy: a request that does not fit
is refused and leaves the counter alone, so later smaller requests may still pass.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.scratch import arrow_batches, let, settle


def quota_replay_units(requests: DataFrame, keys: list[str], time: str, order: str, limit: int, unit: str) -> DataFrame:
    """Requests of amount 1: the first ``limit`` of each window are admitted."""
    start = F.date_trunc(unit, F.col(time))
    rn = F.row_number().over(Window.partitionBy(*keys, start).orderBy(time, order))
    end = F.unix_micros(start) + (60 if unit == "minute" else 86400) * 1_000_000
    out = requests.withColumns({"admitted": rn <= limit, "_wait": F.greatest(F.lit(1).cast("long"), F.ceil((end - F.unix_micros(F.col(time))) / 1_000_000))})
    return out.withColumn("retry_after", F.when(~F.col("admitted"), F.col("_wait"))).drop("_wait")


def _walk(rows: DataFrame, keys: list[str], out: str, make: Callable[[], Callable[[tuple], bool]]) -> DataFrame:
    """``rows`` (keys, window, ts, id, ...) with ``admitted``, gone through in time order per (keys, window).

    Rows are dealt by key and sorted by Spark; a task keeps only the counters of the window it is in,
    so a window may have any number of requests.  ``make`` gives the rule of a new window."""
    spark, head = rows.sparkSession, [*keys, "window"]
    rows = rows.repartition(*head).sortWithinPartitions(*head, "ts", "id")

    def run(batches):
        now, rule = None, None
        for b in batches:
            ok = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[: len(head)] != now:
                    now, rule = row[: len(head)], make()
                ok.append(rule(row[len(head) + 2 :]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "admitted"])

    with arrow_batches(spark, 10_000):
        return settle(rows.mapInArrow(run, _schema(rows) + ", admitted boolean"), out)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def quota_replay(requests: DataFrame, keys: list[str], time: str, order: str, amount: str, limit: int, unit: str) -> DataFrame:
    """Requests of any amount in time order inside one owner's window: (keys, window, order, admitted)."""
    rows = requests.select(*keys, F.date_trunc(unit, F.col(time)).alias("window"), F.col(time).alias("ts"), F.col(order).alias("id"), F.col(amount).cast("long").alias("amount"))

    def make() -> Callable[[tuple], bool]:
        used = 0

        def rule(row: tuple) -> bool:
            nonlocal used
            fits = used + row[0] <= limit
            used += row[0] if fits else 0
            return fits

        return rule

    return _walk(rows, keys, "admitted", make).select(*keys, "window", F.col("id").alias(order), "admitted")


def quota_replay_all(requests: DataFrame, client: str, owner: str, time: str, order: str, owner_limit: int, client_limit: int, global_limit: int, unit: str = "day") -> DataFrame:
    """Owner and client limits are charged together or not at all; then the global limit applies
    over admitted requests in time order.  A request refused by the global limit has already used
    its client's room.

    Where the global limit falls is found from totals per minute; only the requests of that one
    minute are ranked."""
    rows = requests.select(F.col(client).alias("client"), F.date_trunc(unit, F.col(time)).alias("window"), F.col(time).alias("ts"), F.col(order).alias("id"), F.col(owner).cast("string").alias("owner"))

    def make() -> Callable[[tuple], bool]:
        own: dict[str, int] = {}  # at most client_limit owners are ever charged
        total = 0

        def rule(row: tuple) -> bool:
            nonlocal total
            fits = total < client_limit and own.get(row[0], 0) < owner_limit
            if fits:
                own[row[0]] = own.get(row[0], 0) + 1
                total += 1
            return fits

        return rule

    each = _walk(rows, ["client"], "charged", make).withColumn("slot", F.date_trunc("minute", "ts"))
    totals = each.filter("admitted").groupBy("window", "slot").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("window").orderBy("slot"))
    totals = totals.select("window", "slot", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    j = each.join(totals, ["window", "slot"], "left")
    border = j.filter(F.col("admitted") & (F.col("before") < global_limit) & (F.col("upto") > global_limit))
    rank = F.row_number().over(Window.partitionBy("window").orderBy("ts", "id"))
    border = border.select("id", (F.col("before") + rank <= global_limit).alias("admitted"))
    rest = j.filter(~(F.col("admitted") & (F.col("before") < global_limit) & (F.col("upto") > global_limit)))
    rest = rest.select("id", (F.col("admitted") & F.coalesce(F.col("upto") <= global_limit, F.lit(False))).alias("admitted"))
    return rest.unionByName(border).withColumnRenamed("id", order)


def capacity_replay(requests: DataFrame, queue: str, time: str, order: str, capacity: int, started: int) -> DataFrame:
    """Unit requests are admitted while those already active plus the admitted ones fit.

    The minute in which a queue fills is found from totals per minute; only its requests are ranked."""
    room = capacity - started
    rows = requests.withColumn("_slot", F.date_trunc("minute", F.col(time)))
    totals = rows.groupBy(queue, "_slot").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(queue).orderBy("_slot"))
    totals = totals.select(queue, "_slot", upto.alias("_upto"), (upto - F.col("_n")).alias("_before"))
    j = rows.join(totals, [queue, "_slot"])
    at_border = (F.col("_before") < room) & (F.col("_upto") > room)
    rank = F.row_number().over(Window.partitionBy(queue).orderBy(time, order))
    border = j.filter(at_border).withColumn("admitted", F.col("_before") + rank <= room)
    rest = j.filter(~at_border).withColumn("admitted", F.col("_upto") <= room)
    return rest.unionByName(border).select(*requests.columns, "admitted")


def address_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, four hexadecimal digits each; null if it is none."""
    def plain(bare: Column) -> Column:  # a dotted end becomes two groups
        byte = F.transform(F.split(F.regexp_extract(bare, r"(\d+\.\d+\.\d+\.\d+)$", 1), r"\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0"))
        tail = let(byte, lambda b: F.concat(F.try_element_at(b, F.lit(1)), F.try_element_at(b, F.lit(2)), F.lit(":"), F.try_element_at(b, F.lit(3)), F.try_element_at(b, F.lit(4))))
        return F.when(bare.rlike(r":\d+\.\d+\.\d+\.\d+$"), F.concat(F.regexp_replace(bare, r"[^:]+$", ""), F.lower(tail))).otherwise(bare)

    bare = let(F.lower(F.regexp_replace(F.trim(address), r"^\[|\]$|%.*$", "")), plain)

    def expand(v: Column) -> Column:
        side = lambda i: F.filter(F.split(F.split_part(v, F.lit("::"), F.lit(i)), ":"), lambda x: x != "")
        gap = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(side(1)) - F.size(side(2)), F.lit(0)))
        whole = F.when(F.contains(v, F.lit("::")), F.concat(side(1), gap, side(2))).when(F.contains(v, F.lit(":")), F.split(v, ":"))
        return F.transform(whole, lambda x: F.lpad(x, 4, "0"))

    return let(let(bare, expand), lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{4}$")), g))


def network(address: Column) -> Column:
    """An IPv4 address whole, also where IPv6 only carries it; else the IPv6 /64 in full form."""
    def name(groups: Column) -> Column:
        number = lambda i, at: F.conv(F.substring(F.element_at(groups, i), at, 2), 16, 10)
        mapped = F.array_join(F.slice(groups, 1, 6), ":") == "0000:0000:0000:0000:0000:ffff"
        inner = F.concat_ws(".", number(7, 1), number(7, 3), number(8, 1), number(8, 3))
        return F.when(groups.isNull(), F.trim(address)).when(mapped, inner).otherwise(F.concat(F.array_join(F.slice(groups, 1, 4), ":"), F.lit("::/64")))

    return let(address_groups(address), name)


def client_network(address: Column, secret: str) -> Column:
    """Keyed digest of the client's network."""
    return F.sha2(F.concat(F.lit(secret), network(address)), 256)


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def http_date(value: Column) -> Column:
    """Timestamp of an HTTP date in any of its three forms, in UTC unless it names an offset."""
    clock = r"(\d{2}:\d{2}:\d{2})"
    forms = (
        (r"^(?:[A-Za-z]{3,9},\s*)?(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4}|\d{2})\s+" + clock + r"\s*(?:GMT|UTC|Z|([+-]\d{4}))?$", (1, 2, 3, 4, 5)),
        (r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+" + clock + r"\s+(\d{4})()$", (2, 1, 4, 3, 5)),
    )
    out = F.lit(None).cast("timestamp")
    for pattern, places in forms:
        day, month, year, time, zone = (F.regexp_extract(F.trim(value), pattern, i) for i in places)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("string")
        year = F.when(F.length(year) == 4, year).when(year.try_cast("int") < 69, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
        zone = F.when(zone == "", "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
        text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), time, zone)
        out = F.coalesce(out, F.when(F.trim(value).rlike(pattern), text.try_cast("timestamp")))
    return out


def next_allowed(responses: DataFrame, provider: str, received: str, header: str) -> DataFrame:
    """Per provider the latest retry time (seconds or an HTTP date), never before the response.

    A header that is neither says nothing."""
    bare = F.trim(header)
    seconds = F.when(bare.rlike(r"^\d{1,12}$"), bare.try_cast("bigint"))
    by_seconds = F.timestamp_micros(F.unix_micros(F.col(received)) + seconds * 1_000_000)
    said = F.coalesce(by_seconds, http_date(F.col(header)))
    at = F.when(said.isNotNull(), F.greatest(said, F.col(received)))
    return responses.withColumn("_at", at).groupBy(provider).agg(F.max("_at").alias("next_allowed"))
