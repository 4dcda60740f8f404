"""Media columns: content-defined chunks of 8-bit payloads, deduplicated and reassembled.

A payload is cut where a rolling gear hash of its last 32 bytes has ``MASK_BITS`` zero bits (within
least and greatest chunk sizes), so shared passages give shared chunks.  A chunk is stored as a
frame: a length, its SHA-256 and its samples, packed by zstd where the chunk is shared.  The store has
two Parquet tables in the shared folder:

* ``media``: one row per input row with its ordered list of entries; chunks seen nowhere else are
  frames in the list, all others are references (an empty frame with the chunk's digest);
* ``chunks``: the frame of each chunk that may occur more than once, exactly once, found by a join
  of digests.

The stored form of a medium is its frames in order, wherever they lie.

Which digests repeat is counted over the whole corpus with Spark and handed to the writing tasks
as a bit map.  A false positive only moves a chunk into the shared table.  The map has 64 bits for
each repeated digest up to MOST_BITS (16 MB); a corpus with far more repeated chunks fills it, which
moves chunks that need not move, each once, and changes no result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.scratch import arrow_batches, new_path, settle

UNIT = 576
MASK_BITS, LEAST, GREATEST = 11, 512, 8192
#: Least and most bits of the map of repeated digests; the most are 16 MB.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
#: Bytes of a frame before its samples, and the mark in its length of packed ones.
HEAD, PACKED = 36, 1 << 31
GEAR = np.random.default_rng(29).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the unpadded number of bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + b"\xff" * (size - len(raw)), len(raw)


def cut(payload: bytes) -> list[bytes]:
    """The payload's chunks in order."""
    h = GEAR[np.frombuffer(payload, dtype=np.uint8)]
    span = 1
    while span < 32:  # the hash of the last 2 * span bytes from two of span bytes
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, at, size = [], 0, len(payload)
    for m in [*marks.tolist(), size]:
        while m - at > GREATEST:
            out.append(payload[at : at + GREATEST])
            at += GREATEST
        if m - at >= LEAST or (m == size and m > at):
            out.append(payload[at:m])
            at = m
    return out


def frame(chunk: bytes, digest: bytes, packer: zstandard.ZstdCompressor | None = None) -> bytes:
    """A chunk's stored form: length, digest, samples, the latter packed if there is a packer."""
    if packer is None:
        return struct.pack(">I", len(chunk)) + digest + chunk
    body = packer.compress(chunk)
    return struct.pack(">I", len(body) | PACKED) + digest + body


def samples(stored: bytes) -> bytes:
    """The samples of a frame, checked against its length and digest."""
    size, body = struct.unpack(">I", stored[:4])[0], stored[HEAD:]
    chunk = zstandard.ZstdDecompressor().decompress(body) if size & PACKED else body
    if size & ~PACKED != len(body) or hashlib.sha256(chunk).digest() != stored[4:HEAD]:
        raise ValueError("a stored chunk does not match its digest")
    return chunk


def entries(body: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """(digest, frame) of every entry of a medium's list; the frame of a reference is None."""
    at = 0
    while at < len(body):
        size, digest = struct.unpack(">I", body[at : at + 4])[0], body[at + 4 : at + HEAD]
        yield digest, body[at : at + HEAD + size] if size else None
        at += HEAD + size


def repeated_map(docs: DataFrame, text_col: str) -> bytes:
    """Bit map of the digests that occur more than once in the corpus; its length is a power of 2."""
    def run(batches):
        for b in batches:
            out = [hashlib.sha256(c).digest()[:16] for t in b.column(0).to_pylist() for c in cut(payload_of(t)[0])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["d"])

    digests = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "d binary")
    with arrow_batches(docs.sparkSession, 256):
        twice = settle(digests.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 64 * twice.count()):
        bits *= 2
    bit = F.pmod(F.conv(F.hex(F.substring("d", 5, 4)), 16, 10).cast("long"), F.lit(bits))
    words = twice.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 AS int))")).alias("v"))
    out = np.zeros(bits // 32, dtype="<u4")
    got = words.toPandas()  # at most MOST_BITS / 32 rows
    out[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out.tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """Write the media store of ``docs`` and return the paths of its two tables.

    Null texts are stored as the empty text, that is 576 bytes of 255.  Ids may be null or repeat:
    rows are told apart by the digest of their chunk list.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(repeated_map(docs, text_col))

    def is_shared(digest: bytes) -> bool:
        i = int.from_bytes(digest[4:8], "big") % (8 * len(bits.value))
        return bool(bits.value[i >> 3] >> (i & 7) & 1)

    def media(batches):
        for b in batches:
            sizes, bodies = [], []
            for t in b.column(1).to_pylist():
                payload, n = payload_of(t)
                digests = [(hashlib.sha256(c).digest(), c) for c in cut(payload)]
                bodies.append(b"".join([frame(b"" if is_shared(d) else c, d) for d, c in digests]))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], names=["id", "n_bytes", "body"])

    def shared(batches):
        packer, seen = zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            out = {}
            for t in b.column(0).to_pylist():
                for c in cut(payload_of(t)[0]):
                    d = hashlib.sha256(c).digest()
                    if is_shared(d) and d not in seen:
                        out[d] = frame(c, d, packer)
                        if len(seen) < 1 << 16:  # spares repeats inside a task; the rest fold in the shuffle
                            seen.add(d)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["digest", "frame"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    at_media, at_chunks = new_path(spark, "media"), new_path(spark, "chunks")
    with arrow_batches(spark, 256):
        rows.mapInArrow(media, f"id {kind}, n_bytes long, body binary").write.option("compression", "zstd").parquet(at_media)
        once = rows.select("t").mapInArrow(shared, "digest binary, frame binary").groupBy("digest").agg(F.min("frame").alias("frame"))
        once.write.option("compression", "uncompressed").parquet(at_chunks)
    return at_media, at_chunks


def _measure(body: bytes, refs: dict[bytes, bytes]) -> tuple:
    """Reassemble one payload, verify every chunk, and compute its features.

    ``refs`` has the stored frames of the chunks that ``body`` only refers to."""
    sha, media, stored, size = hashlib.sha256(), hashlib.sha256(), 0, 0
    hist, tail, n = np.zeros(256, dtype=np.int64), b"", 0
    for digest, held in entries(body):
        held = refs[digest] if held is None else held
        if held[4:HEAD] != digest:
            raise ValueError("a stored chunk does not match its reference")
        c = samples(held)
        sha.update(c)
        media.update(held)
        hist += np.bincount(np.frombuffer(c, dtype=np.uint8), minlength=256)
        size, stored, n, tail = size + len(c), stored + len(held), n + 1, (tail + c)[-32:]
    share = hist[hist > 0] / size
    mean = float((hist * np.arange(256)).sum() / size)
    feature = f"chunks={n};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};peak={int(hist.argmax())}"
    return size, sha.hexdigest(), zlib.crc32(tail), stored, media.hexdigest(), feature


OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batch(keys: list, measured: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = zip(*measured, strict=True) if measured else [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*names, *[x.split()[0] for x in OUT.split(", ")]])


def read_back(spark, at_media: str, at_chunks: str) -> DataFrame:
    """One row per stored row: id, n_bytes and what the reassembled, verified samples show.

    Media without references are measured where they are read.  Of the others, each distinct list
    is assembled once: its references are joined with the chunk table, gathered by list and
    measured; copies share the result.
    """
    media, chunks = spark.read.parquet(at_media), spark.read.parquet(at_chunks)
    kind = dict(media.dtypes)["id"]

    def first(batches):  # measures what needs no other table
        for b in batches:
            got, keys = [], []
            for x in b.column(2).to_pylist():
                alone = all(held is not None for _, held in entries(x))
                got.append(_measure(x, {}) if alone else (None,) * 6)
                keys.append(None if alone else hashlib.md5(x).digest())
            yield _batch([b.column(0), b.column(1), pa.array(keys, pa.binary())], got, ["id", "n_bytes", "media_key"])

    def listed(batches):  # the lists of the rest, and what they refer to
        for b in batches:
            rows = [(x, [*dict.fromkeys(d for d, held in entries(x) if held is None)]) for x in b.column(0).to_pylist()]
            rows = [(hashlib.md5(x).digest(), x, wanted) for x, wanted in rows if wanted]
            cols = zip(*rows, strict=True) if rows else [[]] * 3
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["media_key", "body", "wanted"])

    with arrow_batches(spark, 256):
        rows = settle(media.select("id", "n_bytes", "body").mapInArrow(first, f"id {kind}, n_bytes long, media_key binary, {OUT}"), "measured")
        lists = media.select("body").mapInArrow(listed, "media_key binary, body binary, wanted array<binary>")
        lists = settle(lists.groupBy("media_key").agg(F.min("body").alias("body"), F.min("wanted").alias("wanted")), "lists")
    refs = lists.select("media_key", F.explode("wanted").alias("digest")).join(chunks, "digest")
    parts = refs.select("media_key", F.lit(False).alias("whole"), F.col("frame").alias("data")).unionByName(lists.select("media_key", F.lit(True).alias("whole"), F.col("body").alias("data")))
    held = parts.groupBy("media_key").agg(F.collect_list(F.struct("whole", "data")).alias("parts"))

    def assembled(batches):
        for b in batches:
            got = []
            for parts in b.column(1).to_pylist():
                body = next(p["data"] for p in parts if p["whole"])
                got.append(_measure(body, {p["data"][4:HEAD]: p["data"] for p in parts if not p["whole"]}))
            yield _batch([b.column(0)], got, ["media_key"])

    with arrow_batches(spark, 64):
        whole = settle(held.mapInArrow(assembled, f"media_key binary, {OUT}"), "assembled")
    shown = [x.split()[0] for x in OUT.split(", ")]
    shared = rows.filter(F.col("media_key").isNotNull()).select("id", "n_bytes", "media_key").join(whole, "media_key").select("id", "n_bytes", *shown)
    return rows.filter(F.col("media_key").isNull()).select("id", "n_bytes", *shown).unionByName(shared)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media, read them back and return one verified row per input row."""
    out = read_back(docs.sparkSession, *store(docs, id_col, text_col))
    return out.withColumnRenamed("id", id_col)
