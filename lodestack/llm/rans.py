"""Static range asymmetric numeral system over interleaved lanes, in numpy.

Format of one block: symbol i belongs to lane i % LANES.  All lanes share one stream of 32-bit
words, read forwards by the decoder; lane states are 64-bit.  Every STRIDE steps a checkpoint keeps
the stream position and all lane states, so segments decode independently of each other, and each
segment has its own CRC-32 of the decoded symbols.
"""

from __future__ import annotations

import zlib

import numpy as np

PROB_BITS = 18
LANES = 1024
STRIDE = 64
LOW = np.uint64(1 << 31)
_P, _W = np.uint64(PROB_BITS), np.uint64(32)
_MASK, _WORD = np.uint64((1 << PROB_BITS) - 1), np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies scaled to 2^PROB_BITS; every symbol that occurs keeps at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        total, seen = int(counts.sum()), counts > 0
        size = 1 << PROB_BITS
        if int(seen.sum()) > size:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), dtype=np.int64)
        if total:
            freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * size / total).astype(np.int64))
            over = int(freq.sum()) - size
            order = np.argsort(-freq, kind="stable")
            if over < 0:
                freq[order[0]] -= over
            at = 0
            while over > 0:  # take from the most frequent, never below 1
                s = order[at]
                take = min(over, max(0, int(freq[s]) - max(1, int(freq[s]) // 2)))
                freq[s] -= take
                over -= take
                at = (at + 1) % int(seen.sum())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint16), freq)


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, bytes, bytes]:
    """(words, checkpoints, checksums) of a block of 16-bit ids."""
    n = len(ids)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    f_all, s_all = table.freq[ids], table.start[ids]
    limit_all = f_all << np.uint64(31 - PROB_BITS + 32)
    for step in range(steps - 1, -1, -1):
        lo, hi = step * LANES, min(n, (step + 1) * LANES)
        v, f = x[: hi - lo], f_all[lo:hi]
        big = v >= limit_all[lo:hi]
        if big.any():
            got = (v[big] & _WORD).astype("<u4")
            out.append(got)
            written += len(got)
            v[big] >>= _W
        q = v // f
        x[: hi - lo] = (q << _P) + (v - q * f) + s_all[lo:hi]
        if step % STRIDE == 0:
            marks.append((written, x.copy()))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, dtype="<u4")
    # a checkpoint's position counts from the start of the stream as the decoder reads it
    points = b"".join(np.uint64(written - w).tobytes() + states.astype("<u8").tobytes() for w, states in reversed(marks))
    raw = ids.astype("<u2")
    span = STRIDE * LANES
    sums = b"".join(zlib.crc32(raw[i : i + span].tobytes()).to_bytes(4, "little") for i in range(0, n, span))
    return stream.tobytes(), points, sums


def decode(words: bytes, points: bytes, sums: bytes, n: int, table: Table, segments: range | None = None) -> np.ndarray:
    """The block's ids, or those of some of its segments; raises if a checksum differs."""
    stream = np.frombuffer(words, dtype="<u4").astype(np.uint64)
    span, width = STRIDE * LANES, 8 * (LANES + 1)
    parts = []
    for k in segments if segments is not None else range(-(-n // span)):
        head = np.frombuffer(points[k * width : (k + 1) * width], dtype="<u8")
        at, x = int(head[0]), head[1:].astype(np.uint64)
        lo, hi = k * span, min(n, (k + 1) * span)
        out = np.empty(hi - lo, dtype="<u2")
        for i in range(0, hi - lo, LANES):
            m = min(LANES, hi - lo - i)
            v = x[:m]
            slot = v & _MASK
            s = table.symbol[slot]
            out[i : i + m] = s
            v = table.freq[s] * (v >> _P) + slot - table.start[s]
            low = v < LOW
            k_low = int(np.count_nonzero(low))
            if k_low:
                v[low] = (v[low] << _W) | stream[at : at + k_low]
                at += k_low
            x[:m] = v
        if zlib.crc32(out.tobytes()) != int.from_bytes(sums[4 * k : 4 * k + 4], "little"):
            raise ValueError(f"segment {k} does not match its checksum")
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u2")
