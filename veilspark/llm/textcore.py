"""Vectorised words and rolling hashes over Arrow text buffers (numpy, no per-word Python).

A word is hashed eight bytes at a time by a mixer that isn't a polynomial (words of one length up to
eight bytes never collide), very long ones by a library digest; there are two independent streams of word
hashes. Runs of words or bytes are polynomials modulo 2**64 over mixed unit values, finished by
a 64-bit mixer. Where rows are decided by hashes, both streams with a base each give 128 bits.
Runs are far shorter than the 1,024 units from which on such polynomials can vanish whatever the base.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib

import numpy as np
import pyarrow as pa

#: Units (bytes or words) that are hashed together at most; a longer document is cut by the callers that allow it.
CHUNK = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a public hash family (xor-shift, multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@functools.cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


@functools.lru_cache(4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefix:
    """Hashes of any run of units in O(1) each."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        size = 1 << max(10, int(len(values)).bit_length())
        power, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n] + U64(k))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, most: int):
    """Yields (first, last) row ranges of at most about `most` units each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE):
    """(starts, ends, per-document word offsets) of the runs of bytes that aren't `outside`."""
    if not len(raw):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~outside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Bytes from which on a word is digested by hashlib.
LONG_WORD = 512
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_SEEDS = (U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 0) -> np.ndarray:
    """64-bit hashes of the byte runs raw[start:end]; the streams 0 and 1 are independent."""
    size = ends - starts
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + _SEEDS[stream])
    if not len(out):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    # eight bytes from each place on
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    rows = np.flatnonzero(size <= LONG_WORD)
    at, left = starts[rows], size[rows]
    while len(rows):
        out[rows] = mix(out[rows] ^ (lanes[at] & _TAIL[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for row in np.flatnonzero(size > LONG_WORD).tolist():
        own = hashlib.blake2b(raw[starts[row] : ends[row]].tobytes(), digest_size=8, key=bytes([stream + 1])).digest()
        out[row] = np.frombuffer(own, "<u8")[0]
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out[:n]


def give_back() -> None:
    """Returns freed memory to the system; an idle worker keeps it from its executor otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library that has it
        return


def trimmed(task):
    """A task of mapInArrow that gives its memory back at its end."""

    def run(batches):
        yield from task(batches)
        give_back()

    return run


def columns(schema: pa.Schema, **arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], type=f.type) for f in schema], schema=schema)
