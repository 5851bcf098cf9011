"""Vectorised scanning of UTF-8 text held in Arrow buffers: words, lines and their 64-bit hashes.

Everything here works on one bounded slice of a record batch inside a task.
White space is the ASCII set ``[\\x20\\x09-\\x0D]``; lower-casing, where asked for, touches A-Z only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text that one numpy pass takes at once.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def release() -> None:
    """Gives memory that is free in this process back, as workers live on beside the JVM and the workers of other stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` has about ``limit`` bytes; a longer text makes a run of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_bytes(batch.column(column))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets into them (null rows: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = SOLID[raw]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step."""
    lengths = ends - starts
    out = mix(lengths.astype(U64) * _GOLD + U64(seed))
    if not len(starts):
        return out
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    at = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    alive, done = np.flatnonzero(lengths > 0), 0
    while len(alive):
        left = lengths[alive] - done
        word = at[starts[alive] + done]
        short = left < 8
        if short.any():
            word = np.where(short, word & ((U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1)), word)
        out[alive] = mix((out[alive] ^ word) * _M2 + _GOLD)
        done += 8
        alive = alive[left > 8]
    return out


def word_hashes(col: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, and for each row the index of its first word."""
    raw, offsets = text_bytes(col)
    if lower:
        raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets)
    return span_hashes(raw, starts, ends, seed), first


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` consecutive words, also of runs across rows (mask those)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(len(words), _BASE), out=total[1:])
    return mix((total[length:] - total[:n]) * powers(n, _BASE_INV))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def run_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 seen as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
