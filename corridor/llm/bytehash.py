"""Vectorised hashing of whole texts held as Arrow buffers.

Texts of an Arrow batch stay one contiguous ``uint8`` array plus offsets.  Every function works on slices
("chunks") of a bounded number of bytes; one document is never split, so a chunk is as large as the
longest document in the worst case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
#: The word separators of all word-based contracts: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

KEPT = 1 << 24
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; up to ``KEPT`` of them stay for the worker's life."""
    global _pow, _inv
    if len(_pow) > n:
        return _pow, _inv
    m = max(1 << (n + 1).bit_length(), 1 << 20) if n < KEPT else n + 1
    got = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(m - 1, x, dtype=U64), dtype=U64)]) for x in (_BASE, _INV))
    if m <= KEPT:
        _pow, _inv = got
    return got


def prefix(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Prefix sums from which ``substring`` reads the hash of any substring."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(table[data] * p[: len(data)], dtype=U64, out=out[1:])
    return out


def substring(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], independent of where the substring lies."""
    _, inv = powers(len(h) - 1)
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if column.type == pa.large_string() or column.type == pa.large_binary():
        kind = np.int64
    else:
        column, kind = (column if column.type in (pa.string(), pa.binary()) else column.cast(pa.string())), np.int32
    if column.null_count:
        column = column.fill_null("" if column.type in (pa.string(), pa.large_string()) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or of one document."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of non-separators; runs never cross documents."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    edge = off[:-1][off[1:] > off[:-1]]
    if len(edge):
        starts[edge] = solid[1:-1][edge]
        last = (off[1:] - 1)[off[1:] > off[:-1]]
        ends[last] = solid[1:-1][last]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1
