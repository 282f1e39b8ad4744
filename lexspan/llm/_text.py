"""Words of whole Arrow batches as arrays: no Python loop over words.

Text is handled as UTF-8 bytes. The separators are ASCII, so words found in bytes are the words found in characters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(0x5EED)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = int(_RNG.integers(2**40, 2**63)) | 5
MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, U), np.full(n, b, U))), dtype=U) for b in (U(BASE), U(pow(BASE, -1, 2**64))))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def release() -> None:
    """Free memory goes back to the system: Spark keeps idle Python workers for a while, beside a JVM that may need it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 3 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about `most` bytes of text each (one row may have more), with their bytes and offsets."""
    for b in batches:
        data, offs = text_bytes(b.column(text))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            yield b.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
    release()


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of inside bytes (default: not space) of each row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    is_in = (~SPACE if inside is None else inside)[data]
    filled = offs[:-1][offs[1:] > offs[:-1]]
    edge = np.zeros(len(data), bool)
    edge[filled] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, is_in[:-1]
    starts = np.flatnonzero(is_in & (~before | edge))
    after = np.ones(len(data), bool)
    after[:-1] = ~is_in[1:] | edge[1:]
    ends = np.flatnonzero(is_in & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges (polynomial by prefix sums, then mixed)."""
    if not len(starts):
        return np.zeros(0, U)
    p, inverse = _powers(1 << max(20, (len(data) - 1).bit_length()))
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(BYTE[data] * p[: len(data)], dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries, over row ends too (mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * MULT[0]
    for j in range(1, k):
        out += h[j : j + n] * MULT[j]
    return mix(out)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers, and the end."""
    return np.searchsorted(rows, np.arange(n + 1), "left")
