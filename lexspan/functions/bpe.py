"""The merge step: bytes of one piece to ids. No Spark in here."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa


class Merger:
    """Merges the neighbouring pair of lowest rank (leftmost of equals) until none is left. Remembers up to `cap` pieces."""

    def __init__(self, ranks: dict[bytes, int], cap: int = 100_000):
        if cap < 0:
            raise ValueError("the cache can't have a negative size")
        self.ranks, self.cap, self.memo = ranks, cap, {}

    def piece(self, b: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(b)
        if rank is not None:
            return (rank,)
        got = self.memo.get(b)
        if got is None:
            got = self._merge(b)
            if len(b) <= 64 and self.cap:
                if len(self.memo) >= self.cap:
                    self.memo.clear()
                self.memo[b] = got
        return got

    def _merge(self, b: bytes) -> tuple[int, ...]:
        n, get = len(b), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] - i != size:
                continue
            alive[j] = 0
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(b[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]] - i))
            if before[i] >= 0 and (r := get(b[before[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, before[i], end[i] - before[i]))
        return tuple(self.ranks[b[i : end[i]]] for i in range(n) if alive[i])


@lru_cache(8)
def _merger(key: str, cap: int) -> Merger:
    return Merger(_RANKS[key], cap)


_RANKS: dict[str, dict[bytes, int]] = {}


def merger(key: str, ranks: dict[bytes, int], cap: int = 100_000) -> Merger:
    """One merger a process for each vocabulary (by the key that its broadcast carries)."""
    _RANKS[key] = ranks
    return _merger(key, cap)


def encode_lists(pieces: pa.ListArray, m: Merger, special: pa.ListArray | None = None, count_only: bool = False) -> pa.Array:
    """Lists of pieces to lists of ids, or to their numbers. Each distinct piece of a batch is merged once.

    special: lists beside the pieces with the id that a piece has as a special token, or null."""
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    flat = pieces.flatten().dictionary_encode()
    ids = [m.piece(x if isinstance(x, bytes) else x.encode()) for x in flat.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in ids] or [0], np.int64)
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.nan_to_num(pieces.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    n = sizes[index] if len(index) else np.zeros(0, np.int64)
    own = None
    if special is not None:
        own = special.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.where(own >= 0, 1, n)
    total = np.concatenate(([0], np.cumsum(n)))
    offsets = total[ends]
    mask = pieces.is_null().to_numpy(zero_copy_only=False) if pieces.null_count else None
    if count_only:
        return pa.array(np.diff(offsets), pa.int32(), mask=mask)
    table = np.concatenate([np.array(x, np.int32) for x in ids] or [np.zeros(0, np.int32)])
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(begin[index], n) if len(index) else np.zeros(0, np.int64)
    values = table[np.minimum(at, max(0, len(table) - 1))] if len(table) else np.zeros(len(at), np.int32)
    if own is not None:
        values = np.where(np.repeat(own >= 0, n), np.repeat(own, n), values).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(mask) if mask is not None else None)


_DECODERS: dict[str, Decoder] = {}


def decoder(key: str, table: dict[int, bytes]) -> Decoder:
    """One decoder a process for each vocabulary (by its key); few vocabularies are kept."""
    if key not in _DECODERS:
        if len(_DECODERS) >= 8:
            _DECODERS.clear()
        _DECODERS[key] = Decoder(table)
    return _DECODERS[key]


class Decoder:
    """ids to bytes, over whole lists."""

    def __init__(self, table: dict[int, bytes]):
        top = max(table, default=-1) + 1
        self.known = np.zeros(top + 1, bool)
        self.known[list(table)] = True
        self.table = pa.array([table.get(i, b"") for i in range(top + 1)], pa.large_binary())
        self.chars = np.array([sum(c & 0xC0 != 0x80 for c in table.get(i, b"")) for i in range(top + 1)], np.int64)
        self.inner = np.array([bool(t := table.get(i, b"")) and t[0] & 0xC0 == 0x80 for i in range(top + 1)])

    def flat(self, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        x = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.where((x >= 0) & (x < len(self.known)), x, len(self.known) - 1)
        if len(x) and not self.known[x].all():
            raise ValueError("an id that the vocabulary doesn't have")
        ends = np.concatenate(([0], np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64))))
        return x, ends, ids.is_null().to_numpy(zero_copy_only=False) if ids.null_count else None

    def bytes_of(self, ids: pa.ListArray) -> pa.Array:
        x, ends, mask = self.flat(ids)
        got = self.table.take(pa.array(x))
        offs = np.frombuffer(got.buffers()[1], np.int64)[: len(x) + 1] if len(x) else np.zeros(1, np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offs[ends].tobytes()), got.buffers()[2] or pa.py_buffer(b"")])
        out = out.cast(pa.binary())
        return out if mask is None else pa.compute.if_else(pa.array(mask), pa.scalar(None, pa.binary()), out)

    def offsets_of(self, ids: pa.ListArray) -> pa.Array:
        """For each id the character it begins in."""
        x, ends, mask = self.flat(ids)
        total = np.concatenate(([0], np.cumsum(self.chars[x])))
        at = total[:-1] - np.repeat(total[ends[:-1]], np.diff(ends))
        at = np.maximum(0, at - self.inner[x]) if len(x) else at
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32)), mask=pa.array(mask) if mask is not None else None)
