"""Learning a vocabulary: pieces and pairs are counted in Spark, merges chosen in a loop over arrays."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..encoding import Encoding
from ..functions import text as T
from ..registry import O200K
from ..sources.tables import drop_stored, stored
from .codec import workers

DEFAULT_PATTERN = O200K
#: distinct pieces that the driver's loop takes; beyond it train_distributed() is used
MOST_PIECES = 250_000
#: words from which the driver guesses the next merges there
CORE = 150_000
#: bytes of words (4 an id) that a task takes at once
CHUNK = 8 << 20


def _check(vocab_size: int, min_frequency: int) -> None:
    if vocab_size < 256:
        raise ValueError("a vocabulary has 256 tokens at least, one a byte")
    if min_frequency < 1:
        raise ValueError("min_frequency is 1 at least")


def piece_counts(df: DataFrame, text_col: str, pattern: str | None = None) -> DataFrame:
    """(piece, n) over all texts; counted before they are shuffled."""
    return df.select(F.explode(T.pieces(F.col(text_col), pattern or DEFAULT_PATTERN)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def as_ids(piece: Column) -> Column:
    return T.byte_values(piece.cast("binary"))


def pair_counts(words: DataFrame) -> DataFrame:
    """words: (ids, n). (l, r, n): how often ids stand next to each other, overlapping pairs included."""
    k = F.size("ids") - 1
    pairs = F.zip_with(F.slice("ids", F.lit(1), F.greatest(k, F.lit(0))), F.slice("ids", F.lit(2), F.greatest(k, F.lit(0))), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return words.where(k > 0).select(F.explode(pairs).alias("p"), "n").groupBy("p.l", "p.r").agg(F.sum("n").alias("n"))


class Links:
    """Distinct words as one linked list of ids, with each word's weight at all its places, and where each pair stands.

    Places of a pair are looked up by lists that only grow; places that no longer hold the pair are passed over."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, n: np.ndarray):
        self.ids = data.astype(np.int32)
        k = len(self.ids)
        self.weight = np.repeat(n.astype(np.int64), sizes)
        self.after, self.before = np.arange(1, k + 1, dtype=np.int64), np.arange(-1, k - 1, dtype=np.int64)
        ends = np.cumsum(sizes)
        self.after[ends[sizes > 0] - 1] = -1
        self.before[(ends - sizes)[sizes > 0]] = -1
        self.total: dict[int, int] = {}
        self.where: dict[int, list[np.ndarray]] = {}
        self.heap: list[tuple[int, int]] = []
        self._count(np.flatnonzero(self.after >= 0), 1)

    def _count(self, at: np.ndarray, sign: int) -> None:
        """Adds or takes off the pairs that begin at these places."""
        if not len(at):
            return
        pair = (self.ids[at].astype(np.int64) << 32) | self.ids[self.after[at]]
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        sums = np.add.reduceat(self.weight[at], first)
        pair = pair[first]
        if sign > 0:
            for p, places in zip(pair.tolist(), np.split(at, first[1:]), strict=True):
                self.where.setdefault(p, []).append(places)
        self._add(pair, sign * sums)

    def _add(self, pair: np.ndarray, sums: np.ndarray) -> None:
        for p, n in zip(pair.tolist(), sums.tolist(), strict=True):
            now = self.total[p] = self.total.get(p, 0) + n
            if now > 0:
                heapq.heappush(self.heap, (-now, p))

    def best(self) -> tuple[int, int] | None:
        """(count, pair) of the most frequent pair, ties to the smaller one."""
        while self.heap:
            n, p = self.heap[0]
            if self.total.get(p, 0) == -n:
                return -n, p
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: int, new: int) -> None:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        at = np.unique(np.concatenate(self.where.pop(pair)))
        at = at[(self.ids[at] == left) & (self.after[at] >= 0)]
        at = at[self.ids[self.after[at]] == right]
        if left == right and len(at):  # of pairs that overlap in a row, every second one
            chained = np.zeros(len(at), bool)
            chained[1:] = self.after[at[:-1]] == at[1:]
            k = np.arange(len(at))
            start = np.maximum.accumulate(np.where(chained, 0, k))
            at = at[(k - start) % 2 == 0]
        gone = self.after[at]
        prior = self.before[at]
        touched = np.unique(np.concatenate((prior[prior >= 0], at, gone)))
        self._count(touched[self.after[touched] >= 0], -1)
        behind = self.after[gone]
        self.ids[at], self.ids[gone] = new, -1
        self.after[at] = behind
        self.before[behind[behind >= 0]] = at[behind >= 0]
        self.after[gone] = -1
        prior = self.before[at]
        touched = np.unique(np.concatenate((prior[prior >= 0], at)))
        self._count(touched[self.after[touched] >= 0], 1)
        self.total.pop(pair, None)


def merges_of(links: Links, vocab_size: int, min_frequency: int) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    while len(out) < vocab_size - 256 and (got := links.best()) is not None and got[0] >= min_frequency:
        out.append((got[1] >> 32, got[1] & 0xFFFFFFFF, 256 + len(out)))
        links.merge(got[1], out[-1][2])
    return out


def train_from_counts(counts: Iterable[tuple[bytes, int]], vocab_size: int, min_frequency: int = 2) -> list[tuple[int, int, int]]:
    """Merges (left, right, new) from piece counts: the most frequent pair first, ties to the smaller left, then right id."""
    _check(vocab_size, min_frequency)
    words = [(p, n) for p, n in counts if len(p) > 1 and n > 0]
    data = np.frombuffer(b"".join(p for p, _ in words), np.uint8)
    return merges_of(Links(data, np.array([len(p) for p, _ in words], np.int64), np.array([n for _, n in words], np.int64)), vocab_size, min_frequency)


class Changes(Links):
    """Links that only keep by how much each merge changes the counts of pairs: (step, pair, change), step 0 for the pairs at the start."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, n: np.ndarray, merges: list[tuple[int, int, int]]):
        self.step, self.seen = 0, []
        super().__init__(data, sizes, n)
        for self.step, (left, right, new) in enumerate(merges, 1):
            if left << 32 | right in self.where:
                self.merge(left << 32 | right, new)

    def _add(self, pair: np.ndarray, sums: np.ndarray) -> None:
        self.seen.append((np.full(len(pair), self.step, np.int64), pair, sums))


def _summed(seen: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes with each step and pair once; those that come to 0 go."""
    step, pair, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*seen, strict=True) if seen else ((), (), ())))
    order = np.lexsort((pair, step))
    step, pair, n = step[order], pair[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (step[1:] != step[:-1]) | (pair[1:] != pair[:-1])))) if len(step) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, first) if len(first) else n
    return step[first][n != 0], pair[first][n != 0], n[n != 0]


def changes_of(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(step, pair, n): what merges, done one after the other on all words (ids binary, n), change in the counts of pairs."""
    names = ["step", "pair", "n"]

    def batch(seen: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in _summed(seen)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: list = []

        def chunk() -> None:
            data, sizes, n = _arrays(pa.Table.from_batches(held), 4)
            if len(data):
                seen.append(_summed(Changes(data.view(np.int32), sizes, n, merges).seen))

        size = 0
        for b in batches:
            held.append(b)
            size += b.column("ids").nbytes
            if size > CHUNK:
                chunk()
                held, size = [], 0
                if sum(len(x[0]) for x in seen) > 4_000_000:
                    yield batch(seen)
                    seen.clear()
        if held:
            chunk()
        yield batch(seen)

    return words.mapInArrow(run, "step long, pair long, n long").groupBy("step", "pair").agg(F.sum("n").alias("n")).where("n <> 0")


def _arrays(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ids of each row, n) of a table with a first column of bytes, `width` bytes an id, and n."""
    x = t.column(0).combine_chunks().cast(pa.large_binary())
    if isinstance(x, pa.ChunkedArray):
        x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.large_binary())
    offs = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(x) and x.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, np.diff(offs) // width, t["n"].to_numpy()


def _start(counts: DataFrame) -> DataFrame:
    """(ids binary, n) of the pieces that have a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, sizes, n = _arrays(pa.Table.from_batches([b]), 1)
            ends = 4 * np.concatenate(([0], np.cumsum(sizes)))
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.astype(np.int32).tobytes())])
            yield pa.record_batch([ids, b.column("n")], names=["ids", "n"])

    return counts.where("n > 0 and octet_length(piece) > 1").select(F.col("piece").cast("binary").alias("ids"), F.col("n").cast("long").alias("n")).mapInArrow(run, "ids binary, n long")


def _core(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words to guess from, as arrays: about two thirds of `CORE` words are the most frequent ones, the others stand for the rest, by hash and
    with higher weights."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["step"], r["k"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total = np.cumsum([k for _, k in sizes])
    top = int(np.searchsorted(total, CORE if len(total) and total[-1] <= CORE else CORE * 2 // 3, "right"))  # steps that are taken whole
    rest = int(total[-1] - (total[top - 1] if top else 0)) if len(total) else 0
    lowest, part = sizes[top - 1][0] if top else 1 << 30, max(1, -(-rest * 3 // CORE))
    whole = step >= lowest
    return _arrays(words.where(whole | (F.pmod(F.xxhash64("ids"), F.lit(part)) == 0)).select("ids", F.when(whole, F.col("n")).otherwise(F.col("n") * part).alias("n")).toArrow(), 4)


def _merged_words(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """words (ids binary, n) after merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, sizes, n = _arrays(pa.Table.from_batches([b]), 4)
            if not len(data):
                continue
            links = Changes(data.view(np.int32), sizes, n, merges)
            live = links.ids >= 0
            ends = np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], np.cumsum(sizes)))]
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(links.ids[live].tobytes())])
            yield pa.record_batch([ids, b.column("n")], names=["ids", "n"])

    return words.mapInArrow(run, "ids binary, n long")


def _guessed(links: Links, done: list[tuple[int, int, int]], counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """The merges that links would do after those done, with the given counts before the last of these."""
    out: list[tuple[int, int, int]] = []

    def merge(left: int, right: int, new: int) -> None:
        if left << 32 | right in links.where:
            links.merge(left << 32 | right, new)
        links.total.pop(left << 32 | right, None)

    for x in done[:-1]:
        merge(*x)
    if done:
        links.total = dict(counts)
        links.heap = [(-n, p) for p, n in counts.items() if n > 0]
        heapq.heapify(links.heap)
        merge(*done[-1])
    while len(out) < most and (got := links.best()) is not None:
        out.append((got[1] >> 32, got[1] & 0xFFFFFFFF, 256 + len(done) + len(out)))
        merge(*out[-1])
    return out


class Pass:
    """Merges and by how much each changes the counts of pairs (dicts), done in this order; the order can be changed."""

    def __init__(self, merges: list[tuple[int, int, int]], changes: list[dict[int, int]]):
        self.merges, self.changes = merges, changes

    def forward(self, pair: tuple[int, int], i: int) -> bool:
        """Puts the merge of pair, which stands behind place i, there, with its id; the changes are those of the new order. False, and nothing
        is done, if it isn't there or shares an id with one before it.

        Merges without a common id come to the same in either order. Where g stood before p, ids beside p that g made were g's nearer half
        without it; the changes of both together stay, so those of g behind p follow."""
        j = next((k for k in range(i, len(self.merges)) if self.merges[k][:2] == pair), None)
        if j is None or any({*pair} & {*m} for m in self.merges[i:j]):
            return False
        if j == i:
            return True
        p = self.changes[j]
        for k in range(j - 1, i - 1, -1):
            left, right, made = self.merges[k]
            before: dict[int, int] = {}
            for q, n in p.items():
                a, b = q >> 32, q & 0xFFFFFFFF
                if a == made or b == made:
                    q = (right if a == made else a) << 32 | (left if b == made else b)
                before[q] = before.get(q, 0) + n
            after = dict(self.changes[k])
            for x, sign in ((p, 1), (before, -1)):
                for q, n in x.items():
                    after[q] = after.get(q, 0) + sign * n
            self.changes[k + 1], p = {q: n for q, n in after.items() if n}, before
        self.changes[i] = p
        first = self.merges[i][2]
        new = {first + k: first + k + 1 for k in range(j - i)} | {first + j - i: first}
        self.merges[i : j + 1] = [self.merges[j], *self.merges[i:j]]
        name = lambda x: new.get(x, x)
        for k in range(i, len(self.merges)):
            self.merges[k] = tuple(map(name, self.merges[k]))
            self.changes[k] = {name(q >> 32) << 32 | name(q & 0xFFFFFFFF): n for q, n in self.changes[k].items()}
        return True


def train_distributed(counts: DataFrame, vocab_size: int, min_frequency: int = 2, store_every: int = 512, at_once: int = 512) -> list[tuple[int, int, int]]:
    """The same merges with the words left in Spark. The driver guesses the next merges from about `CORE` words; one pass over all words does
    them and counts by how much each changes the pairs. With these exact counts the driver finds the right merges as long as they are among
    the guesses, in any order that comes to the same, and the first one that isn't. Words are stored anew after `store_every` merges or more."""
    _check(vocab_size, min_frequency)
    workers(counts.sparkSession)
    words = stored(_start(counts), "words")
    core = _core(words)
    out: list[tuple[int, int, int]] = []
    total: dict[int, int] = {}
    done = 0  # merges that the stored words have
    try:
        while len(out) < vocab_size - 256:
            behind = out[done:]
            most = min(at_once, vocab_size - 256 - len(out))
            guess = _guessed(Links(core[0].view(np.int32), *core[1:]), out, total, most + most // 4 + 1)
            t = changes_of(words, behind + guess).toArrow()
            changes: list[dict[int, int]] = [{} for _ in range(len(behind) + len(guess) + 1)]
            for step, pair, n in zip(*(t[c].to_pylist() for c in ("step", "pair", "n")), strict=True):
                changes[step][pair] = n
            total, heap = {}, []

            def follow(change: dict[int, int]) -> None:
                for p, x in change.items():
                    now = total[p] = total.get(p, 0) + x
                    if now > 0:
                        heapq.heappush(heap, (-now, p))

            for x in changes[: len(behind) + 1]:
                follow(x)
            todo, i = Pass(guess, changes[len(behind) + 1 :]), 0
            while len(out) < vocab_size - 256:
                while heap and total[heap[0][1]] != -heap[0][0]:
                    heapq.heappop(heap)
                if not heap or -heap[0][0] < min_frequency:
                    return out
                pair = heap[0][1] >> 32, heap[0][1] & 0xFFFFFFFF
                out.append((*pair, 256 + len(out)))
                if not todo.forward(pair, i):
                    break
                follow(todo.changes[i])
                i += 1
            if len(out) - done >= store_every and len(out) < vocab_size - 256:
                old, words = words, stored(_merged_words(words, out[done:]), "words")
                drop_stored(old)
                done = len(out)
        return out
    finally:
        drop_stored(words)


def ranks_from_merges(merges: Iterable[tuple[int, int, int]]) -> dict[bytes, int]:
    tokens = {i: bytes([i]) for i in range(256)}
    for left, right, new in merges:
        tokens[new] = tokens[left] + tokens[right]
    return {t: i for i, t in tokens.items()}


def train_ranks(df: DataFrame, text_col: str, *, vocab_size: int, pattern: str | None = None, min_frequency: int = 2) -> tuple[str, dict[bytes, int]]:
    _check(vocab_size, min_frequency)
    counts = piece_counts(df, text_col, pattern).cache()
    try:
        if counts.count() <= MOST_PIECES:
            t = counts.where(F.octet_length("piece") > 1).toArrow()
            piece = t["piece"].combine_chunks().cast(pa.large_binary())
            offs = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1] if len(piece) else np.zeros(1, np.int64)
            data = np.frombuffer(piece.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(piece) else np.zeros(0, np.uint8)
            merges = merges_of(Links(data, np.diff(offs), t["n"].to_numpy()), vocab_size, min_frequency)
        else:
            merges = train_distributed(counts, vocab_size, min_frequency)
    finally:
        counts.unpersist()
    return pattern or DEFAULT_PATTERN, ranks_from_merges(merges)


def train_encoding(df: DataFrame, text_col: str, *, vocab_size: int, name: str = "trained", pattern: str | None = None, special_tokens: dict[str, int] | None = None, min_frequency: int = 2) -> Encoding:
    pat, ranks = train_ranks(df, text_col, vocab_size=vocab_size, pattern=pattern, min_frequency=min_frequency)
    return Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens=special_tokens or {})


def train_mergeable_ranks_from_iterator(texts: Iterable[str], *, vocab_size: int, pattern: str | None = None, min_frequency: int = 2) -> tuple[str, dict[bytes, int]]:
    _check(vocab_size, min_frequency)
    rx, n = regex.compile(pattern or DEFAULT_PATTERN), defaultdict(int)
    for t in texts:
        for m in rx.finditer(t):
            if m[0]:
                n[m[0].encode()] += 1
    return pattern or DEFAULT_PATTERN, ranks_from_merges(train_from_counts(n.items(), vocab_size, min_frequency))


def train_encoding_from_iterator(texts: Iterable[str], *, vocab_size: int, name: str = "trained", pattern: str | None = None, special_tokens: dict[str, int] | None = None, min_frequency: int = 2) -> Encoding:
    pat, ranks = train_mergeable_ranks_from_iterator(texts, vocab_size=vocab_size, pattern=pattern, min_frequency=min_frequency)
    return Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens=special_tokens or {})


def merge_pairs(vocabulary: DataFrame) -> DataFrame:
    """(l, r, rank): every way to cut a token of (token, rank) into two tokens."""
    v = vocabulary.where(F.octet_length("token") > 1)
    cut = v.select("rank", F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("token") - 1), lambda i: F.struct(F.substring("token", F.lit(1), i).alias("a"), F.substring(F.col("token"), i + 1, F.octet_length("token") - i).alias("b")))).alias("x"))
    a = vocabulary.select(F.col("token").alias("a"), F.col("rank").alias("l"))
    b = vocabulary.select(F.col("token").alias("b"), F.col("rank").alias("r"))
    return cut.select("rank", "x.a", "x.b").join(a, "a").join(b, "b").groupBy("l", "r").agg(F.min("rank").alias("rank"))
