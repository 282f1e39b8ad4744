"""LM scoring: a causal self-attention model on subword ids, trained in numpy.

A text is its lower-cased words (A-Z; split at ASCII white space), each after one space, then one end; the subword ids of each word come from
a public byte-level BPE vocabulary, given by path. The probability of an id is P(class | up to 32 ids before) * P(id | class, context class of the id before).

* Classes of ids: k-means on neighbourhood vectors of all ids, from neighbour counts over every training document.
* P(id | class, context class of the id before), with a finer clustering for contexts, and P(class | context class): counts over every
  training document, smoothed.
* P(class | ids before): one block of causal self-attention over windows of `WINDOW` ids, added to the logarithms of
  P(class | context class). Adam starts it on `sample` training documents; then it goes on with every window of every training document:
  `ROUNDS` times each partition takes its documents of one part of all, and the weights are averaged (an id's embedding by its uses). Windows
  that are scored overlap, and each id is scored once, in the window where it has most ids before it.

The unigram base model is exact: word counts over every training document; the `hot` most frequent words (a bound) are looked up in the
worker, all others by a join. Pass one reads the texts, counts, and keeps the ids; later passes count, train on and score these. Rows are
told apart by two 64-bit hashes of id and text.

Null and empty texts have the end alone. Null ids are never held out. Texts are read whole, however long: windows go over all of them. Repeated
rows and ties give equal results, and count as often as they are there. No training rows: every base probability is 1. Empty tables give
empty results. Only the named columns are read; others may clash."""

from __future__ import annotations

import base64
import copy
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common
from ._common import drop_stored, workers
from ._text import LOWER, U, hashes, pieces, release, row_bounds, text_bytes, words

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the vocabulary's texts are split before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CLASSES, CONTEXTS, WINDOW, STRIDE, D = 64, 256, 32, 24, 16
OWN = 4096  # ids with an embedding of their own
#: neighbour places that are counted together, and how many frequent ids are told apart there
LAGS = (((-1,), 128), ((1,), 128), ((-8, -7, -6, -5, -4, -3, -2, 2, 3, 4, 5, 6, 7, 8), 32))
ROUNDS = 3  # the attention goes on with all training documents, in three parts by hash
BLOCKS, UNIT = 1024, 2.0**20  # sums over partitions: blocks of places; weights are summed as whole numbers, so order has no effect
END = np.array([0xE7D], U)  # stands for the end among word hashes
BATCH = 192  # windows that are scored together
TALL = 128  # rows of a product that are multiplied together: small products take about half the time of one large one


def stored(df: DataFrame, name: str) -> DataFrame:
    """As _common.stored; the executors' heaps shrink after it, as every pass has Python workers that need memory."""
    out = _common.stored(df, name)
    _common.release_executors(df.sparkSession)
    return out


@lru_cache(2)
def tokenizer(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), max(table.values()) + 1


class WordIds:
    """The ids of texts, word by word. The first words seen are remembered, by hash, up to `most`: frequent words come early."""

    def __init__(self, tok, most: int = 1 << 18):
        self.tok, self.most, self.known = tok, most, {}
        self.line = tok.encode_ordinary("\n")

    def encode(self, found: list[bytes]) -> list[bytes]:
        """The ids of words, as bytes. They are encoded as lines of one text, or one by one if lines can't be told apart in the ids."""
        if len(found) > 1 and len(self.line) == 1:
            ids = np.array(self.tok.encode_ordinary(" " + "\n ".join(x.decode("utf-8", "replace") for x in found)), np.uint16)
            cuts = np.flatnonzero(ids == self.line[0])
            if len(cuts) == len(found) - 1:
                raw, cuts = ids.tobytes(), (2 * cuts).tolist()
                return [raw[i:j] for i, j in zip([0, *(c + 2 for c in cuts)], [*cuts, len(raw)], strict=True)]
        return [array("H", self.tok.encode_ordinary(" " + x.decode("utf-8", "replace"))).tobytes() for x in found]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, where each of n rows begins; the distinct hashes, and which of them each word has)"""
        u, first, place = np.unique(h, return_index=True, return_inverse=True)
        place = place.ravel()
        known, got = self.known, list(map(self.known.get, u.tolist()))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            raw = data.tobytes()
            for i, x in zip(new, self.encode([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]), strict=True):
                got[i] = x
                if len(known) < self.most and len(x) <= 64:
                    known[int(u[i])] = x
        size = np.fromiter(map(len, got), np.int64, len(got)) >> 1
        flat = np.frombuffer(b"".join(got), np.uint16)
        each = size[place]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.arange(total[-1]) + np.repeat((np.cumsum(size) - size)[place] - total[:-1], each)]
        return ids, total[row_bounds(rows, n)], u, place


_WORDS: dict[int, WordIds] = {}


def words_of(ranks: bytes) -> tuple[WordIds, int]:
    """The remembered words of a vocabulary, kept by the worker from task to task, and the id of the end."""
    tok, end = tokenizer(ranks)
    if hash(ranks) not in _WORDS:
        _WORDS.clear()
        _WORDS[hash(ranks)] = WordIds(tok)
    return _WORDS[hash(ranks)], end


def ids_of(own: WordIds, texts: pa.Array) -> list[np.ndarray]:
    """The ids of each text."""
    data, offs = text_bytes(texts)
    low = LOWER[data]
    starts, ends, rows = words(low, offs)
    ids, at, _, _ = own(low, starts, ends, rows, hashes(low, starts, ends), len(offs) - 1)
    return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def softmax_log(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for an x of many rows."""
    n, w = len(x) - len(x) % TALL, np.ascontiguousarray(w)
    out = np.empty((len(x), w.shape[1]), np.float32)
    np.matmul(x[:n].reshape(-1, TALL, x.shape[1]), w, out=out[:n].reshape(-1, TALL, w.shape[1]))
    np.matmul(x[n:], w, out=out[n:])
    return out


def across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y for many rows."""
    n = len(x) - len(x) % TALL
    blocks = x[:n].reshape(-1, TALL, x.shape[1]).transpose(0, 2, 1) @ y[:n].reshape(-1, TALL, y.shape[1])
    return blocks.sum(0) + x[n:].T @ y[n:]


def turned(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w of each window, with rows and columns exchanged: quicker than a copy of the product."""
    return np.ascontiguousarray(w.T) @ x.transpose(0, 2, 1)


class SubwordLM:
    """Class tables and the attention block. end is the id of the end (and of what stands before a text)."""

    def __init__(self, end: int):
        self.end, self.cls, self.ctx, self.slot = end, *(np.zeros(end + 1, np.int64) for _ in range(3))
        self.inner = np.zeros((CONTEXTS, end + 1), np.float16)
        self.bigram = np.zeros((CONTEXTS, CLASSES), np.float32)
        r = np.random.default_rng(11)
        n = lambda *s: (r.normal(0, 1, s) * s[0] ** -0.5).astype(np.float32)
        self.p = {"E": (r.normal(0, 0.3, (OWN + CLASSES, D))).astype(np.float32), "P": (r.normal(0, 0.1, (WINDOW, D))).astype(np.float32), "Q": n(D, D), "K": n(D, D), "V": n(D, D), "O": n(2 * D, CLASSES) * np.float32(0.1), "M": n(D, 2 * D), "m": np.zeros(2 * D, np.float32), "A": n(D, D)}

    def set_classes(self, texts: list[np.ndarray]) -> None:
        """As set_neighbours, with counts from texts."""
        x = np.concatenate([np.append(t, self.end) for t in texts] or [np.array([self.end])]).astype(np.int64)
        count = np.bincount(x, minlength=self.end + 1)
        m = np.zeros(n_cells(self.end), np.int32)
        add_neighbours(m, x, ranks_of(count))
        self.set_neighbours(count, m)

    def set_neighbours(self, count: np.ndarray, cells: np.ndarray) -> None:
        """Clusters the ids by what stands next to them, and in the 8 places around (cells, see add_neighbours); ids that never occur share classes."""
        order = np.argsort(-count, kind="stable")
        top = order[: max(OWN, int((count > 0).sum()))]
        parts = []
        at = 0
        for _, dims in LAGS:
            m = cells[at : at + len(count) * dims].reshape(-1, dims)[top].astype(np.float32)
            at += len(count) * dims
            m = np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1))
            r = np.random.default_rng(3).normal(0, 1, (dims, 24)).astype(np.float32)
            q, _ = np.linalg.qr(m.T @ (m @ (m.T @ (m @ r))))
            parts.append(m @ q)
        v = np.concatenate(parts, 1)
        weight = np.sqrt(count[top]).astype(np.float64) + 1e-9
        self.cls, self.ctx = (self._clusters(v, weight, top, k) for k in (CLASSES, CONTEXTS))
        self.slot = OWN + self.cls
        self.slot[top[:OWN]] = np.arange(len(top[:OWN]))
        self.slot[self.end] = OWN + CLASSES - 1

    def _clusters(self, v: np.ndarray, weight: np.ndarray, top: np.ndarray, n: int) -> np.ndarray:
        r, k = np.random.default_rng(5), n - 4
        c = v[r.choice(len(top), k, replace=False, p=weight / weight.sum())]
        for _ in range(15):
            own = np.argmin((c * c).sum(1) - 2 * v @ c.T, 1)
            total = np.bincount(own, weight, k)
            c = np.where(total[:, None] > 0, np.stack([np.bincount(own, weight * v[:, j], k) for j in range(v.shape[1])], 1) / np.maximum(total, 1e-9)[:, None], c).astype(np.float32)
        out = k + np.arange(self.end + 1) % 3
        out[top] = own
        out[self.end] = n - 1
        return out

    def set_counts(self, pair: np.ndarray) -> None:
        """pair: counts of (context class before, id) over all training documents."""
        pair = pair.reshape(CONTEXTS, self.end + 1)
        one = pair.sum(0) + 0.02
        by_class = np.bincount(self.cls, one, CLASSES)
        back = one / by_class[self.cls]
        into = np.stack([np.bincount(self.cls, row, CLASSES) for row in pair])
        for i in range(CONTEXTS):
            self.inner[i] = np.log((pair[i] + 30 * back) / (into[i, self.cls] + 30))
        self.bigram = np.log((into + 0.5) / (into.sum(1, keepdims=True) + 0.5 * CLASSES)).astype(np.float32)

    def hidden(self, ids: np.ndarray, skip: int = 0) -> tuple:
        """ids: windows of the ids before each place; the first `skip` places are attended to, but have no logits."""
        p, (b, w) = self.p, ids.shape
        x = np.take(p["E"], np.take(self.slot, ids), axis=0)
        x += p["P"][:w]
        flat = x.reshape(-1, D)  # one product for all windows
        qv = times(flat, np.concatenate((p["Q"] * np.float32(D**-0.5), p["V"]), 1)).reshape(b, w, -1)
        q, v = qv[:, skip:, :D], qv[..., D:]
        s = q @ turned(x, p["K"])
        if s.max(initial=0) > 60:
            np.minimum(s, 60, out=s)  # bounded, so no maximum need be taken off
        np.exp(s, out=s)
        s *= np.tri(w, dtype=np.float32)[skip:]
        z = s @ v
        total = (s.reshape(-1, w) @ np.ones(w, np.float32)).reshape(b, -1, 1)
        z /= total
        y = times(z.reshape(-1, D), p["A"])
        y += x[:, skip:].reshape(-1, D)
        g = times(y, p["M"])
        g += p["m"]
        np.maximum(g, 0, out=g)
        logits = times(g, p["O"])
        logits += np.take(self.bigram, np.take(self.ctx, ids[:, skip:]).ravel(), axis=0)
        return logits.reshape(b, w - skip, -1), (x, q, s, total, z, y, g)

    def log_probs(self, before: np.ndarray, ids: np.ndarray, skip: int = 0) -> np.ndarray:
        """Of the ids from place `skip` on."""
        logits, _ = self.hidden(before, skip)
        before, ids = before[:, skip:], ids[:, skip:]
        flat = logits.reshape(-1, CLASSES)
        if flat.max(initial=0) > 80:
            np.minimum(flat, 80, out=flat)
        picked = flat[np.arange(len(flat)), np.take(self.cls, ids).ravel()]
        np.exp(flat, out=flat)
        picked -= np.log(flat @ np.ones(CLASSES, np.float32))
        return picked.reshape(ids.shape) + self.inner[np.take(self.ctx, before), ids]

    def train(self, texts: list[np.ndarray], steps: int = 700, batch: int = 96, rate: float = 0.01) -> None:
        before, ids, live = windows(texts, self.end)
        if not len(ids):
            return
        r, state = np.random.default_rng(13), Adam(self.p)
        for i in range(1, steps + 1):
            pick = r.integers(0, len(ids), batch)
            state.step(self.gradients(before[pick], ids[pick], live[pick]), rate * min(1.0, 2 * (1 - i / (steps + 1))))

    def train_once(self, texts: list[np.ndarray], state: Adam, batch: int = 384, rate: float = 0.002) -> int:
        """Goes on with every window of texts once, in an order drawn anew; returns how many there are."""
        before, ids, live = windows(texts, self.end)
        order = np.random.default_rng(len(ids)).permutation(len(ids))
        for i in range(0, len(ids), batch):
            pick = order[i : i + batch]
            state.step(self.gradients(before[pick], ids[pick], live[pick]), rate * len(pick) / batch)
        return len(ids)

    def gradients(self, a: np.ndarray, b: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        """a, b: ids before and at the places of windows; live: the places that count."""
        logits, (x, q, s, total, z, y, g) = self.hidden(a)
        s /= total
        d = logits.reshape(-1, CLASSES)
        if max(d.max(initial=0), -d.min(initial=0)) > 60:
            d -= d.max(1, keepdims=True)
        np.exp(d, out=d)
        w = (live / max(1, live.sum())).astype(np.float32).ravel()
        d *= (w / (d @ np.ones(CLASSES, np.float32)))[:, None]
        d[np.arange(len(d)), np.take(self.cls, b).ravel()] -= w
        p, ones = self.p, np.ones(len(d), np.float32)
        dg = times(d, p["O"].T)
        dg *= g > 0
        dx = times(dg, p["M"].T)
        dz = times(dx, p["A"].T)
        flat_z = z.reshape(-1, D)
        own = (dz * flat_z) @ np.ones(D, np.float32)  # what a place's weights get on the mean: weights times values are z
        grads = {"O": across(g, d), "M": across(y, dg), "m": ones @ dg, "A": across(flat_z, dx)}
        dz = dz.reshape(z.shape)
        ds = dz @ turned(x, p["V"])
        ds -= own.reshape(*a.shape, 1)
        ds *= s
        dqkv = np.empty((*a.shape, 3 * D), np.float32)
        np.matmul(ds, times(x.reshape(-1, D), p["K"]).reshape(x.shape), out=dqkv[..., :D])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., D : 2 * D])  # q is scaled already
        np.matmul(s.transpose(0, 2, 1), dz, out=dqkv[..., 2 * D :])
        dqkv = dqkv.reshape(-1, 3 * D)
        scale = np.float32(D**-0.5)
        dx += times(dqkv, np.concatenate((p["Q"] * scale, p["K"], p["V"]), 1).T)
        grads["Q"], grads["K"], grads["V"] = np.split(across(x.reshape(-1, D), dqkv), 3, 1)
        grads["Q"] = grads["Q"] * scale
        grads["P"] = dx.reshape(*a.shape, D).sum(0)
        slot = np.take(self.slot, a).ravel().astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=np.uint16(65535)))
        grads["E"] = np.zeros_like(p["E"])
        grads["E"][slot[first]] = np.add.reduceat(np.take(dx, order, axis=0), first)
        return grads

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text with its end."""
        out = np.zeros(len(texts))
        lengths = np.array([len(t) + 1 for t in texts])
        flat = np.concatenate([np.append(t, self.end).astype(np.int32) for t in texts])
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        prior = np.empty_like(flat)
        prior[1:] = flat[:-1]
        prior[begin] = self.end
        n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
        own = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        start, size = begin[own] + nth * STRIDE, lengths[own] - nth * STRIDE
        sums = np.zeros(len(own))
        for own_kind, skip in ((nth == 0, 0), (nth > 0, WINDOW - STRIDE)):  # places before skip have been scored in the window before
            which = np.flatnonzero(own_kind)
            for i in range(0, len(which), BATCH):
                w = which[i : i + BATCH]
                at = np.minimum(start[w, None] + np.arange(WINDOW), len(flat) - 1)
                lp = self.log_probs(prior[at], flat[at], skip)
                lp *= np.arange(skip, WINDOW) < size[w, None]
                sums[w] = lp.sum(1, dtype=np.float64)
        return np.bincount(own, sums, len(texts)) / np.log(10)


class Adam:
    """Steps on the arrays of p, which are replaced."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.i = p, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.i += 1
        up, root = np.float32(rate / (1 - 0.9**self.i)), np.float32((1 - 0.99**self.i) ** -0.5)
        for n, t in grads.items():
            m, v = self.m[n], self.v[n]
            m *= np.float32(0.9)
            m += np.float32(0.1) * t
            v *= np.float32(0.99)
            v += np.float32(0.01) * (t * t)
            by = np.sqrt(v)
            by *= root
            by += np.float32(1e-7)
            np.divide(m, by, out=by)
            by *= up
            self.p[n] = self.p[n] - by


def n_cells(end: int) -> int:
    return (end + 1) * sum(dims for _, dims in LAGS)


def ranks_of(count: np.ndarray) -> np.ndarray:
    """Rank of each id by its count."""
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    return rank


def add_neighbours(cells: np.ndarray, x: np.ndarray, rank: np.ndarray) -> None:
    """Adds to cells, for each of LAGS a table of (id, rank of neighbour), the neighbours in the run of ids x."""
    y, at = rank[x], 0
    for lags, dims in LAGS:
        known = np.flatnonzero(y < dims)
        for lag in lags:
            own = known - lag
            ok = (own >= 0) & (own < len(x))
            np.add.at(cells, at + x[own[ok]] * dims + y[known[ok]], cells.dtype.type(1))
        at += len(rank) * dims


def in_blocks(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The places of x that aren't 0, by block."""
    size = -(-len(x) // BLOCKS)
    for i in range(BLOCKS):
        part = x[i * size : (i + 1) * size]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([part[at].astype(np.float64).tobytes()], pa.binary())], names=["block", "at", "n"])


IN_BLOCKS = "block int, at binary, n binary"


def sum_blocks(df: DataFrame, n: int) -> np.ndarray:
    """Sum of the arrays of n places that the partitions of df gave through in_blocks."""
    size = -(-n // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, x in zip(*(b.column(c).to_pylist() for c in ("block", "at", "n")), strict=True):
                total.setdefault(i, np.zeros(size))[np.frombuffer(at, np.uint32)] += np.frombuffer(x)
        for i, x in total.items():
            at = np.flatnonzero(x)
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], names=["block", "at", "n"])

    out = np.zeros(size * BLOCKS)
    sums = stored(df.repartition(64, "block").mapInArrow(run, IN_BLOCKS), "sums")  # what was shuffled goes at once
    for r in sums.toLocalIterator():
        out[r["block"] * size + np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["n"])
    drop_stored(sums)
    return out[:n]


def runs_of(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Ids of many texts in one run, an end before the first and after each."""
    for b in batches:
        x = [np.frombuffer(t, np.uint16) for t in b.column("ids").to_pylist()]
        sizes = np.cumsum([len(t) + 1 for t in x])
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + 500_000, "right")))
            yield np.concatenate([np.array([end], np.uint16), *(np.append(t, np.uint16(end)) for t in x[i:j])]).astype(np.int64)
            i = j


def neighbours(train: DataFrame, held_rank, end: int) -> np.ndarray:
    """Neighbour counts (see add_neighbours) over the ids of all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n_cells(end), np.int32)
        for x in runs_of(batches, end):
            add_neighbours(cells, x, held_rank.value)
        yield from in_blocks(cells)
        release()

    return sum_blocks(train.select("ids").mapInArrow(run, IN_BLOCKS), n_cells(end))


def pair_counts(train: DataFrame, held_ctx, end: int) -> np.ndarray:
    """Counts of (context class before, id) over the ids of all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, pairs = held_ctx.value, np.zeros(CONTEXTS * (end + 1), np.int32)
        for x in runs_of(batches, end):
            np.add.at(pairs, ctx[x[:-1]] * (end + 1) + x[1:], np.int32(1))
        yield from in_blocks(pairs)
        release()

    return sum_blocks(train.select("ids").mapInArrow(run, IN_BLOCKS), CONTEXTS * (end + 1)).astype(np.int64)


def averaged(train: DataFrame, held_lm, lm: SubwordLM, rate: float = 0.002) -> None:
    """Each partition trains the attention on all its windows, each once; the mean of the weights, by windows, and of embeddings, by uses, goes to lm."""
    names = list(lm.p)
    size = sum(lm.p[k].size for k in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.copy(held_lm.value)
        own.p = dict(own.p)
        n, used, state = 0, np.zeros(len(own.p["E"]), np.int64), Adam(own.p)
        for texts in lists_of(batches):
            n += own.train_once(texts, state, rate=rate)
            used += np.bincount(own.slot[np.concatenate([np.append(t, own.end) for t in texts])], minlength=len(used))
        if n:
            weight = np.concatenate([(np.repeat(used, D) if k == "E" else np.full(own.p[k].size, n)) for k in names]).astype(np.float64)
            w = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64)
            yield from in_blocks(np.concatenate((np.round(w * UNIT) * weight, weight)))
        release()

    got = sum_blocks(train.select("ids").mapInArrow(run, IN_BLOCKS), 2 * size)
    total, weight = got[:size] / UNIT, got[size:]
    at = 0
    for k in names:
        old = lm.p[k]
        t, w = (x[at : at + old.size].reshape(old.shape) for x in (total, weight))
        lm.p[k] = np.where(w > 0, t / np.maximum(w, 1), old).astype(np.float32)
        at += old.size


def windows(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids before, ids, which count) of training windows; an end stands in the places that don't."""
    if not texts:
        return (np.zeros((0, WINDOW), np.int64),) * 3
    lengths = np.array([len(t) + 1 for t in texts])
    flat = np.concatenate([np.append(t, end).astype(np.int32) for t in texts])
    begin = np.cumsum(lengths) - lengths
    prior = np.append(np.int32(end), flat[:-1])  # before a text stands the end of another
    n = -(-lengths // WINDOW)
    own = np.repeat(np.arange(len(texts)), n)
    nth = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    live = np.arange(WINDOW) < (lengths[own] - nth)[:, None]
    at = np.minimum((begin[own] + nth)[:, None] + np.arange(WINDOW), len(flat) - 1)
    return np.where(live, prior[at], np.int32(end)), np.where(live, flat[at], np.int32(end)), live


def lists_of(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[list[np.ndarray]]:
    """The ids of texts, in lists of about `most` ids."""
    held, size = [], 0
    for b in batches:
        for t in b.column("ids").to_pylist():
            held.append(np.frombuffer(t, np.uint16))
            size += len(held[-1]) + 1
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


PASS_ONE = "kind tinyint, uid long, uid2 long, id long, held boolean, n long, ids binary, h long"


def read_texts(docs: DataFrame, held_tok) -> DataFrame:
    """One row (kind 0) per document with its ids; word counts of training documents (kind 1: h, n) and id counts (kind 2: h = id, n)."""

    names = ["kind", "uid", "uid2", "id", "held", "n", "ids", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = words_of(held_tok.value)
        seen = np.zeros(end + 1, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size, ends_seen = 0, 0

        def counts(kind: int, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 1 << 18):
                k = len(h[i : i + (1 << 18)])
                null = lambda t: pa.nulls(k, t)
                yield pa.record_batch([pa.array(np.full(k, kind, np.int8)), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.bool_()), pa.array(n[i : i + k]), null(pa.binary()), pa.array(h[i : i + k])], names=names)

        for b, data, offs in pieces(batches, "text", 1 << 20):
            low = LOWER[data]
            starts, ends, rows = words(low, offs)
            h = hashes(low, starts, ends)
            held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            n = len(offs) - 1
            ids, at, u, place = own(low, starts, ends, rows, h, n)
            c = np.bincount(place[~held[rows]], minlength=len(u))
            waiting.append((u[c > 0], c[c > 0]))
            size += len(u)
            ends_seen += int((~held).sum())
            if size > 1_000_000:
                yield from counts(1, *_summed(waiting))
                waiting, size = [], 0
            seen += np.bincount(ids[np.repeat(~held, np.diff(at))], minlength=end + 1)
            seen[end] += int((~held).sum())
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * at).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.record_batch([pa.array(np.zeros(n, np.int8)), b.column("uid"), b.column("uid2"), b.column("id"), b.column("held"), pa.array(np.bincount(rows, minlength=n) + 1), packed, pa.nulls(n, pa.int64())], names=names)
        waiting.append((END, np.array([ends_seen])))
        yield from counts(1, *_summed(waiting))
        at = np.flatnonzero(seen)
        yield from counts(2, at, seen[at])

    return docs.mapInArrow(run, PASS_ONE)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of several lists of them, hashes with a count once."""
    u, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.zeros(len(u), np.int64)
    np.add.at(n, place.ravel(), np.concatenate([c for _, c in parts]))
    return u[n > 0].view(np.int64), n[n > 0]


class HotWords:
    """Counts of frequent words by hash."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        h = h.view(U)
        order = np.argsort(h)
        self.key, self.count = np.append(h[order], U(2**64 - 1)), np.append(c[order], 0)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key[:-1], h)
        return np.where(self.key[at] == h, self.count[at], 0)


def rare_words(docs: DataFrame, hot, scale: float) -> DataFrame:
    """Pass over the texts for the base: per document (h null) the sums over hot words; per other word of a document (h, n)."""
    names = ["uid", "uid2", "h", "n", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, "text", 1 << 20):
            low = LOWER[data]
            starts, ends, rows = words(low, offs)
            h = hashes(low, starts, ends)
            n = b.num_rows
            rows, h = np.concatenate((rows, np.arange(n))), np.concatenate((h, np.repeat(END, n)))
            c = hot.value.find(h)
            known = c > 0
            base = np.bincount(rows[known], np.log10(c[known] + 1.0) - scale, n)
            n_known = np.bincount(rows[known], minlength=n)
            yield pa.record_batch([b.column("uid"), b.column("uid2"), pa.nulls(n, pa.int64()), pa.array(n_known), pa.array(base)], names=names)
            rows, h = rows[~known], h[~known]
            order = np.lexsort((h, rows))
            rows, h = rows[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            own = pa.array(rows[first])
            yield pa.record_batch([b.column("uid").take(own), b.column("uid2").take(own), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h)))), pa.nulls(len(first), pa.float64())], names=names)

    return docs.select("uid", "uid2", "text").mapInArrow(run, "uid long, uid2 long, h long, n long, base double")


def score_texts(docs: DataFrame, is_held: Column, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, sample: int = 1500, hot: int = 65_536) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score. is_held: a condition on docs."""
    spark = docs.sparkSession
    workers(spark)
    sc = spark.sparkContext
    _common.release_executors(spark)  # of what ran before
    with open(vocab, "rb") as f:
        ranks = f.read()
    tok, end = tokenizer(ranks)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(is_held, F.lit(False)).alias("held"), F.xxhash64(id_col, text_col).alias("uid"), F.xxhash64(F.lit(2), id_col, text_col).alias("uid2"))
    first = base.where("not held").orderBy(F.xxhash64("id"), "id").limit(sample).select("text").toArrow()["text"]
    texts = ids_of(WordIds(tok), first)
    lm = SubwordLM(end)
    one = stored(read_texts(base, sc.broadcast(ranks)), "texts")
    train = one.where("kind = 0 and not held")
    got = one.where("kind = 2").groupBy("h").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as ids
    count = np.zeros(end + 1, np.int64)
    count[got["h"].to_numpy()] = got["n"].to_numpy()
    lm.set_neighbours(count, neighbours(train, sc.broadcast(ranks_of(count)), end))
    lm.set_counts(pair_counts(train, sc.broadcast(lm.ctx), end))
    lm.train(texts)
    for i in range(ROUNDS):
        averaged(train.where(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == i), sc.broadcast(lm), lm, 0.002 / (i + 1))
    counts = stored(one.where("kind = 1").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, n_distinct = total[0] or 0, total[1]
    scale = float(np.log10(n_all + n_distinct + 1))
    top = counts.orderBy(F.desc("c"), "h").limit(hot).toArrow()
    held_hot, held_lm = sc.broadcast(HotWords(top["h"].to_numpy(), top["c"].to_numpy())), sc.broadcast(lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.uint16) for x in b.column("ids").to_pylist()]
            s = np.zeros(len(ids))
            sizes = np.cumsum([len(t) + 1 for t in ids])
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + 400_000, "right")))
                s[i:j] = held_lm.value.score(ids[i:j])
                i = j
            yield pa.record_batch([*(b.column(x) for x in ("uid", "uid2", "id", "held", "n")), pa.array(s)], names=["uid", "uid2", "id", "held", "n", "score"])

    parts = stored(rare_words(base, held_hot, scale), "parts")
    c, key = F.coalesce("c", F.lit(0)), ["uid", "uid2"]
    rare = parts.where("h is not null").join(counts, "h", "left").groupBy(*key).agg(F.sum(F.col("n") * (F.log10(c + 1.0) - F.lit(scale))).alias("rare_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    # equal rows have one uid: the sums over their other words hold each of them, and are shared out again
    hot_sums = parts.where("h is null").groupBy(*key).agg(F.count("*").alias("copies"), F.first("n").alias("hot_known"), F.first("base").alias("base"))
    sums = stored(hot_sums.join(rare, key, "left"), "words")  # one row a document: what it is made of goes before the texts are scored
    drop_stored(parts, counts)
    scored = one.where("kind = 0").select("uid", "uid2", "id", "held", "n", "ids").mapInArrow(run, "uid long, uid2 long, id long, held boolean, n long, score double")
    out = scored.join(sums, key)
    zero = F.lit(0)
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("hot_known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), zero)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce(F.col("rare_base") / F.col("copies"), F.lit(0.0))).alias("base_score"), "score",
    )
