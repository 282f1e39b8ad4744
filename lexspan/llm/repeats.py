"""Substring dedup with repeated-phrase automata.

Words are runs of characters other than ASCII white space, unchanged. A window is `size` consecutive words of one document. A word goes
if a window that covers it also starts in a document with a smaller id (judged on the input).

1. Anchors: the smallest of the hashes of the k-word phrases inside a window. Equal windows have equal anchors; about a fifth of all places are anchors.
2. Every document is read again; its runs of windows around anchors that two ids have (all others occur in one document only) are
   kept with their words, and dealt to shards by anchor.
3. In a shard, windows that two ids have are confirmed. What their first document holds of them is cut out as passages, in words.
4. Each shard compiles an Aho-Corasick automaton of its passages and streams all its runs through it (equal runs once). What the
   automaton matches is what is found: each match is a window of a passage, with the passage's id. A window is spelled as two overlapping
   phrases, numbered by hashes, in a small alphabet, as that keeps the automaton narrow; so matches are compared with the passage byte by byte.
5. Matches go from the runs to the documents that have them, and the text is rebuilt without the words found in a smaller id.

An anchor that more than `per_shard` runs have doesn't go to a shard whole: the same steps are done over it in parts. Equal runs are made one
by a partial aggregate, windows are counted by another, and all parts of a shard get its passages. So no group is unbounded.

Null and empty texts have no words. Texts are read whole, however long. Rows with a null id are left as they are. Rows are told
apart by id and text: rows that repeat an id don't remove each other's words (an id isn't smaller than itself), repeated rows get
equal results. Only the named columns are read. Empty tables give empty results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, stored, workers
from ._text import U, grams, hashes, pieces, row_bounds, text_bytes, words

BITS = 7  # of a symbol of the automata


def _spans(data: np.ndarray, offs: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; then for each valid window its start word, its row and its anchor."""
    starts, ends, rows = words(data, offs)
    h = hashes(data, starts, ends)
    n = len(h) - size + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return h, z, z, np.zeros(0, U)
    g = grams(h, k)
    width, low = 1, g
    need = size - k + 1
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[: n], low[need - width : need - width + n])
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return h, at, rows[at], low[at]


def _runs(at: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of successive windows of one kind in one row."""
    if not len(at):
        return (np.zeros(0, np.int64),) * 2
    new = np.ones(len(at), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def _binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return text_bytes(col.cast(pa.large_binary()).view(pa.large_string()))


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between them, and their starts and ends there."""
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int(begin[-1] + size[-1]) if len(size) else 0, 0x20, np.uint8)
    shift = np.repeat(starts - begin, size)
    to = np.arange(len(shift)) + np.repeat(begin - (np.cumsum(size) - size), size)
    out[to] = data[to + shift]
    return out.tobytes(), begin, begin + size


def window_hashes(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start word, row) of the windows inside each row, and the starts and ends of all words."""
    starts, ends, rows = words(data, offs)
    g = grams(hashes(data, starts, ends), size)
    at = np.flatnonzero(rows[: len(g)] == rows[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[at].view(np.int64), at, rows[at], starts, ends


def find_anchors(docs: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, "text"):
            _, at, rows, anchor = _spans(data, offs, size, k)
            first, _ = _runs(at, rows, anchor)
            yield pa.record_batch([pa.array(anchor[first].view(np.int64)), b.column("id").take(pa.array(rows[first]))], names=["anchor", "id"])

    return docs.select("id", "text").mapInArrow(run, "anchor long, id long")


def find_runs(docs: DataFrame, size: int, k: int) -> DataFrame:
    """docs has id, row, text, and anchors and busy (arrays); gives (anchor, hot, id, row, pos, seq): the runs of windows at those anchors, with
    their words. hot: the anchor is one of busy."""

    def marks(own: np.ndarray, rows: np.ndarray, wanted: pa.Array) -> np.ndarray:
        """Whether the hash is in its row's list."""
        wanted = wanted.cast(pa.large_list(pa.int64()))
        owner = np.repeat(np.arange(len(wanted)), np.array(wanted.value_lengths()))
        odd = U(0x9E3779B97F4A7C15)
        return np.isin(own + rows.astype(U) * odd, wanted.flatten().to_numpy().view(U) + owner.astype(U) * odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, "text", 2 << 20):
            _, at, rows, anchor = _spans(data, offs, size, k)
            keep = marks(anchor, rows, b.column("anchors"))
            at, rows, anchor = at[keep], rows[keep], anchor[keep]
            first, last = _runs(at, rows, anchor)
            starts, ends, word_rows = words(data, offs)
            head = row_bounds(word_rows, b.num_rows)
            raw, starts, ends = single_spaced(data, starts, ends)
            seq = [raw[i:j] for i, j in zip(starts[at[first]].tolist(), ends[at[last] + size - 1].tolist(), strict=True)]
            own = pa.array(rows[first])
            hot = marks(anchor[first], rows[first], b.column("busy"))
            yield pa.record_batch([pa.array(anchor[first].view(np.int64)), pa.array(hot), b.column("id").take(own), b.column("row").take(own), pa.array((at[first] - head[rows[first]]).astype(np.int32)), pa.array(seq, pa.binary())], names=["anchor", "hot", "id", "row", "pos", "seq"])

    return docs.select("id", "row", "text", "anchors", "busy").mapInArrow(run, "anchor long, hot boolean, id long, row binary, pos int, seq binary")


def confirmed(g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that two ids have, sorted, and the smallest of these ids."""
    order = np.argsort(g)
    g, lo, hi = g[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
    if not len(first):
        return g, lo
    low, high = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    return g[first][low < high], low[low < high]


def passages_of(windows: tuple, low: np.ndarray, known: np.ndarray, lowest: np.ndarray, raw: bytes, size: int) -> tuple[np.ndarray, list[bytes]]:
    """(id, words): what the first documents hold of the known windows. windows: from window_hashes; low: the smallest id of each row."""
    g, at, own, starts, ends = windows
    if not len(known) or not len(g):
        return np.zeros(0, np.int64), []
    place = np.minimum(np.searchsorted(known, g), len(known) - 1)
    hit = np.flatnonzero((known[place] == g) & (lowest[place] == low[own]))
    hit = np.sort(hit[np.unique(place[hit], return_index=True)[1]])  # of windows that stand here several times, one is enough
    a, z = _runs(at[hit], own[hit], own[hit])
    a, z = hit[a], hit[z]
    return low[own[a]], [raw[i:j] for i, j in zip(starts[at[a]].tolist(), ends[at[z] + size - 1].tolist(), strict=True)]


def match(runs: pa.Array, low: np.ndarray, passages: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, off, n, lo): `n` words from word `off` on of a run are windows of passages whose id (low) is `lo`, by run and place. An
    automaton of the passages' windows finds them."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(runs) or not len(passages):
        return nothing
    data, offs = _binary(pa.concat_arrays([passages, runs]))
    starts, ends, rows = words(data, offs)
    half, step = size - size // 2, size // 2
    phrase = grams(hashes(data, starts, ends), half)
    head = row_bounds(rows, len(offs) - 1)
    cut, n_runs = int(head[len(passages)]), len(runs)  # words before the cut are those of passages
    at = np.flatnonzero(rows[: max(0, cut - size + 1)] == rows[size - 1 : max(size - 1, cut)])  # where windows of passages begin
    if not len(at):
        return nothing
    known = np.unique(np.concatenate((phrase[at], phrase[at + step])))
    # a phrase is spelled in symbols, in an alphabet of its own for each place, so that matches begin and end where phrases do
    length = max(1, -(-len(known).bit_length() // BITS))
    spell = lambda x: np.stack([0x100 + (i << BITS) + ((x >> (BITS * i)) & ((1 << BITS) - 1)) for i in range(length)], 1).astype(np.uint32)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    keys = np.concatenate([spell(np.searchsorted(known, phrase[at])), spell(np.searchsorted(known, phrase[at + step]))], 1).tobytes().decode("utf-32-le")
    for i, place in enumerate(at.tolist()):
        automaton.add_word(keys[2 * length * i : 2 * length * (i + 1)], place)
    automaton.make_automaton()
    # each run as `step` streams of every step-th phrase, with a gap between, and where a phrase is in no passage
    n = np.maximum(0, np.diff(head)[len(passages) :] - half + 1)
    run_of = np.repeat(np.arange(n_runs), n)
    base = np.cumsum(n) - n
    inside = np.arange(len(run_of)) - np.repeat(base, n)
    number = np.minimum(np.searchsorted(known, (own := phrase[head[len(passages) + run_of] + inside])), len(known) - 1)
    order = np.empty(len(run_of), np.int64)
    order[np.repeat(base, n) + (inside % step) * np.repeat(n // step, n) + np.minimum(inside % step, np.repeat(n % step, n)) + inside // step] = np.arange(len(run_of))
    order = order[(known[number] == own)[order]]
    if not len(order):
        return nothing
    run_of, inside, number = run_of[order], inside[order], number[order]
    new = np.ones(len(run_of), bool)
    new[1:] = (run_of[1:] != run_of[:-1]) | (inside[1:] != inside[:-1] + step)
    slot = length * np.arange(len(run_of)) + np.cumsum(new)
    text = np.full(int(slot[-1]) + length, 0x20, np.uint32)
    symbols = spell(number)
    for i in range(length):
        text[slot + i] = symbols[:, i]
    found = list(automaton.iter(text.tobytes().decode("utf-32-le")))
    if not found:
        return nothing
    end, where = np.array(found, np.int64).T
    source = np.searchsorted(slot, end, "right") - 1  # the second phrase of the window
    run_of, start = run_of[source], inside[source] - step
    order = np.argsort(run_of * (int(n.max()) + size) + start)
    run_of, start, where = run_of[order], start[order], where[order]
    # stretches of successive windows of one passage are compared with it
    a, z = _runs(start, run_of, where - start)
    first, last = head[len(passages) + run_of[a]] + start[a], head[len(passages) + run_of[z]] + start[z] + size - 1
    true = np.repeat(same_bytes(data, starts[first], ends[last], starts[where[a]], ends[where[z] + size - 1]), z - a + 1)
    for i in np.flatnonzero(~true).tolist():  # hashes have met: each window by itself
        j = int(head[len(passages) + run_of[i]] + start[i])
        true[i] = data[starts[j] : ends[j + size - 1]].tobytes() == data[starts[where[i]] : ends[where[i] + size - 1]].tobytes()
    run_of, start, lo = run_of[true], start[true], low[rows[where[true]]]
    a, z = _runs(start, run_of, lo)
    return run_of[a], start[a], start[z] - start[a] + size, lo[a]


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether data[a:a_end] is data[b:b_end], for each of several."""
    out = a_end - a == b_end - b
    size = np.where(out, a_end - a, 0)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    unlike = data[at + np.repeat(a, size)] != data[at + np.repeat(b, size)]
    out[np.repeat(np.arange(len(a)), size)[unlike]] = False
    return out


def whole_shard(size: int):
    """For a shard: its runs, to (id, row, pos, n): the words that a smaller id has."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        coded = t["seq"].combine_chunks().dictionary_encode()  # equal runs are one from here on
        index, seq = coded.indices.to_numpy(), coded.dictionary
        ids = t["id"].to_numpy()
        low, high = np.full(len(seq), np.iinfo(np.int64).max), np.full(len(seq), np.iinfo(np.int64).min)
        np.minimum.at(low, index, ids)
        np.maximum.at(high, index, ids)
        data, offs = _binary(seq)
        windows = window_hashes(data, offs, size)
        known, lowest = confirmed(windows[0], low[windows[2]], high[windows[2]])
        lo, cut = passages_of(windows, low, known, lowest, data.tobytes(), size)
        of, off, n, lo = match(seq, lo, pa.array(cut, pa.binary()), size)
        # from the distinct runs to the rows that have them
        bounds = np.searchsorted(of, np.arange(len(seq) + 1))
        count = np.diff(bounds)[index]
        each = np.repeat(np.arange(len(index)), count)
        f = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1][index], count)
        keep = lo[f] < ids[each]
        each, f = each[keep], f[keep]
        return pa.table([pa.array(ids[each]), t["row"].take(pa.array(each)), pa.array((t["pos"].to_numpy()[each] + off[f]).astype(np.int32)), pa.array(n[f].astype(np.int32))], names=["id", "row", "pos", "n"])

    return run


def find_windows(runs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, _, own, _, _ = window_hashes(*_binary(b.column("seq")), size)
            own = pa.array(own)
            yield pa.record_batch([b.column("shard").take(own), pa.array(g), b.column("lo").take(own), b.column("hi").take(own)], names=["shard", "win", "lo", "hi"])

    return runs.select("shard", "seq", "lo", "hi").mapInArrow(run, "shard int, win long, lo long, hi long")


def cut_passages(size: int):
    """For one part of a shard: its runs and the shard's confirmed windows, to (shard, lo, seq)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lo, seq = np.zeros(0, np.int64), []
        if left.num_rows and right.num_rows:
            data, offs = _binary(left["seq"])
            known = right["win"].to_numpy()
            order = np.argsort(known)
            lo, seq = passages_of(window_hashes(data, offs, size), left["lo"].to_numpy(), known[order], right["lo"].to_numpy()[order], data.tobytes(), size)
        shard = left["shard"][0].as_py() if left.num_rows else 0
        return pa.table([pa.array([shard] * len(seq), pa.int32()), pa.array(lo), pa.array(seq, pa.binary())], names=["shard", "lo", "seq"])

    return run


def locate(size: int):
    """For one part of a shard: its runs and the shard's passages, to (run, off, n, lo), see match()."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        one = lambda t: t["seq"].combine_chunks() if t.num_rows else pa.array([], pa.binary())
        of, off, n, lo = match(one(left), right["lo"].to_numpy(), one(right), size)
        return pa.table([left["run"].take(pa.array(of)), pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(lo)], names=["run", "off", "n", "lo"])

    return run


def in_parts(every: DataFrame, size: int, per_shard: int) -> DataFrame:
    """(id, row, pos, n) of the runs at anchors that many runs have; every: from find_runs, with shard."""
    every = every.withColumn("run", F.unhex(F.md5("seq")))
    runs = stored(every.groupBy("shard", "run").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.any_value("seq").alias("seq")), "runs")
    again = stored(find_windows(runs, size).groupBy("shard", "win").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("shard", "win", "lo"), "windows")
    parts = runs.groupBy("shard").agg(F.ceil(F.count("*") / per_shard).cast("int").alias("parts"))  # a row a shard, each with more than per_shard runs
    key = ["shard", "part"]
    left = runs.join(parts, "shard").select("shard", F.pmod(F.xxhash64("run"), F.col("parts")).cast("int").alias("part"), "run", "lo", "seq")
    to_parts = lambda x: x.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    passages = stored(left.groupBy(key).cogroup(to_parts(again).groupBy(key)).applyInArrow(cut_passages(size), "shard int, lo long, seq binary"), "passages")
    drop_stored(again)
    found = stored(left.select("shard", "part", "run", "seq").groupBy(key).cogroup(to_parts(passages).groupBy(key)).applyInArrow(locate(size), "run binary, off int, n int, lo long"), "found")
    drop_stored(passages, runs)
    out = every.select("id", "row", "pos", "run").join(found, "run").where("lo < id")
    return out.select("id", "row", (F.col("pos") + F.col("off")).cast("int").alias("pos"), "n")


def repeated_places(docs: DataFrame, size: int = 13, k: int = 5, per_shard: int = 20_000) -> DataFrame:
    """docs has id, row (a key of its text) and text; gives (id, row, pos, n): word ranges that a document with a smaller id has too.
    Ranges of one row can overlap."""
    docs = docs.where("id is not null")
    seen = stored(find_anchors(docs, size, k), "anchors")
    shared = seen.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", (F.col("n") > per_shard).alias("hot"))
    some = lambda c: F.collect_set(F.when(c, F.col("anchor")))
    by_doc = stored(seen.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"), some(F.col("hot")).alias("busy")), "anchored")
    drop_stored(seen)
    every = stored(find_runs(docs.join(by_doc, "id"), size, k), "runs")
    drop_stored(by_doc)
    n = every.groupBy("hot").count().collect()
    light, heavy = (sum(r["count"] for r in n if r["hot"] == hot) for hot in (False, True))
    shard = lambda n: F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n // per_shard)))).cast("int").alias("shard")
    parts = []
    if light:
        rows = every.where("not hot").select(shard(light), "id", "row", "pos", "seq")
        parts.append(stored(rows.groupBy("shard").applyInArrow(whole_shard(size), "id long, row binary, pos int, n int"), "gone"))
    if heavy:
        parts.append(stored(in_parts(every.where("hot").select(shard(heavy), "id", "row", "pos", "seq"), size, per_shard), "gone"))
    drop_stored(every)
    if not parts:
        return docs.select("id", "row", F.lit(0).alias("pos"), F.lit(0).alias("n")).limit(0)
    return reduce(DataFrame.union, parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, k: int = 5, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_text (the words left, joined by one space; null unless with_text) and kept_sha256 of it."""
    workers(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("row"), F.col(text_col).alias("text"))
    gone = repeated_places(base, size, k).groupBy("id", "row").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            data, offs = text_bytes(b.column("text"))
            raw, offs = data.tobytes(), offs.tolist()
            for i, spans in enumerate(b.column("gone")):
                w = raw[offs[i] : offs[i + 1]].split()
                n = len(w)
                if spans.is_valid:
                    stay = bytearray(b"\1") * n
                    flat = spans.values
                    for p, m in zip(flat.field("pos").to_pylist(), flat.field("n").to_pylist(), strict=True):
                        stay[p : p + m] = bytes(m)
                    w = list(compress(w, stay))
                kept = b" ".join(w)
                for c, x in zip(out, (n, n - len(w), kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(x)
            yield pa.record_batch([b.column("id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    done = base.join(gone, ["id", "row"], "left").select("id", "text", "gone").mapInArrow(run, "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_text", "kept_sha256")
