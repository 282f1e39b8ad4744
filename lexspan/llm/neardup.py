"""Near duplicates by SuperMinHash, banding, verification on full sets and union-find grouping.

A document's set holds its distinct k-word shingles (words are split at ASCII white space, A-Z lower-cased; fewer words than k
are one shingle; no words, no shingle and no link). Two documents are linked when 100 * |A n B| >= percent * |A u B|.

Equal sets are one node from the start. Signature slots are filled level by level: at level j each element gives its j-th rank
to one slot of its own permutation, and a document stops as soon as no slot is free. Bands of equal slots propose pairs in the
shape of stars, twice with other centres. Documents still apart in a bucket are compared with each
other in blocks, on their full sets, so no link is lost to a cap; what comes out of a block is at most one link a document. Sets are recomputed from the text for the documents that share a bucket.

Buckets, hubs and centres that many documents share are spread over tasks. Null text counts as empty. Rows with a null id get a null
component. Ties: the smallest id stands for its group. Repeated rows give repeated results; rows that repeat an id with
other texts share its component. Texts are read whole, however long. Other columns are not read. Empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, fits_broadcast, spread_join, stored, workers
from ._text import LOWER, U, grams, hashes, mix, pieces, row_bounds, words

FULL = U(2**64 - 1)
MOST_IDS = 1_000_000  # ids that are broadcast (8 MB); more are joined by a shuffle
MOST_SHINGLES = 2_000_000  # of the documents of one block, together (16 MB)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows and the bounds of each row's part."""
    n = len(offs) - 1
    data = LOWER[data]
    starts, ends, rows = words(data, offs)
    h = hashes(data, starts, ends)
    at = row_bounds(rows, n)
    g, full = grams(h, k), np.zeros(0, bool)
    if len(g):
        full = rows[: len(g)] == rows[k - 1 :]
    parts, owner = [g[full]], [rows[: len(g)][full]]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    if len(short):  # the whole sequence, with its length
        whole = np.array([reduce(lambda a, i: a + int(h[at[r] + i]) * (2 * i + 3), range(at[r + 1] - at[r]), int(at[r + 1] - at[r])) % 2**64 for r in short], U)
        parts.append(mix(whole))
        owner.append(short)
    g, rows = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    g, rows = g[new], rows[new]
    return g, row_bounds(rows, n)


def superminhash(g: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """An m-slot signature for each row with elements; FULL in rows without any."""
    n = len(at) - 1
    sig = np.full((n, m), FULL, U)
    flat = sig.ravel()
    e, d, perm, first = g, np.repeat(np.arange(n), np.diff(at)), None, None
    for j in range(m):
        if not len(e):
            break
        x = mix(e + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + (((x & U(0xFFFFF)) * U(m - j)) >> U(20)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
                perm[np.arange(len(e)), 0], perm[np.arange(len(e)), first] = first, 0
            i = np.arange(len(e))
            slot = perm[i, k].astype(np.int64)
            perm[i, k] = perm[i, j]
            perm[i, j] = slot
        np.minimum.at(flat, d * m + slot, (U(j) << U(44)) | (x >> U(20)))
        if j in (0, 1, 2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96):
            going = (sig == FULL).any(axis=1)[d]
            if not going.all():
                e, d = e[going], d[going]
                first = first[going]
                perm = None if perm is None else perm[going]
    return sig


def bands_of(sig: np.ndarray, bands: int) -> np.ndarray:
    r = sig.shape[1] // bands
    s = sig[:, : r * bands].reshape(len(sig), bands, r)
    out = np.zeros((len(sig), bands), U)
    for i in range(r):
        out = mix(out + s[:, :, i] * U(2 * i + 3) + U(i + 1))
    return out


def _list(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, text_col, 1 << 20):
            g, at = shingle_sets(data, offs, k)
            n = np.diff(at)
            c = np.concatenate(([U(0)], np.cumsum(mix(g ^ U(0xA5A5A5A5)), dtype=U))), np.concatenate(([U(0)], np.cumsum(mix(g * U(0x9E3779B97F4A7C15)), dtype=U)))
            f = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in c]
            v = bands_of(superminhash(g, at, bands * rows), bands)
            v = v[n > 0]
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0))))
            yield pa.record_batch([b.column(0), pa.array(n.astype(np.int64)), pa.array(f[0]), pa.array(f[1]), _list(v.ravel(), ends)], names=["id", "n", "f1", "f2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, k: int) -> DataFrame:
    """(id, full set) of the documents whose ids are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, text_col, 2 << 20):
            g, at = shingle_sets(data, offs, k)
            yield pa.record_batch([b.column(0), _list(g, at)], names=["id", "s"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).join(F.broadcast(ids) if fits_broadcast(ids, MOST_IDS) else ids, "id", "left_semi").mapInArrow(run, "id long, s array<long>")


def heavy_keys(rows: DataFrame, on: list[str], n: int) -> DataFrame:
    """The keys that more than a ten-thousandth of n rows have, and 1,000 at least: at most 10,000 if there are n rows."""
    return rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > max(1000, n // 10_000)).select(*on)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b). Union-find in rounds: each root hooks on to the smallest neighbouring
    root, then paths are halved, until no root has a smaller neighbour. Rows that meet at a hub are spread. Nodes without an edge take no
    part in the rounds."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    n = both.count()
    hubs = stored(heavy_keys(both, ["b"], n), "hubs")
    now = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "roots")
    while True:
        over = spread_join(both, now.select(F.col("id").alias("b"), F.col("root").alias("rb")), ["b"], hubs, "a").groupBy("a").agg(F.min("rb").alias("rb"))
        hook = stored(now.join(over, now.id == over.a, "left").select("id", "root", F.least("root", F.coalesce("rb", "root")).alias("to")), "hooks")
        if hook.where("to < root").isEmpty():
            out = stored(nodes.join(now, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
            drop_stored(both, hubs, hook, now)
            return out
        parent = hook.groupBy("root").agg(F.min("to").alias("up")).where("up < root").select(F.col("root").alias("to"), "up")
        up = spread_join(hook, parent, ["to"], heavy_keys(hook, ["to"], n), "id", "left")
        old, now = now, stored(up.select("id", F.least("to", F.coalesce("up", "to")).alias("root")), "roots")
        drop_stored(old, hook)


def fewer_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that reach the same as those between each id and its centres (id, o), about one an id where ids share centres: each id goes
    to its smallest centre, and that one to the others. Ids have at most twice as many centres as there are bands."""
    own = rows.groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("c")).withColumn("first", F.element_at("c", 1))
    ends = F.explode(F.concat(F.array("id"), F.slice("c", F.lit(2), F.size("c")))).alias("x")
    return own.select("first", ends).where("first <> x").select(F.least("first", "x").alias("a"), F.greatest("first", "x").alias("b")).distinct()


def unlike_cells(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows of those buckets that hold more than one component."""
    rows = rows.select(*(c for c in rows.columns if c not in ("r0", "r1")))
    mixed = rows.groupBy("band", "cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band", "cell")
    return spread_join(rows, mixed, ["band", "cell"], heavy, "id")


def compare_families(rows: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between components, among documents of one family that share a band. rows: id, n, root, bands, family, s.

    A family is cut into blocks of about `block` documents, fewer if their sets are large, and every two blocks meet in one group,
    whose full sets are compared as rows of bits. Only links that join two components inside the group come out: fewer than it has documents."""
    sizes = rows.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / MOST_SHINGLES)).cast("int").alias("blocks"))
    r = rows.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = r.select("family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "root", "bands", "s")
    key = ["family", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in key], 1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)])) if len(keys) else np.zeros(1, int)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = tuple(keys[i].tolist())
                if now != last and held:
                    yield _links(held, percent)
                    held = []
                last = now
                held.append(b.slice(i, j - i))
        if held:
            yield _links(held, percent)

    return r.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _links(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    ids, comp, own = (t[c].to_numpy().copy() for c in ("id", "root", "own"))
    n = t["s"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    g = t["s"].combine_chunks().flatten().to_numpy()
    bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    _, col, c = np.unique(g, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), n)
    kept = c[col] > 1
    row, col = row[kept], (np.cumsum(c > 1) - 1)[col[kept]]
    bits = np.zeros((len(ids), (int(col.max()) >> 6) + 1 if len(col) else 1), U)
    np.bitwise_or.at(bits, (row, col >> 6), U(1) << (col & 63).astype(U))
    crossed = len(set(own.tolist())) > 1  # two blocks: within a block another group compares
    out: list[tuple[int, int]] = []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        may = (comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
        j = j[may & (own[j] != own[i])] if crossed else j[may]
        j = j[(bands[j] == bands[i]).any(1)] if len(j) else j
        if not len(j):
            continue
        common = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
        for x in j[100 * common >= percent * (n[j] + n[i] - common)].tolist():
            if comp[x] != comp[i]:
                out.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
                comp[comp == comp[x]] = comp[i]
    return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable), kept (is it that one)."""
    spark = docs.sparkSession
    workers(spark)
    sig = stored(signatures(docs, id_col, text_col, k, bands, rows), "signatures")
    node = stored(sig.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.min("bands").alias("bands")), "nodes")
    cells = node.select("id", "n", F.posexplode("bands").alias("band", "cell"))
    end = F.struct("id", "n")
    shared_cells = cells.groupBy("band", "cell").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), F.count("*").alias("rows")).where("lo.id < hi.id")
    shared_cells = stored(shared_cells, "shared")
    heavy = shared_cells.where(F.col("rows") > max(1000, shared_cells.count() // 10_000)).select("band", "cell")
    busy = stored(spread_join(cells, shared_cells.drop("rows"), ["band", "cell"], heavy, "id"), "buckets")

    sets = stored(sets_of(docs, id_col, text_col, busy.select("id").distinct(), k), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs of a document (doc) and a centre, as few edges. A hub's set goes to several tasks, not beside each of its rows in one."""
        pairs = stored(pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").groupBy("a", "b").agg(F.min("doc").alias("doc")), "pairs")
        size = pairs.count()
        one = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), ["a"], heavy_keys(pairs, ["a"], size), "b")
        one = spread_join(one, sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), ["b"], heavy_keys(pairs, ["b"], size), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        out = stored(one.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select(F.col("doc").alias("id"), F.when(F.col("doc") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("o")), "confirmed")
        drop_stored(pairs)
        few = stored(fewer_edges(out), "links")
        drop_stored(out)
        return few

    stars = busy.select("id", "n", F.col("lo").alias("o")).union(busy.select("id", "n", F.col("hi").alias("o"))).where("id <> o.id")
    links = confirmed(stars.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"), F.col("n").alias("na"), F.col("o.n").alias("nb"), F.col("id").alias("doc")))
    held = node.select("id").distinct()
    roots = components(held, links)
    apart = stored(unlike_cells(busy.select("id", "n", "band", "cell").join(roots, "id"), heavy), "apart")
    own = apart.groupBy("id").agg(F.min("root").alias("root")).join(node.select("id", "n", "bands"), "id")
    low = apart.groupBy("band", "cell").agg(F.min("id").alias("low"))
    family = components(own.select("id"), fewer_edges(spread_join(apart, low, ["band", "cell"], heavy, "id").where("id <> low").select("id", F.col("low").alias("o"))))
    more = stored(compare_families(own.join(family.withColumnRenamed("root", "family"), "id").join(sets, "id"), percent), "links")
    drop_stored(sets, apart, busy, family, shared_cells)
    if not more.isEmpty():
        drop_stored(roots)
        roots = components(held, links.union(more))
    drop_stored(links, more)
    by_set = node.select("n", "f1", "f2", "id").join(roots, "id").select("n", "f1", "f2", "root")
    return (
        sig.select("id", "n", "f1", "f2").join(by_set, ["n", "f1", "f2"], "left")
        .select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
