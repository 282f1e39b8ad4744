"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades run from 0 (not toxic) to 3. The labels say toxic or not, so the grades of toxic training documents come from other folds: a model
of toxic or not, fitted without the document's fold, scores it, and thirds of these scores are the grades 1 to 3. One weight vector is
shared by all thresholds: P(grade <= k) = sigmoid(theta_k - w.x), theta ordered. Reported: the expected grade, P(grade >= 1) and the decision.

The decision's cut is part of the model. Ordinal models fitted without each fold score its documents; the cut is the lowest one that
`false_positives` of the documents labelled not toxic exceed at most (half-way to the next toxic document's score above it).

Features: logarithms of counts of hashed words (runs of letters or digits, lower-cased) and of word beginnings of 4 to 8 bytes, those
`n_features` buckets only that a signed chi-square test picks. The fit uses at most `max_train` labelled documents (smallest hashes of
ids; of rows that repeat an id, one); every text is scored whole, however long. Null and empty texts have no features. Rows with null labels or
ids don't train; without labels of both classes every document gets the share of toxic labels, and none is rejected. Ties and repeated
rows get equal scores. Other columns are not read. Empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, stored, workers
from ._text import ALNUM, LOWER, U, hashes, mix, pieces, row_bounds, words
from .quality import bounded_labels

BITS = 18
GRADES = 4
FOLDS = 3
PREFIXES = (4, 5, 6, 7, 8)


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of their beginnings, and the row of each."""
    data = LOWER[data]
    starts, ends, rows = words(data, offs, ALNUM)
    h, r = [hashes(data, starts, ends)], [rows]
    for n in PREFIXES:
        longer = ends - starts > n
        h.append(mix(hashes(data, starts[longer], starts[longer] + n) + U(n)))
        r.append(rows[longer])
    return (np.concatenate(h) >> U(64 - BITS)).astype(np.int64), np.concatenate(r)


def counted(b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count), sorted."""
    key, n = np.unique((rows << BITS) | b, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chosen_buckets(bucket: np.ndarray, in_pos: np.ndarray, in_all: np.ndarray, share: float, n_features: int) -> np.ndarray:
    """The buckets whose documents are toxic most unlike the share of all."""
    expected = in_all * share
    chi = np.where(in_all >= 4, (in_pos - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0)
    best = np.lexsort((bucket, -chi))[:n_features]
    return np.sort(bucket[best[chi[best] > 10.8]])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, top: int, steps: int = 250, rate: float = 0.05, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) for grades 0 to top, by Adam on the penalised likelihood."""
    n, d = x.shape
    w, cut = np.zeros(d), np.zeros(top)  # the first threshold, then logarithms of the gaps
    cut[0] = 2.0
    m, v = np.zeros(d + top), np.zeros(d + top)
    at = np.arange(n)
    for i in range(1, steps + 1):
        theta = cut[0] + np.concatenate(([0], np.cumsum(np.exp(cut[1:]))))
        below = np.concatenate((np.zeros((n, 1)), sigmoid(theta - (x @ w.astype(np.float32))[:, None]), np.ones((n, 1))), 1)
        p = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
        slope = below * (1 - below)
        up, low = slope[at, grade + 1] / p, slope[at, grade] / p
        d_eta = (up - low) / n  # of minus the log likelihood
        d_theta = np.array([(-(up * (grade == k)) + low * (grade == k + 1)).sum() for k in range(top)]) / n
        tail = np.cumsum(d_theta[::-1])[::-1]  # a gap moves all thresholds from its own on
        q = np.concatenate((x.T @ d_eta.astype(np.float32) + ridge * w, tail[:1], tail[1:] * np.exp(cut[1:])))
        m, v = 0.9 * m + 0.1 * q, 0.999 * v + 0.001 * q * q
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, cut = w - step[:d], cut - step[d:]
    return w, cut[0] + np.concatenate(([0], np.cumsum(np.exp(cut[1:]))))


class OrdinalModel:
    """Chosen buckets, their shared weights, the ordered thresholds, and the cut of the decision."""

    def __init__(self) -> None:
        self.place, self.w, self.theta, self.base, self.cut = np.full(1 << BITS, -1, np.int32), np.zeros(0), np.zeros(GRADES - 1), 0.0, 1.0

    def fit(self, rows: np.ndarray, bucket: np.ndarray, count: np.ndarray, toxic: np.ndarray, fold: np.ndarray, chosen: list[np.ndarray], false_positives: float = 0.005) -> OrdinalModel:
        """rows, bucket, count: the documents' features. chosen: buckets for each fold (picked without it), and at last for the whole."""
        n, pos = len(toxic), toxic.astype(bool)
        self.base = float(pos.mean()) if n else 0.0
        if not n or pos.all() or not pos.any():
            return self

        def matrix(keep: np.ndarray) -> np.ndarray:
            place = np.full(1 << BITS, -1, np.int32)
            place[keep] = np.arange(len(keep))
            at = place[bucket]
            x = np.zeros((n, len(keep)), np.float32)
            x[rows[at >= 0], at[at >= 0]] = np.log1p(count[at >= 0])
            return x

        out_of_fold = np.zeros(n)
        grade, p = pos.astype(np.int64), np.full(n, self.base)
        for f in range(FOLDS):
            own = fold == f
            if own.any() and len(set(toxic[~own].tolist())) == 2:
                x = matrix(chosen[f])
                w, _ = fit_ordinal(x[~own], grade[~own], 1)
                out_of_fold[own] = x[own] @ w
        thirds = np.quantile(out_of_fold[pos], (1 / 3, 2 / 3))
        grade = np.where(pos, 1 + (out_of_fold > thirds[0]) + (out_of_fold > thirds[1]), 0)
        for f in range(FOLDS):
            own = fold == f
            if own.any() and len(set(toxic[~own].tolist())) == 2:
                x = matrix(chosen[f])
                w, theta = fit_ordinal(x[~own], grade[~own], GRADES - 1)
                p[own] = 1 - sigmoid(theta[0] - x[own] @ w)
        clean = np.sort(p[~pos])[::-1]
        self.cut = float(clean[min(int(false_positives * len(clean)), len(clean) - 1)])
        above = p[pos & (p > self.cut)]
        if len(above):
            self.cut = float((self.cut + above.min()) / 2)
        self.place[chosen[FOLDS]] = np.arange(len(chosen[FOLDS]))
        self.w, self.theta = fit_ordinal(matrix(chosen[FOLDS]), grade, GRADES - 1)
        return self

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= 1))"""
        n = len(offs) - 1
        if not len(self.w):
            return np.full(n, self.base), np.full(n, self.base)
        b, rows = buckets(data, offs)
        keep = self.place[b] >= 0
        rows, b, c = counted(b[keep], rows[keep])
        eta = np.bincount(rows, self.w[self.place[b]] * np.log1p(c), n)
        above = 1 - sigmoid(self.theta[None, :] - eta[:, None])
        return above.sum(1), above[:, 0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 6000, n_features: int = 1024, false_positives: float = 0.005) -> OrdinalModel:
    """Two passes over the labelled documents' features: counts by bucket, then the chosen buckets of each document. The driver gets at
    most 2^18 rows of counts, and max_train rows of at most (FOLDS + 1) * n_features buckets."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, "text", 1 << 20):
            rows, bucket, count = counted(*buckets(data, offs))
            at = row_bounds(rows, b.num_rows)
            both = np.stack((bucket, count), 1).astype(np.int32)
            yield pa.record_batch([b.column("id"), b.column("label"), pa.array([both[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "label", "x"])

    some = F.broadcast(bounded_labels(labels, id_col, label_col, max_train))
    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(some, "id").select("id", "label", "text").mapInArrow(run, "id long, label int, x binary")
    table = stored(got.groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), "m.label", "m.x"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS, 2 * FOLDS), np.int32)
        for b in batches:
            for fold, label, x in zip(b["fold"].to_pylist(), b["label"].to_pylist(), b["x"].to_pylist(), strict=True):
                total[np.frombuffer(x, np.int32)[::2], 2 * fold + (label > 0)] += 1
        at = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array(at.astype(np.int32)), *(pa.array(total[at, i]) for i in range(2 * FOLDS))], names=["bucket", *names])

    names = [f"n{i}" for i in range(2 * FOLDS)]
    sums = table.select("fold", "label", "x").mapInArrow(count, "bucket int, " + ", ".join(f"{c} int" for c in names)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
    sums = sums.where(sum((F.col(c) for c in names), F.lit(0)) >= 4).toArrow()
    n = np.stack([sums[c].to_numpy() for c in names], 1).astype(float).reshape(-1, FOLDS, 2)
    sizes = {(r["fold"], r["label"]): r["n"] for r in table.groupBy("fold", (F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    size = np.array([[sizes.get((f, k), 0) for k in (0, 1)] for f in range(FOLDS)], float)
    if not size.sum():
        drop_stored(table)
        return OrdinalModel()
    chosen = []
    for f in range(FOLDS + 1):
        inside = [i for i in range(FOLDS) if i != f]
        total, s = n[:, inside].sum(1), size[inside].sum(0)
        chosen.append(chosen_buckets(sums["bucket"].to_numpy(), total[:, 1], total.sum(1), s[1] / max(s.sum(), 1), n_features))
    wanted = np.zeros(1 << BITS, bool)
    wanted[np.concatenate(chosen)] = True

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in b["x"].to_pylist()]
            yield pa.record_batch([b["id"], b["fold"], b["label"], pa.array([t[wanted[t[:, 0]]].tobytes() for t in x], pa.binary())], names=["id", "fold", "label", "x"])

    got = table.mapInArrow(keep, "id long, fold int, label int, x binary").toArrow().sort_by("id")
    drop_stored(table)
    xs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in got["x"].to_pylist()]
    rows = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    x = np.concatenate(xs).astype(np.int64)
    return OrdinalModel().fit(rows, x[:, 0], x[:, 1], (got["label"].to_numpy() > 0).astype(int), got["fold"].to_numpy(), chosen, false_positives)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float | None = None) -> DataFrame:
    """docs with expected_severity, p_toxic and toxic (p_toxic > cut, by default the model's own) added after its id; other columns don't come along."""
    spark = docs.sparkSession
    workers(spark)
    held, cut = spark.sparkContext.broadcast(model), model.cut if cut is None else cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, text_col, 1 << 20):
            severity, p = held.value.predict(data, offs)
            yield pa.record_batch([b.column(0), pa.array(severity), pa.array(p), pa.array(p > cut)], names=[id_col, "expected_severity", "p_toxic", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, expected_severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float | None = None) -> DataFrame:
    """docs without the rows that the model rejects (see score_toxicity), all columns as they were; rows with null or empty texts stay. No
    join: rows pass through the scorer."""
    spark = docs.sparkSession
    workers(spark)
    held, cut = spark.sparkContext.broadcast(model), model.cut if cut is None else cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, text_col, 1 << 20):
            yield b.filter(pa.array(held.value.predict(data, offs)[1] <= cut))

    return docs.mapInArrow(run, docs.schema)
