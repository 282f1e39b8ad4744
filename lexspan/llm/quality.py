"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `passage` words. Each passage becomes a vector of surface measures, an encoder layer maps it, gated
attention weighs the passages (weights learned from document labels alone), and a logistic unit scores the weighted sum.

The fit uses at most `max_train` labelled documents, those with the smallest hashes of their ids (bound is a documented parameter); all
texts are scored whole, however long. Null and empty texts are one passage of zeros. Rows with null labels or ids don't train; of rows that
repeat an id, one does. Repeated rows and ties get equal scores. With no usable labels, or labels of one class only, the score is the share of
label 1 (0.5 without labels). Empty tables give empty results. Other columns are not read, and may clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import workers
from ._text import hashes, pieces, row_bounds, words

# fixed values: the byte classes that passages are measured by
CLASSES = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "wide": range(0x80, 0x100), "stop": b".", "comma": b",", "bang": b"!", "mark": b"?;:", "bar": b"|", "symbol": b"#$%&*", "bracket": b"()[]{}<>", "quote": b"\"'`", "other": b"+-/=@\\^_~", "line": b"\n"}
N_FEATURES = len(CLASSES) + 8


def _shape_masks() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for i, v in enumerate(CLASSES.values()):
        t[list(v)] = i + 1
    return t


TABLE = _shape_masks()


def passage_features(data: np.ndarray, offs: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each row); rows without words have one passage of zeros."""
    n = len(offs) - 1
    starts, ends, rows = words(data, offs)
    at = row_bounds(rows, n)
    per_row = np.maximum(1, -(-np.diff(at) // passage))
    first_out = np.concatenate(([0], np.cumsum(per_row)))
    out = np.zeros((first_out[-1], N_FEATURES), np.float32)
    if not len(starts):
        return out, per_row
    inside = np.arange(len(starts)) - at[rows]
    head = np.flatnonzero(inside % passage == 0)
    tail = np.concatenate((head[1:], [len(starts)])) - 1
    where = first_out[rows[head]] + inside[head] // passage
    kind = TABLE[data]
    size = (ends[tail] - starts[head]).astype(np.float32)
    n_words = (tail - head + 1).astype(np.float32)
    for i in range(len(CLASSES)):
        c = np.concatenate(([0], np.cumsum(kind == i + 1, dtype=np.int32)))
        out[where, i] = (c[ends[tail]] - c[starts[head]]) / size
    h = hashes(data, starts, ends)
    again = np.zeros(len(h), bool)
    adjacent = np.zeros(len(h), bool)
    for lag in (1, 2, 3, 4, 6, 8):
        same = (h[lag:] == h[:-lag]) & (rows[lag:] == rows[:-lag])
        again[lag:] |= same
        if lag == 1:
            adjacent[1:] = same
    last = kind[ends - 1]
    long_ = ends - starts
    measures = [adjacent, again, kind[starts] == 1, (kind[starts] == 1) & ((kind[np.maximum(starts, ends - 3)] == 1) & (long_ > 3)), last > 4, long_ == 1, long_ / np.float32(10), long_ > 24]
    for i, x in enumerate(measures):
        out[where, len(CLASSES) + i] = np.add.reduceat(x.astype(np.float32), head) / n_words
    return out, per_row


def by_rows(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w without a library's product, whose rounding depends on how many rows there are: equal rows get equal results, whatever stands beside them."""
    out = np.zeros((len(x), *w.shape[1:]), np.float32)
    for j, row in enumerate(w):
        out += np.multiply.outer(x[:, j], row)
    return out


class AttentionMIL:
    """Encoder, gated attention and logistic output over bags of passages."""

    NAMES = ("W", "b", "V", "U", "w", "c", "c0")

    def __init__(self, d: int = 24, a: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.base = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), 0.5
        self.p = {"W": r.normal(0, N_FEATURES**-0.5, (N_FEATURES, d)), "b": np.zeros(d), "V": r.normal(0, d**-0.5, (d, a)), "U": r.normal(0, d**-0.5, (d, a)), "w": r.normal(0, a**-0.5, a), "c": r.normal(0, d**-0.5, d), "c0": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.fitted = False

    def forward(self, x: np.ndarray, counts: np.ndarray, product=np.matmul) -> tuple:
        p, heads, bag = self.p, np.concatenate(([0], np.cumsum(counts)[:-1])), np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(product(x, p["W"]) + p["b"])
        t, g = np.tanh(product(h, p["V"])), 1 / (1 + np.exp(-product(h, p["U"])))
        s = product(t * g, p["w"])
        e = np.exp(s - np.maximum.reduceat(s, heads)[bag])
        alpha = e / np.add.reduceat(e, heads)[bag]
        z = np.add.reduceat(alpha[:, None] * h, heads)
        y = 1 / (1 + np.exp(-np.clip(product(z, p["c"]) + p["c0"], -30, 30)))
        return y, z, alpha, h, t, g, heads, bag

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> AttentionMIL:
        if len(labels):
            self.base = float(labels.mean())
        if len(set(labels.tolist())) < 2:
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + np.float32(1e-3)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            p = self.p
            y, z, alpha, h, t, g, heads, bag = self.forward(x, counts)
            dy = ((y - labels) / len(labels)).astype(np.float32)
            dz = dy[:, None] * p["c"]
            da = (h * dz[bag]).sum(1)
            ds = alpha * (da - np.add.reduceat(alpha * da, heads)[bag])
            dgate = ds[:, None] * p["w"]
            dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
            dh = (alpha[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grads = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dy, "c0": dy.sum(keepdims=True)}
            for k in self.NAMES:
                q = grads[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
        self.fitted = True
        return self

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(counts), self.base)
        return self.forward(np.clip((x - self.mean) / self.scale, -8, 8), counts, by_rows)[0].astype(np.float64)


def bounded_labels(labels: DataFrame, id_col: str, label_col: str, most: int, where: Column | None = None) -> DataFrame:
    """At most `most` labelled ids, by the hash of the id: (id, label). Small enough to broadcast by its bound."""
    got = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    return (got if where is None else got.where(where)).orderBy(F.xxhash64("id"), "id", "label").limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_where: Column | None = None, max_train: int = 4000, passage: int = 48) -> AttentionMIL:
    """Fits on at most max_train labelled documents; train_where is a condition on the column `id`."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, "text", 1 << 20):
            x, counts = passage_features(data, offs, passage)
            ends = np.concatenate(([0], np.cumsum(counts)))
            yield pa.record_batch([b.column("id"), b.column("label"), pa.array(counts), pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["id", "label", "n", "x"])

    some = F.broadcast(bounded_labels(labels, id_col, label_col, max_train, train_where))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(some, "id").select("id", "label", "text").mapInArrow(run, "id long, label int, n long, x binary")
    one = rows.groupBy("id").agg(F.min(F.struct("label", "n", "x")).alias("m")).select("id", "m.label", "m.n", "m.x")
    got = one.toArrow().sort_by("id")
    if not got.num_rows:
        return AttentionMIL()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    return AttentionMIL().fit(x, got["n"].to_numpy(), got["label"].to_numpy().astype(np.float32))


def score_quality(docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text", passage: int = 48, cut: float = 0.7) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= cut, else 0), n_passages."""
    spark = docs.sparkSession
    workers(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches, text_col, 1 << 20):
            x, counts = passage_features(data, offs, passage)
            s = held.value.score(x, counts)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(counts)], names=[id_col, "score", "predicted", "n_passages"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, n_passages long")
