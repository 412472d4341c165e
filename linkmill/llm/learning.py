"""What the trained operators share: bounded samples, hashed n-grams, logistic fits and calibration, all in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_classes: int = 500) -> DataFrame:
    """``doc_id, text`` and ``label`` of at most ``per_class`` documents of each class: those with the smallest id hashes.

    Of more than ``most_classes`` classes those with the most ids are learned (ties by name), so a column of junk labels doesn't grow the sample.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``label``. An id counts once, with its largest label and, of
    several texts, that with the smallest hash. Ids and labels that are null, and ids without a document, are left out
    before ranking. So the bound holds whatever repeats, and every class with documents is filled.

    Only ids and labels are ranked, and a rank limit is applied before the shuffle, so a class with most of the rows
    sends ``per_class`` rows a partition. Of an id with very many rows each partition sends one text.
    """
    ids = labels.select("doc_id", label).na.drop().groupBy("doc_id").agg(F.max(label).alias(label))
    ids = ids.join(docs.filter("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    classes = ids.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_classes).select(label)
    ids = ids.join(F.broadcast(classes), label, "left_semi")  # most_classes rows at most
    order = W.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_class).drop("nth")
    found = docs.filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id")  # per_class rows of each of most_classes at most
    return found.groupBy("doc_id", label).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


#: Bytes of a text whose n-grams are held at once.
CHUNK = 1 << 20


def chunks(n: int, overlap: int = 0):
    """``begin, end`` of parts of ``n`` places, each with the next ``overlap`` places, so that no run over a cut is lost or counted twice."""
    for at in range(0, max(1, n - overlap), CHUNK):
        yield at, min(n, at + CHUNK + overlap)


def byte_grams(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed buckets of all runs of ``n`` bytes."""
    if len(values) < n:
        return np.zeros(0, dtype=np.int64)
    v = values.astype(np.uint32)
    h = v[: len(v) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint32(0x01000193) + v[k : len(v) - n + 1 + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) >> np.uint32(0) & np.uint32((1 << bits) - 1)).astype(np.int64)


def word_grams(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed buckets of all runs of ``n`` word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.int64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(3)) + words[k : len(words) - n + 1 + k]
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Rows of (columns, values), kept flat."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(c) for c, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
        self.column = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.n)

    def transposed_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], minlength=size)


def fit_logistic(x: Sparse, y: np.ndarray, size: int, rounds: int = 200, l2: float = 1e-6, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; classes weigh the same."""
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for t in range(1, rounds + 1):
        g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight
        grad = np.append(x.transposed_dot(g, size) + l2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50, prior: float | None = None) -> np.ndarray:
    """Weights (the last one is the bias) of a small logistic model by Newton steps; ``prior`` is the share of ones to assume."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    share = np.ones(len(y))
    if prior is not None and 0 < y.mean() < 1:
        share = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    penalty = np.full(x.shape[1], l2 * len(y) + 1e-9)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (share * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
