"""Quality rules: counts of the whole text, and a hashed n-gram logistic model of the labelled quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, documents, window_hashes, word_hashes, word_spans
from .learning import Sparse, byte_grams, chunks, fit_dense, fit_logistic, sample, sigmoid, word_grams

BITS = 15
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FAMILIES = 4


class Text:
    """Bytes, words and word hashes of one text, shared by counts and features."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode()
        self.values, self.starts, self.ends = word_spans(self.data)
        self.words = word_hashes(self.values, self.starts, self.ends)


def counts(t: Text, window: int = 8) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    n = len(t.words)
    first_bytes = np.concatenate(([0], np.cumsum((t.values & 0xC0) != 0x80)))
    chars = int((first_bytes[t.ends] - first_bytes[t.starts]).sum())
    lines = [x for x in t.data.split(b"\n") if x.strip()]
    found = window_hashes(t.words, window)
    repeats = 0
    if len(found):
        _, back, times = np.unique(found, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        repeats = int(covered(again, window, n).sum()) if len(again) else 0
    return n, chars, int(_SYMBOL[t.values].sum()), len(lines) - len(set(lines)), repeats


def features(t: Text):
    """Family by family, in parts of bounded size: its number, and buckets of words, word pairs, and runs of 3 and 4 bytes,
    each family in a range of its own."""
    for family, (grams, values, n) in enumerate(((word_grams, t.words, 1), (word_grams, t.words, 2), (byte_grams, t.values, 3), (byte_grams, t.values, 4))):
        for a, b in chunks(len(values), n - 1):
            yield family, grams(values[a:b], n, BITS) + (family << BITS)


def shares(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text, and the share of each in its family."""
    n = np.zeros(FAMILIES << BITS)
    for _, index in features(t):
        n += np.bincount(index, minlength=len(n))
    n = n.reshape(FAMILIES, -1)
    n = (n / np.maximum(1, n.sum(1, keepdims=True))).ravel()
    index = np.flatnonzero(n)
    return index, n[index]


class Model:
    """Means of bucket weights over each family, put on a scale of probability by held-back texts."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def probability(self, t: Text) -> float:
        total, n = np.zeros(FAMILIES), np.zeros(FAMILIES)
        for family, index in features(t):
            total[family] += self.weights[index].sum(dtype=np.float64)
            n[family] += len(index)
        z = self.bias + float((total / np.maximum(1, n)).sum())
        return float(sigmoid(np.array(self.scale * z + self.shift)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, prior: float | None = None) -> Model | None:
    """Learns ``quality`` from at most ``per_class`` labelled documents of each class; None without both classes.

    Features are counted on the executors; the driver gets hashed counts of that bounded sample. A fifth is held back
    for calibration to the share of good documents among the labels (or ``prior``).
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    rows = sample(documents(docs), labels, "quality", per_class)
    if prior is None:
        prior = labels.agg(F.avg("quality")).first()[0]

    def per_batch(batches):
        for b in batches:
            out = [], []
            for text in b.column(0).to_pylist():
                index, share = shares(Text(text))
                out[0].append(index.astype(np.int32))
                out[1].append(share.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.float32())), b.column(1), b.column(2)], ["i", "v", "y", "h"])

    found = rows.select("text", "quality", F.xxhash64("doc_id").alias("h")).mapInArrow(per_batch, "i array<int>, v array<float>, y int, h long")
    table = found.toArrow().sort_by("h")
    y = np.asarray(table["y"]).astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = [(np.asarray(i.values), np.asarray(v.values, dtype=np.float64)) for i, v in zip(table["i"], table["v"], strict=True)]
    held = np.arange(len(y)) % 5 == 4
    part = lambda keep: Sparse([r for r, k in zip(x, keep, strict=True) if k])
    weights, bias = fit_logistic(part(~held), y[~held], FAMILIES << BITS)
    scale, shift = fit_dense((part(held).dot(weights) + bias)[:, None], y[held], prior=prior) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    return Model(weights.astype(np.float32), bias, float(max(scale, 1e-3)), float(shift))


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, threshold: float = 0.5, per_class: int = 1000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality``.

    A text fails the base rules with fewer than ``min_words`` words, or with more than ``max_repeat_percent`` of its words
    in windows of eight that occur twice or more in it. The others are kept if the calibrated probability of good quality
    reaches ``threshold``. Both look at the whole text, in Arrow batches. Null and empty texts have no words and fail.
    Labels without a document, null labels and other values are ignored; without labels of both classes only the base
    rules judge, and ``quality`` is null. Repeated rows get the same result; an empty table gives an empty one.
    """
    model = fit(docs, labels, per_class)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]

    def per_batch(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                t = Text(text)
                n = counts(t)
                failed = n[0] < min_words or 100 * n[4] > max_repeat_percent * n[0]
                p = model.probability(t) if model else None
                rows.append((*n, failed, not failed and (p is None or p >= threshold), p))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return documents(docs).mapInArrow(per_batch, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double")
