"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, word_hashes, word_spans
from .learning import byte_grams, chunks, sample, word_grams

BITS, WIDTH = 15, 16
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]+")


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of runs of 2 to 4 bytes of the whole lower-cased text, and the share of each; white space counts as one space.

    Long texts are counted in parts that overlap, with the same result.
    """
    data = b" " + _WHITE.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip(b" ") + b" "
    values, starts, ends = word_spans(data)
    n = np.zeros(1 << BITS, dtype=np.int64)
    for a, b in chunks(len(starts)):
        n += np.bincount(word_grams(word_hashes(values[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]), 1, BITS), minlength=len(n)) if b > a else 0
    for size in (2, 3, 4):
        for a, b in chunks(len(values), size - 1):
            n += np.bincount(byte_grams(values[a:b], size, BITS), minlength=len(n))
    index = np.flatnonzero(n)
    return index, (n[index] / max(1, n.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = 8, rate: float = 0.4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-by-language scores (embeddings times output weights), and biases, from (buckets, shares, language)."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, n_langs), dtype=np.float32), np.zeros(n_langs, dtype=np.float32)
    total, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, share, y = rows[k]
            step = rate * (1 - done / total)
            done += 1
            mean = share @ table[index]
            score = mean @ out + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            table[index] -= step * len(index) ** 0.5 * share[:, None] * back
    return table @ out, bias


class Model:
    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.5):
        self.langs, self.scores, self.bias, self.temperature, self.reject = langs, scores, bias, temperature, reject

    def logits(self, index: np.ndarray, share: np.ndarray) -> np.ndarray:
        return share @ self.scores[index] + self.bias

    def probabilities(self, text: str) -> np.ndarray:
        z = self.logits(*shares(text)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0, False
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.reject)


def _calibrate(model: Model, held: list[tuple[np.ndarray, np.ndarray, int]], max_error: float) -> None:
    """Sets the temperature that makes held-back texts likeliest, then the lowest rejection threshold with at most that error."""
    if not held:
        return
    z, y = np.array([model.logits(i, s) for i, s, _ in held]), np.array([k for *_, k in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.1, 10, 41)), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    p /= p.sum(1, keepdims=True)
    sure, right = p.max(1), p.argmax(1) == y
    for threshold in np.linspace(1 / p.shape[1], 0.99, 50):
        taken = sure >= threshold
        if not taken.any() or (~right[taken]).mean() <= max_error:
            model.reject = float(threshold)
            return


def fit(docs: DataFrame, per_lang: int = 400, max_error: float = 0.01) -> Model:
    """Learns from at most ``per_lang`` documents of each non-null ``lang``; an id counts once (:func:`.learning.sample`).

    The driver gets their hashed counts, not their texts. Each whole text is an example, and so are some short runs of its
    words, as short texts occur too. A tenth of the texts is held back for the temperature and the rejection threshold.
    """

    def per_batch(batches):
        for b in batches:
            rows = []
            for lang, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.split()
                runs = [" ".join(words[at : at + n]) for at, n in ((0, 3), (len(words) // 3, 6), (len(words) // 2, 2), (2 * len(words) // 3, 12))]
                rows += [(lang, h, k, *shares(t)) for k, t in enumerate((text, *runs)) if any(map(str.isalpha, t))]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "h", "k", "i", "s"])

    rows = sample(docs.select("doc_id", "text"), docs, "lang", per_lang)
    found = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(per_batch, "lang string, h long, k int, i array<int>, s array<float>")
    table = found.toArrow().sort_by([("h", "ascending"), ("k", "ascending")])
    names, hashes = table["lang"].to_pylist(), table["h"].to_pylist()
    langs = sorted(set(names))
    rows = [(np.asarray(i.values), np.asarray(s.values), langs.index(x)) for i, s, x in zip(table["i"], table["s"], names, strict=True)]
    held = [h % 10 == 9 for h in hashes]
    model = Model(langs, *train([r for r, x in zip(rows, held, strict=True) if not x], len(langs))) if langs else Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    _calibrate(model, [r for r, x in zip(rows, held, strict=True) if x], max_error)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns of ``keep`` (``doc_id`` unless given), ``lang_pred``, ``score`` and ``sure`` (not rejected)."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("sure", "boolean")

    def per_batch(batches):
        for b in batches:
            found = [model.predict(t) for t in b.column(len(keep)).to_pylist()]
            lang, score, sure = zip(*found, strict=True) if found else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + new, schema.names)

    return rows.mapInArrow(per_batch, schema)


def language_id(docs: DataFrame, per_lang: int = 400) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, lang_pred, score, sure``.

    Learns from documents whose crc32 of the id as text leaves 0 or 2 by 3, predicts for all from their whole texts.
    Of equally likely languages the first by name counts. ``und`` with score 0 if the text is null, has no letter, or nothing could be learned; otherwise always a learned
    language, and ``sure`` is false where the calibrated probability stays under the rejection threshold. Null ``lang`` is
    never learned. Repeated rows get the same result; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", in_fold(3, 1))
    model = fit(rows.filter(~F.col("held_out")), per_lang)
    return predict(rows, model, ["doc_id", "held_out"])
