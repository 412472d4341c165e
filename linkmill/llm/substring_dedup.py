"""Substring dedup: words covered by a passage that starts earlier in the corpus are removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import covered, documents, mix, window_hashes, word_hashes, word_spans

#: A perfect difference cover: every difference modulo the period is one of two members of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
_LEAST = -(1 << 63)


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = (text or "").encode()
    values, starts, ends = word_spans(data)
    return data, starts, ends, word_hashes(values, starts, ends)


def _anchor_positions(n_anchors: int) -> np.ndarray:
    at = np.arange(n_anchors)
    return at[np.isin(at % PERIOD, COVER)]


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _join(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def _anchors(size: int):
    """Anchor rows ``h, key, at``: ``at`` is four times the position plus 1 for an anchor alone in its batch, 2 for the first
    row of one that repeats in it (which also tells the other batches), 3 for its other rows, which need no meeting."""
    length = size - PERIOD + 1

    def per_batch(batches):
        for b in batches:
            hashes, docs, places = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = window_hashes(_words(text)[3], length)
                at = _anchor_positions(len(found))
                hashes.append(found[at])
                docs.append(np.full(len(at), i))
                places.append(at)
            h, doc, pos = _join(hashes, np.uint64), _join(docs, np.int64), _join(places, np.int64)
            _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            sure = (n > 1)[back]
            alone = np.zeros(len(h), dtype=bool)
            alone[first] = True
            known = sure & ~alone
            h = np.where(known, mix(np.arange(len(h), dtype=np.uint64) + np.uint64(len(h))), h)  # any key does for known ones
            at = 4 * pos + np.where(known, 3, np.where(sure, 2, 1))
            yield _batch(["h", "key", "at"], [h.view(np.int64), np.asarray(b.column(0))[doc], at.astype(np.int32)])

    return per_batch


def _windows(size: int):
    """Candidate windows ``h1, h2, key, row, pos, kind``: kind 1 is first in its batch, kind 2 known to start earlier."""
    length = size - PERIOD + 1

    def per_batch(batches):
        for b in batches:
            out = {"h1": [], "h2": [], "doc": [], "pos": []}
            key, row = np.asarray(b.column(0)), np.asarray(b.column(1))
            texts, anchors = b.column(2).to_pylist(), b.column(3).to_pylist()
            last = None
            for i in np.lexsort((row, key)):
                if (key[i], row[i]) == last:  # a repeated row
                    continue
                last = key[i], row[i]
                words = _words(texts[i])[3]
                n = len(words) - size + 1
                if n <= 0:
                    continue
                at = np.asarray(anchors[i], dtype=np.int64)
                at = at[at < len(words)]  # of other rows with this id
                # an anchor at p lies at the start of the window p and up to size - length places further in others
                first = np.maximum(at - (size - length), 0)
                near = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(near, first, 1)
                np.add.at(near, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(near)[:n] > 0)
                h1, h2 = window_hashes(words, size)[starts], window_hashes(mix(words ^ np.uint64(0xA5A5A5A5DEADBEEF)), size)[starts]
                out["h1"].append(h1), out["h2"].append(h2), out["pos"].append(starts)
                out["doc"].append(np.full(len(starts), i))
            h1, h2 = _join(out["h1"], np.uint64), _join(out["h2"], np.uint64)
            doc, pos = _join(out["doc"], np.int64), _join(out["pos"], np.int64)
            both = mix(h1) ^ h2
            order = np.argsort(both, kind="stable")  # stable: rows stand in the order (key, row, pos)
            s1, s2 = h1[order], h2[order]
            again = np.zeros(len(h1), dtype=bool)
            again[order[1:]] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
            # repeats inside the batch leave as runs of starts, dealt out by any key
            starts_run = again & ~np.concatenate(([False], again[:-1] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1)))
            begin = np.flatnonzero(starts_run)
            ordinal = np.cumsum(starts_run) - 1
            run = np.bincount(ordinal[again], minlength=len(begin)) if len(begin) else np.zeros(0, dtype=np.int64)
            single = np.flatnonzero(~again)
            at = np.concatenate((single, begin))
            many = np.concatenate((np.zeros(len(single), dtype=np.int64), run))
            yield _batch(["h1", "h2", "key", "row", "pos", "run"], [h1[at].view(np.int64), np.where(many > 0, mix(at.astype(np.uint64)), h2[at]).view(np.int64), key[doc[at]], row[doc[at]], pos[at].astype(np.int32), many.astype(np.int32)])

    return per_batch


def _kept(size: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def per_batch(batches):
        for b in batches:
            total, gone, texts = [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                total.append(len(words))
                lost = np.zeros(len(words), dtype=bool)
                if runs and len(words) >= size:
                    runs = np.asarray(runs, dtype=np.int64)
                    pos, run = runs >> 32, runs & 0xFFFFFFFF
                    if not run.all():  # a copy: all of it repeats
                        pos, run = np.zeros(1, dtype=np.int64), np.full(1, len(words) - size + 1)
                    starts = np.repeat(pos - np.cumsum(run) + run, run) + np.arange(run.sum())
                    lost = covered(starts, size, len(words))
                gone.append(int(lost.sum()))
                texts.append(b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x]))
            hashes = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            columns = [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), hashes]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([t.decode() for t in texts], pa.string())] * with_text, names)

    return per_batch


def substring_dedup(docs: DataFrame, size: int = 20, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and, unless turned off, ``kept_text``.

    A word goes if a window of ``size`` words that covers it has the same words as a window that starts earlier (smaller
    ``doc_id``, or earlier in the same document). Windows are judged on the input.

    1. Texts that are exact copies of a text with a smaller id are settled by the text's hash: all their windows repeat.
    2. Of the others only anchors are hashed: windows of ``size - 12`` words at the places of a difference cover modulo
       13. Two equal windows always have an aligned place in the cover, so they share an anchor there; and where no
       anchor of a window repeats, the window does not.
    3. Each repeated anchor is extended to the full windows around it, keyed by 128 bits of hash, and all but the first
       of each key are covered.

    Batches settle what repeats inside them before anything is shuffled, so a passage in a third of all rows sends one row
    a batch and no pair is ever formed. The text crosses the network once, by document; that exchange is used again.

    Null texts have no words. A null ``doc_id`` comes before all others. Rows with the same id and different texts are told
    apart by the text's hash (its order stands for the id's); repeated rows are one document. Texts shorter than
    ``size`` words keep everything. An empty table gives an empty result.
    """
    if size < PERIOD + 1:
        raise ValueError(f"windows need more than {PERIOD} words")
    rows = documents(docs).select(F.coalesce("doc_id", F.lit(_LEAST)).alias("key"), F.xxhash64("text").alias("row"), "text")
    texts = rows.select(F.unhex(F.md5("text")).alias("digest"), "key", "row")
    owner = texts.groupBy("digest").agg(F.min("key").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    copies = texts.join(owner, "digest").filter("key <> owner").select(F.col("key").alias("k"), F.col("row").alias("r")).distinct()

    def beside(small: DataFrame) -> DataFrame:
        return rows.join(small, F.col("key") == F.col("k"), "left")

    # ids are joined alone, as the same exchange of texts serves all three joins; rows of one id are told apart after them
    gone = copies.groupBy("k").agg(F.collect_set("r").alias("gone"))
    once = beside(gone).filter(~F.coalesce(F.array_contains("gone", F.col("row")), F.lit(False))).select("key", "text")
    anchors = once.mapInArrow(_anchors(size), "h long, key long, at int")
    repeated = anchors.withColumn("seen", F.sum(F.least(F.col("at") % 4, F.lit(2))).over(W.partitionBy("h"))).filter("seen > 1")
    repeated = repeated.groupBy(F.col("key").alias("k")).agg(F.collect_list((F.col("at") / 4).cast("int")).alias("anchors")).join(gone, "k", "left")
    found = beside(repeated).filter(F.col("anchors").isNotNull() & ~F.coalesce(F.array_contains("gone", F.col("row")), F.lit(False)))
    windows = found.select("key", "row", "text", "anchors").mapInArrow(
        _windows(size), "h1 long, h2 long, key long, row long, pos int, run int")
    order = W.partitionBy("h1", "h2").orderBy("key", "row", "pos")
    late = windows.withColumn("nth", F.rank().over(order)).filter("run > 0 OR nth > 1")  # repeated rows tie
    packed = lambda pos, run: F.shiftleft(pos.cast("long"), 32).bitwiseOR(run.cast("long")).alias("at")
    late = late.select(F.col("key").alias("k"), F.col("row").alias("r"), packed(F.col("pos"), F.greatest("run", F.lit(1))))
    late = late.unionByName(copies.select("k", "r", packed(F.lit(0), F.lit(0)))).groupBy("k").agg(F.collect_list(F.struct("r", "at")).alias("late"))
    late = beside(late).withColumn("at", F.transform(F.filter("late", lambda x: x["r"] == F.col("row")), lambda x: x["at"]))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return late.select(F.when(F.col("key") != _LEAST, F.col("key")).alias("doc_id"), "text", "at").mapInArrow(_kept(size, with_text), schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", "kept_sha256")
