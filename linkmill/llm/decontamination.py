"""Benchmark decontamination: passages of documents within a few edits of a benchmark item."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, documents

#: Code points of item text handled in one pass over the documents; larger benchmarks take several passes.
BLOCK = 4_000_000
_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, with every run of characters other than letters and digits as one space, and one at both ends."""
    return f" {_NOT_WORD.sub(' ', (text or '').lower()).strip()} "


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def split(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """Finds items in a text with at most ``errors`` insertions, deletions and replacements each."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, pieces = [], {}
        for item_id, text in items:
            errors = budget(len(text), rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            k = len(self.items)
            self.items.append((item_id, text, errors, masks))
            for at, piece in split(text, errors):
                pieces.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def _myers(self, k: int, text: str, begin: int, end: int) -> tuple[int, int]:
        """Least distance of item ``k`` to any part of ``text[begin:end]``, and the end of the first part that has it."""
        _, item, _, masks = self.items[k]
        m = len(item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, at = full, 0, m, m, begin
        get = masks.get
        for j in range(begin, end):
            eq = get(text[j], 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up) & full, up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, at = score, j + 1
            ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere: no cost at the top
            up, down = mh | ~(xv | ph) & full, ph & xv
        return best, at

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``item_id, distance, end`` for each item in the (normalised) text within its budget, at its best place."""
        if not self.items:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, at in places:
                spans.setdefault(k, []).append((end + 1 - n - at, 0))
        out = []
        for k, found in spans.items():
            item_id, item, errors, _ = self.items[k]
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, 0, exact + len(item)))
                continue
            if not errors:
                continue
            best = (errors + 1, 0)
            begin = end = None
            for first, _ in sorted(found):  # windows that overlap are read once
                a, b = max(0, first - errors), min(len(text), first + len(item) + errors)
                if begin is None or a > end:
                    if begin is not None:
                        best = min(best, self._myers(k, text, begin, end))
                    begin, end = a, b
                end = max(end, b)
            best = min(best, self._myers(k, text, begin, end))
            if best[0] <= errors:
                out.append((item_id, *best))
        return out


#: The last matcher of a worker, by the name of its block of items, so that tasks need not build it again.
_matcher: dict[tuple[str, float], Matcher] = {}


def matcher_of(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    if (name, rate) not in _matcher:
        _matcher.clear()
        _matcher[name, rate] = Matcher(items, rate)
    return _matcher[name, rate]


def blocks(benchmark: DataFrame, size: int = BLOCK):
    """The benchmark's items, normalised, in lists of at most about ``size`` code points; items without text are left out."""
    block, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalise(row[1])
        if not text.strip():
            continue
        if block and total + len(text) > size:
            yield block
            block, total = [], 0
        block.append((row[0], text))
        total += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block: int = BLOCK) -> DataFrame:
    """``doc_id, key`` (hash of the text), ``item_id, distance, end``: each item found in each row of ``docs``, at its best place.

    Texts are compared in lower case by letters and digits alone. An item of ``n`` characters may differ in ``rate * n``
    insertions, deletions or replacements, rounded down. By the pigeonhole principle one of budget-plus-one pieces of it
    then occurs unchanged: an Aho-Corasick automaton finds all pieces of all items in one pass over the whole text, and
    Myers' bit-parallel distance reads only the places that the hits leave open.

    The benchmark is sent to the tasks in blocks of bounded size, with one pass over the documents for each; documents are
    never shuffled or paired. Of several blocks each is searched, its finds written to the checkpoint folder, and
    released before the next is read. ``end`` counts characters of the normalised text. Null and empty texts match nothing,
    items without letters or digits are never found, items with the same id are searched each (the least distance counts),
    repeated rows give repeated results, and an empty table or benchmark gives an empty result.
    """
    rows = documents(docs).withColumn("key", F.xxhash64("text"))
    schema = "doc_id long, key long, item_id long, distance int, end int"
    out = None
    left = blocks(benchmark, block)
    items = next(left, None)
    while items:
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def per_batch(batches, shared=shared, name=name):
            matcher = matcher_of(name, shared.value, rate)
            for b in batches:
                found = []
                for doc, text, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    best: dict[int, tuple[int, int]] = {}
                    for item, *at in matcher.find(normalise(text)):
                        best[item] = min(best.get(item, (1 << 30, 0)), tuple(at))
                    found += [(doc, key, item, *at) for item, at in best.items()]
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["doc_id", "key", "item_id", "distance", "end"])

        part = rows.mapInArrow(per_batch, schema)
        items = next(left, None)
        if items or out is not None:
            part = cut_lineage(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "item_id", "distance", "end")
