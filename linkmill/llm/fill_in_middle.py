"""Fill-in-the-middle: documents rearranged as prefix, suffix and middle, assembled from sorted pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: The marks before the prefix, the suffix and the middle.
MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
ORDER = {"psm": "PSM", "spm": "SPM"}
#: Bytes of a piece.
CHUNK = 8192
#: The place of a document's summary, behind all its pieces.
_LAST = (1 << 62)
_KEYS = ["doc_id", "row", "row2"]
_HEAD = "doc_id long, row long, row2 long"
_FACTS = "n long, form string, prefix_chars long, middle_chars long"


def _lines_before(text: Column, breaks: Column, k: Column) -> Column:
    """The first ``k`` lines of a text with so many line breaks."""
    return F.when(k == 0, "").when(k > breaks, text).otherwise(F.concat(F.call_function("substring_index", text, F.lit("\n"), k), F.lit("\n")))


def pieces(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """The pieces of all rearranged documents, dealt out by document and sorted by their place in the output.

    ``doc_id``, ``row`` and ``row2`` (hashes of the text), the facts ``n``, ``form``, ``prefix_chars`` and ``middle_chars``, ``pos`` and ``data``
    (bytes). Cuts lie between lines, at two places drawn from the hash of seed and id. A document stays ``plain`` if it is
    empty, holds a mark itself, or is not among ``rate`` in a hundred; of the others ``spm`` in a hundred put the suffix
    first. A mark is a piece of its own; segments are cut into pieces of at most :data:`CHUNK` bytes, so a sort or a reader
    holds pieces and never documents.

    A null text is an empty one; a null id draws as an empty one. Rows with the same id and different texts are told apart by two
    hashes of the text; a repeated row brings each of its pieces again.
    """
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("draw", 8 * k + 1, 8), 16, 10).cast("long")
    breaks = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).cast("int")
    rows = rows.withColumns({"row": F.xxhash64("text"), "row2": F.xxhash64(F.lit(1), "text"), "draw": draw, "breaks": breaks})
    rows = rows.withColumn("n", (F.col("breaks") + F.when((F.col("text") != "") & ~F.endswith("text", F.lit("\n")), 1).otherwise(0)).cast("long"))
    plain = (F.col("text") == "") | (number(2) % 100 >= rate)
    for mark in MARKS.values():
        plain = plain | F.contains("text", F.lit(mark))
    rows = rows.withColumns({
        "form": F.when(plain, "plain").when(number(3) % 100 < spm, "spm").otherwise("psm"),
        "a": (number(0) % (F.col("n") + 1)).cast("int"), "b": (number(1) % (F.col("n") + 1)).cast("int")})
    to = lambda k: _lines_before(F.col("text"), F.col("breaks"), k)
    rows = rows.withColumns({"prefix": to(F.least("a", "b")), "upto": to(F.greatest("a", "b"))})
    cut = F.col("form") != "plain"
    rows = rows.select(
        *_KEYS, "n", "form", F.when(cut, F.char_length("prefix").cast("long")).alias("prefix_chars"),
        F.when(cut, (F.char_length("upto") - F.char_length("prefix")).cast("long")).alias("middle_chars"),
        F.col("text").cast("binary").alias("bytes"), F.octet_length("prefix").alias("p"), F.octet_length("upto").alias("q"), F.octet_length("text").alias("z"))
    parts = {"P": (F.lit(0), F.col("p")), "M": (F.col("p"), F.col("q")), "S": (F.col("q"), F.col("z"))}
    span = lambda mark, start, end: F.struct(F.lit(mark).alias("mark"), start.alias("start"), end.alias("end"))
    spans = F.when(F.col("form") == "plain", F.array(span("", F.lit(0), F.col("z"))))
    for form, order in ORDER.items():
        spans = spans.when(F.col("form") == form, F.array(*[span(MARKS[x], *parts[x]) for x in order]))

    def chunks(s: Column) -> Column:
        body = F.transform(F.sequence(s["start"], s["end"], F.lit(CHUNK)), lambda at: F.substring("bytes", at + 1, F.least(s["end"] - at, F.lit(CHUNK))))
        return F.concat(F.array(s["mark"].cast("binary")), body)

    facts = [*_KEYS, "n", "form", "prefix_chars", "middle_chars"]
    cuts = rows.select(*facts, F.posexplode(F.flatten(F.transform(spans, chunks))).alias("pos", "data"))
    cuts = cuts.filter((F.octet_length("data") > 0) | (F.col("pos") == 0))  # an empty segment has no piece, but each document one at least
    return cuts.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "pos")


class _Document:
    """One document as its pieces go by: the digest of what came so far, and where each piece stood before."""

    def __init__(self, key: tuple, facts: tuple):
        self.key, self.facts, self.copies, self.digest, self.segment, self.count = key, facts, 0, hashlib.sha256(), 0, 0

    def place(self, data: bytes) -> int | None:
        """The original place of a piece of the output; None for a mark, which was not in the text."""
        self.digest.update(data)
        if self.facts[1] != "plain" and data in _SEGMENTS:
            self.segment = _SEGMENTS[data]
            return None
        self.count += 1
        return (self.segment << 40) + self.count


_SEGMENTS = {MARKS[x].encode(): k for k, x in enumerate("PMS")}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to pieces with their original places, and a summary with the output's digest behind each document's."""
    names = [*_KEYS, "at", "data", "n", "form", "prefix_chars", "middle_chars", "copies", "output_sha256"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    doc, seen, no_facts = None, -1, (None,) * 6
    for batch in batches:
        out = []
        for *key, n, form, p, m, pos, data in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if doc is None or doc.key != tuple(key):
                if doc is not None:
                    out.append((*doc.key, _LAST, None, *doc.facts, doc.copies, doc.digest.hexdigest()))
                doc, seen = _Document(tuple(key), (n, form, p, m)), -1
            doc.copies += pos == 0
            if pos != seen:  # else a repeated row's
                seen, at = pos, doc.place(data)
                if at is not None:
                    out.append((*doc.key, at, data, *no_facts))
        if out:
            yield pack(out)
    if doc is not None:
        yield pack([(*doc.key, _LAST, None, *doc.facts, doc.copies, doc.digest.hexdigest())])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in original order, each document's summary behind them, to one row a document."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    digest = hashlib.sha256()
    for batch in batches:
        out = []
        for i, at, data, n, form, p, m, copies, digested in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "data", *names[1:5], "copies", "output_sha256")), strict=True):
            if at != _LAST:
                digest.update(data)
                continue
            out += [(i, n, form, p, m, digested, digest.hexdigest())] * copies
            digest = hashlib.sha256()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def digests(cut: DataFrame) -> DataFrame:
    """Per row of the documents behind ``cut`` (:func:`pieces`): its facts, ``output_sha256`` and ``restored_sha256``.

    The pieces stream by in output order; what follows from the output alone, its digest and each piece's place before the
    rearrangement (by the mark it stands behind), is all that is kept. They are then sorted anew, inside their
    partitions and so without another exchange, and stream into the digest of the restored text.
    """
    told = cut.mapInArrow(_digested, f"{_HEAD}, at long, data binary, {_FACTS}, copies long, output_sha256 string")
    return told.sortWithinPartitions(*_KEYS, "at").mapInArrow(_restored, f"doc_id long, {_FACTS}, output_sha256 string, restored_sha256 string")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, copies, seen, facts, parts = None, 0, -1, (), []

    def row() -> pa.RecordBatch:
        values = [[key[0]] * copies, *([x] * copies for x in facts), [b"".join(parts).decode()] * copies]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    for batch in batches:
        for *new, n, form, p, m, pos, data in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if key != tuple(new):
                if key is not None:
                    yield row()
                key, copies, seen, facts, parts = tuple(new), 0, -1, (n, form, p, m), []
            copies += pos == 0
            if pos != seen:
                seen = pos
                parts.append(data)
    if key is not None:
        yield row()


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``, the rearranged texts as training rows.

    ``n`` counts lines, the middle's and prefix's lengths are null where the form is plain (:func:`pieces`). A null text gives an
    empty plain output, repeated rows give repeated outputs, an empty table gives an empty one; extra columns take no part.
    """
    return pieces(docs, rate, spm, seed).mapInArrow(_whole, f"doc_id long, {_FACTS}, output string")


_CUT = "array_to_string(list_slice(u, {0}, {1}), '')"
SQL = f"""
WITH draw AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS h FROM documents),
line AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM draw),
number AS (SELECT *, len(u) AS n, {', '.join(f"('0x' || substring(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM line),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM number),
part AS (SELECT *, {_CUT.format(1, 'a')} AS p, {_CUT.format('a + 1', 'b')} AS m, {_CUT.format('b + 1', 'n')} AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM part
"""
