"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WHITE, ascii_lower, cut_lineage, documents


def lost_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``lost_id, lost_row`` (hash of the text) and ``lost``, the positions of the lines that go."""
    rows = documents(docs).filter(F.octet_length("text") >= min_chars).select("doc_id", F.xxhash64("text").alias("row"), ascii_lower(F.col("text")).alias("text"))
    line = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.octet_length("line") >= min_chars)
    line = line.select("doc_id", "row", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).filter(F.char_length("line") >= min_chars)
    # both uses below read the keys from the shared folder instead of cutting the texts again
    keyed = cut_lineage(line.select("doc_id", "row", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")))
    shared = keyed.groupBy("k1", "k2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    shared = shared.filter(F.col("n") >= min_docs).select("k1", "k2", "keeper")
    lost = keyed.join(shared, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # repeated rows bring each position several times
    return lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row")).agg(F.collect_set("pos").alias("lost"))


def _cut(rows: DataFrame, lost: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``rows`` with ``lost``, the positions that go (null if none), by id and text hash."""
    return rows.join(lost, doc_id.cast("long").eqNullSafe(F.col("lost_id")) & (F.xxhash64(text) == F.col("lost_row")), "left")


def _kept(text: Column) -> Column:
    """The lines of a text that are not at the positions ``lost``, in their order."""
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lost"), lambda i: F.get(lines, i))
    return F.when(F.col("lost").isNull(), text).otherwise(F.array_join(kept, "\n"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped, kept_text``.

    Lines are exploded with their position, keyed by 128 bits of hash of the stripped, lower-cased line, and the distinct
    documents of each key are counted. A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses its lines everywhere but in the largest ``doc_id`` that holds it. Only keys and positions are shuffled by
    line; the text crosses the network once, to meet its own positions, and is put together again by position.

    A key with a third of all rows is counted from partial counts; the join that brings its verdict back to the lines
    is left to adaptive skew splitting, as one row per key stands on the other side.

    Null and empty texts are one empty line, which is kept. A null ``doc_id`` holds lines that may be dropped but does
    not count as a document; a key found only there is kept. Rows with the same id and different texts are judged each
    by its own lines; repeated rows get the same result. An empty table gives an empty result.
    """
    rows = documents(docs)
    found = _cut(rows, lost_lines(docs, min_chars, min_docs), rows["doc_id"], rows["text"])
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        _kept(text).alias("kept_text"),
    )


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_chars``, if it has that column, counted anew where lines go.

    All columns keep their names, whatever these are, and their types. Null texts stay null, null ids are judged as in
    :func:`line_dedup`, repeated rows all stay, and an empty table gives an empty one.
    """
    names = [c.lower() for c in docs.columns]
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    found = _cut(flat, lost_lines(docs, min_chars, min_docs), doc_id, text)
    new = {"text": _kept(text)}
    if "n_chars" in names:
        n = F.col(f"c{names.index('n_chars')}")
        new["n_chars"] = F.when(F.col("lost").isNull(), n).otherwise(F.char_length(new["text"]).cast(docs.schema[names.index("n_chars")].dataType))
    return found.select(*(new.get(c, F.col(f"c{i}")).alias(docs.columns[i]) for i, c in enumerate(names)))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_CHARS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SQL = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_CHARS}), '{UPPER}', '{UPPER.lower()}') AS key FROM line),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS lost
           FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
