"""From ``documents`` to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``docs``. Columns other than ``doc_id`` and ``text`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import decontamination, line_dedup, near_copies, packing, toxicity
from linkmill.llm.common import cut_lineage, free_name, in_fold, table
from linkmill.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more.

    Null and empty texts stay. Each row is judged by its text alone, so repeated rows go or stay together and ids may be null; an
    empty table gives an empty one. Without labels of both kinds nothing is known and the share of toxic labels decides.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~in_fold(5, 0)))
    name = free_name(docs, "score")
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by the lines that it keeps; all rows stay.

    Null texts stay null, empty ones empty. Rows of one id with different texts are judged each by its own lines, repeated rows
    alike; lines under a null id may be dropped but don't count as a document. An empty table gives an empty one.
    """
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (similar five-word shingles): that with the smallest id, ties by text hash.

    Rows are judged by id and text, so rows of one id with different texts each by their own; of repeated rows (same id and
    text) any one stays. Null and empty texts are copies of each other. Rows without an id come last in their group.
    """
    groups = cut_lineage(near_copies.near_copies(docs))
    key, i, k = (free_name(docs, c) for c in ("_key", "_lost_id", "_lost_key"))
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    same = rows["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k))
    pick = lambda df: df.select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()
    kept = rows.join(pick(groups.filter("NOT head")), same, "left_anti")
    again = cut_lineage(pick(groups.filter("head").groupBy("doc_id", "key").count().filter("count > 1")))
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item, judged by id and text; null and empty texts stay, rows without an id are judged too."""
    key, i, k = (free_name(docs, c) for c in ("_key", "_lost_id", "_lost_key"))
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    lost = found.select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    return rows.join(lost, rows["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)), "left_anti").drop(key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are the closing id alone. Each row is a document, so repeated rows and rows without an id are all packed;
    an empty table gives an empty one. Columns other than id and text take no part.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained scores, fingerprints, edit distances and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
