"""Growing inputs: profiles, runs and samples kept up to date by Structured Streaming.

The sources have no event time and no late rows, so nothing waits for a watermark. Results are tables of batches
(:mod:`.tables`); what must be remembered of each mention is in Spark's state store. Each job reads what is there and stops (``availableNow``); started again with the same checkpoint it
goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import mention_script
from ..operators.corpus import ARABIC, draw, profile_measures
from .tables import BatchTable


def _source(spark: SparkSession, in_dir: str, schema: StructType | str, fmt: str) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(in_dir)


PROFILED = "text string, mentions array<struct<mention: string, type: string, gold: string>>"
_COUNTERS = ("sentences", "with_mentions", "no_arabic", "chars", "mentions", "nil", "latin")


def profile_counts(docs: DataFrame) -> DataFrame:
    """``kind, key, n``: the counters of a corpus profile over annotated texts (:data:`PROFILED`), and mentions by type; blank texts don't count.

    All of them add up over batches, and come from one pass: each text becomes a few counters, which are summed.
    """
    m = F.coalesce("mentions", F.array().cast("array<struct<mention: string, type: string, gold: string>>"))
    n_if = lambda f: F.size(F.filter(m, f))
    values = (F.lit(1), (F.size(m) > 0), ~F.col("text").rlike(ARABIC), F.char_length("text"), F.size(m), n_if(lambda x: x["gold"] == "NIL"), n_if(lambda x: mention_script(x["mention"]) != "arabic"))
    entry = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.cast("long").alias("n"))
    counters = F.array(*[entry("counter", F.lit(c), v) for c, v in zip(_COUNTERS, values, strict=True)])
    types = F.transform(m, lambda x: entry("type", F.coalesce(x["type"], F.lit("None")), F.lit(1)))
    return docs.filter(r"text RLIKE '\\S'").select(F.inline(F.concat(counters, types))).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _profile(spark: SparkSession, table: str) -> BatchTable:
    return BatchTable(spark, table, "kind string, key string, n long")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def stream_profile(spark: SparkSession, in_dir: str, schema: StructType | str, table: str, checkpoint: str, fmt: str = "json", every: int = 100) -> StreamingQuery:
    """Adds the counters of each batch to the table ``table`` (a path); :func:`read_profile` sums them.

    Each batch overwrites its own part, so one that runs twice counts once; every ``every`` batches they are summed into a snapshot.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        kept = _profile(batch.sparkSession, table)
        kept.write(profile_counts(batch).coalesce(1), batch_id)  # a row a counter and type
        if (batch_id + 1) % every == 0:
            kept.compact(batch_id, _summed)

    return _source(spark, in_dir, schema, fmt).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_profile(spark: SparkSession, table: str) -> DataFrame:
    """``measure, value`` of all batches so far, as :func:`linkmill.operators.corpus.corpus_profile` gives them."""
    rows = _summed(_profile(spark, table).read())
    one = rows.filter("kind = 'counter'").agg(*[F.coalesce(F.max(F.when(F.col("key") == c, F.col("n"))), F.lit(0)).alias(c) for c in _COUNTERS])
    return profile_measures(one, rows.filter("kind = 'type'").select(F.col("key").alias("t"), F.col("n").alias("c")), True)


def newest_answers(rows: DataFrame) -> DataFrame:
    """Of a stream of run rows the answer of each ``run, id``: ``best`` (``good, at, ord, row``), with ``seen``, when its last batch came.

    The first batch's answer that didn't fail stays, the last one in that batch; without one the last failure. ``at`` is when the
    answer's batch came, below zero if it is good, and ``row`` has the columns that don't stand beside it. This is the stream's
    state: one row a mention in the state store, of which a batch reads and writes those alone that it brings.
    """
    now = F.unix_micros(F.current_timestamp())  # in a stream one time a batch, the same if it runs again
    good = F.coalesce(F.col("qid") != "ERROR", F.lit(False))
    rest = F.to_json(F.struct(*[f"`{c}`" for c in rows.columns if c not in _PLACED]), {"ignoreNullFields": "false"})
    rows = rows.select(*_PLACED, good.alias("good"), rest.alias("row"), now.alias("came"))
    best = F.struct("good", F.when(F.col("good"), -F.col("came")).otherwise(F.col("came")).alias("at"), "ord", "row")
    return rows.groupBy("run", "id").agg(F.max(best).alias("best"), F.max("came").alias("seen"))


#: Columns of run rows that stand beside the others' JSON in the state.
_PLACED = ("run", "id", "ord")
#: State that grows with the mentions is on executors' disks, packed, and has a bound in the memory of each.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """Settings of :data:`ON_DISK` for streams that start here, but for those that the session has of its own."""
    own = [k for k in ON_DISK if k not in spark.conf.getAll]
    try:
        for k in own:
            spark.conf.set(k, ON_DISK[k])
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def stream_runs(spark: SparkSession, in_dir: str, schema: StructType | str, table: str, checkpoint: str, fmt: str = "json", every: int = 100) -> StreamingQuery:
    """Appends new answers to the table ``table`` (a path), which :func:`read_runs_table` reads; failed mentions are tried again.

    What was answered before is known to the stream's state (:func:`newest_answers`), so a batch reads nothing of the table, however
    long it has grown. Each batch overwrites its own part, so one that runs twice leaves the same rows; every ``every`` batches
    they are merged into a snapshot. The state is in Spark's RocksDB store (:data:`ON_DISK`), so that executors hold no row a mention
    in memory; a checkpoint that began with another provider keeps it.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rest = StructType([f for f in kind.fields if f.name not in _PLACED])

    def add(batch: DataFrame, batch_id: int) -> None:
        kept = BatchTable(batch.sparkSession, table, kind)
        new = batch.filter("if(best.good, -best.at, best.at) = seen").select("run", "id", "best.ord", F.from_json("best.row", rest).alias("row"))
        kept.write(new.select("run", "id", "ord", "row.*").select(*[f"`{c}`" for c in kind.names]), batch_id)
        if (batch_id + 1) % every == 0:
            kept.compact(batch_id, files=batch.sparkSession.sparkContext.defaultParallelism)

    answers = newest_answers(_source(spark, in_dir, schema, fmt))
    with _on_disk(spark):
        return answers.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_runs_table(spark: SparkSession, table: str, schema: StructType | str) -> DataFrame:
    return BatchTable(spark, table, schema).read()


def stream_sample(spark: SparkSession, in_dir: str, schema: StructType | str, k: int, key: str, out: str, checkpoint: str, seed: int = 13, fmt: str = "json", every: int = 100) -> StreamingQuery:
    """The ``k`` rows with the smallest hashes of all so far; :func:`read_sample` reads them.

    The smallest of each batch's smallest are the smallest of all, so a batch writes its own and reads nothing.
    """
    smallest = lambda rows: rows.orderBy(draw(seed, key), key).limit(k)

    def keep(batch: DataFrame, batch_id: int) -> None:
        kept = BatchTable(batch.sparkSession, out, schema)
        kept.write(smallest(batch), batch_id)
        if (batch_id + 1) % every == 0:
            kept.compact(batch_id, smallest)

    return _source(spark, in_dir, schema, fmt).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sample(spark: SparkSession, out: str, schema: StructType | str, k: int, key: str, seed: int = 13) -> DataFrame:
    return BatchTable(spark, out, schema).read().orderBy(draw(seed, key), key).limit(k)
