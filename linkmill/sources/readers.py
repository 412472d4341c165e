"""Run files, rows, corpora, token files and review sheets to tables, and back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from ..schemas import RUN
from .files import data_files
from .formats import sentences
from .numbering import in_order, numbered

CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


def read_runs(spark: SparkSession, path: str, columns: list[str] | None = None, least: int | None = None) -> DataFrame:
    """All run files of a folder: their rows with ``run`` (the name of the file, or of its folder) and ``ord`` (the row's place,
    counted over the files in order of their names and parts, so that of two records of a mention the later one is known).

    Development runs stay out; of a plain and a packed file of one run the packed one counts. ``columns`` prunes the
    schema before reading; with ``least``, runs with fewer rows that didn't fail are left out. What is known of each run goes
    to all tasks (a row a run, of which the driver lists the files anyway): a join by run would give a task all rows of one.
    """
    name = F.url_decode(F.regexp_extract("_metadata.file_path", r"/([^/]+?)\.jsonl(?:\.gz)?(?:/part-[^/]*)?$", 1))
    rows = spark.read.schema(RUN).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)
    rows = numbered(rows.select(*(columns or ["*"]), name.alias("run"), F.endswith("_metadata.file_name", F.lit(".gz")).alias("_packed")), "ord")
    rows = rows.filter("run <> '' AND NOT startswith(run, 'dev_')")
    use = rows.groupBy("run").agg(F.bool_or("_packed").alias("_packed"))
    rows = rows.join(F.broadcast(use), ["run", "_packed"], "left_semi").drop("_packed")
    if least is not None:
        enough = rows.filter("qid <> 'ERROR'").groupBy("run").count().filter(F.col("count") >= least)
        rows = rows.join(F.broadcast(enough), "run", "left_semi")
    return rows


def write_run(rows: DataFrame, folder: str, run: str) -> None:
    """A run's rows as packed JSON lines in ``<run>.jsonl.gz`` parts under ``folder``, which :func:`read_runs` finds by the folder's name."""
    rows.write.mode("overwrite").json(f"{folder}/{run}.jsonl", compression="gzip")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, JSON (an array, or an object with the rows in ``data``), CSV or TSV, packed or not, by the path's ending."""
    plain = path.removesuffix(".gz")
    if plain.endswith((".csv", ".tsv")):
        return spark.read.schema(schema).options(**CSV, sep="\t" if plain.endswith(".tsv") else ",").csv(path)
    if plain.endswith(".json"):
        wrapped = spark.read.schema(f"data array<struct<{_as_struct(schema)}>>, {schema}").option("multiLine", True).json(path)
        inner = wrapped.filter("data IS NOT NULL").select(F.inline("data"))
        return inner.unionByName(wrapped.filter("data IS NULL").drop("data"))
    return spark.read.schema(schema).json(path)


def common_rows(one: DataFrame, other: DataFrame, key: str, slices: int = 4096) -> DataFrame:
    """Rows of ``one`` that ``other`` has too, as often as both have them; columns go by their names, nulls are alike.

    Rows fall into slices by the hash of ``key``, and counts and sums over the rows' hashes (128 bits) tell slices that are alike from
    others. So a row a slice and task is moved, and of the rows themselves those alone whose slice differs.
    """
    columns = one.columns
    place = F.pmod(F.xxhash64(key), F.lit(slices))

    def sums(rows: DataFrame) -> DataFrame:
        whole = [F.xxhash64(F.lit(k), *columns, *map(F.isnull, columns)) for k in (1, 2)]  # a null alone doesn't change a hash
        rows = rows.select(place.alias("_slice"), *[h.alias(f"_h{k}") for k, h in enumerate(whole)])
        halves = [f(h) for h in ("_h0", "_h1") for f in (lambda c: F.shiftrightunsigned(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))]
        return rows.groupBy("_slice").agg(F.count("*").alias("_n"), *[F.sum(h).alias(f"_s{k}") for k, h in enumerate(halves)])

    both = sums(one).unionByName(sums(other))
    odd = cut_lineage(both.groupBy(*both.columns).count().filter("count < 2").select("_slice").distinct())
    if odd.isEmpty():
        return one
    odd = F.broadcast(odd)  # at most a number a slice
    each = [rows.select(*columns).join(odd, place == F.col("_slice"), "left_semi") for rows in (one, other)]
    return one.join(odd, place == F.col("_slice"), "left_anti").unionByName(each[0].intersectAll(each[1]))


def _as_struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, format`` of each file, judged by its first bytes (:data:`linkmill.sources.formats.FORMATS`), of which no more are read.

    ``path`` is a file, a folder or a pattern. Files of no bytes are listed too, as empty.
    """
    return data_files(spark, path, "heads")


def read_records(spark: SparkSession, path: str, schema: str, lines: bool = False, number: str | None = None) -> DataFrame:
    """Corpus records by what a file holds: JSON of any form (:func:`linkmill.sources.formats.json_records`), token lines (``tokens, tags,
    qids``), CSV and TSV (by the path's ending), packed or not, with or without a byte order mark.

    Archives, web pages, empty files, unknown formats and text that is broken before its end raise an error that names the
    file. ``lines`` says that it is JSON lines, which Spark reads in pieces; of other forms a file is a task, which reads it as a
    stream and holds a record at a time, but for an object that wraps all records of its file. ``number`` adds a
    column of record numbers, counted over all files in order of their paths.
    """
    if lines or path.removesuffix(".gz").endswith((".csv", ".tsv")):
        rows = spark.read.schema(schema).json(path) if lines else read_rows(spark, path, schema)
        return numbered(rows, number) if number else rows
    rows = data_files(spark, path, "records")
    if number:
        rows = in_order(rows, "path", "nth", number)
    row = F.inline(F.array(F.from_json("json", schema)))
    return rows.select(row, number) if number else rows.select(row)


_SENTENCE = "tokens array<string>, tags array<string>, qids array<string>"
_SPLIT = "path string, start long, " + _SENTENCE


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of token files between blank lines to sentences; a piece may hold several if lines of white space part them."""
    text, words = pa.string(), pa.list_(pa.string())
    for b in batches:
        for path, start, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found = [(path, start, s["tokens"], s["tags"], s["qids"]) for s in sentences([piece.lstrip("\ufeff")])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (text, pa.int64(), words, words, words), strict=True)], ["path", "start", "tokens", "tags", "qids"])


def read_conll(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """``id, tokens, tags, qids`` of token files: a token a line, sentences between blank lines, ``#`` comments, ragged rows padded.

    Roles of columns are found for each sentence; cells that are no item are null. ``id`` is the file's name and the sentence's
    number in it. A blank line is Spark's record separator here, so sentences are rows and a large file is read by many tasks; numbers
    come from counts of the splits (:mod:`.numbering`). ``line_end`` is the files' line end; without it the first bytes
    of each file tell those that end lines by carriage return and line feed from the others.
    """
    if line_end is None:
        returns = [p for p, crlf in _line_ends(spark, path) if crlf]
        ends = {"\n": ~F.col("_metadata.file_path").isin(returns) if returns else F.lit(True)} | ({"\r\n": F.col("_metadata.file_path").isin(returns)} if returns else {})
    else:
        ends = {line_end: F.lit(True)}
    parts = []
    for end, where in ends.items():
        rows = spark.read.option("lineSep", "\n" + end).text(path).filter(where)
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value").mapInArrow(_cut, _SPLIT)
        parts.append(numbered(rows, "k", path="path", start="start", by_file=True))
    name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("-"), F.col("k"))
    return reduce(DataFrame.unionByName, parts).select(name.alias("id"), "tokens", "tags", "qids")


def _line_ends(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Whether each file's first line ends in carriage return and line feed; one row a file, of which Spark's driver holds a list anyway."""
    first = data_files(spark, path, "lines")
    return [(r["path"], r["crlf"]) for r in first.collect()]


def read_review(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A review sheet: all strings, empty cells as empty strings."""
    head = spark.read.options(**CSV).csv(path)
    return head.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in head.columns else F.lit("").alias(c) for c in columns])


def write_review(sheet: DataFrame, path: str) -> None:
    """A sheet has as many rows as people can judge: one file."""
    sheet.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Small result tables, each as one CSV file in a folder of its name."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{path}/{name}")
