"""Record numbers of distributed inputs: the same whatever the tasks, counted in two passes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage

#: Splits of which the table of first numbers is sent to all tasks (under 64 bytes each); more are joined by Spark's choice.
FEW_SPLITS = 500_000


_MOVED = "the files were split otherwise when their rows were counted: set spark.sql.files.minPartitionNum, which else follows the number of executors"


def numbered(df: DataFrame, name: str = "record", path: str | None = None, start: str | None = None, by_file: bool = False) -> DataFrame:
    """Adds ``name``: each row's place, from 0, among all rows of the files that ``df`` was read from, or ``by_file`` in its own file.

    Files count in the order of their paths, parts of a folder by their numbers. The first pass counts the rows of each split (a
    file's part that one task reads); sums over the splits before give each split's first number. In the second pass a row's
    number is its split's first one and its place in the split, which is read in order. So no row is shuffled or
    sorted, and a number follows from the files alone, not from tasks or the sizes of splits. ``path`` and ``start`` name columns
    that tell a row's split, where the rows went through a step that lost the file source's own.

    A table that was not read from files, or whose rows have been dealt out since, has no order of its own: it is
    written to the checkpoint folder, and the order in which it was written counts from then on.
    """
    at = (F.col(path or "_metadata.file_path").alias("_path"), F.col(start or "_metadata.file_block_start").alias("_start"))
    found = _counted(df, at)
    if found is None:
        df = cut_lineage(df)
        found = _counted(df, (F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")))
    rows, splits = found
    first = _with_sums(splits, by_file).select(F.xxhash64("_path").alias("_p"), F.col("_start").alias("_s"), "_first", "_n", "_before")
    first = F.broadcast(first) if splits.count() <= FEW_SPLITS else first
    place = F.col("_nth") - F.col("_first")
    rows = rows.join(first, (F.xxhash64("_path") == F.col("_p")) & (F.col("_start") == F.col("_s")), "left")
    # splits of which none was counted would have no number: better no result than a wrong one
    checked = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place).otherwise(F.raise_error(F.lit(_MOVED)).cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], checked.alias(name))


def in_order(df: DataFrame, path: str, nth: str, name: str) -> DataFrame:
    """Adds ``name``: each row's place among all files, from its place ``nth`` in its file. One pass counts the rows of each file."""
    counts = cut_lineage(df.groupBy(F.col(path).alias("_path")).agg((F.max(nth) + 1).alias("_n"), F.lit(0).alias("_start")))
    ahead = _with_sums(counts, False).select(F.col("_path").alias("_p"), "_before")
    return df.join(ahead, F.col(path) == F.col("_p")).withColumn(name, F.col("_before") + F.col(nth)).drop("_p", "_before")


def _counted(df: DataFrame, at: tuple[Column, Column]) -> tuple[DataFrame, DataFrame] | None:
    """The rows with their place in their task, and the rows of each split; None where splits don't lie in one piece in a task."""
    try:
        rows = df.select("*", *at, F.monotonically_increasing_id().alias("_nth"))
    except AnalysisException:
        return None
    splits = cut_lineage(rows.groupBy("_path", "_start").agg(F.min("_nth").alias("_first"), F.max("_nth").alias("_last"), F.count("*").alias("_n")))
    return (rows, splits) if splits.filter("_last - _first + 1 <> _n").isEmpty() else None


def _with_sums(splits: DataFrame, by_file: bool) -> DataFrame:
    """Adds ``_before``: the rows of the splits before, in the file or in all of them. Files are summed first, then the splits of each."""
    inside = F.sum("_n").over(W.partitionBy("_path").orderBy("_start")) - F.col("_n")
    splits = splits.withColumn("_before", inside)
    if by_file:
        return splits
    files = splits.groupBy(F.col("_path").alias("_file")).agg(F.sum("_n").alias("_rows"))
    # one window over a row a file, of which the driver lists all anyway
    order = W.orderBy(F.regexp_extract("_file", r"^(.*/)", 1), F.lpad(F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1), 12, "0"), "_file")
    files = files.select("_file", (F.sum("_rows").over(order) - F.col("_rows")).alias("_ahead"))
    return splits.join(files, F.col("_path") == F.col("_file")).withColumn("_before", F.col("_ahead") + F.col("_before"))
