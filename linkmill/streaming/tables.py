"""Tables that grow by batches of a stream and are merged into snapshots now and then, while others read them."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import store


class BatchTable:
    """The rows of a stream's batches under ``path``.

    Each batch has a folder of its own (``batches/batch=3``), which it overwrites if it runs again. :meth:`compact` writes what stands
    in the last snapshot and the batches since as a new one (``snapshots/upto=3``) and then adds a line to the ``manifest``.
    That line, one file that appears at once, is what readers go by: they read the snapshot that the manifest's
    highest line names, and the batches after it. A compaction that breaks off before the line leaves the old table, one that
    breaks off after it the new one. Old folders stay for readers that began before, until a later :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _folder(self, name: str, schema: StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _marks(self) -> list[int]:
        return sorted({r[0] for r in self._folder("manifest", "upto long").collect()})  # a number a compaction

    def write(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id > max(self._marks(), default=-1):  # else it is part of a snapshot
            rows.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def read(self) -> DataFrame:
        upto = max(self._marks(), default=-1)
        schema = StructType([*self.schema.fields, StructField("batch", LongType())])
        rows = self._folder("batches", schema).filter(F.col("batch") > upto).drop("batch")
        return rows if upto < 0 else self._folder(f"snapshots/upto={upto}", self.schema).unionByName(rows)

    def snapshot(self, upto: int, merge: Callable[[DataFrame], DataFrame] | None = None, files: int = 1) -> None:
        """Writes all rows up to batch ``upto`` as a snapshot, which no reader sees yet."""
        rows = self.read()
        (merge(rows).repartition(files) if merge else rows.coalesce(files)).write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={upto}")

    def commit(self, upto: int) -> None:
        """From here on readers go by the snapshot."""
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def compact(self, upto: int, merge: Callable[[DataFrame], DataFrame] | None = None, files: int = 1) -> None:
        """Merges all batches so far, of which ``upto`` is the last, into one snapshot and removes what was merged before."""
        if upto > max(self._marks(), default=-1):
            self.snapshot(upto, merge, files)
            self.commit(upto)
            self.vacuum()

    def vacuum(self) -> None:
        """Removes batches and snapshots that the snapshot before the last one replaced; readers of the last two go on undisturbed."""
        marks = self._marks()
        if len(marks) < 2:
            return
        system, inner, _ = store(self.path)
        for folder, old in (("batches", lambda n: n <= marks[-2]), ("snapshots", lambda n: n < marks[-2])):
            for info in system.get_file_info(fs.FileSelector(f"{inner}/{folder}", allow_not_found=True)):
                if info.type == fs.FileType.Directory and "=" in info.base_name and old(int(info.base_name.split("=")[1])):
                    system.delete_dir(info.path)
