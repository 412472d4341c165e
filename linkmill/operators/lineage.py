"""Cutting the lineage of iterative jobs where a lost executor can't hurt."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the cluster's checkpoint folder (one of our own only where none is set, as in tests) and reads it.

    A table rather than a checkpoint, so that later self-joins start from fresh columns.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder := context.getConf().get("spark.checkpoint.dir"):
            context.setCheckpointDir(folder)
        else:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
