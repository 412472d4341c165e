"""Folders of data files as a Spark data source that reads streams: first bytes only, or records from a bounded buffer."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .formats import CHUNK, HEAD, format_of, records

SCHEMAS = {"heads": "path string, length long, format string", "lines": "path string, crlf boolean", "records": "path string, nth long, json string"}
#: Bytes, and files, that a task reads if files are smaller.
TASK_BYTES, TASK_FILES = 1 << 27, 1000


def store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what Spark puts before such paths."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, "file://"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else path.split("://")[0] + "://"


def listed(path: str) -> list[tuple[str, int]]:
    """Paths (as Spark writes them) and lengths of a file, of a folder's files, or of those that a pattern names; hidden ones left out as Spark does."""
    system, inner, before = store(path)
    wild = any(c in inner for c in "*?[")
    base = inner[: min(inner.index(c) for c in "*?[" if c in inner)].rpartition("/")[0] if wild else inner
    one = system.get_file_info(base or "/")
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [one] if one.is_file else system.get_file_info(fs.FileSelector(base or "/", recursive=wild))
    whole = inner.rstrip("/").split("/")
    fits = lambda p: not wild or len(p.split("/")) == len(whole) and all(map(fnmatch.fnmatchcase, p.split("/"), whole))
    return sorted((before + i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", ".")) and fits(i.path))


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, what: str):
        self.path, self.what = path, what

    def partitions(self) -> list[Files]:
        """Files in order of their paths, small ones together."""
        parts, size = [], 0
        for path, length in listed(self.path):
            cost = length if self.what == "records" else min(length, HEAD)
            if not parts or size + cost > TASK_BYTES or len(parts[-1].paths) >= TASK_FILES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append((path, length))
            size += cost
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple | pa.RecordBatch]:
        for path, length in partition.paths:
            if self.what == "records":
                yield from _batches(path)
                continue
            with _opened(path) as f:
                head = f.read(HEAD)
            yield (path, length, format_of(head).name) if self.what == "heads" else (path, b"\r\n" in head)


def _opened(path: str) -> pa.NativeFile:
    system, inner, _ = store(path)
    return system.open_input_stream(inner, compression=None)


def _parts(path: str) -> Iterator[bytes]:
    with _opened(path) as f:
        while part := f.read(CHUNK):
            yield part


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    """A file's records as JSON text with their numbers, at most 1,000 or some megabytes at once."""
    out, size, nth = [], 0, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array(range(nth - len(out), nth), pa.int64()), pa.array(out, pa.string())], ["path", "nth", "json"])

    for record in records(lambda: _parts(path), path.rsplit("/", 1)[-1]):
        out.append(json.dumps(record, ensure_ascii=False, default=str))
        size, nth = size + len(out[-1]), nth + 1
        if len(out) == 1000 or size > 4 * CHUNK:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


class DataFiles(DataSource):
    """``spark.read.format("data_files").option("what", "heads", "lines" or "records").load(path)``.

    Paths are those of any store that pyarrow reads (local, HDFS, object stores). *heads* judges each file by its first bytes and
    reads no more of it, *lines* tells how it ends lines; *records* cuts its records out of a stream, so a task holds a buffer and never a file.
    """

    @classmethod
    def name(cls) -> str:
        return "data_files"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "records")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("what", "records"))


def data_files(spark: SparkSession, path: str, what: str):
    spark.dataSource.register(DataFiles)
    return spark.read.format("data_files").option("what", what).load(path)
