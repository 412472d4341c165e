"""Column helpers and vectorised text helpers that the operators of this subpackage share.

Every operator starts from :func:`documents`, so columns other than the id and the text never take part and
extra columns may have any name.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which separate words in all contracts of this subpackage.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string) of a table."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take Spark's fast ``lower``."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def in_fold(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as crc32 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % modulus == remainder


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores so that no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared checkpoint folder; one of our own only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder := context.getConf().get("spark.checkpoint.dir"):
            context.setCheckpointDir(folder)
        else:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, where it outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns what a task's Python has freed to the system: workers are kept for later stages, whose memory it would take."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


# --- words as arrays -------------------------------------------------------------------------------------------------

_IS_WHITE = np.zeros(256, dtype=np.int8)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64 and of its inverse; kept between calls."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and where each word begins and ends."""
    values = np.frombuffer(data, dtype=np.uint8)
    white = np.ones(len(values) + 2, dtype=np.int8)
    np.take(_IS_WHITE, values, out=white[1:-1])
    turn = np.flatnonzero(white[1:] != white[:-1])
    return values, turn[0::2], turn[1::2]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each slice ``values[start:end]`` of 64-bit values."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return mix(rolling(_BYTE_VALUE[values], starts, ends))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes; empty if there are fewer words."""
    starts = np.arange(max(0, len(words) - size + 1))
    return mix(rolling(words, starts, starts + size)) if len(starts) else np.zeros(0, dtype=np.uint64)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``size`` that begins at one of ``starts``."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:-1]) > 0
