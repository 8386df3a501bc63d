"""Scratch tables, checked broadcasts and hashing that the operators share."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.lineage import shared_folder

#: Sides of a join are broadcast only while a count proves them at most this many bytes.
BROADCAST_LIMIT = 32 << 20

def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Whole texts go to Python in batches of that many rows: they stand in memory on both sides of the pipe.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage of df with a table in the shared folder; returns the table and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, SMALL_BATCHES):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_blobs(blobs: DataFrame, out: str, between: str, batch_rows: int = 2000) -> None:
    """Write the bytes of the one column to files under `out`, a file for each task, with `between` (ASCII) after each row.

    Spark's text writer passes bytes on as they are; it reaches every file system that Spark does, and its commit keeps
    one file of each task, also if tasks are lost or run twice. This rests on an engine that doesn't validate the bytes of
    strings; readers find their lengths in each part and fail where they don't fit.
    """
    with settings(blobs.sparkSession, dict.fromkeys(SMALL_BATCHES, str(batch_rows))):
        blobs.select(F.col(blobs.columns[0]).cast("string")).write.option("lineSep", between).option("compression", "none").text(out)


def read_blobs(spark: SparkSession, out: str) -> DataFrame:
    """(content) of every file that write_blobs has put under `out`, in batches of one file or so."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content")


def small_enough(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether a count proves df to be within the broadcast limit."""
    most = limit // bytes_per_row
    return df.limit(most + 1).count() <= most if most < 10_000 else df.count() <= most


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str, bytes_per_row: int = 48) -> DataFrame:
    """Join with a materialized right side: broadcast after a size check, else a shuffle that AQE can split on hot keys."""
    return left.join(F.broadcast(right) if small_enough(right, bytes_per_row) else right.hint("merge"), on, how)


def null_safe_id(name: str):
    """A long that tells null from every value, for sorting and hashing."""
    return F.xxhash64(F.col(name).isNull(), F.col(name))


def release() -> None:
    """Give freed memory of this worker back to the system: workers outlive tasks, and their leftovers add up."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on unsigned 64-bit arrays (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, and the number of words in each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lens = np.flatnonzero(edge == -1) - starts
    where = np.flatnonzero(inside)
    pos = where - np.repeat(starts, lens)
    vals = _BYTE[buf[where]] * _powers(int(lens.max()) + 1)[pos]
    first = np.cumsum(lens) - lens
    h = mix(np.add.reduceat(vals, first) + lens.astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def chunks_of(texts: list, most: int = 1 << 20):
    """Index ranges of texts that hold about `most` bytes or characters together; a longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
