"""Helpers that the training-data operators share: staged tables, Arrow text blocks, word hashes.

A *word* is a maximal run of bytes other than space and 0x09-0x0D.  No
UTF-8 continuation or lead byte lies in that set, so words can be found on the
raw bytes of an Arrow string column without making a Python string.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch, at most, while a stage is written: texts of some kilobytes make large batches, which lie in the JVM's buffers and in the worker at once.
BATCH_ROWS = 2048
#: Bytes of text that a Python worker handles at once; one longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or (unset, with a local master as in tests) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spanweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's scratch space
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so a lost executor costs no recomputation.

    The shuffle files behind the written table are dropped with the write.  The table itself goes when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")
    had = {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _BATCH: spark.conf.get(_BATCH, "10000")}
    rows = int(had[_BATCH])
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in had.items():
            spark.conf.set(key, value)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote and nothing reads any more."""
    _delete(df.sparkSession, df._staged_at)


def wider(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A schema with more fields at its end."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_small(rows: DataFrame, small: DataFrame, key: str, few: bool, how: str, salt_by: tuple[str, ...], salts: int = 32) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row for each ``key``, which may be null).

    ``few`` says that ``small`` was counted and may be broadcast; else it is repeated under ``salts`` numbers, and ``rows`` are dealt
    to these by the hash of ``salt_by``, so that a key with a great part of the rows is spread.
    """
    other, salt = fresh(rows, f"{key}_of_small", f"{key}_salt")
    small = small.withColumnRenamed(key, other)
    if few:
        return rows.join(F.broadcast(small), rows[key].eqNullSafe(small[other]), how).drop(other)
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*map(quoted, salt_by)), F.lit(salts)).cast("int"))
    small = small.withColumn(salt + "r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(small, rows[key].eqNullSafe(small[other]) & (rows[salt] == small[salt + "r"]), how).drop(other, salt, salt + "r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(text: pa.Array, max_bytes: int = BLOCK_BYTES):
    """Cut a string column into ``(first row, end row, bytes, offsets)`` with about ``max_bytes`` each; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, off_buf, data_buf = text.buffers()
    off = np.frombuffer(off_buf, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _splitmix(np.arange(256, dtype=np.uint64))
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _POWERS[:] = []
        for base in (_P, _P_INV):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.multiply.accumulate(row))
    return _POWERS


def find_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words of a block, and the number of words of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    w = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[off] = True
    begin = w.copy()
    begin[1:] &= ~w[:-1] | edge[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, equal for equal words wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):  # pieces of about a block, so that the tables of powers stay small
            a = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, a + BLOCK_BYTES, "right")))
            b = ends[hi - 1]
            power, inverse = _powers(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[data[a:b]] * power[: b - a], out=total[1:])
            out[lo:hi] = (total[ends[lo:hi] - a] - total[starts[lo:hi] - a]) * inverse[starts[lo:hi] - a]
            lo = hi
    return _splitmix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (runs over a row's end are for the caller to skip)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = words[:n].copy()
        for j in range(1, k):
            g = g * np.uint64(_P) + words[j : j + n]
    return _splitmix(g)
