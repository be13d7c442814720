"""Helpers of the corpus operators: shared-folder tables, safe column names, text batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

# A word, as a pattern for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

# The smallest id: stands for a null id wherever ids are compared.
NO_ID = -(2**63)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session (tests) may leave that setting out; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Cuts lineage: a lost executor costs a read, not the work before, and later readers fetch
    only the columns they use.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that only lead to others, and go when those are stored in turn."""

    def __init__(self) -> None:
        self._tables: list[tuple[SparkSession, str]] = []

    def saved(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = shared_folder(df.sparkSession)
        df.write.option("compression", compression).parquet(path)
        self._tables.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for spark, path in self._tables:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        self._tables = []


_BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most 4 MB.

    Whole texts go to Python; with large batches the copies on the way would take more of an
    executor than the work itself.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", str(conf.get(_BATCH_KEY)).lower()).groups()
    size = int(number) << 10 * " kmgt".index(unit or " ")
    if not 0 < size <= _BATCH_BYTES:
        conf.set(_BATCH_KEY, str(_BATCH_BYTES))
    return df


_trim = None


def give_back() -> None:
    """Return freed memory to the system. Workers live on between stages, and what they hoard
    after large batches would count against the executor's next tasks."""
    global _trim
    if _trim is None:
        try:
            _trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library: nothing to do
            _trim = lambda pad: 0
    pa.default_memory_pool().release_unused()
    _trim(0)


def text_parts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple]:
    """A string column in runs of rows of about ``most`` bytes: (first row, last row + 1,
    bytes, offsets). A null is empty. A longer text is a run of its own, never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    ends = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(ends, ends[low] + most, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high
    give_back()
