"""What the operators of this subpackage share.

Every operator reads only the columns its parameters name and returns only the columns its docstring
lists, so further columns of the input, whatever their names, can't clash with its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import new_path, remove

#: Rows and bytes of an Arrow batch; with these, a worker holds a few tens of MB of text at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


#: Spark's own switch, which may be set at any time.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless the caller has set tighter bounds."""
    for key, value in BATCH.items():
        have = spark.conf.get(key, value)
        if not have.isdigit() or not 0 < int(have) < int(value):
            spark.conf.set(key, value)


@contextlib.contextmanager
def files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job are deleted when it ends, since nothing can refer to them any more."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors cost nothing.

    The shuffle files of the write are deleted when it ends, since nothing can refer to them any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with files_cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what written() wrote for these; only where all that was made from them is itself written."""
    for df in frames:
        remove(df.sparkSession, df.written_at)


def give_back() -> None:
    """Give memory that this worker holds but doesn't use back to the system: a worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """Tables of rows in a row that hold about `most` bytes of a column; where they are cut depends on the rows alone."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        while len(lengths):
            upto = size + np.cumsum(lengths)
            n = int(np.searchsorted(upto, most)) + 1
            held.append(batch.slice(0, n))
            if n > len(lengths):
                size = int(upto[-1])
                break
            yield pa.Table.from_batches(held)
            held, size = [], 0
            batch, lengths = batch.slice(n), lengths[n:]
    if held:
        yield pa.Table.from_batches(held)


def sliced(columns: list, names: list[str], sizes: Iterable[int], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of these column lists, cut so that each holds about `most` bytes."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield pa.RecordBatch.from_arrays([x[start : i + 1] if isinstance(x, pa.Array) else pa.array(x[start : i + 1]) for x in columns], names)
            start, size = i + 1, 0
    if start < len(columns[0]):
        yield pa.RecordBatch.from_arrays([x[start:] if isinstance(x, pa.Array) else pa.array(x[start:]) for x in columns], names)
