"""The folder that a cluster's driver and executors share, and what this package writes into it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MADE: list[str] = []
SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one is made only for a local master that has none."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if have:
        return have.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stepforge-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stepforge/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    if (here := SCOPE.get()) is not None:
        here.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what several readers need is made once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df for joins that sort and merge both sides: a written table is taken to be as large as its files, which may be a fiftieth of its rows in memory, and would be sent through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores: by its size alone adaptive execution would give rows that take long each to one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def no_entries(kind: T.ArrayType | T.MapType) -> Column:
    """The empty list or map of a type."""
    none = lambda x: F.array().cast(T.ArrayType(x))
    return none(kind.elementType) if isinstance(kind, T.ArrayType) else F.map_from_arrays(none(kind.keyType), none(kind.valueType))


def without_null_lists(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(df with empty lists and maps in place of null ones and a mark for each, a function that puts the nulls back).

    Spark measures an Arrow batch after each row, and a list column for that goes over all null lists since its last other one: a batch would take the square of its rows.
    """
    some = {f"_null_{f.name}": f for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))}
    marked = df.withColumns({m: F.col(f.name).isNull() for m, f in some.items()}) if some else df
    filled = marked.withColumns({f.name: F.coalesce(f.name, no_entries(f.dataType)) for f in some.values()}) if some else df
    back = lambda out: out.withColumns({f.name: F.when(~F.col(m), F.col(f.name)) for m, f in some.items()}).drop(*some) if some else out
    return filled, back


@contextmanager
def scope(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Delete at its end what was written within it, but for the paths that `keep` then holds."""
    made: list[str] = []
    token = SCOPE.set(made)
    try:
        yield
    finally:
        SCOPE.reset(token)
        for path in made:
            if path in MADE and path not in keep:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete one of these paths."""
    if path in MADE:
        MADE.remove(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete what this process has written there; DataFrames that still read it can't be used afterwards."""
    while MADE:
        remove(spark, MADE[-1])
