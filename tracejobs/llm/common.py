"""Small things that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the five ASCII controls 9 to 13, as bytes.split() has it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch of texts, which JVM and Python hold several times over.
BATCH_BYTES = 4 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), a temporary folder that ends with the process; on a
    cluster that is an error, as executors would write to their own disks.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tracejobs-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it again: (table, path).

    This cuts the lineage with files that outlive any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/tracejobs/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has been counted to at most ``rows`` rows, else df as it is.

    Beyond the bound the join shuffles, and adaptive execution splits its skewed keys. df should be a stored table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_BYTES, unless it bounds them closer itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at = spark.conf.get(name, "64m").lower().removesuffix("b")
    now = int(at[:-1]) << {"k": 10, "m": 20, "g": 30}[at[-1]] if at[-1:] in "kmg" else int(at)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return what this Python worker has freed to the system, as workers wait for their next task without end."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving freed memory back when a task ends."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
