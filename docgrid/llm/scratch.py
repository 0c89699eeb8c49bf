"""Intermediate tables in the folder that the cluster shares.

A table written here cuts the lineage and survives the loss of an executor.
The folder is the one named by ``spark.checkpoint.dir``; only a local session
that names none gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.text import free_name

#: Name of the column that ``with_row_ids`` adds.
ROW = "__row"

#: Most rows, and most bytes of their files, that are ever broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 16 << 20

_local: dict[str, str] = {}
#: Where stored tables are, and for each thread the lists of those that open calls of ``settled`` pass through.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_passing = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="docgrid-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docgrid-{uuid.uuid4().hex}-{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems, so on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the result.

    The table is removed when the Python process ends, if Spark still runs, or by
    ``let_go``, or with the call of ``settled`` in which it was made.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    forget_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    for made in getattr(_passing, "open", [])[-1:]:
        made.append(path)
    return out


def let_go(table: DataFrame) -> None:
    """Remove a table from ``keep`` that nothing reads any more."""
    _forget(table.sparkSession, _stored.pop(table))


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``keep`` of what ``make`` returns; the tables that it stored on the way are removed then."""
    made: list[str] = []
    _passing.open = [*getattr(_passing, "open", []), made]
    try:
        df = make()
    finally:
        _passing.open = _passing.open[:-1]
    out = keep(df, name)
    for path in made:
        _forget(df.sparkSession, path)
    return out


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Remove a path when the Python process ends, if Spark still runs."""
    atexit.register(_forget, spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session is gone: nothing left to tidy with
        pass


def spread(df: DataFrame, stored: bool = False) -> DataFrame:
    """``df`` on all cores: a table of fewer splits than there are cores is dealt out anew, and ``stored`` if it is read often.

    Tables of many files are left as they are, without a look at their splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    dealt = df.repartition(cores)
    return keep(dealt, "spread") if stored else dealt


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long ``ROW`` per row, stored so that it stays the same; a column that is called so is put aside."""
    aside = [free_name(f"aside_{c}", df) for c in df.columns if c.lower() == ROW]
    for c, other in zip([c for c in df.columns if c.lower() == ROW], aside):
        df = df.withColumnRenamed(c, other)
    return keep(spread(df).withColumn(ROW, F.monotonically_increasing_id()), name)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a stored table."""
    spark = df.sparkSession
    total, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``limit`` rows and its files BROADCAST_BYTES.

    Beyond either the table is returned as it is, and Spark joins by a shuffle.
    """
    return F.broadcast(df) if df.count() <= limit and stored_bytes(df) <= BROADCAST_BYTES else df


def without_rows(rows: DataFrame, dropped: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``rows`` (from ``with_row_ids``) whose ``ROW`` isn't in ``dropped``, with the columns of ``docs``."""
    left = rows.join(sized(dropped), ROW, "left_anti").drop(ROW)
    return left.toDF(*docs.columns)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; memory that Arrow and the C library keep for reuse goes back to the system before the first and after each.

    A Python worker lives on from task to task, so what it keeps adds to the executor's memory in every later stage.
    """
    _release()
    for b in batches:
        yield b
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)
