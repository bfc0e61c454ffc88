"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="namelode-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no earlier stage."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table of ``written`` that no plan reads any more."""
    if (path := _tables.pop(table, None)) is not None:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Texts are long: smaller Arrow batches bound what the JVM and Python hold of them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy(run):
    """run(batches); then what the task has freed goes back to the system, for workers stay and serve later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def running_offsets(counts: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """counts with ``before`` (sum of n over smaller ``order`` of the same keys) and ``total`` (over all of them)."""
    from pyspark.sql import Window

    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("before", F.coalesce(F.sum(n).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(n).over(part))


def hash60(*cols: Column) -> Column:
    """60 bits of the MD5 of the columns joined by ':' (nulls as 'null'), as SQL elsewhere can compute them too."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")
