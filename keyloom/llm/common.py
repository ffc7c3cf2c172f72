"""Shared folder, written tables and small expressions used by every operator here."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and Python character class of the six white-space characters that part words.
SPACE = "\\x20\\x09-\\x0D"

#: A side is broadcast only if its measured size stays below this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later stages don't depend on its executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_written(df: DataFrame, name: str, column: str, values: Iterable) -> dict[object, DataFrame]:
    """``df`` written once, in a folder for each value of ``column``, and read back as a table for each of ``values``."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    kept = T.StructType([f for f in df.schema.fields if f.name != column])
    out = {}
    for value in values:
        folder = f"{path}/{column}={value}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        table = spark.read.schema(kept).parquet(folder) if found else spark.createDataFrame([], kept)
        out[value] = table.select(*[F.lit(value).cast(f.dataType).alias(f.name) if f.name == column else f.name for f in df.schema.fields])
    return out


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, before the next ones are written.

    Spark's cleaner deletes them some time after the driver has collected its garbage; half a second is given to it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2 ... that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in itertools.count() if (n := f"_{name}_{k}" if k else f"_{name}").lower() not in taken)


def small_enough(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has so few rows that a broadcast of ``row_bytes`` each stays within ``bound``."""
    most = bound // row_bytes
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in ``bound``; else as it is, for a shuffle join."""
    return F.broadcast(df) if small_enough(df, row_bytes, bound) else df


_RESIDENT: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this worker process for later tasks. One at a time: another key's makes room first.

    Workers outlive tasks, so without this a worker would go on holding the memory of every operator that used it.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
