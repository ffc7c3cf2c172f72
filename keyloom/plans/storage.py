"""Results kept in the folder that all executors share, so that lineage stays short and lost executors cost nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str = "kept", by: str | tuple[str, ...] = ()) -> DataFrame:
    """``df`` computed once, written as Parquet in the shared folder and read back; ``by``: in a folder for each value of columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    by = (by,) if isinstance(by, str) else by
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``kept`` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:  # of partitioned tables, each value's
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fitting(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` hinted for broadcast if its counted rows stay within BROADCAST_BYTES; otherwise left to a shuffle join."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
