"""Arrays of generated cells: constant, uniform, normal, empty; and arrays over tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.array import DistArray
from keyloom.plans.meta import InitType, Meta, ParentType, cells, delinearize, key_names


def _dense(spark: SparkSession, dims: Sequence[int], value: Column, init: InitType, init_value: object = None, parts: int | None = None) -> DistArray:
    dims = tuple(int(d) for d in dims)
    n = cells(dims)
    rows = spark.range(0, n, 1, parts) if parts else spark.range(n)  # contiguous, near-equal ranges of linear keys
    keys = [c.alias(k) for c, k in zip(delinearize(F.col("id"), dims), key_names(len(dims)))]
    return DistArray(rows.select(*keys, value.alias("value")), Meta(len(dims), dims, True, ParentType.INIT, init, init_value=init_value))


def fill(spark: SparkSession, value: Column | float | int | str, *dims: int, parts: int | None = None) -> DistArray:
    return _dense(spark, dims, value if isinstance(value, Column) else F.lit(value), InitType.FILL, value, parts)


def _uniform(seed: int, at: int) -> Column:
    """52 bits of a digest of the seed and the linear key: the same however the cells are parted or a task is run again."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), at, 13), 16, 10).cast("double")


def rand(spark: SparkSession, *dims: int, dtype: str = "float", seed: int = 1, parts: int | None = None) -> DistArray:
    """Uniform in [0, 1), a function of seed and key."""
    return _dense(spark, dims, (_uniform(seed, 1) / float(1 << 52)).cast(dtype), InitType.UNIFORM_RANDOM, None, parts)


def randn(spark: SparkSession, *dims: int, dtype: str = "float", seed: int = 1, parts: int | None = None) -> DistArray:
    """Normal with mean 0 and deviation 1, a function of seed and key, from two uniform numbers."""
    radius = F.sqrt(-2 * F.log((_uniform(seed, 1) + 1) / float(1 << 52)))
    return _dense(spark, dims, (radius * F.cos(2 * math.pi * _uniform(seed, 14) / float(1 << 52))).cast(dtype), InitType.NORMAL_RANDOM, None, parts)


def empty(spark: SparkSession, value_type: str, *dims: int) -> DistArray:
    schema = ", ".join([*(f"{k} long" for k in key_names(len(dims))), f"value {value_type}"])
    return DistArray(spark.createDataFrame([], schema), Meta(len(dims), tuple(dims), False, ParentType.INIT, InitType.EMPTY))


def from_table(df: DataFrame, keys: Sequence[Column], value: Column, dims: Sequence[int] | None = None, dense: bool = False) -> DistArray:
    """An array over any table: ``keys`` are 1-based and must tell the rows apart."""
    columns = [k.cast("long").alias(n) for n, k in zip(key_names(len(keys)), keys)]
    return DistArray(df.select(*columns, value.alias("value")), Meta(len(keys), tuple(dims) if dims else None, dense))
