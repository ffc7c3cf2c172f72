"""Line-oriented text as arrays.

Lines are numbered from 1 in the order of file names and positions, blank ones included; blank lines are then left out.
Numbering counts the lines of each split, adds the counts up over splits, and adds a line's place in its split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.operators.array import DistArray
from keyloom.plans.meta import MapType, Meta, ParentType, key_names
from keyloom.plans.storage import fitting


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of each line that isn't blank. Splits follow spark.sql.files.maxPartitionBytes; any Hadoop file system."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no``, ``line`` of each line that isn't blank."""
    read = spark.read.text(path)
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    read = read.select("value", *split, F.monotonically_increasing_id().alias("_row"))
    sizes = read.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    starts = sizes.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = read.join(fitting(starts, 256), ["_file", "_block"])
    return out.where(F.length(F.trim("value")) > 0).select((F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no"), F.col("value").alias("line"))


def text_file(spark: SparkSession, path: str, parse: Callable | None = None, *, with_line_number: bool = False, new_keys: bool = True, flatten: bool = False, num_dims: int = 1, dense: bool = False) -> DistArray:
    """An array of a file's records.

    ``parse`` builds columns from ``line`` or, with line numbers, from ``(line_no, line)``:

    * new keys: ``(keys, value)``, or with ``flatten`` an array of structs (k1..kN, value), of which any number may be there;
    * no new keys but line numbers: the value; its key is the line number;
    * neither: the value; the result is a bag without keys.

    Without ``parse`` the value is the line.
    """
    source = numbered_lines(spark, path) if with_line_number else lines(spark, path)
    args: list[Column] = [F.col("line_no"), F.col("line")] if with_line_number else [F.col("line")]
    if flatten and not new_keys:
        raise ValueError("records can only be flattened if the parser gives keys")
    if parse is None:
        new_keys, parse = False, (lambda *a: a[-1])
    kind = {(True, True): MapType.MAP, (False, True): MapType.MAP_VALUES_NEW_KEYS, (True, False): MapType.MAP_FIXED_KEYS, (False, False): MapType.MAP_VALUES}[with_line_number, new_keys]
    parsed = parse(*args)
    if flatten:
        df = source.select(F.explode(parsed).alias("r")).select(*[F.col(f"r.{k}").cast("long").alias(k) for k in key_names(num_dims)], F.col("r.value").alias("value"))
    elif new_keys:
        keys, value = parsed
        df = source.select(*[k.cast("long").alias(n) for n, k in zip(key_names(num_dims), keys, strict=True)], value.alias("value"))
    elif with_line_number:
        df, num_dims = source.select(F.col("line_no").cast("long").alias("k1"), parsed.alias("value")), 1
    else:
        df, num_dims = source.select(parsed.alias("value")), 0
    return DistArray(df, Meta(num_dims, None, dense, ParentType.TEXT_FILE, map=kind))
