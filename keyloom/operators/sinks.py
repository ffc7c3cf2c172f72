"""Arrays as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.operators.array import DistArray


def save_as_text(a: DistArray, path: str, to_string: Callable[[list[Column], Column], Column] | None = None, mode: str = "error") -> None:
    """One record a line, one file a partition, in Spark's naming. By default keys and value, comma-joined."""
    to_string = to_string or (lambda keys, value: F.concat_ws(",", *keys, value))
    a.df.select(to_string(a.keys, F.col("value")).alias("value")).write.mode(mode).text(path)
