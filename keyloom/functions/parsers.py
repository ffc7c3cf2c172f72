"""Parsers of text records, as column expressions: a line gives a key and a value, or an array of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rating(line: Column, sep: str = ",", first_id: int = 0) -> tuple[tuple[Column, Column], Column]:
    """``user,item,rating``: key (item, user), 1-based; ids in the file start at ``first_id``."""
    parts = F.split(line, F.lit("\\Q" + sep + "\\E") if len(sep) == 1 and not sep.isalnum() else sep)
    at = lambda k: F.trim(F.element_at(parts, k))
    return (at(2).cast("long") + (1 - first_id), at(1).cast("long") + (1 - first_id)), at(3).cast("float")


def libsvm(line: Column) -> Column:
    """``label fid:val ...``: struct of y (label -1 counts as 0) and features (fid, fval)."""
    parts = F.split(F.trim(line), r"\s+")
    label = F.element_at(parts, 1).cast("double").cast("long")
    features = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.element_at(F.split(p, ":"), 1).cast("long").alias("fid"), F.element_at(F.split(p, ":"), 2).cast("float").alias("fval")))
    return F.struct(F.when(label == -1, 0).otherwise(label).cast("long").alias("y"), features.alias("features"))


def word_counts(line_no: Column, line: Column) -> Column:
    """``docid wid:cnt ...``: array of (k1: occurrence, k2: word, k3: document, value 0), one entry a token."""
    parts = F.split(F.trim(line), r"\s+")
    pairs = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    tokens = F.transform(
        pairs,
        lambda p: F.transform(
            F.sequence(F.lit(1).cast("long"), F.element_at(F.split(p, ":"), 2).cast("long")),
            lambda n: F.struct(n.alias("k1"), (F.element_at(F.split(p, ":"), 1).cast("long") + 1).alias("k2"), line_no.alias("k3"), F.lit(0).alias("value")),
        ),
    )
    return F.flatten(tokens)
