"""Reads of array cells from a table of requests: joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.array import DistArray
from keyloom.plans.capture import accesses_of
from keyloom.plans.dependence import Fixed, Loop
from keyloom.plans.storage import fitting


def lookup(requests: DataFrame, a: DistArray, on: dict[str, str], name: str = "found", strict: bool = False) -> DataFrame:
    """``requests`` with the value of the cell they name: ``on`` maps key names to request columns. Without a cell no row, or an error if ``strict``."""
    right = a.df.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("value").alias(name), F.lit(True).alias("_there"))
    condition = [requests[c] == right[f"_{k}"] for k, c in on.items()]
    out = requests.join(right, condition, "left" if strict else "inner")
    if strict:
        missing = F.raise_error(F.lit("a requested key is not in the array"))
        out = out.withColumn("_there", F.coalesce("_there", missing)).where("_there")
    return out.drop("_there", *[f"_{k}" for k in on])


def lookup_or(requests: DataFrame, a: DistArray, on: dict[str, str], init: Column, name: str = "found") -> DataFrame:
    """As ``lookup``, with ``init`` where there is no cell."""
    right = a.df.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("value").alias(name), F.lit(True).alias("_there"))
    out = requests.join(right, [requests[c] == right[f"_{k}"] for k, c in on.items()], "left")
    return out.withColumn(name, F.when(F.col("_there"), F.col(name)).otherwise(init)).drop("_there", *[f"_{k}" for k in on])


def lookup_slice(requests: DataFrame, a: DistArray, dim: int, column: str, name: str = "vec") -> DataFrame:
    """``requests`` with the values along all other dimensions, in their order, at a coordinate of one."""
    return requests.join(a.blocks(dim).withColumnRenamed("vec", name), requests[column] == F.col("k")).drop("k")


def gather(requests: DataFrame, a: DistArray, on: dict[str, str]) -> DistArray:
    """The cells that any request names, each once: what a loop would fetch ahead."""
    keys = requests.select(*[F.col(c).alias(k) for k, c in on.items()]).distinct()
    return a.with_df(a.df.join(fitting(keys, 16 * len(on)), list(on), "left_semi"), dense=False)


def explode_lookup(samples: DataFrame, features: str, weights: DistArray) -> DataFrame:
    """Samples with data-dependent keys: each (fid, fval) of an array column with its weight."""
    rows = samples.withColumn("_f", F.explode(features)).select("*", F.col("_f.fid").alias("fid"), F.col("_f.fval").alias("fval")).drop("_f", features)
    return lookup(rows, weights, {"k1": "fid"}, "weight")


def gathered(space: DistArray, body: Callable, arrays: dict[str, DistArray], writes: dict | None = None) -> dict[str, DistArray]:
    """Of each array, the cells that a loop over ``space`` reads, as the body's source says: what it would fetch ahead.

    Subscripts that are loop keys, with or without a constant, and constants narrow the cells down, by semi-joins with the
    distinct keys of the space. Whole dimensions don't, nor do subscripts that depend on values or on what the body reads:
    those are slices of the body that a join on the read values replaces (``lookup``).
    """
    out = {}
    for name, a in arrays.items():
        parts = []
        for access in dict.fromkeys(x for x in accesses_of(body, list(arrays), writes) if x.array == name and not x.write):
            df = a.df
            for k, at in zip(a.key_names, access.subscripts):
                if isinstance(at, Fixed):
                    df = df.where(F.col(k) == at.value)
            loops = {k: at for k, at in zip(a.key_names, access.subscripts) if isinstance(at, Loop)}
            if loops:
                keys = space.df.select(*[(F.col(f"k{at.dim}") + at.offset).alias(k) for k, at in loops.items()]).distinct()
                df = df.join(fitting(keys, 16 * len(loops)), list(loops), "left_semi")
            parts.append(df.select(*a.key_names, "value"))
        cells = reduce(DataFrame.unionByName, parts) if parts else a.df.limit(0)
        out[name] = a.with_df(cells.dropDuplicates(a.key_names) if len(parts) > 1 else cells, dims=a.meta.dims, dense=False)
    return out
