"""Array metadata, enumerations and the arithmetic of keys.

Keys are tuples of 1-based longs in columns k1..kN. Their linear form is 0-based, first dimension fastest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

ParentType = Enum("ParentType", "TEXT_FILE DIST_ARRAY INIT")
InitType = Enum("InitType", "EMPTY UNIFORM_RANDOM NORMAL_RANDOM FILL")
MapType = Enum("MapType", "NO_MAP MAP MAP_FIXED_KEYS MAP_VALUES MAP_VALUES_NEW_KEYS GROUP_BY")
PartitionType = Enum(
    "PartitionType",
    "NAIVE ONE_D TWO_D TWO_D_UNIMODULAR RANGE MODULO_SERVER MODULO_EXECUTOR PARTIAL_MODULO_EXECUTOR PARTIAL_RANDOM_EXECUTOR HASH_EXECUTOR ONE_D_ORDERED",
)
IndexType = Enum("IndexType", "NONE RANGE")
LoopScheme = Enum("LoopScheme", "NAIVE ONE_D TWO_D UNIMODULAR NONE")
DelayMode = Enum("DelayMode", "DEFAULT MAX_DELAY AUTO")

#: Spark type of each primitive element type; unsigned ones are widened.
VALUE_TYPES = {
    "int8": "byte", "uint8": "short", "int16": "short", "uint16": "int", "int32": "int", "uint32": "long",
    "int64": "long", "uint64": "long", "float32": "float", "float64": "double", "string": "string",
}


@dataclass(frozen=True)
class Partitioning:
    """A partitioning scheme: what decides a cell's partition, and how many partitions there are."""

    kind: PartitionType = PartitionType.NAIVE
    dims: tuple[int, ...] = ()
    parts: tuple[int, ...] = ()
    bounds: tuple[tuple[int, ...], ...] = ()
    index: IndexType = IndexType.NONE
    #: Of a unimodular scheme: for each axis, a factor for each of ``dims`` and a constant.
    coefficients: tuple[tuple[int, ...], ...] = ()


@dataclass(frozen=True)
class Meta:
    num_dims: int
    dims: tuple[int, ...] | None = None
    dense: bool = False
    parent: ParentType = ParentType.DIST_ARRAY
    init: InitType = InitType.EMPTY
    map: MapType = MapType.NO_MAP
    init_value: object = None
    symbol: str | None = None
    partitioning: Partitioning = field(default_factory=Partitioning)
    parts_per_dim: int | None = None

    def but(self, **changes) -> Meta:
        return replace(self, **changes)


def key_names(n: int) -> list[str]:
    return [f"k{d}" for d in range(1, n + 1)]


def cells(dims: tuple[int, ...]) -> int:
    """How many cells dims span; linear keys must stay within 63 bits."""
    total = math.prod(dims)
    if total >= 1 << 63:
        raise OverflowError(f"{dims} span {total} cells: linear keys would not fit in 63 bits")
    return total


def linearize(keys: list[Column], dims: tuple[int, ...]) -> Column:
    """(k1-1) + d1*((k2-1) + d2*(...))."""
    cells(dims)
    out = None
    for key, dim in reversed(list(zip(keys, dims))):
        zero_based = key.cast("long") - 1
        out = zero_based if out is None else zero_based + F.lit(dim).cast("long") * out
    return out


def delinearize(linear: Column, dims: tuple[int, ...]) -> list[Column]:
    out, step = [], 1
    for dim in dims:
        out.append(F.pmod(floor_div(linear, step), F.lit(dim).cast("long")) + 1)
        step *= dim
    return out


def floor_div(value: Column, by: int) -> Column:
    """Integer quotient of non-negative longs, exact."""
    return F.call_function("div", value, F.lit(by).cast("long")) if by != 1 else value


def linear_key(key: tuple[int, ...], dims: tuple[int, ...]) -> int:
    out = 0
    for k, d in reversed(list(zip(key, dims))):
        out = out * d + (k - 1)
    return out


def key_of(linear: int, dims: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for d in dims:
        out.append(linear % d + 1)
        linear //= d
    return tuple(out)
