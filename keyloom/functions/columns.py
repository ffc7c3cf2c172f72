"""Scalar and vector functions over columns, all evaluated in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    """Sum of products, from the first element on; 0 for empty vectors."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)


def vector(op, u: Column, v: Column | None = None) -> Column:
    """``op`` element by element over one vector or two of equal length."""
    return F.transform(u, op) if v is None else F.zip_with(u, v, op)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def safe_log(x: Column) -> Column:
    """Logarithm with arguments below 1e-15 raised to it."""
    return F.log(F.when(F.abs(x) < 1e-15, F.lit(1e-15)).otherwise(x))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def find_index(values: Column, wanted: Column) -> Column:
    """1-based place of a value, 0 if it is absent."""
    return F.array_position(values, wanted)


def sorted_counts(counts: Column) -> Column:
    """Array of (count, topic) of non-zero counts, largest first, then by topic."""
    pairs = F.transform(counts, lambda c, k: F.struct(c.alias("count"), (k + 1).alias("topic")))
    nonzero = F.filter(pairs, lambda p: p["count"] > 0)
    order = lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1)).otherwise(
        F.when(a["topic"] < b["topic"], -1).when(a["topic"] > b["topic"], 1).otherwise(0)
    )
    return F.array_sort(nonzero, order)


def map_get(values: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(values, key), default)


def map_put(values: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def map_remove(values: Column, key: Column) -> Column:
    return F.map_filter(values, lambda k, _: k != key)


def lgamma(x: Column) -> Column:
    """Logarithm of the absolute gamma function, which Spark lacks: Stirling's series above 9, and below after raising the argument."""
    x = x.cast("double")

    def series(y: Column) -> Column:
        inverse = 1 / (y * y)
        tail = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse * (1 / 1188 - inverse * 691 / 360360))))) / y
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail

    def raised(y: Column) -> Column:
        product = y
        for k in range(1, 9):
            product = product * (y + k)
        return series(y + 9) - F.log(product)

    positive = lambda y: F.when(y > 9, series(y)).otherwise(raised(y))
    mirrored = math.log(math.pi) - F.log(F.abs(F.sin(math.pi * x))) - positive(1 - x)
    return F.when(x > 0, positive(x)).when(x == F.floor(x), F.lit(float("inf"))).otherwise(mirrored)
