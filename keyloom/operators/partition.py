"""Partitioning schemes: a column that names each cell's partition, and the exchange that realises it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.array import DistArray
from keyloom.operators.groups import bin_of, histogram
from keyloom.plans.meta import IndexType, Partitioning, PartitionType, floor_div, linearize
from keyloom.plans.schedule import tile_size
from keyloom.plans.storage import fitting


def tile(key: Column, dim: int, parts: int) -> Column:
    """Equal tiles of a 1-based coordinate."""
    return floor_div(key.cast("long") - 1, tile_size(dim, parts))


def tile_by_bounds(key: Column, bounds: Sequence[int]) -> Column:
    """How many inclusive 0-based upper bounds lie below the coordinate."""
    return F.size(F.filter(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), lambda b: b < key.cast("long") - 1)).cast("long")


def equal_mass_bounds(counts: Sequence[tuple[int, int]], dim: int, bins: int, parts: int) -> list[int]:
    """Inclusive 0-based upper coordinates of ``parts`` ranges of about equal mass, the last at the end of the dimension.

    ``counts``: (bin, mass) of a histogram of ``bins`` bins. Mass is spread evenly inside a bin.
    """
    full = -(-dim // bins)
    large = bins if dim % bins == 0 else dim % bins
    start = lambda b: b * full if b <= large else large * full + (b - large) * (full - 1)
    total, seen, bounds = sum(n for _, n in counts), 0.0, []
    for b, n in sorted(counts):
        lo, width = start(b), start(b + 1) - start(b)
        while len(bounds) < parts - 1 and n and seen + n >= (want := total * (len(bounds) + 1) / parts):
            inside = -(-(want - seen) * width // n)
            bounds.append(int(min(dim - 1, max(lo + inside - 1, (bounds[-1] if bounds else 0)))))
        seen += n
    return [*bounds, *[dim - 1] * (parts - len(bounds))]


def first_executor(pid: Column, executors: int) -> Column:
    """Where a partition of the ordered scheme starts, so that the first wave of executors is aligned."""
    return F.pmod(F.lit(executors) - F.pmod(pid, F.lit(executors)), F.lit(executors)).cast("long")


def with_partition(a: DistArray, p: Partitioning, key_func: Callable[[list[Column]], Column] | None = None, seed: int = 0) -> DataFrame:
    """The array's table with ``pid``; two-dimensional schemes have ``sid`` and ``tid`` too, and ``pid`` is ``sid``.

    Dimensions with bounds are cut by them, others into equal tiles. Unimodular axes are tiles, of ``parts`` wide, of a sum
    of keys times factors. The ordered scheme has ``executor`` too, where each partition is first placed.
    """
    kind, keys, dims = p.kind, a.keys, a.size()

    def one(at: int) -> Column:
        d = p.dims[at]
        return tile_by_bounds(keys[d - 1], p.bounds[at]) if p.bounds and p.bounds[at] else tile(keys[d - 1], dims[d - 1], p.parts[at])

    if kind is PartitionType.ONE_D:
        return a.df.withColumn("pid", one(0))
    if kind is PartitionType.ONE_D_ORDERED:
        return a.df.withColumn("pid", one(0)).withColumn("executor", first_executor(F.col("pid"), p.parts[0]))
    if kind is PartitionType.TWO_D_UNIMODULAR:
        axes = [sum((keys[d - 1] * f for d, f in zip(p.dims, c)), F.lit(c[-1])) for c in p.coefficients]
        sid, tid = (floor_div(axis, width) for axis, width in zip(axes, p.parts))
        return a.df.withColumn("sid", sid).withColumn("tid", tid).withColumn("pid", F.col("sid"))
    if kind is PartitionType.TWO_D:
        return a.df.withColumn("sid", one(0)).withColumn("tid", one(1)).withColumn("pid", F.col("sid"))
    if kind in (PartitionType.MODULO_SERVER, PartitionType.MODULO_EXECUTOR):
        pid = F.pmod(linearize(keys, dims), F.lit(p.parts[0]).cast("long"))
    elif kind is PartitionType.PARTIAL_MODULO_EXECUTOR:
        pid = F.pmod(linearize([keys[d - 1] for d in p.dims], tuple(dims[d - 1] for d in p.dims)), F.lit(p.parts[0]).cast("long"))
    elif kind is PartitionType.PARTIAL_RANDOM_EXECUTOR:
        pid = F.pmod(F.xxhash64(F.lit(seed), *[keys[d - 1] for d in p.dims]), F.lit(p.parts[0]).cast("long"))
    elif kind is PartitionType.HASH_EXECUTOR:
        pid = F.pmod(key_func(keys).cast("long"), F.lit(p.parts[0]).cast("long"))
    else:
        raise ValueError(f"nothing is repartitioned to {kind.name}")
    return a.df.withColumn("pid", pid)


def repartition(a: DistArray, p: Partitioning, key_func: Callable[[list[Column]], Column] | None = None, seed: int = 0, ordered: bool = False) -> DistArray:
    """The array exchanged to ``p``: partition i holds the cells of id i. As it is if it is partitioned so already.

    ``ordered`` sorts each partition by linear key.
    """
    if a.is_partitioned_as(p):
        return a
    if p.kind is PartitionType.RANGE:
        df = a.linear().repartitionByRange(p.parts[0], "lin_key").drop("lin_key")
        return a.partitioned_as(p, df)
    rows = with_partition(a, p, key_func, seed)
    df = rows.repartitionById(p.parts[0], F.col("pid").cast("int"))
    if ordered:
        df = df.withColumn("_lin", linearize(a.keys, a.size())).sortWithinPartitions("_lin").drop("_lin")
    return a.partitioned_as(p, df.select(*a.key_names, "value"))


def balanced(a: DistArray, dim: int, parts: int, bins_per_part: int = 10) -> Partitioning:
    """A one-dimensional scheme of equal mass, from a histogram of at most ``bins_per_part`` bins a part."""
    size = a.size()[dim - 1]
    bins = max(1, min(size, bins_per_part * parts))
    counts = [(r["bin"], r["count"]) for r in histogram(a, dim, bins).collect()]
    return Partitioning(PartitionType.ONE_D, (dim,), (parts,), (tuple(equal_mass_bounds(counts, size, bins, parts)),))


def balanced_2d(a: DistArray, dims: tuple[int, int], parts: tuple[int, int], by_mass: tuple[bool, bool] = (True, True), bins_per_part: int = 10) -> Partitioning:
    """A two-dimensional scheme: dimensions ``by_mass`` get ranges of equal mass, from a histogram each, others equal tiles."""
    bounds = tuple(balanced(a, d, n, bins_per_part).bounds[0] if mass else () for d, n, mass in zip(dims, parts, by_mass))
    return Partitioning(PartitionType.TWO_D, dims, parts, bounds)


def reindexed(a: DistArray, index: IndexType) -> DistArray:
    """The array with another index on its partitions; no cell moves, as lookups are joins."""
    return a.with_df(a.df, partitioning=replace(a.meta.partitioning, index=index))


def remap_table(a: DistArray, dims: tuple[int, ...], seed: int = 0) -> DataFrame:
    """Partial keys and ``new_key`` (1-based, linear): their ranks in the order of a digest, so an injective renumbering.

    Ranks are counted in 256 ranges of the digest and added up, so no task sorts all keys.
    """
    names = [f"k{d}" for d in dims]
    digest = F.md5(F.concat_ws(",", *[F.lit(seed).cast("string")] * bool(seed), *names))
    keys = a.df.select(*names).distinct().withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 2))
    sizes = keys.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_digest", *names))
    return keys.withColumn("_rank", rank).join(F.broadcast(starts), "_range").select(*names, (F.col("_before") + F.col("_rank")).alias("new_key"))


def random_remap(a: DistArray, dim: int, seed: int = 0) -> DistArray:
    """The array with the coordinates of a dimension renumbered at random within its range, for balance."""
    table = fitting(remap_table(a, (dim,), seed), 16)
    moved = a.df.join(table, f"k{dim}").withColumn(f"k{dim}", F.col("new_key")).select(*a.key_names, "value")
    return a.with_df(moved, dims=a.size(), partitioning=Partitioning())


def partition_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid").agg(F.count(F.lit(1)).alias("cells"))


__all__ = ["balanced", "balanced_2d", "bin_of", "equal_mass_bounds", "first_executor", "partition_sizes", "random_remap", "reindexed", "remap_table", "repartition", "tile", "tile_by_bounds", "with_partition"]
