"""The array: a lazy table of keys k1..kN and a value, with its metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.meta import MapType, Meta, ParentType, Partitioning, PartitionType, cells, delinearize, key_names, linearize
from keyloom.plans.storage import dropped, kept

#: Arrays that were given a name.
NAMED: dict[str, DistArray] = {}


class DistArray:
    """Dense arrays have every key within dims; sparse ones those that are stored; rank 0 is a bag of values.

    Nothing is computed before ``materialize`` or an action on ``df``. Keys must be unique: ``unique`` checks or combines.
    """

    def __init__(self, df: DataFrame, meta: Meta):
        self.df, self.meta = df, meta
        self.tiled: dict[tuple, DataFrame] = {}  # cells cut for loops, by how they are cut
        self._cached = False

    # description

    @property
    def key_names(self) -> list[str]:
        return key_names(self.meta.num_dims)

    @property
    def keys(self) -> list[Column]:
        return [F.col(k) for k in self.key_names]

    @property
    def num_dims(self) -> int:
        return self.meta.num_dims

    @property
    def value_type(self) -> str:
        return self.df.schema["value"].dataType.simpleString()

    def with_df(self, df: DataFrame, **changes) -> DistArray:
        return DistArray(df, self.meta.but(**changes))

    def named(self, symbol: str) -> DistArray:
        """Registers the array and a view of its table under a name."""
        self.meta = self.meta.but(symbol=symbol)
        NAMED[symbol] = self
        self.df.createOrReplaceTempView(symbol)
        return self

    def set_parts_per_dim(self, n: int) -> DistArray:
        self.meta = self.meta.but(parts_per_dim=n)
        return self

    def parts_per_dim(self) -> int:
        return self.meta.parts_per_dim or 2 * self.df.sparkSession.sparkContext.defaultParallelism

    # life

    def materialize(self) -> DistArray:
        """Computes the table and infers dims, once. The table is written in the shared folder, so no executor is needed for it."""
        if not self._cached:
            self._source, self.df = self.df, kept(self.df, "array")
            self._cached = True
            self.size()
            if self.meta.symbol:
                self.df.createOrReplaceTempView(self.meta.symbol)
        return self

    def delete(self) -> None:
        if self._cached:
            dropped(self.df)
            self.df, self._cached = self._source, False
        dropped(*self.tiled.values())
        self.tiled.clear()
        if self.meta.symbol and NAMED.get(self.meta.symbol) is self:
            del NAMED[self.meta.symbol]
            self.df.sparkSession.catalog.dropTempView(self.meta.symbol)

    def size(self) -> tuple[int, ...]:
        """Dims; where they weren't given, the largest key of each dimension, by one aggregate."""
        if self.meta.dims is None:
            row = self.df.agg(*[F.max(k) for k in self.key_names]).first() if self.meta.num_dims else ()
            self.meta = self.meta.but(dims=tuple(int(x or 0) for x in row))
        return self.meta.dims

    def linear(self) -> DataFrame:
        """The table with ``lin_key``."""
        return self.df.withColumn("lin_key", linearize(self.keys, self.size()))

    def unique(self, combine: Callable[[Column], Column] | None = None) -> DistArray:
        """Repeated keys combined by an aggregate; without one, an error when a repeated key is read."""
        if combine is not None:
            return self.with_df(self.df.groupBy(*self.key_names).agg(combine(F.col("value")).alias("value")))
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key is repeated and no combiner was named"))).otherwise(F.lit(1))
        checked = self.df.groupBy(*self.key_names).agg(one.alias("_once"), F.first("value").alias("value"))
        return self.with_df(checked.where("_once = 1").drop("_once"))

    # maps

    def map(self, f: Callable, num_dims: int | None = None, dims: tuple[int, ...] | None = None, flatten: bool = False, dense: bool | None = None) -> DistArray:
        """``f(keys, value)`` gives (new keys, new value); flattened: an array of structs (k1..kN, value)."""
        return self._rekeyed(f(self.keys, F.col("value")), num_dims, dims, flatten, dense, MapType.MAP)

    def map_values_new_keys(self, f: Callable, num_dims: int | None = None, dims: tuple[int, ...] | None = None, flatten: bool = False, dense: bool | None = None) -> DistArray:
        """``f(value)`` gives (new keys, new value); flattened: an array of structs (k1..kN, value)."""
        return self._rekeyed(f(F.col("value")), num_dims, dims, flatten, dense, MapType.MAP_VALUES_NEW_KEYS)

    def _rekeyed(self, result, num_dims, dims, flatten, dense, kind) -> DistArray:
        n = num_dims if num_dims is not None else self.meta.num_dims
        if flatten:
            df = self.df.select(F.explode(result).alias("r")).select(*[F.col(f"r.{k}").cast("long").alias(k) for k in key_names(n)], F.col("r.value").alias("value"))
        else:
            keys, value = result
            df = self.df.select(*[k.cast("long").alias(name) for name, k in zip(key_names(n), keys, strict=True)], value.alias("value"))
        return self.with_df(df, num_dims=n, dims=dims, dense=self.meta.dense if dense is None else dense, map=kind, parent=ParentType.DIST_ARRAY, partitioning=Partitioning(), symbol=None)

    def map_fixed_keys(self, f: Callable) -> DistArray:
        """``f(keys, value)`` gives the new value; keys and partitioning stay."""
        return self.with_df(self.df.withColumn("value", f(self.keys, F.col("value"))), map=MapType.MAP_FIXED_KEYS, parent=ParentType.DIST_ARRAY, symbol=None)

    def map_values(self, f: Callable[[Column], Column]) -> DistArray:
        """``f(value)`` gives the new value; keys and partitioning stay."""
        return self.with_df(self.df.withColumn("value", f(F.col("value"))), map=MapType.MAP_VALUES, parent=ParentType.DIST_ARRAY, symbol=None)

    def map_batches(self, f: Callable, value_type: str, num_dims: int | None = None, dims: tuple[int, ...] | None = None) -> DistArray:
        """``f`` from iterators of pandas frames to such, for what columns can't express; the result has k1..kN and value."""
        n = num_dims if num_dims is not None else self.meta.num_dims
        schema = ", ".join([*(f"{k} long" for k in key_names(n)), f"value {value_type}"])
        return self.with_df(self.df.mapInPandas(f, schema), num_dims=n, dims=dims, map=MapType.MAP, partitioning=Partitioning(), symbol=None)

    def densify(self, init: Column, dims: tuple[int, ...] | None = None) -> DistArray:
        """Every cell within dims; those that aren't stored get ``init``."""
        dims = dims or self.size()
        every = self.df.sparkSession.range(cells(dims)).select(*[c.alias(k) for c, k in zip(delinearize(F.col("id"), dims), self.key_names)])
        found = every.join(self.df.withColumn("_there", F.lit(True)), self.key_names, "left")
        df = found.select(*self.key_names, F.when(F.col("_there"), F.col("value")).otherwise(init).alias("value"))
        return self.with_df(df, dims=tuple(dims), dense=True)

    def sparsify(self, absent: Callable[[Column], Column]) -> DistArray:
        """Without the cells whose value ``absent`` holds for."""
        return self.with_df(self.df.where(~absent(F.col("value"))), dense=False)

    def blocks(self, dim: int) -> DataFrame:
        """``k``, ``vec``: of each coordinate of a dimension, the values in the order of the other keys."""
        others = [k for d, k in enumerate(self.key_names, 1) if d != dim]
        rows = self.df.groupBy(F.col(f"k{dim}").alias("k")).agg(F.array_sort(F.collect_list(F.struct(*others[::-1], "value"))).alias("r"))
        return rows.select("k", F.transform("r", lambda r: r["value"]).alias("vec"))

    def partitioned_as(self, partitioning: Partitioning, df: DataFrame) -> DistArray:
        return self.with_df(df, partitioning=partitioning)

    def is_partitioned_as(self, partitioning: Partitioning) -> bool:
        return self.meta.partitioning == partitioning and partitioning.kind is not PartitionType.NAIVE
