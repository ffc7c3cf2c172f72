"""Write buffers: updates are gathered by key, combined, and applied to the target once.

Deltas are combined before the shuffle. With ``max_delay`` the loop runs in mini-batches of that many elements in key
order, and each batch's deltas are applied before the next; auto delay is as default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.array import DistArray
from keyloom.plans.meta import DelayMode
from keyloom.plans.storage import dropped, kept


class WriteBuffer:
    """``combine``: aggregate of a key's updates. ``apply(keys, old, update, *helpers)``: the new value, or with helper arrays a tuple of it and theirs."""

    def __init__(self, combine: Callable[[Column], Column] = F.sum, apply: Callable | None = None, delay: DelayMode = DelayMode.DEFAULT, max_delay: int | None = None):
        self.combine, self.delay, self.max_delay = combine, delay, max_delay
        self.apply = apply or (lambda keys, old, update, *_: old + update)

    def reset(self) -> WriteBuffer:
        """Back to adding up without delay: what it was registered with is dropped."""
        self.combine, self.apply, self.delay, self.max_delay = F.sum, lambda keys, old, update, *_: old + update, DelayMode.DEFAULT, None
        return self

    def delta(self, updates: DataFrame, keys: list[str], value: str = "update") -> DataFrame:
        return updates.groupBy(*keys).agg(self.combine(F.col(value)).alias("update"))

    def flush(self, target: DistArray, delta: DataFrame, helpers: tuple[DistArray, ...] = (), init: Column | None = None) -> DistArray | tuple[DistArray, ...]:
        """The target, and helpers if there are any, after one application. Untouched cells stay; with ``init`` new keys are added."""
        names = target.key_names
        rows = target.df.withColumn("_target", F.lit(True)).join(delta.withColumn("_touched", F.lit(True)), names, "left" if init is None else "full")
        old = F.col("value") if init is None else F.when(F.col("_target"), F.col("value")).otherwise(init)
        for k, h in enumerate(helpers):
            rows = rows.join(h.df.withColumnRenamed("value", f"_h{k}"), names, "left")
        held = [F.col(f"_h{k}") for k in range(len(helpers))]
        result = self.apply([F.col(n) for n in names], old, F.col("update"), *held)
        if not helpers:
            return target.with_df(rows.select(*names, F.when(F.col("_touched"), result).otherwise(old).alias("value")))
        after = [F.when(F.col("_touched"), new).otherwise(was).alias(f"_n{k}") for k, (new, was) in enumerate(zip(result, [old, *held], strict=True))]
        rows = kept(rows.select(*names, *after), "flushed")
        return tuple(a.with_df(rows.select(*names, F.col(f"_n{k}").alias("value"))) for k, a in enumerate((target, *helpers)))

    def run(self, space: DataFrame, order: list[str], target: DistArray, updates: Callable[[DataFrame, DistArray], DataFrame]) -> DistArray:
        """``updates(elements, target)`` gives k1..kN and ``update``. One application, or one per batch of ``max_delay`` elements."""
        if self.delay is not DelayMode.MAX_DELAY:
            return self.flush(target, self.delta(updates(space, target), target.key_names))
        batches = kept(numbered(space, order).withColumn("_batch", F.expr(f"_at div {int(self.max_delay)}")), "batches", by="_batch")
        last = batches.agg(F.max("_batch")).first()[0]
        before = None
        for b in range(0 if last is None else last + 1):
            elements = batches.where(F.col("_batch") == b).drop("_batch", "_at")  # one folder is read
            flushed = self.flush(target, self.delta(updates(elements, target), target.key_names))
            target = flushed.with_df(kept(flushed.df, "target"))
            dropped(*[] if before is None else [before])
            before = target.df
        dropped(batches)
        return target


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``_at``: 0-based place in the order of columns. Ranges are sorted apart and their sizes added up."""
    rows = kept(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_rank", place).join(starts, "_range").withColumn("_at", F.col("_before") + F.col("_rank") - 1).drop("_range", "_rank", "_before")


def last_writer(writes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Overwrites of one key: the one that a declared order puts last."""
    return writes.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def upsert(target: DistArray, new: DataFrame) -> DistArray:
    """Cells of ``new`` in place of the target's, and besides them."""
    old = target.df.join(new.select(*target.key_names), target.key_names, "left_anti")
    return target.with_df(old.unionByName(new.select(*target.key_names, "value")))
