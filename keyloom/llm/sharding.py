"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in a task's memory, by a seeded hash. Pass two shuffles each
bucket by Fisher-Yates and puts the buckets one after another. The result is a seeded random order of all records, cut
into shards whose row counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import unused

#: Expected bytes of a bucket, which one task holds in memory at a time. A longer record makes a larger bucket.
BUCKET_BYTES = 16 << 20

#: Buckets whose rows are added up in one task.
GROUP = 4096

SEED = 42


def two_pass_shuffle(docs: DataFrame, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs``, all columns, with size (long), shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Law: rows. Any two shards' row counts are at most one apart, whatever ids or texts repeat; sizes follow by chance.
    size: UTF-8 bytes of the text (null: none) plus 8. Columns of ``docs`` with these three names are replaced. The
    hash takes the row's place in the input beside its id, so that an id in a third of all rows fills no bucket.
    ``docs`` must come from files or written tables: its rows must have the same places when read again. An empty
    table stays empty. The texts are shuffled once.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    row, bucket = unused(docs, "row"), unused(docs, "bucket")
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long") + 8
    rows = docs.select(*names, size.alias("size"), F.monotonically_increasing_id().alias(row))
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-total[1] // bucket_bytes))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), id_col, row), F.lit(buckets)))
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    # rows before each bucket, in two levels: within groups of buckets, and of the groups
    counts = counts.withColumn("_group", F.floor(F.col(bucket) / GROUP))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_n").over(before.orderBy("_group")), F.lit(0)).alias("_first"))  # one row a group
    within = F.coalesce(F.sum("_n").over(before.partitionBy("_group").orderBy(bucket)), F.lit(0))
    starts = counts.withColumn("_before", within).join(groups, "_group").select(F.col(bucket).alias(bucket), (F.col("_first") + F.col("_before")).cast("long").alias("_start"))
    count, at = total[0], [*names, "size"]

    def fisher_yates(records: pa.Table, start: pa.Table) -> pa.Table:
        if not records.num_rows:
            return records.select(at).append_column("shard", pa.array([], pa.int32())).append_column("slot", pa.array([], pa.int64()))
        records = records.take(pa.compute.sort_indices(records, sort_keys=[(row, "ascending")]))
        random = np.random.default_rng([seed, records.column(bucket)[0].as_py()])
        order = np.arange(records.num_rows)
        random.shuffle(order)  # Fisher-Yates
        place = start.column("_start")[0].as_py() + np.arange(records.num_rows)
        shard = place * shards // count
        slot = place + (-shard * count) // shards
        return records.select(at).take(pa.array(order)).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    schema = T.StructType([*rows.select(*at).schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return rows.groupBy(bucket).cogroup(starts.groupBy(bucket)).applyInArrow(fisher_yates, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard; a file's rows are in runs of consecutive slots."""
    shuffled.write.partitionBy("shard").parquet(path)
