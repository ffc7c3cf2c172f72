"""One query per operator over the given tables, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import columns as C
from keyloom.operators import access, groups, partition
from keyloom.operators.array import DistArray
from keyloom.operators.buffers import WriteBuffer, last_writer, upsert
from keyloom.operators.loops import for_each_group, parallel_for
from keyloom.operators.sinks import save_as_text
from keyloom.plans.meta import Meta, Partitioning, PartitionType, delinearize, linearize
from keyloom.plans.schedule import rotation, wavefront
from keyloom.plans.storage import scratch_path
from keyloom.sources.cells import fill, from_table, rand, randn
from keyloom.sources.text import text_file
from keyloom.workloads import lda, lr, mf

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RATINGS = "r AS (SELECT l_partkey + 1 AS k1, l_suppkey + 1 AS k2, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2), d AS (SELECT max(k1) AS d1, max(k2) AS d2 FROM r)"
RANK = 4


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DistArray:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows = rows.groupBy((F.col("user_id") + 1).alias("k1"), F.dayofmonth("ts").cast("long").alias("k2"))
    return DistArray(rows.agg(F.count(F.lit(1)).alias("value")), Meta(2))


EVENTS = "e AS (SELECT user_id + 1 AS k1, CAST(day(ts) AS BIGINT) AS k2, count(*) AS value FROM events GROUP BY 1, 2)"


# keys


@query(f"WITH {RATINGS} SELECT d1, d2 FROM d")
def q_dims(spark, sf):
    a = mf.ratings(spark, sf)
    return a.df.agg(F.max("k1").alias("d1"), F.max("k2").alias("d2"))


@query(f"WITH {RATINGS} SELECT k1, k2, (k1 - 1) + d1 * (k2 - 1) AS lin_key FROM r, d")
def q_linearize(spark, sf):
    return mf.ratings(spark, sf).linear().select("k1", "k2", "lin_key")


@query(f"WITH {RATINGS}, l AS (SELECT (k1 - 1) + d1 * (k2 - 1) AS lin_key, d1, d2 FROM r, d) SELECT lin_key, lin_key % d1 + 1 AS a, lin_key // d1 % d2 + 1 AS b FROM l")
def q_delinearize(spark, sf):
    a = mf.ratings(spark, sf)
    rows = a.linear()
    one, two = delinearize(F.col("lin_key"), a.size())
    return rows.select("lin_key", one.alias("a"), two.alias("b"))


@query("SELECT e.event_id, e.user_id + 1 AS k1, e.user_id + (SELECT max(user_id) + 1 FROM events) * hour(ts) AS partial_key FROM events e")
def q_partial_key(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("user_id") + 1).alias("k1"), (F.hour("ts") + 1).cast("long").alias("k2"))
    users = DistArray(rows, Meta(1)).size()[0]
    return rows.select("event_id", "k1", linearize([F.col("k1"), F.col("k2")], (users, 24)).alias("partial_key"))


# sources


def _written_text(spark: SparkSession, sf: str, name: str, rows: DataFrame) -> str:
    path = scratch_path(spark, f"text-{name}")
    rows.write.text(path)
    return path


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS line_no, n_name AS line FROM nation")
def q_line_numbers(spark, sf):
    from keyloom.sources.text import numbered_lines

    path = _written_text(spark, sf, "nation", spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").select("n_name").coalesce(1))
    return numbered_lines(spark, path)


@query("SELECT o_custkey + 1 AS k1, o_orderkey + 1 AS k2, CAST(CAST(o_totalprice AS BIGINT) AS FLOAT) AS value FROM orders")
def q_text_ratings(spark, sf):
    from keyloom.functions.parsers import rating

    rows = spark.read.parquet(f"{sf}/orders.parquet")
    # DuckDB's cast rounds half to even
    path = _written_text(spark, sf, "ratings", rows.select(F.concat_ws(",", "o_orderkey", "o_custkey", F.rint("o_totalprice").cast("long"))))
    return text_file(spark, path, rating, num_dims=2).df


@query("SELECT vec_id + 1 AS id, CAST(label >= 5 AS BIGINT) AS y, len(embedding) AS features FROM embeddings")
def q_text_libsvm(spark, sf):
    from keyloom.functions.parsers import libsvm

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id")
    label = F.when(F.col("label") >= 5, "1").otherwise("-1")
    pairs = F.array_join(F.transform("embedding", lambda v, k: F.concat(k + 1, F.lit(":"), v)), " ")
    path = _written_text(spark, sf, "libsvm", rows.select(F.concat_ws(" ", label, pairs)).coalesce(1))
    a = text_file(spark, path, lambda no, line: libsvm(line), with_line_number=True, new_keys=False)
    return a.df.select(F.col("k1").alias("id"), "value.y", F.size("value.features").cast("long").alias("features"))


@query("SELECT CAST(i % 20 + 1 AS BIGINT) AS k1, CAST(i // 20 + 1 AS BIGINT) AS k2, 0.5::DOUBLE AS value FROM range(300) t(i)")
def q_fill(spark, sf):
    return fill(spark, 0.5, 20, 15).df


@query("SELECT CAST(i // 25 AS BIGINT) AS block, min(i) AS lo, max(i) AS hi, count(*) AS cells FROM range(100) t(i) GROUP BY 1")
def q_range_blocks(spark, sf):
    a = fill(spark, 1, 10, 10, parts=4)
    rows = a.linear().withColumn("block", F.spark_partition_id().cast("long"))
    return rows.groupBy("block").agg(F.min("lin_key").alias("lo"), F.max("lin_key").alias("hi"), F.count(F.lit(1)).alias("cells"))


def _draw(seed: int, at: int) -> str:
    """The SQL of a uniform number of cell i: 52 bits of a digest."""
    return f"CAST(('0x' || substr(md5('{seed}:' || i), {at}, 13)) AS BIGINT)"


@query(
    f"SELECT CAST(i % 40 + 1 AS BIGINT) AS k1, CAST(i // 40 + 1 AS BIGINT) AS k2, round({_draw(1, 1)} / pow(2, 52), 9) AS u, "
    f"round(sqrt(-2 * ln(({_draw(2, 1)} + 1) / pow(2, 52))) * cos(2 * pi() * {_draw(2, 14)} / pow(2, 52)) / 10, 9) AS n FROM range(2000) t(i)"
)
def q_random_fill(spark, sf):
    u, n = rand(spark, 40, 50, dtype="double", seed=1).df, randn(spark, 40, 50, dtype="double", seed=2).map_values(lambda v: v / 10).df
    return u.withColumnRenamed("value", "u").join(n.withColumnRenamed("value", "n"), ["k1", "k2"]).select("k1", "k2", F.round("u", 9).alias("u"), F.round("n", 9).alias("n"))


# maps


@query(f"WITH {RATINGS} SELECT k2 AS k1, k1 AS k2, value * 2 + k1 AS value FROM r")
def q_map(spark, sf):
    return mf.ratings(spark, sf).map(lambda k, v: ((k[1], k[0]), v * 2 + k[0])).df


@query(f"WITH {RATINGS} SELECT k1, k2, value + k1 * 10 + k2 AS value FROM r")
def q_map_fixed_keys(spark, sf):
    return mf.ratings(spark, sf).map_fixed_keys(lambda k, v: v + k[0] * 10 + k[1]).df


@query(f"WITH {RATINGS} SELECT k1, k2, value * value AS value FROM r")
def q_map_values(spark, sf):
    return mf.ratings(spark, sf).map_values(lambda v: v * v).df


@query(f"WITH {EVENTS} SELECT value AS k1, CAST(sum(1) AS BIGINT) AS value FROM e GROUP BY 1")
def q_map_values_new_keys(spark, sf):
    a = _events(spark, sf).map_values_new_keys(lambda v: ((v,), F.lit(1).cast("long")), num_dims=1)
    return a.unique(F.sum).df


@query(f"WITH {RATINGS} SELECT k1, k2, (value + 1) * k1 - k2 AS value FROM r WHERE (value + 1) * k1 - k2 > 100")
def q_map_chain(spark, sf):
    a = mf.ratings(spark, sf).map_values(lambda v: v + 1).map_fixed_keys(lambda k, v: v * k[0] - k[1])
    return a.df.where("value > 100")


@query("SELECT k1, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id + 1 AS k1, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def q_flatten(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = from_table(docs, [F.col("doc_id") + 1], F.col("text"))
    words = a.map(lambda k, v: F.transform(F.filter(F.split(v, r"\s+"), lambda w: w != ""), lambda w, i: F.struct(k[0].alias("k1"), (i + 1).alias("k2"), w.alias("value"))), num_dims=2, flatten=True)
    return words.df.groupBy("k1").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id + 1 AS k1, u.key AS name, CAST(json_extract(props, '$.' || u.key) AS BIGINT) AS value FROM events, unnest(json_keys(props)) AS u(key)")
def q_flatten_props(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select((F.col("event_id") + 1).alias("k1"), F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))


@query(f"WITH {EVENTS}, d AS (SELECT max(k1) AS d1, max(k2) AS d2 FROM e) SELECT CAST(i + 1 AS BIGINT) AS k1, CAST(j + 1 AS BIGINT) AS k2, coalesce(value, 0) AS value FROM (SELECT unnest(range(d1)) AS i FROM d) CROSS JOIN (SELECT unnest(range(d2)) AS j FROM d) LEFT JOIN e ON k1 = i + 1 AND k2 = j + 1")
def q_densify(spark, sf):
    return _events(spark, sf).densify(F.lit(0).cast("long")).df


@query(f"WITH {EVENTS} SELECT k1, k2, value FROM e WHERE value >= 3")
def q_sparsify(spark, sf):
    return _events(spark, sf).sparsify(lambda v: v < 3).df


# groups


@query(f"WITH {RATINGS} SELECT k1 % 10 + 1 AS k1, round(sum(value), 4) AS value FROM r GROUP BY 1")
def q_group_by_key(spark, sf):
    a = groups.group_by(mf.ratings(spark, sf), lambda k: (k[0] % 10 + 1,), lambda k, v: F.sum(v))
    return a.map_values(lambda v: F.round(v, 4)).df


@query(f"WITH {EVENTS}, o AS (SELECT k1, value, row_number() OVER (PARTITION BY k1 ORDER BY k2) AS n FROM e) SELECT k1, CAST(sum(value * n) AS DOUBLE) AS value FROM o GROUP BY 1")
def q_group_fold(spark, sf):
    def fold(rows):
        import pandas as pd

        return pd.DataFrame({"k1": [int(rows["k1"].iloc[0])], "value": [float(sum((i + 1) * v for i, v in enumerate(rows["value"])))]})

    return groups.group_fold(_events(spark, sf), lambda k: k[0], fold, "double", 1).df


@query(f"WITH {EVENTS} SELECT CAST(sum(value) AS BIGINT) AS total, max(value) AS most, min(value) AS least, bit_xor(k1) AS mark FROM e")
def q_accumulators(spark, sf):
    v = F.col("value")
    return groups.accumulate(_events(spark, sf).df, total=("+", v), most=("max", v), least=("min", v), mark=("xor", F.col("k1")))


@query(
    f"WITH {RATINGS}, p AS (SELECT k1 - 1 AS c, d1 AS dd, ceil(d1 / 64.0)::BIGINT AS fl, CASE WHEN d1 % 64 = 0 THEN 64 ELSE d1 % 64 END AS nf FROM r, d) "
    "SELECT CASE WHEN c <= nf * fl - 1 THEN c // fl ELSE (c - fl * nf) // greatest(fl - 1, 1) + nf END AS bin, count(*) AS count FROM p GROUP BY 1"
)
def q_histogram(spark, sf):
    return groups.histogram(mf.ratings(spark, sf), 1, 64)


@query(f"WITH {RATINGS} SELECT count(DISTINCT k1) AS distinct_parts, count(DISTINCT k2) AS distinct_suppliers FROM r")
def q_distinct_partial_keys(spark, sf):
    a = mf.ratings(spark, sf)
    return a.df.agg(F.count_distinct("k1").alias("distinct_parts"), F.count_distinct("k2").alias("distinct_suppliers"))


# partitions


def _part(kind: PartitionType, *columns: str, dims=(), parts=(4,), bounds=(), key_func=None):
    def run(spark, sf):
        a = mf.ratings(spark, sf)
        rows = partition.with_partition(a, Partitioning(kind, dims, parts, bounds), key_func)
        return rows.select("k1", "k2", *columns)

    return run


@query(f"WITH {RATINGS} SELECT k1, k2, (k1 - 1) // ((d1 + 7) // 8) AS pid FROM r, d")
def q_part_1d(spark, sf):
    return _part(PartitionType.ONE_D, "pid", dims=(1,), parts=(8,))(spark, sf)


@query(f"WITH {RATINGS} SELECT k1, k2, (k2 - 1) // ((d2 + 3) // 4) AS sid, (k1 - 1) // ((d1 + 3) // 4) AS tid FROM r, d")
def q_part_2d(spark, sf):
    return _part(PartitionType.TWO_D, "sid", "tid", dims=(2, 1), parts=(4, 4))(spark, sf)


@query(f"WITH {RATINGS} SELECT k1, k2, CASE WHEN k1 - 1 <= 99 THEN 0 WHEN k1 - 1 <= 140 THEN 1 WHEN k1 - 1 <= 180 THEN 2 ELSE 3 END::BIGINT AS pid FROM r")
def q_part_1d_hist(spark, sf):
    return _part(PartitionType.ONE_D, "pid", dims=(1,), parts=(4,), bounds=((99, 140, 180),))(spark, sf)


@query(f"WITH {RATINGS} SELECT k1, k2, ((k1 - 1) + d1 * (k2 - 1)) % 7 AS pid FROM r, d")
def q_part_modulo(spark, sf):
    return _part(PartitionType.MODULO_EXECUTOR, "pid", parts=(7,))(spark, sf)


@query(f"WITH {RATINGS} SELECT k1, k2, (k2 - 1) % 7 AS pid FROM r")
def q_part_partial_modulo(spark, sf):
    return _part(PartitionType.PARTIAL_MODULO_EXECUTOR, "pid", dims=(2,), parts=(7,))(spark, sf)


@query(f"WITH {RATINGS} SELECT k1, k2, (31 * k1 + k2) % 5 AS pid FROM r")
def q_part_hash(spark, sf):
    return _part(PartitionType.HASH_EXECUTOR, "pid", parts=(5,), key_func=lambda k: 31 * k[0] + k[1])(spark, sf)


@query(f"WITH {RATINGS}, p AS (SELECT DISTINCT k1, 1 AS one FROM r) SELECT count(*) AS keys, true AS spread FROM p")
def q_part_partial_random(spark, sf):
    rows = _part(PartitionType.PARTIAL_RANDOM_EXECUTOR, "pid", dims=(1,), parts=(4,))(spark, sf)
    per = rows.groupBy("k1").agg(F.count_distinct("pid").alias("n"), F.min("pid").alias("pid"))
    return per.agg(F.count(F.lit(1)).alias("keys"), ((F.max("n") == 1) & (F.count_distinct("pid") == 4)).alias("spread"))


@query(f"WITH {RATINGS} SELECT ((k1 - 1) + d1 * (k2 - 1)) % 7 AS partition, count(*) AS cells FROM r, d GROUP BY 1")
def q_repartition(spark, sf):
    a = partition.repartition(mf.ratings(spark, sf), Partitioning(PartitionType.MODULO_EXECUTOR, (), (7,)), ordered=True)
    return a.df.groupBy(F.spark_partition_id().cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("cells"))


#: Histogram of the first key in at most 80 bins, wide ones first, as (bin, first coordinate, width, count, count before), and bounds of 8 parts.
BINS = (
    "s AS (SELECT d1, least(d1, 80) AS b FROM d), w AS (SELECT *, (d1 + b - 1) // b AS fl, CASE WHEN d1 % b = 0 THEN b ELSE d1 % b END AS nf FROM s), "
    "g AS (SELECT CASE WHEN k1 - 1 < nf * fl THEN (k1 - 1) // fl ELSE (k1 - 1 - nf * fl) // greatest(fl - 1, 1) + nf END AS bin, count(*) AS n FROM r, w GROUP BY 1), "
    "h AS (SELECT bin, n, CASE WHEN bin <= nf THEN bin * fl ELSE nf * fl + (bin - nf) * (fl - 1) END AS lo, CASE WHEN bin < nf THEN fl ELSE fl - 1 END AS width, "
    "sum(n) OVER (ORDER BY bin) - n AS seen, sum(n) OVER () AS total FROM g, w), "
    "b AS (SELECT j, lo + CAST(ceil((total * j / 8.0 - seen) * width / n) AS BIGINT) - 1 AS upper FROM h, range(1, 8) t(j) WHERE seen < total * j / 8.0 AND seen + n >= total * j / 8.0)"
)


@query(f"WITH {RATINGS}, {BINS} SELECT CAST(j - 1 AS INTEGER) AS part, CAST(greatest(0, least(upper, d1 - 1)) AS BIGINT) AS upper FROM b, d UNION ALL SELECT 7, CAST(d1 - 1 AS BIGINT) FROM d")
def q_equal_mass_bounds(spark, sf):
    p = partition.balanced(mf.ratings(spark, sf), 1, 8)
    return spark.createDataFrame([(k, int(b)) for k, b in enumerate(p.bounds[0])], "part int, upper long")


@query(f"WITH {RATINGS}, {BINS}, u AS (SELECT list(greatest(0, least(upper, d1 - 1)) ORDER BY j) AS up FROM b, d) SELECT k1, k2, (k2 - 1) // ((d2 + 3) // 4) AS tid, CAST(len(list_filter(up, lambda x: x < k1 - 1)) AS BIGINT) AS sid FROM r, d, u")
def q_part_2d_hist(spark, sf):
    """Ranges of equal mass along the first key, equal tiles along the second."""
    a = mf.ratings(spark, sf)
    return partition.with_partition(a, partition.balanced_2d(a, (1, 2), (8, 4), (True, False))).select("k1", "k2", "sid", "tid")


@query(f"WITH {RATINGS}, p AS (SELECT k1, k2, (k1 - 1) // ((d1 + 7) // 8) AS pid FROM r, d) SELECT k1, k2, pid, (8 - pid % 8) % 8 AS executor FROM p")
def q_part_1d_ordered(spark, sf):
    return _part(PartitionType.ONE_D_ORDERED, "pid", "executor", dims=(1,), parts=(8,))(spark, sf)


@query(f"WITH {RATINGS} SELECT k1, k2, (2 * k1 + k2) // 16 AS sid, (k1 - k2 + 1000000) // 32 AS tid FROM r")
def q_part_2d_unimodular(spark, sf):
    a = mf.ratings(spark, sf)
    p = Partitioning(PartitionType.TWO_D_UNIMODULAR, (1, 2), (16, 32), coefficients=((2, 1, 0), (1, -1, 1_000_000)))
    return partition.with_partition(a, p).select("k1", "k2", "sid", "tid")


@query(f"WITH {RATINGS}, m AS (SELECT k1, row_number() OVER (ORDER BY md5(CAST(k1 AS VARCHAR)), k1) AS new_key FROM (SELECT DISTINCT k1 FROM r)) SELECT k1, CAST(new_key AS BIGINT) AS new_key FROM m")
def q_random_remap(spark, sf):
    return partition.remap_table(mf.ratings(spark, sf), (1,))


# access


@query(f"WITH {RATINGS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, value AS found FROM lineitem JOIN r ON k1 = l_partkey + 1 AND k2 = l_suppkey + 1")
def q_point_lookup(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") + 1).alias("a"), (F.col("l_suppkey") + 1).alias("b"))
    return access.lookup(rows, mf.ratings(spark, sf), {"k1": "a", "k2": "b"}, strict=True).drop("a", "b")


@query(f"WITH {EVENTS} SELECT c_custkey, list(value ORDER BY k2) AS vec FROM customer JOIN e ON k1 = c_custkey % (SELECT max(k1) FROM e) + 1 GROUP BY 1")
def q_range_lookup(spark, sf):
    a = _events(spark, sf)
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_custkey") % a.size()[0] + 1).alias("u"))
    return access.lookup_slice(rows, a, 1, "u").drop("u")


@query(f"WITH {EVENTS} SELECT n_nationkey, coalesce(value, -1) AS found FROM nation LEFT JOIN e ON k1 = n_nationkey * 40 + 1 AND k2 = 3")
def q_default_lookup(spark, sf):
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") * 40 + 1).alias("a"), F.lit(3).alias("b"))
    return access.lookup_or(rows, _events(spark, sf), {"k1": "a", "k2": "b"}, F.lit(-1).cast("long")).drop("a", "b")


@query(f"WITH {RATINGS} SELECT k1, k2, value FROM r WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 7 AND p_partkey + 1 = k1)")
def q_gather_keys(spark, sf):
    wanted = spark.read.parquet(f"{sf}/part.parquet").where("p_size = 7").select((F.col("p_partkey") + 1).alias("a"))
    return access.gather(wanted, mf.ratings(spark, sf), {"k1": "a"}).df


def _shifted(key, value, C):
    return value + C[key[0] + 3] + C[1]


@query(f"WITH {EVENTS} SELECT c_custkey + 1 AS k1, c_acctbal AS value FROM customer WHERE c_custkey = 0 OR c_custkey + 1 IN (SELECT k1 + 3 FROM e)")
def q_gather_by_body(spark, sf):
    """What a loop body reads, from its source."""
    customers = from_table(spark.read.parquet(f"{sf}/customer.parquet"), [F.col("c_custkey") + 1], F.col("c_acctbal"))
    return access.gathered(_events(spark, sf), _shifted, {"C": customers})["C"].df


@query("SELECT l_partkey + 1 AS k1, count(*) AS reads FROM lineitem GROUP BY 1")
def q_access_counts(spark, sf):
    return groups.access_counts(spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") + 1).alias("k1")), "k1")


# loops and buffers


def _last_digit(key, value):
    return value - 10 * (value // 10)


@query(f"WITH {RATINGS} SELECT k1, k2, value - floor(value / 10) * 10 AS value FROM r")
def q_loop_update_values(spark, sf):
    """A loop whose body's result replaces the value of each cell."""
    _, space = parallel_for(mf.ratings(spark, sf).materialize(), _last_digit, {}, reassign=True)
    return space.df


@query(f"WITH {EVENTS} SELECT k1, list(value ORDER BY k2) AS vals, list(k2 ORDER BY k2) AS days FROM e GROUP BY 1")
def q_iterate_groups(spark, sf):
    def body(coordinates, cells):
        keys, values = zip(*cells)
        yield {"k1": coordinates[0], "vals": list(values), "days": [k[1] for k in keys]}

    return for_each_group(_events(spark, sf), (1,), body, "k1 long, vals array<long>, days array<long>")


@query("WITH u AS (SELECT o_custkey + 1 AS k1, sum(round(o_totalprice)) AS s FROM orders GROUP BY 1) SELECT c_custkey + 1 AS k1, 100 + coalesce(s, 0) AS value FROM customer LEFT JOIN u ON k1 = c_custkey + 1")
def q_buffer_add(spark, sf):
    target = from_table(spark.read.parquet(f"{sf}/customer.parquet"), [F.col("c_custkey") + 1], F.lit(100.0))
    updates = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") + 1).alias("k1"), F.round("o_totalprice").alias("update"))
    b = WriteBuffer(F.sum)
    return b.flush(target, b.delta(updates, ["k1"])).df


@query(
    "WITH u AS (SELECT o_custkey + 1 AS k1, CAST(count(*) AS DOUBLE) AS g FROM orders GROUP BY 1) "
    "SELECT c_custkey + 1 AS k1, round(CASE WHEN g IS NULL THEN 1 ELSE 1 - 0.1 * g / sqrt(1 + g * g) END, 9) AS value, CASE WHEN g IS NULL THEN 1 ELSE 1 + g * g END AS z FROM customer LEFT JOIN u ON k1 = c_custkey + 1"
)
def q_buffer_helpers(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    target, z = (from_table(customers, [F.col("c_custkey") + 1], F.lit(1.0)) for _ in range(2))
    updates = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") + 1).alias("k1"), F.lit(1.0).alias("update"))
    b = WriteBuffer(F.sum, lambda keys, x, g, h: (x - 0.1 * g / F.sqrt(h + g * g), h + g * g))
    new, new_z = b.flush(target, b.delta(updates, ["k1"]), (z,))
    return new.df.join(new_z.df.withColumnRenamed("value", "z"), "k1").select("k1", F.round("value", 9).alias("value"), "z")


@query("SELECT l_orderkey, l_linenumber, l_partkey + 1 AS fid, l_quantity AS fval, 0.01::DOUBLE * (l_partkey + 1) AS weight FROM lineitem")
def q_explode_lookup(spark, sf):
    """Samples whose features name the weights that they need."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array(F.struct((F.col("l_partkey") + 1).alias("fid"), F.col("l_quantity").alias("fval"))).alias("features"))
    parts = spark.read.parquet(f"{sf}/part.parquet")
    weights = from_table(parts, [F.col("p_partkey") + 1], 0.01 * (F.col("p_partkey") + 1))
    return access.explode_lookup(rows, "features", weights)


@query("SELECT user_id + 1 AS k1, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def q_last_writer(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") + 1).alias("k1"), F.col("event_type").alias("value"), "event_id")
    target = DistArray(spark.createDataFrame([], "k1 long, value string"), Meta(1))
    return upsert(target, last_writer(rows, ["k1"], F.col("event_id"))).df


# regression

X = "x AS (SELECT vec_id + 1 AS id, CAST(label >= 5 AS INTEGER) AS y, CAST(f AS BIGINT) AS fid, CAST(embedding[f] AS DOUBLE) AS fval FROM embeddings, range(1, 65) t(f))"
SCORED = "w AS (SELECT CAST(f AS BIGINT) AS k1, f * 0.01::DOUBLE AS value FROM range(1, 65) t(f)), s AS (SELECT id, y, sum(fval * value) AS s FROM x JOIN w ON fid = k1 GROUP BY 1, 2)"


def _weights(spark):
    return lr.constant_weights(spark, 64, F.col("k1") * 0.01)


@query(f"WITH {X}, {SCORED}, g AS (SELECT fid AS k1, sum(fval * (1 / (1 + exp(-s)) - s.y)) AS g FROM x JOIN s USING (id) GROUP BY 1) SELECT k1, round(value - 0.001 * g, 9) AS value FROM w JOIN g USING (k1)")
def q_lr_epoch(spark, sf):
    return lr.epoch(lr.samples(spark, sf), _weights(spark), 0.001).map_values(lambda v: F.round(v, 9)).df


@query(
    f"WITH {X}, {SCORED}, p AS (SELECT y, 1 / (1 + exp(-s)) AS p FROM s) "
    "SELECT round(sum(CASE WHEN y = 1 THEN -ln(greatest(p, 1e-15)) ELSE -ln(greatest(1 - p, 1e-15)) END), 6) AS loss, round(sum((p - y) * (p - y)), 6) AS err, CAST(sum(CASE WHEN (p >= 0.5) <> (y = 1) THEN 1 ELSE 0 END) AS BIGINT) AS misses, count(*) AS n FROM p"
)
def q_lr_metrics(spark, sf):
    return lr.metrics(lr.samples(spark, sf), _weights(spark)).select(F.round("loss", 6).alias("loss"), F.round("err", 6).alias("err"), "misses", "n")


@query(
    f"WITH {X}, {SCORED}, g AS (SELECT fid AS k1, sum(CASE WHEN id % 2 = 0 THEN fval * (1 / (1 + exp(-s)) - s.y) ELSE 0 END) AS g0, "
    "sum(CASE WHEN id % 2 = 1 THEN fval * (1 / (1 + exp(-s)) - s.y) ELSE 0 END) AS g1 FROM x JOIN s USING (id) GROUP BY 1), "
    "a AS (SELECT k1, g0, g1, value, 1 + g0 * g0 AS z1, greatest(1 + g0 * g0, 1) AS zp1 FROM w JOIN g USING (k1)), "
    "b AS (SELECT *, value - 0.1 / sqrt(zp1) * g0 AS x1, z1 + g1 * g1 + 2 * g1 * g0 AS z2, greatest(z1 + g1 * g1 + 2 * g1 * g0, zp1) AS zp2 FROM a) "
    "SELECT k1, round(x1 - 0.1 / sqrt(zp2) * g1 + (0.1 / sqrt(zp1) - 0.1 / sqrt(zp2)) * g0, 8) AS value, round(z2, 6) AS z, round(g0 + g1, 6) AS grads FROM b"
)
def q_lr_adarevision(spark, sf):
    """Two batches whose gradients are computed from the same weights: the second one's arrives when the first has been applied."""
    state = lr.adarevision_epoch(lr.samples(spark, sf), lr.adarevision_state(_weights(spark)), batches=2)
    rows = state["x"].df.join(state["z"].df.withColumnRenamed("value", "z"), "k1").join(state["G"].df.withColumnRenamed("value", "grads"), "k1")
    return rows.select("k1", F.round("value", 8).alias("value"), F.round("z", 6).alias("z"), F.round("grads", 6).alias("grads"))


def _batches(many: int, size: int, step: float) -> str:
    """Mini-batches one after another, up to ``many``: later ones are empty and change nothing."""
    parts = [f"n AS MATERIALIZED (SELECT id, y, fid, fval, (dense_rank() OVER (ORDER BY id) - 1) // {size} AS b FROM x)", "w0 AS MATERIALIZED (SELECT CAST(f AS BIGINT) AS k1, f * 0.01::DOUBLE AS value FROM range(1, 65) t(f))"]
    for b in range(many):
        parts.append(
            f"w{b + 1} AS MATERIALIZED (WITH s AS (SELECT id, any_value(y) AS y, sum(fval * value) AS s FROM n JOIN w{b} ON fid = k1 WHERE b = {b} GROUP BY 1), "
            f"g AS (SELECT fid AS k1, sum(fval * (1 / (1 + exp(-s)) - s.y)) AS g FROM n JOIN s USING (id) WHERE b = {b} GROUP BY 1) SELECT k1, value - {step} * coalesce(g, 0) AS value FROM w{b} LEFT JOIN g USING (k1))"
        )
    return ", ".join(parts)


@query(f"WITH {X}, {_batches(10, 200, 0.001)} SELECT k1, round(value, 9) AS value FROM w10")
def q_lr_minibatch(spark, sf):
    return lr.minibatch_epoch(lr.samples(spark, sf), _weights(spark), 0.001, 200).map_values(lambda v: F.round(v, 9)).df


# factorisation

FACTORS = (
    f"w AS (SELECT CAST(k AS BIGINT) AS k1, f, sin(0.5 + f * k) / 10 AS x FROM (SELECT unnest(range(1, d1 + 1)) AS k FROM d), range(1, {RANK + 1}) t(f)), "
    f"h AS (SELECT CAST(k AS BIGINT) AS k2, f, sin(1.5 + f * k) / 10 AS x FROM (SELECT unnest(range(1, d2 + 1)) AS k FROM d), range(1, {RANK + 1}) t(f))"
)


def _factors(spark, a):
    m, n = a.size()
    return mf.wave_factors(spark, m, RANK, 0.5), mf.wave_factors(spark, n, RANK, 1.5)


@query(f"WITH {RATINGS}, {FACTORS}, p AS (SELECT r.k1, r.k2, any_value(value) AS value, sum(w.x * h.x) AS dot FROM r JOIN w ON r.k1 = w.k1 JOIN h ON r.k2 = h.k2 AND w.f = h.f GROUP BY 1, 2) SELECT round(sum((value - dot) * (value - dot)), 4) AS loss, count(*) AS n FROM p")
def q_mf_eval(spark, sf):
    a = mf.ratings(spark, sf)
    return mf.squared_error(a, *_factors(spark, a)).select(F.round("loss", 4).alias("loss"), "n")


@query(
    "SELECT CAST(ts * 3 + c AS INTEGER) AS step, CAST(ss AS INTEGER) AS sub, CAST(e AS INTEGER) AS slot, CAST(ss * 3 + e AS INTEGER) AS space, CAST(ts * 3 + (c + e) % 3 AS INTEGER) AS time "
    "FROM range(2) a(ts), range(3) b(c), range(3) g(e), range(2) h(ss) WHERE ss * 3 + e < 5 AND ts * 3 + (c + e) % 3 < 6"
)
def q_mf_strata_schedule(spark, sf):
    return spark.createDataFrame([(t.step, t.sub, t.slot, t.space, t.time) for t in rotation(3, 5, 6)], "step int, sub int, slot int, space int, time int")


@query("SELECT CAST(s + t AS INTEGER) AS step, CAST(s AS INTEGER) AS slot, CAST(s AS INTEGER) AS space, CAST(t AS INTEGER) AS time FROM range(5) a(s), range(6) b(t)")
def q_wavefront_schedule(spark, sf):
    return spark.createDataFrame([(t.step, t.slot, t.space, t.time) for t in wavefront(5, 6)], "step int, slot int, space int, time int")


def _trained(spark, sf, run):
    a = mf.ratings(spark, sf).map_values(lambda v: v / 50).materialize()  # quantities go up to 50; steps are for ratings about 1
    w, h = run(a, *_factors(spark, a))[:2]
    return mf.squared_error(a, w, h).unionByName(mf.squared_error(a, *_factors(spark, a)))


@query()
def q_mf_ordered_epoch(spark, sf):
    return _trained(spark, sf, lambda a, w, h: mf.epoch(a, w, h, ordered=True, slots=2))


@query()
def q_mf_unordered_epoch(spark, sf):
    return _trained(spark, sf, lambda a, w, h: mf.epoch(a, w, h, slots=2))


@query()
def q_mf_adaptive_epoch(spark, sf):
    return _trained(spark, sf, lambda a, w, h: mf.adaptive_epoch(a, w, h, slots=2))


# topics

TOK = (
    "tk AS (SELECT doc_id + 1 AS did, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents), "
    f"v AS (SELECT word, CAST(row_number() OVER (ORDER BY md5(word), word) AS BIGINT) AS wid FROM (SELECT DISTINCT word FROM tk WHERE word <> '')), m AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM v), "
    "c AS (SELECT wid, did, count(*) AS cnt FROM tk JOIN v USING (word) GROUP BY 1, 2), "
    f"t AS (SELECT unnest(range(1, cnt + 1)) AS k1, wid AS k2, did AS k3 FROM c), z AS (SELECT k1, k2, k3, CAST((7 * k1 + 3 * k2 + 5 * k3) % {lda.TOPICS} + 1 AS INTEGER) AS value FROM t), "
    "nt AS (SELECT value AS topic, count(*) AS n FROM z GROUP BY 1), dt AS (SELECT k3 AS did, value AS topic, count(*) AS n FROM z GROUP BY 1, 2), wt AS (SELECT k2 AS wid, value AS topic, count(*) AS n FROM z GROUP BY 1, 2)"
)
A, B, K = lda.ALPHA, lda.BETA, lda.TOPICS


def _tokens(spark, sf):
    """The tokens of all words of all documents."""
    return lda.tokens(lda.token_counts(spark, sf))


@query(f"WITH {TOK} SELECT k1, k2, k3, value FROM z")
def q_lda_tokens(spark, sf):
    return _tokens(spark, sf).df


@query(f"WITH {TOK} SELECT topic, n FROM nt")
def q_lda_counts(spark, sf):
    return lda.topic_totals(_tokens(spark, sf))


@query(f"WITH {TOK} SELECT did, topic, n FROM dt")
def q_lda_doc_topic(spark, sf):
    return lda.doc_topic(_tokens(spark, sf))


@query(f"WITH {TOK} SELECT wid, string_agg(topic || ':' || n, ' ' ORDER BY n DESC, topic) AS counts FROM wt GROUP BY 1")
def q_lda_word_topic_sorted(spark, sf):
    rows = lda.word_topic_sorted(_tokens(spark, sf))
    return rows.select("wid", F.array_join(F.transform("counts", lambda c: F.concat_ws(":", c["topic"], c["count"])), " ").alias("counts"))


@query(f"WITH {TOK} SELECT round(sum({A * B} / ({B} * v + n)), 10) AS s_sum FROM nt, m")
def q_lda_s_sum(spark, sf):
    t = _tokens(spark, sf)
    return lda.s_sum(lda.topic_totals(t), t.size()[1]).select(F.round("s_sum", 10).alias("s_sum"))


@query(f"WITH {TOK} SELECT did, round(sum(dt.n * {B} / ({B} * v + nt.n)), 10) AS r_sum FROM dt JOIN nt USING (topic), m GROUP BY 1")
def q_lda_r_sum(spark, sf):
    t = _tokens(spark, sf)
    return lda.r_sum(lda.doc_topic(t), lda.topic_totals(t), t.size()[1]).select("did", F.round("r_sum", 10).alias("r_sum"))


@query(f"WITH {TOK} SELECT did, topic, round(({A} + dt.n) / ({B} * v + nt.n), 10) AS q_coeff FROM dt JOIN nt USING (topic), m")
def q_lda_q_coeff(spark, sf):
    t = _tokens(spark, sf)
    return lda.q_coeff(lda.doc_topic(t), lda.topic_totals(t), t.size()[1]).withColumn("q_coeff", F.round("q_coeff", 10))


@query(
    f"WITH {TOK}, l AS (SELECT did, sum(n) AS n FROM dt GROUP BY 1) SELECT "
    f"round((SELECT sum(lgamma(n + {B}) - lgamma({B})) FROM wt) + (SELECT sum(lgamma({B} * v) - lgamma(n + {B} * v)) FROM nt, m), 3) AS word_llh, "
    f"round((SELECT sum(lgamma(n + {A}) - lgamma({A})) FROM dt) + (SELECT sum(lgamma({A * K}) - lgamma(n + {A * K})) FROM l), 3) AS doc_llh"
)
def q_lda_llh(spark, sf):
    t = _tokens(spark, sf)
    return lda.log_likelihood(t, t.size()[1]).select(F.round("word_llh", 3).alias("word_llh"), F.round("doc_llh", 3).alias("doc_llh"))


@query()
def q_lda_sweep(spark, sf):
    t = _tokens(spark, sf)
    return lda.topic_totals(lda.sweep(t, t.size()[1], slots=2))


@query(f"WITH {EVENTS} SELECT k1, k2, value FROM e")
def q_text_round_trip(spark, sf):
    """What is read back from the text that an array was saved as."""
    path = scratch_path(spark, "saved")
    save_as_text(_events(spark, sf), path)
    return text_file(spark, path, lambda line: ((F.split(line, ",")[0], F.split(line, ",")[1]), F.split(line, ",")[2].cast("long")), num_dims=2).df


# scalar functions


@query(
    "SELECT vec_id, round(list_dot_product(e, e), 6) AS norm2, round(1 / (1 + exp(-e[1])), 9) AS p, round(ln(greatest(abs(e[2]), 1e-15)), 9) AS lg FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
)
def q_scalars(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(C.dot(F.col("e"), F.col("e")), 6).alias("norm2"), F.round(C.sigmoid(F.col("e")[0]), 9).alias("p"), F.round(C.safe_log(F.abs(F.col("e")[1])), 9).alias("lg"))


@query("SELECT n_nationkey, round(lgamma(n_nationkey + 0.5), 6) AS lg FROM nation")
def q_lgamma(spark, sf):
    rows = spark.read.parquet(f"{sf}/nation.parquet")
    return rows.select("n_nationkey", F.round(C.lgamma(F.col("n_nationkey") + 0.5), 6).alias("lg"))


@query("SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def q_ranked_counts(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "o_orderpriority")).cast("long"))
