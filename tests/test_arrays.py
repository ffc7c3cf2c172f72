"""Arrays, sources, partitions, access, buffers and loops against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import columns as C
from keyloom.functions.parsers import libsvm, rating, word_counts
from keyloom.operators import access, groups, partition
from keyloom.operators.array import NAMED, DistArray
from keyloom.operators.buffers import WriteBuffer, numbered, upsert
from keyloom.operators.loops import Blocks, parallel_for
from keyloom.operators.sinks import save_as_text
from keyloom.plans.dependence import NotParallelizable
from keyloom.plans.meta import DelayMode, Meta, Partitioning, PartitionType, cells, key_of, linear_key
from keyloom.plans.schedule import rotation, tile_size
from keyloom.plans.storage import kept
from keyloom.sources.cells import empty, fill, rand, randn
from keyloom.sources.text import numbered_lines, text_file
from keyloom.workloads import lda, lr, mf


def sparse(spark, m=23, n=19, seed=1):
    random.seed(seed)
    rows = [(i, j, random.random()) for i in range(1, m + 1) for j in range(1, n + 1) if random.random() < 0.5]
    return DistArray(spark.createDataFrame(rows, "k1 long, k2 long, value double"), Meta(2, (m, n))), rows


def test_key_codec(spark):
    dims = (3, 4, 5)
    for linear in range(60):
        assert linear_key(key_of(linear, dims), dims) == linear
    a = fill(spark, 1, *dims)
    assert sorted(r["lin_key"] for r in a.linear().collect()) == list(range(60))
    with pytest.raises(OverflowError):
        cells((1 << 32, 1 << 32))


def test_cells(spark):
    assert fill(spark, "x", 5, 4).df.count() == 20
    u = [r.value for r in rand(spark, 50, 40, seed=3).df.collect()]
    assert u == [r.value for r in rand(spark, 50, 40, seed=3).df.collect()] and 0 <= min(u) and max(u) < 1
    assert len({r.value for r in randn(spark, 100, dtype="double", parts=4).df.collect()}) == 100  # partitions draw apart
    assert empty(spark, "double", 3, 3).df.count() == 0


def test_text_variants(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_bytes(b"1,2,0.5\r\n\n3,4,1.5\n5,6,2.5")
    path = str(p)
    assert [(r.line_no, r.line) for r in numbered_lines(spark, path).orderBy("line_no").collect()] == [(1, "1,2,0.5"), (3, "3,4,1.5"), (4, "5,6,2.5")]
    a = text_file(spark, path, rating, num_dims=2)
    assert sorted((r.k1, r.k2, r.value) for r in a.df.collect()) == [(3, 2, 0.5), (5, 4, 1.5), (7, 6, 2.5)]
    assert a.size() == (7, 6)
    assert text_file(spark, path).num_dims == 0 and text_file(spark, path).df.count() == 3
    assert text_file(spark, path, lambda no, line: F.length(line), with_line_number=True, new_keys=False).size() == (4,)
    b = text_file(spark, path, lambda no, line: ((no,), line), with_line_number=True)
    assert [r.k1 for r in b.df.orderBy("k1").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        text_file(spark, path, rating, flatten=True, new_keys=False)


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{name}{k}\n" for k in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == [f"{n}{k}" for n in "ab" for k in range(500)]
    assert [r.line_no for r in rows] == list(range(1, 1001))


def test_parsers(spark, tmp_path):
    (tmp_path / "s").write_text("-1 1:0.5 7:2\n+1 3:1\n1\n")
    a = text_file(spark, str(tmp_path / "s"), lambda n, line: libsvm(line), with_line_number=True, new_keys=False)
    assert [(r.k1, r.value.y, [(f.fid, f.fval) for f in r.value.features]) for r in a.df.orderBy("k1").collect()] == [(1, 0, [(1, 0.5), (7, 2.0)]), (2, 1, [(3, 1.0)]), (3, 1, [])]
    (tmp_path / "w").write_text("9 0:2 4:1\n8 4:3\n")
    b = text_file(spark, str(tmp_path / "w"), word_counts, with_line_number=True, flatten=True, num_dims=3)
    assert sorted((r.k1, r.k2, r.k3) for r in b.df.collect()) == [(1, 1, 1), (1, 5, 1), (1, 5, 2), (2, 1, 1), (2, 5, 2), (3, 5, 2)]


def test_maps_and_sinks(spark, tmp_path):
    a, rows = sparse(spark)
    flat = a.map(lambda k, v: F.array_repeat(F.struct(k[1].alias("k1"), v.alias("value")), F.when(v > 0.5, 2).otherwise(0)), num_dims=1, flatten=True)
    assert flat.df.count() == 2 * sum(v > 0.5 for *_, v in rows)
    chained = a.map_values(lambda v: v + 1).map_fixed_keys(lambda k, v: v * k[0])
    assert "MapInPandas" not in chained.df._jdf.queryExecution().toString()
    assert {(r.k1, r.k2): r.value for r in chained.df.collect()} == {(i, j): (v + 1) * i for i, j, v in rows}
    dense = a.densify(F.lit(0.0))
    assert dense.df.count() == 23 * 19 and dense.sparsify(lambda v: v == 0).df.count() == len(rows)
    doubled = a.map_batches(lambda it: (p.assign(value=p.value * 2) for p in it), "double")
    assert doubled.df.count() == len(rows)
    save_as_text(a, str(tmp_path / "out"))
    assert text_file(spark, str(tmp_path / "out")).df.count() == len(rows)
    a.named("ratings_t").materialize()
    assert "ratings_t" in NAMED and spark.table("ratings_t").count() == len(rows)
    a.delete()
    assert "ratings_t" not in NAMED


def test_repeated_keys(spark):
    a = DistArray(spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k1 long, value double"), Meta(1))
    assert sorted((r.k1, r.value) for r in a.unique(F.max).df.collect()) == [(1, 2.0), (2, 5.0)]
    with pytest.raises(Exception, match="repeated"):
        a.unique().df.collect()


@pytest.mark.parametrize(("dim", "bins"), [(12, 4), (13, 4), (5, 5), (2000, 64), (7, 1)])
def test_bins(spark, dim, bins):
    got = [r[0] for r in spark.range(dim).select(groups.bin_of(F.col("id"), dim, bins)).collect()]
    sizes = [got.count(b) for b in range(bins)]
    assert got == sorted(got) and max(sizes) - min(sizes) <= 1 and sum(sizes) == dim
    with pytest.raises(ValueError):
        groups.bin_of(F.col("id"), 3, 4)


def test_accumulators(spark):
    acc = groups.Accumulator("+", 10)
    assert acc.value(spark.range(5), F.col("id")) == 20 and acc.value(spark.range(0), F.col("id")) == 10 and acc.reset() == 10
    assert groups.Accumulator("max", 3).value(spark.range(5), F.col("id")) == 4


def test_equal_mass_bounds():
    random.seed(7)
    for _ in range(400):
        dim = random.randint(1, 60)
        bins, parts = random.randint(1, dim), random.randint(1, 9)
        counts = [(b, random.choice([0, 1, 5, 50])) for b in range(bins)]
        bounds = partition.equal_mass_bounds([c for c in counts if c[1]], dim, bins, parts)
        assert len(bounds) == parts and bounds == sorted(bounds) and bounds[-1] == dim - 1
    assert partition.equal_mass_bounds([(0, 100), (1, 100)], 20, 2, 4) == [4, 9, 14, 19]


def test_repartition(spark):
    a, rows = sparse(spark)
    p = Partitioning(PartitionType.ONE_D, (1,), (4,))
    b = partition.repartition(a, p, ordered=True)
    assert partition.repartition(b, p) is b
    seen = {}
    for r in b.df.withColumn("p", F.spark_partition_id()).collect():
        seen.setdefault(r.p, []).append((r.k2, r.k1))
    assert sum(map(len, seen.values())) == len(rows)
    for keys in seen.values():
        assert keys == sorted(keys) and len({(k1 - 1) // 6 for _, k1 in keys}) == 1
    assert partition.repartition(a, Partitioning(PartitionType.RANGE, (), (3,))).df.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        partition.with_partition(a, Partitioning())
    balanced = partition.balanced(a, 1, 4)
    sizes = [r.cells for r in partition.partition_sizes(partition.with_partition(a, balanced)).collect()]
    assert max(sizes) < 2 * len(rows) / 4


def test_random_remap(spark):
    a, rows = sparse(spark)
    moved = partition.random_remap(a, 1, seed=3)
    back = moved.df.select("k1").distinct().collect()
    assert moved.df.count() == len(rows) and all(1 <= r.k1 <= 23 for r in back) and len(back) == len({i for i, *_ in rows})


def test_access(spark):
    a, rows = sparse(spark)
    held = {(i, j): v for i, j, v in rows}
    asked = spark.createDataFrame([(x, y) for x in range(1, 5) for y in range(1, 5)], "x long, y long")
    assert {(r.x, r.y): r.found for r in access.lookup(asked, a, {"k1": "x", "k2": "y"}).collect()} == {k: v for k, v in held.items() if max(k) < 5}
    assert sum(r.found == -1 for r in access.lookup_or(asked, a, {"k1": "x", "k2": "y"}, F.lit(-1.0)).collect()) == 16 - sum(max(k) < 5 for k in held)
    with pytest.raises(Exception, match="not in the array"):
        access.lookup(asked, a, {"k1": "x", "k2": "y"}, strict=True).collect()
    vec = {r.x: r.vec for r in access.lookup_slice(asked.select("x").distinct(), a, 1, "x").collect()}
    assert vec[2] == [held[2, j] for j in range(1, 20) if (2, j) in held]


def test_buffers(spark):
    target = fill(spark, 0.0, 4)
    ups = spark.createDataFrame([(1, 1.0), (1, 2.0), (9, 5.0)], "k1 long, update double")
    b = WriteBuffer()
    assert {r.k1: r.value for r in b.flush(target, b.delta(ups, ["k1"])).df.collect()} == {1: 3.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.k1: r.value for r in b.flush(target, b.delta(ups, ["k1"]), init=F.lit(100.0)).df.collect()}[9] == 105.0
    assert sorted(r._at for r in numbered(spark.range(50), ["id"]).collect()) == list(range(50))
    assert upsert(target, spark.createDataFrame([(2, 7.0), (8, 8.0)], "k1 long, value double")).df.count() == 5
    # each batch reads what the batch before it wrote
    late = WriteBuffer(delay=DelayMode.MAX_DELAY, max_delay=2)
    out = late.run(spark.range(5), ["id"], fill(spark, 1.0, 1), lambda e, t: e.join(t.df).select("k1", F.col("value").alias("update")))
    assert out.df.first().value == 3.0 * 3.0 * 2.0


def serial_mf(rows, w, h, step, order):
    w, h = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in h.items()}
    for i, j, v in sorted(rows, key=order):
        a, b = w[i], h[j]
        d = v - float(np.dot(a, b))
        w[i], h[j] = a + 2 * step * d * b, b + 2 * step * d * a
    return w, h


def vectors(b):
    return {r.k: np.array(r.vec) for r in b.df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_ordered_loop_is_the_serial_one(spark):
    a, rows = sparse(spark)
    w, h = mf.random_factors(spark, 23, 4, 1), mf.random_factors(spark, 19, 4, 2)
    got = mf.epoch(a, w, h, ordered=True, slots=3)
    want = serial_mf(rows, vectors(w), vectors(h), 0.01, lambda r: (r[1], r[0]))
    assert same(vectors(got[0]), want[0]) and same(vectors(got[1]), want[1])


def test_unordered_loop_is_the_serial_one_in_schedule_order(spark):
    a, rows = sparse(spark)
    w, h = mf.random_factors(spark, 23, 4, 1), mf.random_factors(spark, 19, 4, 2)
    got = mf.epoch(a, w, h, slots=3)
    ts, tt = tile_size(19, 3), tile_size(23, 3)
    turn = {(t.space, t.time): (t.step, t.slot, t.sub) for t in rotation(3, -(-19 // ts), -(-23 // tt))}
    want = serial_mf(rows, vectors(w), vectors(h), 0.01, lambda r: (turn[(r[1] - 1) // ts, (r[0] - 1) // tt], r[1], r[0]))
    assert same(vectors(got[0]), want[0]) and same(vectors(got[1]), want[1])


def test_adaptive_epoch_lowers_the_loss(spark):
    a, _ = sparse(spark)
    w, h = mf.random_factors(spark, 23, 4, 1), mf.random_factors(spark, 19, 4, 2)
    before = mf.squared_error(a, w, h).first().loss
    after = mf.squared_error(a, *mf.adaptive_epoch(a, w, h, slots=2)[:2]).first().loss
    assert after < before


def test_one_dimensional_loop(spark):
    a, rows = sparse(spark)

    def body(key, value, S, T):
        S[key[0]] = S[key[0]] + value * T[1]

    s = Blocks(fill(spark, 0.0, 23).df.select(F.col("k1").alias("k"), F.array("value").alias("vec")), 23, scalar=True)
    t = Blocks(spark.createDataFrame([(1, [2.0])], "k long, vec array<double>"), 1, scalar=True)
    out, _ = parallel_for(a, body, {"S": s, "T": t}, slots=3)
    got = {r.k: r.value for r in out["S"].values().collect()}
    assert all(math.isclose(got[i], 2 * sum(v for x, _, v in rows if x == i), abs_tol=1e-9) for i in range(1, 24))


def test_loop_with_loose_writes_is_refused(spark):
    a, _ = sparse(spark)

    def body(key, value, S):
        S[int(value)] = 1.0

    s = Blocks(spark.createDataFrame([(1, [2.0])], "k long, vec array<double>"), 1, scalar=True)
    with pytest.raises(NotParallelizable):
        parallel_for(a, body, {"S": s})


def test_logistic_regression(spark):
    random.seed(2)
    data = [(i, random.randint(0, 1), f, random.random()) for i in range(1, 41) for f in range(1, 5)]
    label = {i: y for i, y, *_ in data}
    data = [(i, label[i], f, v) for i, _, f, v in data]
    x = spark.createDataFrame(data, "id long, y int, fid long, fval double")
    w = lr.constant_weights(spark, 4, F.lit(0.1))
    X, y = np.array([[v for i, _, _, v in data if i == k] for k in range(1, 41)]), np.array([label[k] for k in range(1, 41)])

    def step(v, rows, rate):
        return v - rate * X[rows].T @ (1 / (1 + np.exp(-X[rows] @ v)) - y[rows])

    got = [r.value for r in lr.epoch(x, w, 0.1).df.orderBy("k1").collect()]
    assert np.allclose(got, step(np.full(4, 0.1), slice(None), 0.1))
    want = np.full(4, 0.1)
    for a in range(0, 40, 15):
        want = step(want, slice(a, a + 15), 0.1)
    assert np.allclose([r.value for r in lr.minibatch_epoch(x, w, 0.1, 15).df.orderBy("k1").collect()], want)
    # two AdaRevision steps, the second with gradients computed before the first was applied
    state = lr.adarevision_state(w)
    g = lr.gradients(x, state["x"]).select("k1", "g")
    first = lr.adarevision_step(state, g, state["G"], 0.1)
    second = lr.adarevision_step(first, g, state["G"], 0.1)
    G = X.T @ (1 / (1 + np.exp(-X @ np.full(4, 0.1))) - y)
    v, acc, z, zp = np.full(4, 0.1), np.zeros(4), np.ones(4), np.ones(4)
    for _ in range(2):
        back, old = acc - 0, 0.1 / np.sqrt(zp)
        z = z + G * G + 2 * G * back
        zp = np.maximum(z, zp)
        eta = 0.1 / np.sqrt(zp)
        v, acc = v - eta * G + (old - eta) * back, acc + G
    assert np.allclose([r.value for r in second["x"].df.orderBy("k1").collect()], v)


def test_gibbs_sweep_keeps_marginals(spark, sf):
    counts = lda.token_counts(spark, sf, 60)
    t = lda.tokens(counts, 4)
    n = t.df.count()
    before = lda.log_likelihood(t, 60, 4).first()
    s = t
    for seed in (1, 2):
        s = lda.sweep(s, 60, 4, seed=seed, slots=2)
    assert s.df.count() == n and s.df.select("k1", "k2", "k3").exceptAll(t.df.select("k1", "k2", "k3")).isEmpty()
    assert s.df.where("value < 1 or value > 4").isEmpty()
    after = lda.log_likelihood(s, 60, 4).first()
    assert after.word_llh + after.doc_llh > before.word_llh + before.doc_llh
    assert lda.shuffled(counts).count() == counts.count()


def test_scalar_functions(spark):
    row = spark.range(1).select(
        C.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("dot"), C.safe_log(F.lit(0.0)).alias("log"),
        C.map_get(F.create_map(F.lit("a"), F.lit(1)), F.lit("b"), F.lit(7)).alias("get"), C.map_put(F.create_map(F.lit("a"), F.lit(1)), F.lit("a"), F.lit(2)).alias("put"),
        F.size(C.map_remove(F.create_map(F.lit("a"), F.lit(1)), F.lit("a"))).alias("removed"), C.find_index(F.array(F.lit(5), F.lit(6)), F.lit(6)).alias("at"),
        C.vector(lambda a, b: a + b, C.ones(2), C.zeros(2)).alias("sum"), C.sorted_counts(F.array(F.lit(1), F.lit(0), F.lit(3), F.lit(3))).alias("counts"),
    ).first()
    assert row["dot"] == 11 and row["log"] == math.log(1e-15) and row["get"] == 7 and row["put"] == {"a": 2} and row["removed"] == 0 and row["at"] == 2
    assert row["sum"] == [1.0, 1.0] and [(c["count"], c["topic"]) for c in row["counts"]] == [(3, 3), (3, 4), (1, 1)]


def test_sweep_is_the_serial_one(spark):
    """Against buckets summed up afresh for every token, in the order of keys."""
    random.seed(8)
    cells = sorted({(random.randint(1, 3), random.randint(1, 6), random.randint(1, 9)) for _ in range(90)}, key=lambda k: k[::-1])
    topics = {k: random.randint(1, 5) for k in cells}
    t = DistArray(spark.createDataFrame([(*k, z) for k, z in topics.items()], "k1 long, k2 long, k3 long, value int"), Meta(3, (3, 6, 9)))
    got = {(r.k1, r.k2, r.k3): r.value for r in lda.sweep(t, 6, 5, seed=3, slots=1).df.collect()}
    alpha, beta, w, d, n = lda.ALPHA, lda.BETA, np.zeros((7, 5)), np.zeros((10, 5)), np.zeros(5)
    for (_, word, doc), z in topics.items():
        for table in (w[word], d[doc], n):
            table[z - 1] += 1
    for key in cells:
        _, word, doc = key
        for table in (w[word], d[doc], n):
            table[topics[key] - 1] -= 1
        below = n + beta * 6
        q = [(-w[word][j], j, w[word][j] * (alpha + d[doc][j]) / below[j]) for j in range(5) if w[word][j]]
        buckets = [(j, x) for _, j, x in sorted(q)] + [(j, d[doc][j] * beta / below[j]) for j in range(5) if d[doc][j]] + [(j, alpha * beta / below[j]) for j in range(5)]
        assert math.isclose(sum(x for _, x in buckets), ((w[word] + beta) * (d[doc] + alpha) / below).sum())
        u = lda.draw(3, key) * sum(x for _, x in buckets)
        for j, x in buckets:
            u -= x
            if u < 0:
                break
        topics[key] = j + 1
        for table in (w[word], d[doc], n):
            table[j] += 1
    assert got == topics
    ranked = {r.wid: r.counts for r in lda.word_topic_sorted(lda.sweep(t, 6, 5, seed=3, slots=1), 5).collect()}
    assert all(c["count"] == w[k][c["topic"] - 1] > 0 for k, cs in ranked.items() for c in cs) and all(len(cs) == (w[k] > 0).sum() for k, cs in ranked.items())


def test_repeated_loop_cuts_its_cells_once_and_moves_touched_blocks_only(spark, monkeypatch):
    from keyloom.operators import loops

    a, rows = sparse(spark)
    w, h = mf.random_factors(spark, 23, 4, 1), mf.random_factors(spark, 19, 4, 2)
    cut, put = [], []
    monkeypatch.setattr(loops, "kept", lambda df, name="kept", by=(): cut.append(name) or kept(df, name, by))
    first = loops._Stored.put
    monkeypatch.setattr(loops._Stored, "put", lambda self, df, touched, *more: put.append(len(touched)) or first(self, df, touched, *more))
    got = (w, h)
    for _ in range(2):
        got = mf.epoch(a, *got, slots=3)
    assert cut == ["cells"]  # two epochs ship the cells once
    assert len(put) == 2 * (2 + 3) and all(n == 6 for k, n in enumerate(put) if k % 5 > 1)
    ts, tt = tile_size(19, 3), tile_size(23, 3)
    turn = {(t.space, t.time): (t.step, t.slot, t.sub) for t in rotation(3, -(-19 // ts), -(-23 // tt))}
    want = (vectors(w), vectors(h))
    for _ in range(2):
        want = serial_mf(rows, *want, 0.01, lambda r: (turn[(r[1] - 1) // ts, (r[0] - 1) // tt], r[1], r[0]))
    assert same(vectors(got[0]), want[0]) and same(vectors(got[1]), want[1])
    a.delete()
    assert not a.tiled


def test_loop_with_more_tiles_than_slots_and_equal_mass(spark):
    a, rows = sparse(spark)
    w, h = mf.random_factors(spark, 23, 4, 1), mf.random_factors(spark, 19, 4, 2)
    body = mf.sgd_body(0.01)
    want = serial_mf(rows, vectors(w), vectors(h), 0.01, lambda r: (r[1], r[0]))
    for options in ({"parts": 5}, {"histogram_partitioned": True}, {"prefetch_disabled": True, "parts": 1}):
        got, _ = parallel_for(a, body, {"W": w, "H": h}, ordered=True, slots=2, **options)
        assert same(vectors(got["W"]), want[0]) and same(vectors(got["H"]), want[1]), options


def test_groups_accumulators_and_indexes(spark):
    from keyloom.operators.groups import Accumulator, carried
    from keyloom.operators.loops import for_each_group
    from keyloom.operators.partition import reindexed
    from keyloom.plans.meta import IndexType

    a, rows = sparse(spark)
    got = for_each_group(a, (2,), lambda at, cells: iter([{"k": at[0], "total": sum(v for _, v in cells), "first": next(iter(()), None)}]), "k long, total double, first long")
    assert all(math.isclose(r.total, sum(v for _, y, v in rows if y == r.k)) for r in got.collect()) and got.count() == len({y for _, y, _ in rows})
    acc = Accumulator("+", 10)
    assert math.isclose(acc.add(a.df, F.col("value")), 10 + sum(v for *_, v in rows)) and math.isclose(acc.add(a.df, F.lit(1.0)), acc.current)
    assert acc.reset() == 10 == acc.current

    def running(state, keys, value):
        state["n"] = state.get("n", 0) + 1
        return value + state["n"] * 0

    assert carried(a, running, dict, "double").df.exceptAll(a.df).isEmpty()
    assert reindexed(a, IndexType.RANGE).meta.partitioning.index is IndexType.RANGE
    assert WriteBuffer(F.max).reset().delta(spark.createDataFrame([(1, 2.0), (1, 3.0)], "k1 long, update double"), ["k1"]).first().update == 5.0


def test_every_slot_answers(spark):
    from keyloom.operators.debug import eval_on_all

    assert eval_on_all(spark, lambda: 6 * 7) == ["42"] * spark.sparkContext.defaultParallelism


def test_gathered_cells(spark):
    a = fill(spark, F.col("id").cast("double"), 6, 5)

    def body(key, value, A, B):
        x = A[key[0] + 1, :]
        return x + A[2, 3] + B[int(value)]

    space = DistArray(spark.createDataFrame([(3, 1, 0.0), (4, 1, 0.0), (3, 2, 0.0)], "k1 long, k2 long, value double"), Meta(2, (5, 5)))
    got = access.gathered(space, body, {"A": a, "B": fill(spark, 1.0, 7)})
    assert {(r.k1, r.k2) for r in got["A"].df.collect()} == {(2, 3), *((i, j) for i in (4, 5) for j in range(1, 6))} and got["A"].df.count() == 11
    assert got["B"].df.count() == 7
