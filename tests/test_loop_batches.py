"""Loop bodies that get many cells, and tasks that hold a bounded number of them."""

import numpy as np
import pyarrow as pa

from keyloom.operators import loops
from keyloom.plans.schedule import Turn, closed_up
from keyloom.workloads import mf


def test_levels_keep_the_order_of_cells_that_share_a_coordinate():
    a, b = np.array([1, 2, 1, 3, 3, 2]), np.array([5, 5, 6, 7, 6, 8])
    assert loops.levels([a, b]).tolist() == [0, 1, 1, 0, 2, 2]
    assert loops.levels([a]).tolist() == [0, 0, 1, 0, 1, 1]


def test_tiles_run_as_soon_as_those_before_them_have():
    diagonal = [Turn(2 * k, 0, k, k, k) for k in range(5)]
    assert closed_up(diagonal, 8) == [[(k, k) for k in range(5)]]
    assert [len(s) for s in closed_up(diagonal, 2)] == [2, 2, 1]
    assert closed_up([Turn(0, 0, 0, 0, 0), Turn(1, 0, 0, 0, 1), Turn(1, 0, 1, 1, 0)], 8) == [[(0, 0)], [(0, 1), (1, 0)]]


def batches_of(k1, k2, values, size):
    for at in range(0, len(k1), size):
        n = len(k1[at : at + size])
        own = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(k1[at : at + size]), pa.array(k2[at : at + size]), pa.array(values[at : at + size]), pa.array(np.arange(at, at + n)), *own], ["k1", "k2", "value", "lin", "array", "k", "vec", "block"])


def blocks_of(which, vectors):
    n, blank = len(vectors), [pa.nulls(len(vectors), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())]
    vec = loops._binary(np.concatenate(vectors), np.array([len(v) for v in vectors]))
    return pa.RecordBatch.from_arrays([*blank, pa.array([which] * n, pa.int32()), pa.array(np.arange(1, n + 1)), vec, pa.array([0] * n, pa.int32())], ["k1", "k2", "value", "lin", "array", "k", "vec", "block"])


def test_a_task_gives_cells_back_before_it_has_read_them_all():
    read = []
    k = np.arange(1, 8 * loops.ONE_BY_ONE // 2 + 1)
    source = (read.append(len(b)) or b for b in batches_of(k, k, k / 2, loops.ONE_BY_ONE // 2))
    out = loops._kernel(lambda key, value: value + key[0], [], {}, {}, {}, 2, True, None)(source)
    first = next(out)
    assert sum(read) == loops.ONE_BY_ONE
    got = pa.Table.from_batches([first, *out])
    assert got.column("value").to_numpy().tolist() == (k * 1.5).tolist() and got.column("k1").to_numpy().tolist() == k.tolist()


def test_many_cells_together_give_the_bits_of_one_by_one():
    rng = np.random.default_rng(5)
    cells = sorted({(int(j), int(i)) for i, j in zip(rng.integers(1, 60, 900), rng.integers(1, 20, 900))})
    k1, k2, values = np.array([c[1] for c in cells]), np.array([c[0] for c in cells]), rng.random(len(cells))
    w, h, calls, got = list(rng.random((60, 4))), list(rng.random((20, 4))), [0], []
    for chains in ([2, 1], None):  # None: one by one
        plain = mf.sgd_body(0.01)

        def body(key, value, W, H):
            calls[-1] += 1
            plain(key, value, W, H)

        body.together = True
        run = loops._kernel(body, ["W", "H"], {"W": False, "H": False}, {"W": "time", "H": "space"}, {}, 2, False, chains)
        out = run(iter([blocks_of(0, w), blocks_of(1, h), *batches_of(k1, k2, values, 100)]))
        got.append([(r["name"], r["k"], r["vec"]) for b in out for r in b.to_pylist()])
        calls.append(0)
    assert got[0] == got[1] and len(got[0]) == 80
    assert calls[0] < calls[1] / 4 and calls[1] == len(cells)
