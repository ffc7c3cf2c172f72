"""The loop planner: accesses from source, dependence vectors, schemes, placement, schedules. No Spark."""

import pytest

from keyloom.plans.capture import accesses_of
from keyloom.plans.dependence import ALL, ANY, NONNEG, UNKNOWN, Access, Fixed, Loop, NotParallelizable, Scheme, choose, dependences, placement, scheme_of
from keyloom.plans.meta import LoopScheme
from keyloom.plans.schedule import rotation, wavefront


def test_capture():
    source = """
def body(key, value, A, B, C):
    x = key[0]
    y, z = key
    c = 2
    A[:, x] = B[z - 1 + c]
    A[:, x + 1] += 1
    for f in value:
        C[f] = A[2 * key[0], 3]
    B[5 - key[1]] = B[-1]
"""
    found = accesses_of(source)
    assert Access("A", (ALL, Loop(1)), True) in found
    assert Access("B", (Loop(2, 1),)) in found
    assert Access("A", (ALL, Loop(1, 1)), True) in found and Access("A", (ALL, Loop(1, 1))) in found
    assert Access("C", (UNKNOWN,), True) in found and Access("A", (UNKNOWN, Fixed(3))) in found
    assert Access("B", (UNKNOWN,), True) in found and Access("B", (Fixed(-1),)) in found


def test_capture_names_assigned_twice_are_unknown():
    found = accesses_of("def body(key, value, A):\n    x = key[0]\n    if value:\n        x = 3\n    A[x] = 1\n")
    assert found == [Access("A", (UNKNOWN,), True)]


def test_capture_declared_writes():
    found = accesses_of("def body(key, value, A):\n    v = A[key[0]]\n    v.append(1)\n", writes={"A": [(Loop(1),)]})
    assert Access("A", (Loop(1),), True) in found


def rw(name, *places):
    return [Access(name, places), Access(name, places, True)]


MF = [*rw("W", ALL, Loop(1)), *rw("H", ALL, Loop(2))]
LDA = [*rw("words", Loop(2)), *rw("docs", Loop(3)), Access("totals", (Fixed(1),)), Access("s", (Fixed(1),))]
STENCIL = [Access("A", (Loop(1), Loop(2)), True), Access("A", (Loop(1, -1), Loop(2))), Access("A", (Loop(1), Loop(2, -1)))]


@pytest.mark.parametrize(
    ("accesses", "dims", "ordered", "buffers", "vectors", "scheme"),
    [
        (MF, 2, False, (), {(0, NONNEG), (NONNEG, 0)}, Scheme(LoopScheme.TWO_D, 2, 1)),
        ([a for a in MF if not a.write], 2, False, (), set(), Scheme(LoopScheme.NAIVE)),
        ([Access("w", (UNKNOWN,)), Access("buf", (UNKNOWN,), True)], 1, False, ("buf",), set(), Scheme(LoopScheme.NAIVE)),
        (LDA, 3, False, (), {(NONNEG, 0, ANY), (NONNEG, ANY, 0)}, Scheme(LoopScheme.TWO_D, 3, 2)),
        ([Access("r", (Loop(1),), True), Access("t", (Fixed(1),))], 1, False, (), set(), Scheme(LoopScheme.NAIVE)),
        ([Access("r", (Loop(1),), True), Access("t", (Fixed(1),))], 1, True, (), {(0,)}, Scheme(LoopScheme.ONE_D, 1)),
        (rw("A", Loop(1)), 2, False, (), {(0, NONNEG)}, Scheme(LoopScheme.ONE_D, 1)),
        ([Access("A", (Fixed(1),), True), Access("A", (Fixed(2),))], 2, False, (), set(), Scheme(LoopScheme.NAIVE)),
    ],
)
def test_vectors_and_schemes(accesses, dims, ordered, buffers, vectors, scheme):
    found = dependences(accesses, dims, ordered, buffers)
    assert found == vectors
    assert choose(found, dims) == scheme


def test_stencils():
    one = [Access("A", (Loop(1),), True), Access("A", (Loop(1, -1),))]
    assert dependences(one, 1) == {(1,)}
    with pytest.raises(NotParallelizable):
        scheme_of(one, 1)
    assert dependences(STENCIL, 2) == {(1, 0), (0, 1)}
    assert choose({(1, 0), (0, 1)}, 2) == Scheme(LoopScheme.TWO_D, 2, 1)
    assert placement(STENCIL, Scheme(LoopScheme.TWO_D, 2, 1), {"A": (9, 9)}, (9, 9)) == {"A": ("global", None)}
    assert choose({(1, 1)}, 2).kind is LoopScheme.UNIMODULAR
    with pytest.raises(NotParallelizable):
        scheme_of([Access("A", (UNKNOWN,), True), Access("A", (UNKNOWN,))], 2)


def test_contradictory_distances_are_independent():
    assert dependences([Access("A", (Loop(1), Loop(1)), True), Access("A", (Loop(1, 1), Loop(1)))], 1) == set()


def test_placement():
    scheme = Scheme(LoopScheme.TWO_D, 2, 1)
    assert placement(MF, scheme, {"W": (8, 20), "H": (8, 10)}, (20, 10)) == {"W": ("time", 2), "H": ("space", 2)}
    assert placement(MF, scheme, {"W": (8, 21), "H": (8, 10)}, (20, 10))["W"] == ("global", None)


@pytest.mark.parametrize("slots", [1, 3, 4, 5])
def test_schedules_cover_each_tile_once_and_slots_share_nothing(slots):
    for s, t in ((1, 1), (slots, slots), (slots + 2, 2 * slots + 1)):
        for turns in (rotation(slots, s, t), wavefront(s, t)):
            assert sorted((x.space, x.time) for x in turns) == [(a, b) for a in range(s) for b in range(t)]
            for step in {x.step for x in turns}:
                now = [x for x in turns if x.step == step]
                for a in now:
                    for b in now:
                        if a.slot != b.slot:
                            assert a.space != b.space and a.time != b.time
                        else:
                            assert a.time == b.time


def test_wavefront_respects_order():
    step = {(x.space, x.time): x.step for x in wavefront(4, 6)}
    assert all(step[a, b] < step[c, d] for a, b in step for c, d in step if (a, b) != (c, d) and a <= c and b <= d)
