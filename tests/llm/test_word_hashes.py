"""Hashes of words are of their bytes alone, wherever they lie, and running sums are for long words only."""

import numpy as np

from keyloom.llm import word_hashes as module
from keyloom.llm.word_hashes import SHORT, word_hashes


def hashes(words, before=b""):
    text = np.frombuffer(before + b" ".join(words) + b" ", np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    return word_hashes(text, len(before) + np.cumsum(sizes + 1) - sizes - 1, sizes)


def test_hashes_are_of_bytes_wherever_they_lie():
    rng = np.random.default_rng(1)
    words = [rng.integers(33, 256, n, np.uint8).tobytes() for n in rng.integers(1, 3 * SHORT, 20_000)]
    words += [b"x" * k for k in range(1, 3 * SHORT)] + [b"y" * 200_000, b"y" * 199_999 + b"z", b"z" + b"y" * 199_999, b"\0", b"\0\0", b"a", b"a\0"]
    words += [b"%d" % k for k in range(100_000)] + [b"w" * at + b"v" + b"w" * (SHORT - 1 - at) for at in range(SHORT)]
    got = hashes(words)
    assert len(set(got.tolist())) == len(set(words))
    for before in (b" ", b"12345 ", b"1234567 ", b"abcdefghijkl"):
        assert (hashes(words, before) == got).all()
    assert (hashes(words[::-1])[::-1] == got).all()
    assert len(word_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_bytes_are_summed_up_for_long_words_alone(monkeypatch):
    seen, whole = [], module.summed_bytes
    monkeypatch.setattr(module, "summed_bytes", lambda text, *rest: seen.append(len(text)) or whole(text, *rest))
    hashes([b"short"] * 1000 + [b"s" * SHORT])
    hashes([b"short"] * 1000 + [b"l" * (SHORT + 1)])
    assert seen == [SHORT + 1]
