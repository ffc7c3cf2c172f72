"""Words of texts as 64-bit hashes, found and remembered by whole arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Words of more bytes are summed up: a random number of each byte times a factor to the power of its place, up to a place from which powers come again.
SHORT, PLACES = 32, 1 << 16
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_OF_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15


def _powers(factor: int) -> np.ndarray:
    return np.append(np.uint64(1), np.cumprod(np.full(PLACES - 1, factor & (1 << 64) - 1, np.uint64)))


#: The bits of so many bytes.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_POWERS, _INVERSES = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def word_hashes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a text: of short ones from eight bytes at once, of others from sums over their bytes."""
    eights = np.zeros(len(text) // 8 + 2, "<u8")
    eights.view(np.uint8)[: len(text)] = text
    total = np.zeros(len(starts), np.uint64)
    here, at, left = np.arange(len(starts)), starts, sizes
    for done in range(0, SHORT, 8):
        if done:
            here = np.flatnonzero(sizes > done)
            at, left = starts[here] + done, sizes[here] - done
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = eights[place] >> shift | eights[place + 1] << np.uint64(63) - shift << np.uint64(1)
        x = (total[here] ^ x & _BYTES[np.minimum(left, 8)]) * np.uint64(_FACTOR)
        total[here] = x ^ x >> np.uint64(32)
    if len(long := np.flatnonzero(sizes > SHORT)):
        size = sizes[long]
        total[long] = summed_bytes(text[bytes_at(starts[long], size)], np.cumsum(size) - size, size)
    return mix(total, sizes.astype(np.uint64), 5, (1 << 64) - 1)


def summed_bytes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A sum over each word's bytes, from running sums; words across a multiple of PLACES are summed up apart."""
    terms = np.zeros((-(-len(text) // PLACES), PLACES), np.uint64)
    terms.reshape(-1)[: len(text)] = _OF_BYTE[text]
    terms *= _POWERS
    sums = np.append(np.uint64(0), np.cumsum(terms.reshape(-1)[: len(text)], dtype=np.uint64))
    total = (sums[starts + sizes] - sums[starts]) * _INVERSES[starts % PLACES]
    for k in np.flatnonzero(starts // PLACES != (starts + sizes - 1) // PLACES).tolist():
        own = _OF_BYTE[text[starts[k] : starts[k] + sizes[k]]]
        total[k] = sum((int((own[a : a + PLACES] * _POWERS[: len(own) - a]).sum(dtype=np.uint64)) for a in range(0, len(own), PLACES))) & (1 << 64) - 1
    return total


def mix(a: np.ndarray, b: np.ndarray, salt: int, mask: int) -> np.ndarray:
    """One key of two, in that order, with the bits of ``mask``."""
    x = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) + b * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(32)) & np.uint64(mask)


def grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal values, the place of one of them, by ascending value; and which of those each place has."""
    order = np.argsort(code)
    ordered = code[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(code) else np.zeros(0, bool)
    back = np.empty(len(code), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def bytes_at(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of words, one word after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass(frozen=True)
class Run:
    """Remembered words: hashes, ascending, and where each one's ids are."""

    keys: np.ndarray
    first: np.ndarray
    many: np.ndarray
    ids: np.ndarray

    def size(self) -> int:
        return self.keys.nbytes + self.first.nbytes + self.many.nbytes + self.ids.nbytes

    def beside(self, other: Run) -> Run:
        keys = np.append(self.keys, other.keys)
        order = np.argsort(keys)
        first, many = np.append(self.first, other.first + len(self.ids)), np.append(self.many, other.many)
        return Run(keys[order], first[order], many[order], np.append(self.ids, other.ids))


class Memory:
    """Ids of words by their hashes, in sorted runs; runs of like size are merged, so there are few.

    When they have their bytes, memory starts afresh.
    """

    def __init__(self, most_bytes: int):
        self.runs: list[Run] = []
        self.most_bytes = most_bytes

    def size(self) -> int:
        return sum(r.size() for r in self.runs)

    def look_up(self, keys: np.ndarray, kept: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct ascending ``keys``: where each one's ids begin in an array of ids, how many they are, and that array.

        ``learn``: of places in ``keys`` that aren't remembered, all their ids and how many each has. ``kept``: whether to remember.
        """
        left = np.arange(len(keys))
        first, many, ids, held = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [np.zeros(0, np.uint32)], 0
        for run in self.runs:
            found = np.minimum(np.searchsorted(run.keys, keys[left]), len(run.keys) - 1)
            hit = run.keys[found] == keys[left]
            here, found = left[hit], found[hit]
            many[here] = run.many[found]
            first[here] = held + np.cumsum(many[here]) - many[here]
            ids.append(run.ids[bytes_at(run.first[found], many[here])])
            held, left = held + len(ids[-1]), left[~hit]
        if len(left):
            own, many[left] = learn(left)
            at = np.cumsum(many[left]) - many[left]
            first[left] = held + at
            ids.append(own)
            here = np.flatnonzero(kept[left])
            if len(here):
                n = many[left[here]]
                self._remember(Run(keys[left[here]], np.cumsum(n) - n, n.astype(np.int32), own[bytes_at(at[here], n)]))
        return first, many, np.concatenate(ids)

    def _remember(self, run: Run) -> None:
        if self.size() + run.size() > self.most_bytes:
            self.runs = []
        self.runs.append(run)
        while len(self.runs) > 1 and 2 * len(self.runs[-1].keys) >= len(self.runs[-2].keys):
            last = self.runs.pop()
            self.runs[-1] = self.runs[-1].beside(last)
