"""Interpolated modified Kneser-Ney over words, order three, in tables that grow with the trusted text.

A word, a pair and a triple are keys of as many bits as the text asks for (``key_mask``). There are three tables: of triples (their count n), of pairs and of words
(n: how many different words come before; and as a context the total N of what follows and how many of those have count
1, 2 and more). Each is cut into shards by ranges of keys, so that no shard depends on how frequent a word is. Keys
travel between tasks as sorted, packed runs of one shard. Unseen words are as likely as the letters of ``kneser_ney``
spell them.

Training: chunks of trusted text send their distinct triples to shards by triple; from there go what contexts and pairs
are due to the shards by pair, and from those to the shards by word. Scoring: documents are gathered in chunks; a chunk
asks each shard for its distinct keys and adds up its documents' bits from the answers. Both go in rounds over shards
and chunks, and a round's shuffle files are freed before the next: ``Rounds`` says how many at most, so how much disk is used.
A trusted document is scored by what the others hold: its own counts are taken off first, else the thresholds would be
those of memorised texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.bpe import slices
from keyloom.llm.common import discard, free_shuffles, remove, scratch, split_written, unused, written
from keyloom.llm.word_hashes import SPACES, bytes_at, grouped, mix, word_hashes

#: Bytes of text of a chunk (a longer document makes a larger one) and of all documents to a shard of each table.
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 16 << 20


@dataclass(frozen=True)
class Rounds:
    """In how many parts, one after another, triples are counted, pairs are counted and documents are scored."""

    triples: int = 3
    pairs: int = 6
    scores: int = 8


#: Keys of what comes before a text and after it.
START_KEY, END_KEY = 0, 1 << 62

#: Bits of a key beyond those that number the bytes of all texts: a gram that isn't in a table is found there once in 2**20.
SPARE_BITS = 20

#: Kinds of packed rows: distinct triples of a chunk; counts of triples; what contexts and pairs get; counts of pairs; what words get; counts of words; sums.
FOUND, TRIPLE, CONTEXTS, ENDS, PAIR, BEFORE, AFTER, WORD, SUMS = range(9)

PIECE = "kind int, shard int, blob binary"

_ZSTD = pa.Codec("zstd")


def key_mask(size: int) -> int:
    """The bits that keys have over texts of ``size`` bytes; the rest of 64 are zero, and aren't sent."""
    return (1 << 64) - (1 << max(0, 64 - SPARE_BITS - size.bit_length()))


def pack(spec: str, *arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: k ascending keys (one array at most), i counts. Each has as many bytes as its largest number."""
    parts, zeros, widths = [], 0, []
    for kind, a in zip(spec, arrays):
        if kind == "k":
            bits = int(np.bitwise_or.reduce(a)) if len(a) else 0
            zeros = max(0, (bits & -bits).bit_length() - 1)
            a = np.diff(a >> np.uint64(zeros), prepend=np.zeros(1, np.uint64))
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        widths.append(width)
        if width == 1:
            parts.append(a.astype(np.uint8).tobytes())
        else:
            planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)
            parts += [planes[:, k].tobytes() for k in range(width)]
    head = (len(arrays[0]) << 8 | zeros).to_bytes(8, "little") + bytes(widths)
    return head + _ZSTD.compress(b"".join(parts), asbytes=True)


def unpack(spec: str, blob: bytes) -> list[np.ndarray]:
    head, widths, out, at = int.from_bytes(blob[:8], "little"), blob[8 : 8 + len(spec)], [], 0
    n, zeros = head >> 8, np.uint64(head & 255)
    data = np.frombuffer(_ZSTD.decompress(blob[8 + len(spec) :], n * sum(widths), asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    for kind, width in zip(spec, widths):
        if width == 1:
            a = data[at : at + n].astype(np.uint64 if kind == "k" else np.int64)
        else:
            planes = np.zeros((n, 8), np.uint8)
            for k in range(width):
                planes[:, k] = data[at + k * n : at + (k + 1) * n]
            a = planes.reshape(-1).view(np.uint64 if kind == "k" else np.int64)
        at += width * n
        out.append(np.cumsum(a, dtype=np.uint64) << zeros if kind == "k" else a)
    return out


def joined(blobs: list[bytes], spec: str) -> list[np.ndarray]:
    got = [unpack(spec, b) for b in blobs]
    return [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64 if c == "i" else np.uint64) for k, c in enumerate(spec)]


def pack_grams(grams: list[np.ndarray], n: np.ndarray) -> bytes:
    """Grams (arrays of words' keys, one for each place) and their counts: by numbers into the words that occur."""
    every = np.concatenate(grams)
    at, back = grouped(every)
    words, numbers = every[at], back.reshape(len(grams), -1)
    order = np.argsort(numbers[0])
    body = [np.diff(numbers[0][order], prepend=0), *(x[order] for x in numbers[1:]), n[order]]
    packed = pack("i" * len(body), *body)
    return len(packed).to_bytes(8, "little") + packed + pack("k", words)


def unpack_grams(blob: bytes, size: int) -> list[np.ndarray]:
    """As many arrays of keys as ``size`` says, and the counts."""
    end = 8 + int.from_bytes(blob[:8], "little")
    (words,) = unpack("k", blob[end:])
    first, *rest, n = unpack("i" * (size + 1), blob[8:end])
    return [words[np.cumsum(first)], *(words[x] for x in rest), n]


def joined_grams(blobs: list[bytes], size: int) -> list[np.ndarray]:
    got = [unpack_grams(b, size) for b in blobs]
    return [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint64 if k < size else np.int64) for k in range(size + 1)]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Shard, first and last place of each run of ascending keys in one shard: shards are equal ranges of keys."""
    shard = shard_of(keys, shards)
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(shard[at].astype(int).tolist(), at.tolist(), np.append(at[1:], len(keys)).tolist()))


def classes(n: np.ndarray) -> list[np.ndarray]:
    return [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)]


def sums(level: int, n: np.ndarray) -> tuple:
    """How many grams have counts 1 to 4, the sum of counts, how many grams there are."""
    return (SUMS, level, pack("i", np.array([*((n == k).sum() for k in (1, 2, 3, 4)), n.sum(), len(n)], np.int64)))


def as_table(rows: list[tuple]) -> pa.Table:
    types = (("kind", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary()))
    return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], names=[x for x, _ in types])


_START = np.array([START_KEY], np.uint64)


class Chunk:
    """The words of some texts as keys, and their grams: arrays of one entry for each word and each end.

    Before ``number_grams``: ``u``, ``v`` and ``w``, keys of each word and the two before it. After it, ``triple``, ``pair``, ``context``,
    ``word`` and ``before`` say which of the distinct ``triple_keys``, ``pair_keys`` and ``word_keys``, all ascending, are
    those of all three, of the last two, of the first two, of the last and of the one before.
    """

    def __init__(self, texts: list[bytes], mask: int):
        self.mask, many = mask, len(texts)
        self.text = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, many) + 1
        space = SPACES[self.text]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.word_sizes = np.flatnonzero(~space[:-1] & space[1:]) + 1 - self.starts
        ends = np.searchsorted(self.starts, np.cumsum(lengths) + 1)
        self.sizes = np.diff(ends, prepend=0)  # words of each text
        self.doc = np.repeat(np.arange(many), self.sizes + 1)
        last = np.cumsum(self.sizes + 1) - 1
        self.is_word = np.ones(len(self.doc), bool)
        self.is_word[last] = False
        self.first = last - self.sizes
        self.w = np.full(len(self.doc), END_KEY, np.uint64)
        self.w[self.is_word] = word_hashes(self.text, self.starts, self.word_sizes)
        self.w &= np.uint64(mask)
        self.v = self._before(self.w)
        self.u = self._before(self.v)

    def _before(self, a: np.ndarray) -> np.ndarray:
        out = np.append(np.uint64(START_KEY), a[:-1])[: len(a)]
        out[self.first] = START_KEY
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The triple, the pair and the word at each place."""
        pair, context = mix(self.v, self.w, 2, self.mask), mix(_START, _START, 2, self.mask)
        before = np.append(context, pair[:-1])[: len(pair)]
        before[self.first] = context
        return mix(before, pair, 3, self.mask), pair, self.w

    def requests(self) -> list[tuple[int, np.ndarray]]:
        """Kind of table and the keys that a chunk asks it for, ascending: its triples, pairs and words, and what comes before a text."""
        triple, pair, word = self.keys()
        return [(TRIPLE, distinct(triple)), (PAIR, distinct(np.append(pair, mix(_START, _START, 2, self.mask)))), (WORD, distinct(np.append(word, _START)))]

    def number_grams(self) -> Chunk:
        triple, pair, word = self.keys()
        at, numbers = grouped(np.append(word, _START))
        self.word_keys, self.word, self.start_word = np.append(word, _START)[at], numbers[:-1], numbers[-1]
        self.before = self._shifted(self.word, self.start_word)
        some = at < len(word)
        self.written = np.full(len(at), -1)  # which of the texts' words a number is, or -1 for the start and the end
        self.written[some] = np.where(self.is_word, np.cumsum(self.is_word) - 1, -1)[at[some]]
        pair = np.append(pair, mix(_START, _START, 2, self.mask))
        at, numbers = grouped(pair)
        self.pair_keys, self.pair = pair[at], numbers[:-1]
        self.context = self._shifted(self.pair, numbers[-1])
        at, self.triple = grouped(triple)
        self.triple_keys = triple[at]
        del self.u, self.v, self.w
        return self

    def _shifted(self, numbers: np.ndarray, start: int) -> np.ndarray:
        out = np.append(start, numbers[:-1])[: len(numbers)]
        out[self.first] = start
        return out

    def document_bytes(self) -> np.ndarray:
        """Bytes of each document's words, a space after each and one for the end; 0 without words."""
        size = np.ones(len(self.doc))
        size[self.is_word] += self.word_sizes
        return np.where(self.sizes > 0, np.bincount(self.doc, size, len(self.sizes)), 0).astype(np.int64)


def texts_of(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# training


def emit(chunk: Chunk, shards: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple]:
    """Distinct triples with their counts, for each shard, or for those that are ``wanted``."""
    grams, triple = [chunk.u, chunk.v, chunk.w], chunk.keys()[0]
    if wanted is not None:
        here = wanted(shard_of(triple, shards))
        triple, grams = triple[here], [g[here] for g in grams]
    at, back = grouped(triple)
    n = np.bincount(back, minlength=len(at))
    return [(FOUND, shard, pack_grams([g[at[a:b]] for g in grams], n[a:b])) for shard, a, b in by_shard(triple[at], shards)]


def sent(rows: list[tuple], kind: int, spec: str, shards: int, keys: np.ndarray, *counts: np.ndarray) -> None:
    """Appends packed runs of ascending ``keys`` and their counts, one for each shard."""
    for shard, a, b in by_shard(keys, shards):
        rows.append((kind, shard, pack(spec, keys[a:b], *(c[a:b] for c in counts))))


def count_triples(shard: int, blobs: list[bytes], shards: int, mask: int) -> list[tuple]:
    """The triples of a shard, and what they give to contexts and to pairs."""
    u, v, w, n = joined_grams(blobs, 3)
    context, pair = mix(u, v, 2, mask), mix(v, w, 2, mask)
    del u
    triple = mix(context, pair, 3, mask)
    at, back = grouped(triple)
    n = np.bincount(back, n, len(at)).astype(np.int64)
    rows = [sums(TRIPLE, n), (TRIPLE, shard, pack("ki", triple[at], n))]
    del triple, back
    sent(rows, CONTEXTS, "kiiii", shards, *summed(context[at], n, *classes(n)))
    pair, v, w = pair[at], v[at], w[at]
    first, back = grouped(pair)
    n = np.bincount(back, minlength=len(first))
    for to, a, b in by_shard(pair[first], shards):
        rows.append((ENDS, to, pack_grams([v[first[a:b]], w[first[a:b]]], n[a:b])))
    return rows


def count_pairs(shard: int, contexts: list[bytes], ends: list[bytes], shards: int, mask: int) -> list[tuple]:
    """The pairs of a shard, as grams and as contexts, and what they give to words."""
    v, w, n = joined_grams(ends, 2)
    pair = mix(v, w, 2, mask)
    at, back = grouped(pair)
    n = np.bincount(back, n, len(at)).astype(np.int64)
    rows = [sums(PAIR, n)]
    sent(rows, BEFORE, "kiiii", shards, *summed(v[at], n, *classes(n)))
    sent(rows, AFTER, "ki", shards, *summed(w[at], np.ones(len(at), np.int64)))
    rows.append((PAIR, shard, merged(pair[at], n, joined(contexts, "kiiii"))))
    return rows


def merged(keys: np.ndarray, n: np.ndarray, contexts: list[np.ndarray]) -> bytes:
    """One table of keys: counts as grams, and as contexts."""
    none = [np.zeros(len(keys), np.int64)] * 4
    whole = summed(np.append(keys, contexts[0]), np.append(n, np.zeros(len(contexts[0]), np.int64)), *map(np.append, none, contexts[1:]))
    return pack("kiiiii", *whole)


def count_words(shard: int, before: list[bytes], after: list[bytes]) -> list[tuple]:
    """The words of a shard, as grams and as contexts."""
    keys, n = summed(*joined(after, "ki"))
    return [sums(WORD, n), (WORD, shard, merged(keys, n, joined(before, "kiiii")))]


class Held:
    """The model's tables in the shared folder, in buckets by shard: who asks them doesn't move them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.name = spark, scratch(spark, "gram-tables"), f"gram_tables_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, table: DataFrame) -> None:
        table.write.mode("append").format("parquet").option("compression", "none").option("path", self.path).bucketBy(self.buckets, "shard").saveAsTable(self.name)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def train_tables(trusted: DataFrame, shards: int, mask: int, rounds: Rounds = Rounds()) -> tuple[Held, dict[int, list[int]]]:
    """The tables (kind TRIPLE, PAIR or WORD, shard, blob) of a frame whose one column is text; and each kind's ``sums``."""
    held = Held(trusted.sparkSession)
    many, fewer = min(rounds.triples, shards), min(rounds.pairs, shards)
    text = trusted.columns[0]

    def grams(r: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in slices(batches, text, CHUNK_BYTES):
                yield from as_table(emit(Chunk([t.encode() for t in texts], mask), shards, lambda shard: shard % np.uint64(many) == r)).to_batches()

        return run

    def blobs(table: pa.Table, *kinds: int) -> tuple:
        of, all_ = table["kind"].to_pylist(), table["blob"].to_pylist()
        return (table["shard"][0].as_py(), *([b for k, b in zip(of, all_) if k == kind] for kind in kinds))

    def triples(table: pa.Table) -> pa.Table:
        return as_table(count_triples(*blobs(table, FOUND), shards, mask))

    def pairs(table: pa.Table) -> pa.Table:
        return as_table(count_pairs(*blobs(table, CONTEXTS, ENDS), shards, mask))

    def words(table: pa.Table) -> pa.Table:
        return as_table(count_words(*blobs(table, BEFORE, AFTER)))

    def step(parts: list[Callable[[], DataFrame]], name: str, *kinds: int, due: int = 1) -> dict[tuple[int, int], DataFrame]:
        """Each part written, one after another; the rows of each kind, and of what is due in each later round, as tables of their own."""
        out: dict[tuple[int, int], list[DataFrame]] = {(k, r): [] for k in kinds for r in range(due if k in (CONTEXTS, ENDS) else 1)}
        place = F.concat_ws("-", "kind", F.when(F.col("kind").isin(CONTEXTS, ENDS), F.col("shard") % due).otherwise(F.lit(0)))
        for part in parts:
            tables = split_written(part().withColumn("place", place), name, "place", [f"{k}-{r}" for k, r in out])
            for key, table in zip(out, tables.values()):
                out[key].append(table.drop("place"))
            if shards > 1:
                free_shuffles(trusted.sparkSession)
        return {k: reduce(DataFrame.unionByName, tables) for k, tables in out.items()}

    count = [lambda r=r: trusted.mapInArrow(grams(r), PIECE).groupBy("shard").applyInArrow(triples, PIECE) for r in range(many)]
    a = step(count, "triples", TRIPLE, CONTEXTS, ENDS, SUMS, due=fewer)
    held.append(a[TRIPLE, 0])
    discard(a[TRIPLE, 0])
    done = []
    for r in range(fewer):
        done.append(step([lambda r=r: a[CONTEXTS, r].unionByName(a[ENDS, r]).groupBy("shard").applyInArrow(pairs, PIECE)], "pairs", PAIR, BEFORE, AFTER, SUMS))
        discard(a[CONTEXTS, r], a[ENDS, r])
    b = {k: reduce(DataFrame.unionByName, [x[k, 0] for x in done]) for k in (PAIR, BEFORE, AFTER, SUMS)}
    held.append(b[PAIR])
    discard(b[PAIR])
    c = {k: x for (k, _), x in step([lambda: b[BEFORE].unionByName(b[AFTER]).groupBy("shard").applyInArrow(words, PIECE)], "words", WORD, SUMS).items()}
    held.append(c[WORD])
    discard(b[BEFORE], b[AFTER], c[WORD])
    found: dict[int, list[int]] = {}
    spread = a[SUMS, 0].unionByName(b[SUMS]).unionByName(c[SUMS]).select(F.col("shard").alias("level"), "blob")

    def add_up(table: pa.Table) -> pa.Table:
        total = np.sum([unpack("i", b)[0] for b in table["blob"].to_pylist()], axis=0).tolist()
        return pa.table([table["level"].slice(0, 1), pa.array([total], pa.list_(pa.int64()))], names=["level", "total"])

    for row in spread.groupBy("level").applyInArrow(add_up, "level int, total array<long>").collect():  # three rows
        found[row["level"]] = row["total"]
    discard(a[SUMS, 0], b[SUMS], c[SUMS])
    return held, found


@dataclass(frozen=True)
class Discounts:
    """Of triples, pairs and words (by count 0, 1, 2, more); the words' total, and the share that it leaves to spelling."""

    triple: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    total: float
    spare: float


def discounts_of(found: dict[int, list[int]]) -> Discounts:
    level = []
    for kind in (TRIPLE, PAIR, WORD):
        n1, n2, n3, n4 = (float(x) for x in found.get(kind, [0] * 4)[:4])
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        level.append(np.array([0.0, *(min(max(x, 0.1), k - 0.1) for k, x in zip((1, 2, 3), d))]))
    n1, n2, _, _, total, size = found.get(WORD, [0] * 6)
    spare = float(level[2] @ [0, n1, n2, size - n1 - n2]) / total if total else 1.0
    return Discounts(*level, float(total), spare)


# scoring


def looked_up(kind: int, wanted: np.ndarray, held: list[np.ndarray]) -> list[np.ndarray]:
    """The counts of each wanted key in a shard's table; zeros for keys that it doesn't have."""
    if not held or not len(held[0]):
        return [np.zeros(len(wanted), np.int64)] * (1 if kind == TRIPLE else 5)
    at = np.minimum(np.searchsorted(held[0], wanted), len(held[0]) - 1)
    hit = held[0][at] == wanted
    return [np.where(hit, c[at], 0) for c in held[1:]]


def document_bits(chunk: Chunk, own: np.ndarray, spelt: np.ndarray, triples: np.ndarray, pairs: np.ndarray, words: np.ndarray, d: Discounts) -> np.ndarray:
    """Bits of each document's words and end. ``own``: whether it is scored without what it holds itself.

    ``spelt``: bits of each word's letters. ``triples`` (n), ``pairs`` and ``words`` (n, N and the three classes): counts of
    the chunk's keys. The words' total and the share it leaves to spelling are those of all documents either way.
    """
    n3, n2, n1 = triples[0][chunk.triple], pairs[0][chunk.pair], words[0][chunk.word]
    # of each context, the total and what it leaves to the level below
    all3, left3 = pairs[1][chunk.context], (d.triple[1:] @ pairs[2:])[chunk.context]
    all2, left2 = words[1][chunk.before], (d.pair[1:] @ words[2:])[chunk.before]
    here = np.flatnonzero(own[chunk.doc])
    if len(here):
        doc = chunk.doc[here]
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))  # where a document begins: its context is none of its pairs
        in_doc = lambda a, size: grouped(doc * size + a[here])

        def before_of(of: np.ndarray, many: int) -> np.ndarray:
            out = np.append(0, of[:-1])
            out[new] = many + np.arange(len(new))
            return out

        # each distinct triple of a document once, with how often the document has it
        at, back = in_doc(chunk.triple, len(chunk.triple_keys))
        times = np.bincount(back, minlength=len(at))
        before = n3[here][at]
        after = before - times
        n3[here] = after[back]
        pair_at, of_pair = in_doc(chunk.pair, len(chunk.pair_keys))
        of = before_of(of_pair, len(pair_at))
        take_off(all3, left3, here, of, of[at], times, before, after, d.triple)
        lost = np.bincount(of_pair[at], (after == 0).astype(float), len(pair_at)).astype(np.int64)
        before = n2[here][pair_at]
        after = before - lost
        n2[here] = after[of_pair]
        word_at, of_word = in_doc(chunk.word, len(chunk.word_keys))
        of = before_of(of_word, len(word_at))
        take_off(all2, left2, here, of, of[pair_at], lost, before, after, d.pair)
        gone = np.bincount(of_word[pair_at], ((after == 0) & (before > 0)).astype(float), len(word_at)).astype(np.int64)
        n1[here] -= gone[of_word]
    p = -spelt[chunk.word]
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        if d.total:
            p = np.log2((n1 - d.word[np.minimum(n1, 3)]) / d.total + d.spare * np.exp2(p))
            long = np.flatnonzero(~np.isfinite(p))  # words whose spelling is less likely than a double can say
            p[long] = math.log2(d.spare) - spelt[chunk.word[long]]
        p = _mixed(n3, all3, left3, d.triple, _mixed(n2, all2, left2, d.pair, p))
    return np.where(chunk.sizes > 0, -np.bincount(chunk.doc, p, len(chunk.sizes)), 0.0)


def _mixed(n: np.ndarray, total: np.ndarray, left: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Logarithms of the shares of a level; where a context wasn't seen, the lower level's as they are."""
    share = ((n - d[np.minimum(n, 3)]) + left * np.exp2(lower)) / total
    seen = total > 0
    out = np.where(seen, np.log2(share), lower)
    none = np.flatnonzero(seen & ~(share > 0))
    out[none] = np.log2(left[none] / total[none]) + lower[none]
    return out


def take_off(total: np.ndarray, left: np.ndarray, here: np.ndarray, of: np.ndarray, to: np.ndarray, lost: np.ndarray, before: np.ndarray, after: np.ndarray, d: np.ndarray) -> None:
    """Takes a document's own part off its contexts' totals and what they leave: ``of`` each place, ``to`` each distinct gram."""
    size = of.max() + 1
    total[here] -= np.bincount(to, lost, size).astype(np.int64)[of]
    left[here] -= np.bincount(to, d[np.minimum(before, 3)] - d[np.minimum(after, 3)], size)[of]
    left[here] = np.where(total[here] > 0, left[here], 0.0)


def scores(docs: DataFrame, letters, id_col: str = "doc_id", text_col: str = "text", trusted_col: str = "trusted", with_text: bool = True, rounds: Rounds = Rounds(), names: tuple[str, str] = ("bits", "bytes")) -> DataFrame:
    """``docs`` without ``trusted_col``, with bits (double) and bytes (long), under ``names``, of their words and end (none: 0, 0).

    ``trusted_col`` (boolean) names whose texts train. ``letters``: what ``spelling`` takes.
    Rows are placed by their content, so that it doesn't matter if they come in another order when read again.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (trusted_col, text_col)]
    plain, chunk, part, null = (unused(docs, x) for x in ("words", "chunk", "round", "null"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    placed = docs.select(*keep, trusted_col, text.alias(plain), docs[text_col].isNull().alias(null), F.pmod(F.xxhash64(text, id_col), F.lit(rounds.scores)).cast("int").alias(part))
    sizes = {r[0]: r[1] for r in placed.groupBy(part).agg(F.sum(F.octet_length(plain))).collect()}  # one row a round
    size = sum(sizes.values())
    shards, many = math.ceil((size + 1) / SHARD_BYTES), min(rounds.scores, math.ceil((size + 1) / SHARD_BYTES))
    mask = key_mask(size)
    held, found = train_tables(placed.where(trusted_col).select(plain), shards, mask, rounds)
    level = discounts_of(found)
    schema = placed.select(*keep, *[plain, null] * with_text).schema.add(names[0], "double").add(names[1], "long")
    asked = "chunk int, kind int, shard int, blob binary"

    def request(table: pa.Table) -> pa.Table:
        runs = [(kind, shard, pack("k", keys[a:b])) for kind, keys in Chunk(texts_of(table[plain]), mask).requests() for shard, a, b in by_shard(keys, shards)]
        return as_table(runs).add_column(0, "chunk", pa.array([table[chunk][0].as_py()] * len(runs), pa.int32()))

    def answer(asks: pa.Table, table: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return asks
        kinds, blobs = asks["kind"].to_pylist(), [b""] * asks.num_rows
        own = dict(zip(table["kind"].to_pylist(), table["blob"]))
        for kind in set(kinds):
            spec = "ki" if kind == TRIPLE else "kiiiii"
            have = unpack(spec, own[kind].as_py()) if kind in own else []
            for k in range(asks.num_rows):
                if kinds[k] == kind:
                    blobs[k] = pack(spec[1:], *looked_up(kind, unpack("k", asks["blob"][k].as_py())[0], have))
        return pa.table([asks["chunk"], asks["kind"], asks["shard"], pa.array(blobs, pa.binary())], names=asks.schema.names)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Chunk(texts_of(table[plain]), mask).number_grams()
        got = {(k, s): b for k, s, b in zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["blob"].to_pylist())}
        counts = []
        for kind, keys in ((TRIPLE, own.triple_keys), (PAIR, own.pair_keys), (WORD, own.word_keys)):
            parts = [unpack("i" if kind == TRIPLE else "iiiii", got.pop((kind, s))) for s, _, _ in by_shard(keys, shards)]
            counts.append(np.array([np.concatenate(x) for x in zip(*parts)]))
        spelt = spelling(own, letters)
        bits = document_bits(own, np.array(table[trusted_col].to_pylist(), bool), spelt, *counts, level)
        return pa.table([*(table[c] for c in schema.names[:-2]), pa.array(bits), pa.array(own.document_bytes())], names=schema.names)

    done = []
    for r in range(many):
        chunks = math.ceil((sum(n for k, n in sizes.items() if k % many == r) + 1) / CHUNK_BYTES)
        rows = written(placed.where(F.col(part) % many == r).withColumn(chunk, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")), "round")
        asks = rows.select(chunk, plain).groupBy(chunk).applyInArrow(request, asked)
        answers = asks.groupBy("shard").cogroup(held.frame().groupBy("shard")).applyInArrow(answer, asked)
        done.append(written(rows.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(score, schema), "scores"))
        discard(rows)
        del rows, asks, answers
        if many > 1:
            free_shuffles(spark)
    held.drop()
    out = reduce(DataFrame.unionByName, done)
    whole = F.when(~F.col(null), F.col(plain)).cast(docs.schema[text_col].dataType).alias(text_col) if with_text else None
    return out.select(*[whole if c == text_col else c for c in docs.columns if c != trusted_col and (with_text or c != text_col)], *names)


def spelling(chunk: Chunk, letters) -> np.ndarray:
    """Bits of each of a chunk's words: of its letters and the space after it; of the end after a space; 0 for the start.

    ``letters``: classes ``of`` bytes and ``bits`` of a byte after two classes. A word's first letter comes after two spaces.
    """
    space = int(letters.of[32])
    out = np.where(chunk.word_keys == np.uint64(END_KEY & chunk.mask), float(letters.bits[space, space, 0]), 0.0)
    of = np.flatnonzero(chunk.written >= 0)
    if not len(of):
        return out
    starts, sizes = chunk.starts[chunk.written[of]], chunk.word_sizes[chunk.written[of]] + 1
    text = chunk.text[bytes_at(starts, sizes)]
    first = np.cumsum(sizes) - sizes
    text[first + sizes - 1] = 32  # whatever white space comes after the word
    classes = letters.of[text]
    before = np.append(space, classes[:-1])
    two = np.append([space, space], classes[:-2])[: len(classes)]
    before[first], two[first] = space, space
    two[np.minimum(first + 1, len(classes) - 1)] = space
    out[of] = np.add.reduceat(letters.bits[two, before, text].astype(np.float64), first)
    return out
