"""Best-fit packing of token pieces into sequences by linear grouping.

Lengths are integers up to the sequence length, so a corpus is a histogram of bounded size. The plan is made on the
driver from that histogram alone:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest length;
2. the packing of these few sizes is optimised: a linear program over configurations (column generation, with a
   knapsack for the prices), rounded down; what is left over goes the way of the small ones;
3. actual lengths take the places of their group's rounded size;
4. the rest, from long to short, goes where it fits best, or into a new sequence.

Sequences that hold the same lengths are one class with a count. So the plan's size depends on the sequence length, not
on the number of documents. Pieces are then ranked within their length, and a rank finds its place in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.bpe import slices
from keyloom.llm.common import resident, unused, written
from keyloom.llm.word_hashes import SPACES, Memory, bytes_at, grouped, word_hashes

#: Rows that one task ranks within a length; more of one length are parted by a hash first.
RANKED_ROWS = 200_000

#: Bytes of words' ids that a worker remembers, and of the longest word that it does.
REMEMBERED_BYTES, LONGEST = 64 << 20, 256

#: Bytes of text whose words are looked up together.
BATCH_BYTES = 2 << 20


# tokens


class WordTokenizer:
    """Ids of a tokenizer that drops white space and case, from remembered ids of the words between ASCII white space.

    Words are told apart by 64-bit hashes. Longer words than LONGEST are encoded each time. A full stop or comma after an
    ASCII letter is a word of its own.
    """

    def __init__(self, path: str, most_bytes: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memory = Memory(most_bytes)
        special = next((t.content for t in self.library.get_added_tokens_decoder().values() if t.special and t.content.startswith("<|")), None)
        self.mark, self.mark_id = (special.encode(), self.library.token_to_id(special)) if special else (b"", -1)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, as the library gives them for each alone, and how many each has: many at a time, parted by a special token."""
        ids, many = [], np.zeros(len(words), np.int64)
        alone = [k for k, w in enumerate(words) if b"<|" in w or not self.mark]
        joined = np.delete(np.arange(len(words)), alone)
        for at in range(0, len(joined), 512):
            part = joined[at : at + 512]
            own = np.array(self.library.encode_batch_fast([self.mark.join([words[k] for k in part]).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.append(np.flatnonzero(own == self.mark_id), len(own))
            many[part] = np.diff(ends, prepend=-1) - 1
            ids.append(own[own != self.mark_id])
        for k in alone:
            ids.append(np.array(self.library.encode(words[k].decode(), add_special_tokens=False).ids, np.int64))
            many[k] = len(ids[-1])
        order = np.append(joined, np.array(alone, np.int64)).astype(np.int64)
        flat, ends = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.uint32), np.cumsum(many[order])
        first = np.empty(len(words), np.int64)
        first[order] = ends - many[order]
        return flat[bytes_at(first, many)], many

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each text."""
        raw = [t.encode() for t in texts]
        raw = [t if b"<|" in t else t.lower() for t in raw]
        text = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        space = SPACES[text]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        sizes = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
        if not len(starts):
            return [b""] * len(texts)
        # a full stop or comma after a letter is a word of its own
        last, before = text[starts + sizes - 1], text[starts + sizes - 2] | 32
        marked = (sizes > 1) & ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122)
        of = np.cumsum(marked) - marked + np.arange(len(starts))
        all_starts, all_sizes = np.empty(len(starts) + marked.sum(), np.int64), np.ones(len(starts) + marked.sum(), np.int64)
        all_starts[of], all_sizes[of] = starts, sizes - marked
        all_starts[of[marked] + 1] = starts[marked] + sizes[marked] - 1
        starts, sizes = all_starts, all_sizes
        at, back = grouped(hashes := word_hashes(text, starts, sizes))
        def learn(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            whole = text.tobytes()
            return self._encode([whole[a : a + n] for a, n in zip(starts[at[left]].tolist(), sizes[at[left]].tolist())])

        first, many, ids = self.memory.look_up(hashes[at], sizes[at] <= LONGEST, learn)
        flat = ids[bytes_at(first[back], many[back])].astype("<u4")
        ends = np.append(0, np.cumsum(many[back]))[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in raw]) + 1)]
        return [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def word_tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer for a file."""
    return resident(f"words-{path}", lambda: WordTokenizer(path))


def token_pieces(docs: DataFrame, path: str, most: int = 2048, end_id: int = 0, text_col: str = "text") -> DataFrame:
    """Pieces of at most ``most`` tokens: the columns of ``docs`` but the text, piece, start, length, ids (binary, little-endian 32 bits).

    A document is the ids of its whole text, then ``end_id``; null and empty texts are that one id. Only longer ones are cut.
    ``path``: a tokenizer whose ids depend neither on white space around a word nor on its case, and that parts letters from marks.
    """
    keep, plain = [c for c in docs.columns if c not in (text_col, "piece", "start", "length", "ids")], unused(docs, "text")
    schema = docs.select(*keep).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for part, texts in slices(batches, plain, BATCH_BYTES):
            rows, pieces, starts, ids = [], [], [], []
            for row, own in enumerate(tokenizer.encode(texts)):
                own += end
                for piece, at in enumerate(range(0, len(own), 4 * most)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    ids.append(own[at : at + 4 * most])
            taken = part.select(keep).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                [*keep, "piece", "start", "length", "ids"],
            )

    return docs.select(*keep, docs[text_col].cast("string").alias(plain)).mapInArrow(run, schema)


# the plan


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """How often to use which configuration (how many of each size) to hold all counts in the fewest bins; fractional."""
    m = len(sizes)
    columns = [tuple((capacity // s) if j == k else 0 for j in range(m)) for k, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    need = np.array(counts, float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value = np.zeros(capacity + 1)
        chosen = np.full(capacity + 1, -1)
        worth = sorted((j for j in range(m) if prices[j] > 1e-12), key=lambda j: sizes[j])
        best_size = np.array([sizes[j] for j in worth])
        best_price = np.array([prices[j] for j in worth])
        for c in range(sizes[worth[0]] if worth else capacity + 1, capacity + 1):
            k = int(np.searchsorted(best_size, c, "right"))
            options = value[c - best_size[:k]] + best_price[:k]
            top = int(options.argmax())
            if options[top] > value[c - 1] + 1e-15:
                value[c], chosen[c] = options[top], top
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if chosen[c] < 0:
                c -= 1
                continue
            column[worth[chosen[c]]] += 1
            c -= sizes[worth[chosen[c]]]
        direction, level = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratios = np.where(direction > 1e-10, level / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
        columns[out] = tuple(int(x) for x in column)
    level = np.linalg.solve(basis, need)
    return [(columns[k], max(0.0, float(level[k]))) for k in range(m)]


Classes = list[tuple[int, tuple[tuple[int, int], ...]]]


def plan(histogram: dict[int, int], capacity: int, groups: int = 48, thresholds: tuple[float, ...] = (1 / 4, 1 / 3, 1 / 2)) -> Classes:
    """Classes of sequences, as (count, ((length, how many), ...)), that hold exactly the lengths of ``histogram``.

    ``groups``: how many groups of equal cardinality the large lengths are cut into. A length is large above a share of
    the capacity; of the plans for each of ``thresholds``, the one with the fewest sequences counts.
    """
    plans = [grouped_plan(histogram, capacity, groups, max(1, int(capacity * t))) for t in thresholds]
    return min(plans, key=lambda classes: sum(n for n, _ in classes))


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> Classes:
    """The plan whose large lengths are those above ``small``."""
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is not between 1 and the sequence length")
    open_: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    if full := left.pop(capacity, 0):
        open_[((capacity, 1),)] = full
    large = sorted((k for k in left if k > small), reverse=True)
    total = sum(left[k] for k in large)
    members: list[list[list[int]]] = []  # of each group: [length, how many] from long to short
    if total:
        quota, filled = -(-total // groups), 0
        for k in large:
            n = left.pop(k)
            while n:
                if not members or filled == quota:
                    members.append([])
                    filled = 0
                take = min(n, quota - filled)
                members[-1].append([k, take])
                filled += take
                n -= take
        # equal rounded sizes are one size
        by_size: dict[int, list[list[int]]] = {}
        for g in members:
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = sorted(by_size, reverse=True)
        groups_left = [sorted(by_size[s], reverse=True) for s in sizes]
        amounts = [sum(n for _, n in g) for g in groups_left]
        for counts, times in configurations(sizes, amounts, capacity):
            times = int(times + 1e-9)
            for j, c in enumerate(counts):
                if c:
                    times = min(times, sum(n for _, n in groups_left[j]) // c)
            while times > 0:
                # the actual lengths at the head of each group; as many sequences as have the same ones
                shape: dict[int, int] = defaultdict(int)
                run = times
                taken: list[tuple[int, int, int]] = []
                for j, c in enumerate(counts):
                    want = c
                    for at, (k, n) in enumerate(groups_left[j]):
                        if want == 0:
                            break
                        use = min(want, n)
                        taken.append((j, at, use))
                        shape[k] += use
                        want -= use
                for j, at, use in taken:
                    run = min(run, groups_left[j][at][1] // use)
                for j, at, use in taken:
                    groups_left[j][at][1] -= use * run
                for j in {j for j, _, _ in taken}:
                    groups_left[j] = [x for x in groups_left[j] if x[1]]
                open_[tuple(sorted(shape.items(), reverse=True))] += run
                times -= run
        for g in groups_left:
            for k, n in g:
                left[k] = left.get(k, 0) + n
    return best_fit(open_, left, capacity)


def best_fit(open_: dict[tuple[tuple[int, int], ...], int], left: dict[int, int], capacity: int) -> Classes:
    """``left`` from long to short into the fullest sequences where they fit, or into new ones; equal sequences move together."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room: [[count, {length: how many}], ...]
    rooms: list[int] = []

    def put(room: int, count: int, shape: dict[int, int]) -> None:
        if room not in by_room:
            insort(rooms, room)
        by_room[room].append([count, shape])

    for shape, count in open_.items():
        put(capacity - sum(k * n for k, n in shape), count, dict(shape))
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect_left(rooms, k)
            if at == len(rooms):
                each = min(capacity // k, n)
                count = n // each
                put(capacity - each * k, count, {k: each})
                n -= count * each
                continue
            room = rooms[at]
            classes = by_room[room]
            count, shape = classes.pop()
            if not classes:
                del by_room[room]
                rooms.pop(at)
            # a sequence takes one after another while it stays the best fit: the least room that is enough
            each = min(room // k, n)
            use = min(count, n // each)
            if use < count:
                put(room, count - use, shape)
            grown = dict(shape)
            grown[k] = grown.get(k, 0) + each
            put(room - each * k, use, grown)
            n -= use * each
    merged: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    for classes in by_room.values():
        for count, shape in classes:
            merged[tuple(sorted(shape.items(), reverse=True))] += count
    return [(count, shape) for shape, count in sorted(merged.items(), reverse=True)]


def places(classes: Classes) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: first rank, first sequence and offset of each of its places, in the order of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for count, shape in classes:
        offset = 0
        for k, n in shape:
            for _ in range(n):
                out[k].append((ranks[k], base, offset))
                ranks[k] += count
                offset += k
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*rows)) for k, rows in out.items()}


# the pieces


def ranked(pieces: DataFrame, by: str, rows: int, rank: str) -> DataFrame:
    """``pieces`` with ``rank``: from 0, gapless, within each value of ``by``. No task ranks a whole value that is frequent.

    A value's rows are parted by a hash of their places, so rows alike are parted as well; the parts' sizes give where each
    part starts. ``pieces`` must be a written table: its rows have the same places when it is read again.
    """
    parts = max(1, -(-rows // RANKED_ROWS))
    part, row, many, first, at = (unused(pieces, x) for x in ("part", "row", "many", "first", "at"))
    pieces = pieces.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.pmod(F.xxhash64(row), F.lit(parts)).cast("int"))
    sizes = pieces.groupBy(by, part).agg(F.count(F.lit(1)).alias(many))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, part, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy(by, part).orderBy(row))
    return pieces.withColumn(at, within).join(starts, [by, part]).withColumn(rank, F.col(first) + F.col(at) - 1).drop(at, first, part, row)


def place(pieces: DataFrame, capacity: int = 2048, groups: int = 48) -> DataFrame:
    """``pieces`` (any columns, with ``length``) with sequence_id and offset, in place of columns named so.

    ``pieces`` must be a written table; it is read three times. Every piece is placed, in a sequence of at most ``capacity``,
    gapless from 0; rows alike take different places. Lengths must be 1 to ``capacity``. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {int(k): int(n) for k, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    rows = sum(histogram.values())
    table = places(plan(histogram, capacity, groups))
    schema = T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    names, rank = pieces.columns, unused(pieces, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", rank))
            sequences, offsets = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k in np.unique(lengths):
                here = np.flatnonzero(lengths == k)
                first, base, offset = table[int(k)]
                at = np.searchsorted(first, ranks[here], "right") - 1
                sequences[here] = base[at] + ranks[here] - first[at]
                offsets[here] = offset[at]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(sequences), pa.array(offsets)], [*names, "sequence_id", "offset"])

    return ranked(pieces, "length", rows, rank).select(*names, rank).mapInArrow(run, schema)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), pieces (count) of each sequence, from placed pieces that still have their ids."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.size("p").alias("pieces"))


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048, keep_ids: bool = True, text_col: str = "text") -> DataFrame:
    """Packs whole documents: one row per piece, with the columns of ``docs`` but the text, piece, start, length, ids, ids_crc32, sequence_id and offset.

    Without ``keep_ids``, only the CRC-32 of the ids is kept. Null and empty texts are the end's id alone; repeated rows are
    packed one by one; null ids and other columns pass through, but columns named as those above are replaced. An
    empty table gives no rows.
    """
    pieces = token_pieces(docs.drop("ids_crc32"), path, capacity, text_col=text_col).withColumn("ids_crc32", F.crc32("ids"))
    return place(written(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)
