"""Near-duplicates by SimHash fingerprints, found through pigeonhole blocks.

Equal fingerprints are one class before anything is joined. Two fingerprints that differ in at most two of 64 bits agree
in at least two of four blocks of 16 bits: classes are joined on each pair of blocks, and the Hamming distance of each
candidate pair is verified. Where many classes share a pair of blocks, pairs aren't emitted: each class names itself
and its neighbours at one differing bit among the other blocks; fingerprints within two bits name one in common, and
whoever names it is linked to one of them, again after verification. No link is lost and none is added.

Copies that are alike in four of five shingles may differ in many bits of 64. ``near_copies``, for the pipeline, takes
fingerprints of 1024 bits in four orders of 64 blocks: those that agree in a block and differ in few bits of 128, then
of all 1024, are candidates. Whole sets of shingles are compared where all candidates that pairs join are sent: each set
once, or, of too many for a task, once for each part of them that it has candidates in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.bpe import slices
from keyloom.llm.common import discard, free_shuffles, maybe_broadcast, unused, written

#: Classes that share a pair of blocks are compared pair by pair up to this many.
PAIRED = 48

#: Bits of a wide fingerprint, by which ``near_copies`` finds what to compare, and how many orders of them are cut into blocks of 16.
WIDE, ORDERS = 1024, 4

#: Of the first 128 bits of candidates, how many may differ: of sets of Jaccard 0.8, 19 do, with a deviation of 4.
FAR = 44

#: Of all bits of candidates, how many may differ: of sets of Jaccard 0.8, 155 do, with a deviation of 11; of the smallest, 192 with 12.5.
FAR_WIDE = 300

#: Classes beyond which a block's aren't compared bit by bit, and joined candidates not in one task but in parts by the sizes of their sets.
LARGE = 500

#: Shingles of joined candidates beyond which they are parted: 32 MB.
HELD = 4_000_000

#: Rounds in which sets are sent to where they are compared, which bounds the disk, and members of buckets for which one is enough.
LINK_ROUNDS, ROUND_ROWS = 4, 50_000

#: Classes of which one task compares the bits of one block.
SHARD_ROWS = 250_000

ENTRY = np.dtype([("key", "<u2"), ("size", "<u4"), ("class", "<i8"), ("sketch", "<u8", 2)])


def fingerprint_batch(texts: list[bytes], words: int) -> np.ndarray:
    """64-bit fingerprints, unsigned."""
    digests: list[bytes] = []
    counts: list[int] = []
    digest = xxhash.xxh64_digest
    for text in texts:
        own = text.lower().split()
        if len(own) <= words:
            counts.append(1 if own else 0)
            if own:
                digests.append(digest(b" ".join(own), 42))
            continue
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = [0, *ends[: len(own) - words].tolist()]
        digests += [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
        counts.append(len(starts))
    out, at = np.zeros((len(texts), 64), np.uint8), 0
    hashes = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    for k, n in enumerate(counts):
        if n:
            ones = np.zeros(64, np.int64)
            for part in range(at, at + n, 1 << 16):
                ones += np.unpackbits(hashes[part : min(part + (1 << 16), at + n)], axis=1).sum(0, dtype=np.int32)
            out[k] = 2 * ones > n
            at += n
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and fp (long: the fingerprint's 64 bits). No shuffle; whole texts; null counts as empty: 0."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text", 1 << 20):
            fp = fingerprint_batch([t.encode() for t in texts], words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(fp)], [*keep, "fp"])

    return docs.select(*keep, docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def near_links(classes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b), a < b, that join all distinct ``fp`` at two or fewer differing bits: each pair, or a path of such links."""
    block = [0xFFFF << (16 * k) for k in range(4)]
    masks = [block[i] | block[j] for i, j in combinations(range(4), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("k")).select("fp", "k.t", "k.key")
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    candidates = written(keyed.join(shared, ["t", "key"]), "blocks")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    few = candidates.where(F.col("n") <= paired)
    pairs = few.select("t", "key", F.col("fp").alias("a")).join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    # bits outside the pair of blocks, by table
    free = F.array(*[F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64) if not masks[t] >> b & 1]) for t in range(6)])
    many = candidates.where(F.col("n") > paired)
    named = many.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.element_at(free, F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("name")).distinct()
    centre = named.groupBy("name").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = named.join(centre, "name").select("a", F.col("fp").alias("b")).where((F.col("a") < F.col("b")) & close)
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every end of a link: root is the smallest v that it is linked to over any path.

    Large-star and small-star steps, each written in the shared folder, until a round changes nothing.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return stars.unionByName(edges.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fp and component_id, the smallest id among all documents that links lead to.

    Linked are fingerprints at two or fewer differing bits; documents without words have fingerprint 0, linked like any
    other. Repeated rows stay. A null id never is the smallest while there is another. An empty table stays empty.
    """
    docs = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("words"))
    rows = written(fingerprints(docs, words, "words", ("_id",)), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("_id").alias("rep")), "classes")
    roots = written(components(near_links(classes)), "roots")
    members = classes.join(roots.withColumnRenamed("v", "fp"), "fp")
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    moved = members.join(least, "root").select("fp", "least", F.lit(True).alias("_linked"))
    named = classes.join(moved, "fp", "left").select("fp", F.when(F.col("_linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of ``words`` words, ascending; of fewer words, one of them all; of none, none."""
    own = text.lower().split()
    runs = {b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``WIDE`` bits in 64-bit words: a bit is 1 if it is in over half of the shingles' hashes, which are drawn out to that width."""
    seeds = np.random.default_rng(11).integers(0, 1 << 63, WIDE // 64, np.uint64)
    counts = [np.zeros((0, WIDE // 64), np.uint64)]  # rows of bits that count 1, 2, 4 ...
    for part in range(0, len(hashes), 4096):
        x = (hashes[part : part + 4096, None] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        counts[0] = np.concatenate([counts[0], x ^ x >> np.uint64(31)])
        at = 0
        while at < len(counts):
            rows, carried = counts[at], []
            while len(rows) > 1:
                if len(rows) == 2:
                    rows, carry = rows[:1] ^ rows[1:], rows[:1] & rows[1:]
                else:
                    n = len(rows) // 3
                    a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                    either = a ^ b
                    carry, rows = a & b | c & either, np.concatenate([either ^ c, rows[3 * n :]])
                carried.append(carry)
            counts[at] = rows
            if carried:
                if at + 1 == len(counts):
                    counts.append(np.zeros((0, WIDE // 64), np.uint64))
                counts[at + 1] = np.concatenate([counts[at + 1], *carried])
            at += 1
    half, more, same = len(hashes) // 2, np.zeros(WIDE // 64, np.uint64), np.full(WIDE // 64, ~np.uint64(0))
    for at in reversed(range(max(len(counts), half.bit_length()))):
        bits = counts[at][0] if at < len(counts) and len(counts[at]) else np.zeros_like(more)
        if half >> at & 1:
            same &= bits
        else:
            more |= same & bits
            same &= ~bits
    return more


def block_keys(wide: np.ndarray, order: int) -> np.ndarray:
    """The 64 blocks of 16 bits of each wide fingerprint (a row of words), with its bits in one of the orders."""
    places = np.random.default_rng(order).permutation(WIDE)
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1)
    return np.packbits(np.ascontiguousarray(bits[:, places]), axis=1).view("<u2")


def block_pairs(entries: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Classes to compare, of the entries of one block of all: pairs that agree in it, may be alike by size and differ in few bits.

    A block that more than ``LARGE`` share gives all its classes at once; one that has more such pairs than ``PAIRED`` classes have, all that are in one.
    """
    entries = entries[np.lexsort((entries["size"], entries["key"]))]
    key, size, sketch, name = (np.ascontiguousarray(entries[c]) for c in ("key", "size", "sketch", "class"))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    many = np.diff(np.append(first, len(key)))
    run = np.repeat(np.arange(len(first)), many)
    here, found, step = np.flatnonzero(many[run] <= LARGE), [], 0
    while len(here):
        step += 1
        here = here[here + step < len(key)]
        here = here[(run[here + step] == run[here]) & (size[here] >= similarity * size[here + step])]
        near = here[np.bitwise_count(sketch[here] ^ sketch[here + step]).sum(1) <= FAR]
        found.append(np.stack([near, near + step], 1))
    found = np.concatenate([*found, np.zeros((0, 2), np.int64)])
    whole = (np.bincount(run[found[:, 0]], minlength=len(first)) > PAIRED * (PAIRED - 1) // 2) | (many > LARGE)
    pairs = np.unique(np.sort(name[found[~whole[run[found[:, 0]]]]], axis=1), axis=0)
    paired = many[run] > LARGE
    paired[found] = True
    return [*pairs, *(np.sort(name[first[k] : first[k] + many[k]][paired[first[k] : first[k] + many[k]]]) for k in np.flatnonzero(whole))]


def stars(groups: list[np.ndarray]) -> pa.Table:
    """Of each group of classes its key, its size n and a row (a, b) from its first class to each other one."""
    more = np.array([len(c) - 1 for c in groups], np.int64)
    keys = np.array([xxhash.xxh64_intdigest(c.tobytes(), 7) for c in groups], np.uint64).view(np.int64)
    first = np.array([c[0] for c in groups], np.int64)
    others = np.concatenate([*(c[1:] for c in groups), np.zeros(0, np.int64)])
    return pa.table([pa.array(np.repeat(keys, more)), pa.array(np.repeat(more + 1, more)), pa.array(np.repeat(first, more)), pa.array(others)], names=["key", "n", "a", "b"])


def of_stars(groups: DataFrame) -> DataFrame:
    """(key, class) of each class of each group."""
    return groups.select("key", F.col("a").alias("class")).distinct().unionByName(groups.select("key", F.col("b").alias("class")))


def near_groups(names: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
    """Groups of two or more, ascending, that wide fingerprints (rows of words) with at most ``FAR_WIDE`` differing bits join."""
    left, groups = np.ones(len(names), bool), []
    while left.any():
        new = np.zeros(len(names), bool)
        new[np.argmax(left)] = True
        group = new.copy()
        while new.any():
            left &= ~new
            reached = np.zeros(len(names), bool)
            for k in np.flatnonzero(new):
                rest = np.flatnonzero(left & ~reached)
                reached[rest[np.bitwise_count(wide[rest] ^ wide[k]).sum(1) <= FAR_WIDE]] = True
            new = reached
            group |= new
        if group.sum() > 1:
            groups.append(np.sort(names[group]))
    return groups


def words_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Wide fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE // 64)


def bucket_links(names: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join whatever pairs of ``similarity`` or more join; pairs that are joined already aren't compared."""
    groups: list[list[int]] = []
    links = []
    for k, own in enumerate(sets):
        met = []
        for g in groups:
            for j in g:
                small, large = sorted((len(own), len(sets[j])))
                if small >= similarity * large:
                    both = len(np.intersect1d(own, sets[j], assume_unique=True))
                    if both >= similarity * (small + large - both):
                        met.append(g)
                        links.append((min(names[j], names[k]), max(names[j], names[k])))
                        break
        groups = [g for g in groups if not any(g is m for m in met)] + [[k, *(j for m in met for j in m)]]
    return links


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row (its place in ``docs``), id and component_id, the smallest id among all that links lead to.

    Linked are documents whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more: whole
    sets are compared, of documents whose wide SimHash fingerprints share a block and are near. What such pairs join is
    compared in one task, so that each set is sent once; beyond ``LARGE`` or ``HELD``, in parts by size, two at a time.
    Equal sets are one class before; documents without words, null texts among them, are one class as well. A null id never
    is the smallest while there is another.
    ``docs`` must come from files or a written table: its rows must have the same places when read again.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "words", 1 << 20):
            sets = [shingles(t.encode(), words) for t in own]
            names = np.array([xxhash.xxh64_intdigest(h.tobytes(), 5) for h in sets], np.uint64).view(np.int64)
            fps = pa.array([wide_fingerprint(h).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array([len(h) for h in sets], pa.int32()), fps], ["row", "id", "class", "size", "fp"])

    def blocks(order: int, shards: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wide = words_of(batch.column(2))
                entries = np.empty(len(batch), ENTRY)
                entries["class"], entries["size"], entries["sketch"] = batch.column(0).to_numpy(), batch.column(1).to_numpy(), wide[:, :2]
                of, parts = [], []
                for k, keys in enumerate(block_keys(wide, order).T):
                    entries["key"] = keys
                    shard = keys.astype(np.int64) * shards >> 16
                    for j in np.unique(shard):
                        of.append(k * shards + int(j))
                        parts.append(entries[shard == j].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(parts, pa.binary())], ["shard", "entries"])

        return run

    def compare(table: pa.Table) -> pa.Table:
        return stars(block_pairs(np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY), similarity))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.bitwise_count(words_of(batch["fp"]) ^ words_of(batch["fp_b"])).sum(1) > FAR_WIDE
            yield batch.select(["key", "n", "a", "b"]).filter(pa.array(~far))

    def narrow(table: pa.Table) -> pa.Table:
        return stars(near_groups(table["class"].to_numpy(), words_of(table["fp"])))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "words", 1 << 20):
            sets = [shingles(t.encode(), words) for t in own]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([h.tobytes() for h in sets], pa.binary())], ["class", "size", "hashes"])

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        links = bucket_links(table["class"].to_pylist(), [np.frombuffer(b.as_py(), np.uint64) for b in table["hashes"]], similarity)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = written(texts.mapInArrow(run, "row long, id long, class long, size int, fp binary"), "wide-fingerprints")
    distinct = written(rows.where("size > 0").groupBy("class", "size", "fp").agg(F.min("row").alias("row")), "distinct")
    shards = 1 + distinct.count() // SHARD_ROWS
    star = "key long, n long, a long, b long"
    found = []
    for order in range(ORDERS):  # one after another, which bounds the disk
        entries = distinct.select("class", "size", "fp").mapInArrow(blocks(order, shards), "shard int, entries binary")
        found.append(written(entries.groupBy("shard").applyInArrow(compare, star), "candidates"))
        free_shuffles(docs.sparkSession)
    # whatever several blocks find is compared once
    buckets = written(reduce(DataFrame.unionByName, found).distinct(), "buckets")
    discard(*found)
    wide = distinct.select("class", "fp")
    pairs = buckets.where("n = 2").join(wide.withColumnRenamed("class", "a"), "a")
    pairs = pairs.join(wide.toDF("b", "fp_b"), "b").mapInArrow(near, star)
    blocked = of_stars(buckets.where((F.col("n") > 2) & (F.col("n") <= LARGE))).join(wide, "class").groupBy("key").applyInArrow(narrow, star)
    groups = written(pairs.unionByName(blocked).unionByName(buckets.where(F.col("n") > LARGE)).distinct(), "groups")
    # what they join is compared together if one task can hold it; else in parts of like sizes, each part with each that it shares a group with
    joined = written(components(groups).join(distinct.select(F.col("class").alias("v"), F.col("size").cast("long")), "v"), "joined")
    weight = F.greatest("size", F.lit(HELD // LARGE))
    held = written(joined.groupBy("root").agg((F.sum(weight) <= HELD).alias("fits")), "held")
    once = joined.join(held.where("fits"), "root").select(F.col("root").alias("key"), F.col("v").alias("class"))
    before = F.sum(weight).over(Window.partitionBy("root").orderBy("size", "v").rowsBetween(Window.unboundedPreceding, 0))
    parts = joined.join(held.where("not fits"), "root").select(F.col("v").alias("class"), "root", "size", F.floor(before / (HELD // 2)).alias("part"))
    parts = written(parts, "parts")
    at = written(of_stars(groups.join(parts.select(F.col("class").alias("a")), "a", "left_semi")).join(parts, "class"), "parted")
    met = at.groupBy("key", F.col("part").alias("other")).agg(F.count(F.lit(1)).alias("many"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    alike = (F.col("size") >= similarity * F.col("lo")) & (F.col("hi") >= similarity * F.col("size"))
    sent = at.join(met, "key").where(alike & ((F.col("part") != F.col("other")) | (F.col("many") > 1)))
    sent = sent.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "class").distinct()
    members = written(once.unionByName(sent), "members")
    del pairs, blocked, once, met, sent
    free_shuffles(docs.sparkSession)
    # sets of those that are compared, from one row of each class
    compared = written(distinct.join(members.select("class").distinct(), "class", "left_semi").select("class", "row"), "compared")
    sets = written(texts.join(maybe_broadcast(compared, 32), "row").select("class", "words").mapInArrow(whole, "class long, size int, hashes binary"), "shingles")
    rounds, linked = min(LINK_ROUNDS, 1 + members.count() // ROUND_ROWS), []
    for r in range(rounds):
        bucket = members.where(F.pmod("key", F.lit(rounds)) == r).join(sets, "class")
        linked.append(written(bucket.groupBy("key").applyInArrow(link, "a long, b long").distinct(), "links"))
        del bucket
        if rounds > 1:
            free_shuffles(docs.sparkSession)
    links = reduce(DataFrame.unionByName, linked).distinct()
    roots = written(components(links), "roots")
    classes = rows.groupBy("class").agg(F.min("id").alias("rep")).join(roots.withColumnRenamed("v", "class"), "class", "left")
    classes = written(classes.withColumn("root", F.coalesce("root", "class")), "classes")
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select("class", "root", "component_id")
    found = written(rows.select("row", "id", "class").join(named, "class").select("row", F.col("id").alias(id_col), "component_id", "root"), "near-copies")
    discard(rows, distinct, buckets, groups, joined, held, parts, at, members, compared, sets, *linked, roots, classes)
    return found


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group that ``near_copies`` finds, the row with the smallest id, all columns unchanged; of such rows, the first.

    Rows are decided one by one, so a repeated id loses no text that has no near copy. Null texts count as empty; all
    documents without words are one group; an empty table stays empty; columns may have any names.
    """
    found = near_copies(docs, words, similarity, id_col, text_col)
    stays = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row")).alias("s")).select(F.col("s.row").alias("row"))
    gone = written(found.join(stays, "row", "left_anti").select("row"), "gone")
    row = unused(docs, "row")
    gone = maybe_broadcast(gone.withColumnRenamed("row", row), 16)
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").select(*docs.columns)
