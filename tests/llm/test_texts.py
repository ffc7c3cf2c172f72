"""Operators on whole texts against brute force: packing, sharding, SimHash, BPE, exact deduplication."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from keyloom.llm import queries as Q
from keyloom.llm.bpe import TrieBpe, decode_documents, encode_documents
from keyloom.llm.common import written
from keyloom.llm.exact_dedup import ExactDedup, exact_dedup, keep_last_copies
from keyloom.llm.packing import WordTokenizer, best_fit_packing, packed_sequences, plan, place
from keyloom.llm.sharding import two_pass_shuffle, write_shards
from keyloom.llm.simhash import components, fingerprint_batch, keep_one_of_each, near_duplicates, near_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "a  b", "héllo wörld", "don't we'll <|endoftext|> x", "\x1c\x85　y", "日本語 😀", "word " * 30_000]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names clash with the operators' own."""
    texts = [*ODD, *ODD, "same row", "same row", "The Quick brown fox", "the quick BROWN fox"]
    rows = [(k, t, "en", None, 1, 7, 8) for k, t in enumerate(texts)] + [(5, "same row", None, "s", 1, 7, 8)] * 2 + [(None, "no id", None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, shard int, length int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def check_places(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


# packing


def test_op1(spark, sf):
    from tokenizers import Tokenizer

    rows = Q.op1_best_fit_packing(spark, sf).collect()
    library = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json"))
    want = {}
    for d in docs_of(spark, sf).collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[d.doc_id, piece] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    least = -(-sum(n for _, n, _ in want.values()) // 2048)
    assert check_places(rows, 2048) <= least + max(1, least // 100)


def test_plan_holds_every_length_once():
    random.seed(3)
    for _ in range(60):
        h = {random.randint(1, 64): random.randint(1, 30) for _ in range(random.randint(0, 25))}
        back = {}
        for count, shape in plan(h, 64, groups=5):
            assert count > 0 and sum(k * n for k, n in shape) <= 64
            for k, n in shape:
                back[k] = back.get(k, 0) + n * count
        assert back == h
    with pytest.raises(ValueError):
        plan({65: 1}, 64)


def test_plan_is_near_the_optimum_where_large_lengths_must_match():
    # 1/2 + 1/3 + 1/7 of the capacity fill it together
    assert sum(n for n, _ in plan({21: 100, 14: 100, 7: 100}, 42)) == 100


def test_packing_odd(spark, odd, none):
    rows = best_fit_packing(odd, Q.tokenizer("word_bpe_49k.json"), capacity=64)
    assert {"lang", "source", "size", "shard"} <= set(rows.columns)
    got = rows.collect()
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in got}) == len(got)
    check_places(got, 64)
    sequences = packed_sequences(rows)
    assert sum(len(s.ids) for s in sequences.collect()) == 4 * sum(r.length for r in got)
    assert best_fit_packing(none, Q.tokenizer("word_bpe_49k.json")).count() == 0


def test_place_parts_frequent_lengths(spark, monkeypatch):
    monkeypatch.setattr("keyloom.llm.packing.RANKED_ROWS", 50)
    # a third of all rows alike
    rows = place(written(spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) as id", "cast(if(id % 3 = 0, 5, id % 10 + 1) as bigint) as length"), "lengths"), 16, 4).collect()
    assert len(rows) == 1000 == len({(r.sequence_id, r.offset) for r in rows})
    check_places(rows, 16)


# sharding


def test_op2(spark, sf):
    rows = Q.op2_sharding(spark, sf).collect()
    text = {d.doc_id: (d.text or "").encode() for d in docs_of(spark, sf).collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 8, zlib.crc32(t)) for k, t in text.items()}
    assert len(rows) == len(text) and {r.law for r in rows} == {"rows"}
    check_shards(rows, 24)


def check_shards(rows, shards):
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(x == list(range(len(x))) for x in slots.values())
    sizes = [len(x) for x in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_odd(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr("keyloom.llm.sharding.GROUP", 7)
    out = two_pass_shuffle(odd, 4, bucket_bytes=1000)
    rows = out.collect()
    assert len(rows) == odd.count() and set(out.columns) == set(odd.columns) | {"slot"}
    check_shards(rows, 4)
    assert rows == out.collect()
    assert [r.doc_id for r in rows] != [r.doc_id for r in two_pass_shuffle(odd, 4, seed=7, bucket_bytes=1000).collect()]
    write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert two_pass_shuffle(none).count() == 0


# simhash


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(fp):
    root = {k: k for k in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fp}


def test_op3(spark, sf):
    fp = {d.doc_id: by_hand(d.text) for d in docs_of(spark, sf).collect()}
    rows = Q.op3_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in fp.items()}
    assert {r.doc_id: r.component_id for r in rows} == classes_by_hand(fp)


@pytest.mark.parametrize("paired", [0, 3, 48])
def test_links_of_crowded_blocks(spark, paired):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    fps = {b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & ((1 << 64) - 1) for b in base for _ in range(60)}
    fps = {f % (1 << 64) for f in fps}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), paired)
    got = {r.v: r.root for r in components(links).collect()}
    want = classes_by_hand({f: f % (1 << 64) for f in signed})
    assert {f: got.get(f, f) for f in signed} == want


def test_long_chain(spark):
    chain = [(k + 1, k) for k in range(200)]
    random.seed(1)
    random.shuffle(chain)
    assert {r.v: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == dict.fromkeys(range(201), 0)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd(spark, odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.component_id for r in rows if r.fp == 0}) == 1
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("text = 'same row'").count() == 1  # rows are decided one by one
    assert near_duplicates(none).count() == 0
    assert fingerprint_batch([], 3).shape == (0,)


# byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))


def test_op9(spark, sf, library):
    want = {}
    for d in docs_of(spark, sf).collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want[d.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op9_bpe(spark, sf).collect()} == want


def test_bpe_random(library):
    bpe = TrieBpe(Q.tokenizer("byte_bpe_50k.json"))
    random.seed(1)
    alphabet = list("aeth  \n\t\r.'sdé漢́\x1c\x85ñ12日😀 ll") + ["<|endoftext|>", "  ", " \n"]
    for _ in range(4000):
        text = "".join(random.choices(alphabet, k=random.randrange(30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want, text
        assert bpe.decode(bpe.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets(monkeypatch, library):
    monkeypatch.setattr("keyloom.llm.bpe.PAIRS", 3)
    bpe = TrieBpe(Q.tokenizer("byte_bpe_50k.json"), 500)
    texts = ["one two three four five six one two", "", "two  spaces", "one \u00a0two", " one", "one ", "five six seven", "<|endoftext|> one"]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_odd(spark, odd, none):
    path = Q.tokenizer("byte_bpe_50k.json")
    out = encode_documents(odd, path)
    back = decode_documents(out, path)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert encode_documents(none, path).count() == 0


def test_memories_are_bounded_by_bytes():
    """Both encoders meet far more words than they may remember, long ones among them, and still encode as the library does."""
    from tokenizers import Tokenizer

    random.seed(5)
    text = lambda: " ".join("".join(random.choices("abcdefgh", k=random.randint(3, 14))) + random.choice(["", "", ".", ","]) for _ in range(3000)) + " " + "x" * 5000
    words = WordTokenizer(Q.tokenizer("word_bpe_49k.json"), 1 << 20)
    library, bpe = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json")), TrieBpe(Q.tokenizer("byte_bpe_50k.json"), 1 << 20)
    other = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    for k in range(12):
        t = text()
        got = words.encode([t, "", " ", t.upper()])
        assert got[0] == got[3] and got[1:3] == [b"", b""]
        if k % 4 == 3:
            assert np.frombuffer(got[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert k % 4 != 3 or np.frombuffer(bpe.encode(t), "<u4").tolist() == other.encode(t, add_special_tokens=False).ids
        assert words.memory.size() <= 1 << 20
        assert bpe.memory.size() <= 1 << 20
        assert all((r.keys[1:] > r.keys[:-1]).all() for r in words.memory.runs + bpe.memory.runs)


def test_words_random():
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json")), WordTokenizer(Q.tokenizer("word_bpe_49k.json"), 1 << 18)
    random.seed(2)
    alphabet = list("aethAET  \n\t\r.,'sdéÉ漢́\x1c\x85ñ12日😀 ll!?") + ["<|endoftext|>", "  ", "., ", "a.", "<|", "|>", "'s", "İ", "ß", "ﬁ"]
    for _ in range(150):
        texts = ["".join(random.choices(alphabet, k=random.randrange(40))) for _ in range(60)]
        for text, got in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_any_names_hot_rows_and_long_texts(spark, tmp_path):
    """A third of all rows alike, a text of one word of megabytes, and columns named as the operators' own."""
    names = "_text _row _rank _part _at _id _digest _again _bucket _n _from _many _first rank row id words size shard slot piece start length ids ids_crc32 sequence_id offset fp class".split()
    rows = [(5, "the same words over and over again")] * 40 + [(k, f"row {k} of the table with some words of its own, {k * k}") for k in range(78)]
    rows += [(200, "z" * 3_000_000), (201, "a b " * 500_000), (None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'mine' as `{n}`" for n in names]).write.parquet(path)
    docs = spark.read.parquet(path)
    packed = best_fit_packing(docs, Q.tokenizer("word_bpe_49k.json"), keep_ids=False)
    own = {"piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"}
    assert set(packed.columns) == {*docs.columns, *own} - {"text", "ids"} and packed.where("_rank <> 'mine' or _part <> 'mine'").count() == 0
    got = packed.collect()
    check_places(got, 2048)
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.piece == 0 for r in got) == len(rows)
    sharded = two_pass_shuffle(docs, 4, bucket_bytes=1 << 20)
    check_shards(sharded.select("shard", "slot").collect(), 4)
    assert sharded.where("_row = 'mine' and _bucket = 'mine'").count() == len(rows)
    assert near_duplicates(docs).count() == len(rows)
    for keep in (keep_last_copies, keep_one_of_each):
        out = keep(docs)
        assert out.columns == docs.columns and out.count() == len(rows) - 39 and out.where("_text <> 'mine' or row <> 'mine'").count() == 0
    encoded = encode_documents(docs, Q.tokenizer("byte_bpe_50k.json"))
    assert encoded.where("_text = 'mine'").count() == len(rows)
    assert decode_documents(encoded, Q.tokenizer("byte_bpe_50k.json")).select("doc_id", "text").exceptAll(docs.selectExpr("doc_id", "coalesce(text, '')")).isEmpty()


# exact deduplication


def test_exact_odd(spark, odd, none):
    rows = exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    groups = {}
    for r in rows:
        groups.setdefault(r.digest, []).append(r)
    for g in groups.values():
        assert {r.group_size for r in g} == {len(g)} and sum(r.kept for r in g) == 1
        best = max(-1 if r.id is None else r.id for r in g)
        assert {-1 if r.keep_id is None else r.keep_id for r in g} == {best}
    kept = keep_last_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup(none).count() == 0 and keep_last_copies(none).count() == 0


def test_exact_compares_bytes(spark, odd):
    from pyspark.sql import functions as F

    state = ExactDedup(spark, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary"))
    state.append(odd)
    want = sorted((r.id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup(odd).collect())
    assert sorted((r.id or -1, r.keep_id or -1, r.group_size, r.kept) for r in state.result(odd).collect()) == want


def test_exact_state_outlives_a_call(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/state"
    a, b = odd.where("doc_id < 13"), odd.where("doc_id >= 13 or doc_id is null")
    ExactDedup(spark, folder).append(a)
    state = ExactDedup(spark, folder)
    state.append(b)
    assert state.result(odd).where("kept").count() == keep_last_copies(odd).count()
