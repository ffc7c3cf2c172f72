"""The language model over words against its definition, and that it grows with its text."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import kneser_ney as K
from keyloom.llm import kneser_words as W

TEXTS = ["the cat sat on the mat", "the cat sat on a mat", "a dog sat on the cat", "the dog ate", "", "mat the cat sat"]


def tables(texts):
    tri = Counter()
    for t in texts:
        s = ["<", "<", *t.split(), ">"]
        tri.update(zip(s, s[1:], s[2:]))
    bi = Counter(g[1:] for g in tri)
    return tri, bi, Counter(g[1] for g in bi)


def level(counts):
    n1, n2, n3, n4 = (sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [0, *(min(max(x, 0.1), k - 0.1) for k, x in zip((1, 2, 3), d))]


def letters_by_hand(texts, of, counts):
    """P(byte | two classes) by the definition, over the classes of bytes in words with spaces around and an end."""
    tri = Counter()
    for t in texts:
        c = [of[x] for x in b"  " + b"".join(w.encode() + b" " for w in t.split()) + b"\0"]
        tri.update(zip(c, c[1:], c[2:]))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)
    d = [level(c) for c in (tri, bi, uni)]

    def share(counts, d, gram, lower):
        own = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        return lower if not own else (counts[gram] - d[min(counts[gram], 3)] + sum(d[min(n, 3)] for n in own) * lower) / sum(own)

    def p(a, b, byte):
        g = (a, b, int(of[byte]))
        whole = share(tri, d[0], g, share(bi, d[1], g[1:], share(uni, d[2], g[2:], 1 / K.CLASSES)))
        return whole * (counts[byte] + 1) / sum(counts[x] + 1 for x in range(256) if of[x] == of[byte])

    return p


def letters_of(spark, texts):
    return K.train_letters(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_letters_against_the_definition(spark):
    texts = ["abracadabra abra", "héllo  abc", "", "cab\ncab"]
    model = letters_of(spark, texts)
    counts = Counter(x for t in texts for x in b"  " + b"".join(w.encode() + b" " for w in t.split()) + b"\0")
    p = letters_by_hand(texts, model.of, counts)
    space = model.of[32]
    for a, b, byte in ((space, space, 97), (model.of[97], model.of[98], 114), (model.of[98], space, 0), (space, space, 200), (5, 60, 98)):
        assert math.isclose(model.bits[a, b, byte], -math.log2(p(a, b, byte)), rel_tol=1e-5)
    assert np.allclose((2.0 ** -model.bits).sum(-1), 1, atol=1e-4)
    assert letters_of(spark, []).bits.min() > 5  # without any text
    assert set(model.of.tolist()) == set(range(64)) and len({model.of[x] for x in b"az.,09 \0"}) == 7


def bits_by_hand(text, held, whole, model):
    (tri, bi, uni), d = held, [level(c) for c in whole]
    of, bits = model.of, model.bits

    def spelt(w):
        c, b = [of[32], of[32], *(of[x] for x in w), of[32]], [32, 32, *w, 32]
        return sum(float(bits[c[k - 2] if k > 2 else of[32], c[k - 1], b[k]]) for k in range(2, len(b)))

    def share(counts, d, gram, lower):
        own = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not own:
            return lower
        return (counts[gram] - d[min(counts[gram], 3)] + sum(d[min(n, 3)] for n in own) * lower) / sum(own)

    s, total = ["<", "<", *text.split(), ">"], 0
    for g in zip(s, s[1:], s[2:]):
        p = 2.0 ** -(bits[of[32], of[32], 0] if g[2] == ">" else spelt(g[2].encode()))
        n, everything = uni[g[2]], sum(whole[2].values())
        p = (n - d[2][min(n, 3)] + sum(d[2][min(x, 3)] for x in whole[2].values()) * p) / everything
        total -= math.log2(share(tri, d[0], g, share(bi, d[1], g[1:], p)))
    return total


def test_words_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_BYTES", 30)
    monkeypatch.setattr(W, "CHUNK_BYTES", 40)
    others = ["the cat sat on the dog", "zebra mat", "the " + "z" * 3000]
    docs = spark.createDataFrame([(k, t, k < len(TEXTS)) for k, t in enumerate(TEXTS + others)], "doc_id long, text string, trusted boolean")
    model = letters_of(spark, TEXTS)
    got = {r.doc_id: r for r in W.scores(docs, model, with_text=False, rounds=W.Rounds(2, 2, 3)).collect()}
    assert len(got) == len(TEXTS + others)
    whole = tables(TEXTS)
    for k, text in enumerate(TEXTS + others):
        if text:
            held = tables([t for j, t in enumerate(TEXTS) if j != k])
            assert math.isclose(got[k].bits, bits_by_hand(text, held, whole, model), rel_tol=1e-5) if k != 8 else got[k].bits > 3000
            assert got[k].bytes == sum(len(w) + 1 for w in text.split()) + 1
    assert (got[4].bits, got[4].bytes) == (0, 0)


def test_whole_table_by_counting(spark):
    """Every document of a table, by counting its grams with dictionaries."""
    sf = "/root/testdata/sf0.001"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = [k for k in texts if quality.get(k) == 1]
    model = letters_of(spark, [texts[k] for k in good])
    docs = spark.createDataFrame([(k, t, k in set(good)) for k, t in texts.items()], "doc_id long, text string, trusted boolean")
    got = {r.doc_id: r.bits for r in W.scores(docs, model).collect()}
    split = lambda t: [w.decode() for w in t.encode().split()]
    grams = {k: Counter(zip(s := ["<", "<", *split(t), ">"], s[1:], s[2:])) for k, t in texts.items()}
    tri = Counter()
    for k in good:
        tri.update(grams[k])
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1] for g in bi)
    d3, d2, d1 = (level(c) for c in (tri, bi, uni))
    by3, by2 = {}, {}
    for g in tri:
        by3.setdefault(g[:2], []).append(g)
    for g in bi:
        by2.setdefault(g[0], []).append(g)
    spare = sum(d1[min(n, 3)] for n in uni.values()) / sum(uni.values())
    for k, t in texts.items():
        if not split(t):
            continue
        own = grams[k] if k in set(good) else Counter()
        lost2 = Counter(g[1:] for g, n in own.items() if tri[g] == n)
        lost1 = Counter(g[1] for g, n in lost2.items() if bi[g] == n)
        n3 = lambda g: tri[g] - own[g]  # noqa: E731, B023
        n2 = lambda g: bi[g] - lost2[g]  # noqa: E731, B023
        words = split(t)
        spelt = dict(zip(words, [W.spelling(c := W.Chunk([w.encode()], W.key_mask(1 << 40)).number_grams(), model)[c.word[0]] for w in words])) | {">": float(model.bits[model.of[32], model.of[32], 0])}
        total, mixed = 0.0, {}
        for g, times in grams[k].items():
            n1 = uni[g[2]] - lost1[g[2]]
            p = np.logaddexp2(np.log2(max((n1 - d1[min(n1, 3)]) / sum(uni.values()), 1e-300)), math.log2(spare) - spelt[g[2]])
            for counts, followers, context, gram, d in ((n2, by2, g[1], g[1:], d2), (n3, by3, g[:2], g, d3)):
                if (context, len(gram)) not in mixed:
                    ns = [n for x in followers.get(context, ()) if (n := counts(x))]
                    mixed[context, len(gram)] = (sum(ns), sum(d[min(n, 3)] for n in ns))
                every, off = mixed[context, len(gram)]
                if every:
                    n = counts(gram)
                    p = np.logaddexp2(np.log2(max((n - d[min(n, 3)]) / every, 1e-300)), math.log2(off / every) + p)
            total -= times * p
        assert math.isclose(got[k], total, rel_tol=1e-6), k


def test_tables_grow_with_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select(F.coalesce("text", F.lit("")).alias("words"))
    sizes = []
    for n in (100, 1000):
        held, found = W.train_tables(docs.limit(n), 2, W.key_mask(1 << 22))
        assert held.frame().count() == 6  # three kinds, two shards
        held.drop()
        sizes.append(found[W.TRIPLE][5])
    assert sizes[1] > 6 * sizes[0]


def test_runs_of_keys():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    runs = W.by_shard(keys, 7)
    assert [a for _, a, _ in runs] == [0, *(b for _, _, b in runs[:-1])] and runs[-1][2] == len(keys) and [s for s, _, _ in runs] == list(range(7))
    for s, a, b in runs:
        assert (W.unpack("ki", W.pack("ki", keys[a:b], np.arange(b - a)))[0] == keys[a:b]).all() and all(int(k) * 7 >> 64 == s for k in keys[a:b:50])
    assert W.by_shard(keys[:0], 7) == []
    short = keys & np.uint64(W.key_mask(1 << 20))
    assert 0 < len(set(short.tolist())) == len(keys) and not (short & np.uint64((1 << 22) - 1)).any() and (W.unpack("k", W.pack("k", short))[0] == short).all()
    assert W.key_mask(1 << 60) == (1 << 64) - 1
    grams = [keys[np.random.default_rng(k).integers(0, 50, 300)] for k in range(3)]
    got = W.unpack_grams(W.pack_grams(grams, np.arange(300)), 3)
    assert sorted(zip(*map(list, got))) == sorted(zip(*map(list, grams), range(300)))


def test_hash_of_a_word_is_the_same_wherever_it_stands():
    random.seed(3)
    words = [bytes(random.choices(b"abcdefgh\xc3\xa9", k=random.choice([1, 2, 3, 8, 30]))) for _ in range(40_000)] + [b"q" * 200_000, b"q" * 200_001]
    seen = {}
    for own in (words, words[::-1]):
        for texts in ([b" ".join(own)], [b"\n".join(own[k : k + 700]) + b" " for k in range(0, len(own), 700)]):
            c = W.Chunk(texts, (1 << 64) - 1)
            split = [w for t in texts for w in t.split()]
            assert c.sizes.tolist() == [len(t.split()) for t in texts]
            for word, key in zip(split, c.w[c.is_word].tolist(), strict=True):
                assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen)


def test_model_with_any_names_and_hot_rows(spark):
    """A third of all rows alike, texts of one long word, and columns named as the operator's own."""
    rows = [(5, "the same words again and again", "en", 1, 2, 3)] * 60 + [(k, f"the cat {k} sat on the mat", "en", 1, 2, 3) for k in range(100, 220)]
    rows += [(7, "x" * 3_000_000, "en", 1, 2, 3), (8, "the cat " * 200_000, "en", 1, 2, 3), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _bits long, _trusted long, _chunk long")
    docs = docs.withColumns({x: F.lit("mine") for x in ("_id", "_bytes", "_round", "_words", "_of", "bits", "kind", "shard", "blob", "trusted", "words", "_lang")})
    labels = spark.createDataFrame([(k, 1) for k in (5, *range(100, 200))], "doc_id long, quality int")
    out = K.classify(docs, labels)
    assert set(out.columns) == {*docs.columns, "perplexity", "threshold", "kept"} and out.count() == docs.count()
    assert out.where("perplexity is null or kept is null").count() == 0
    assert out.select(*docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(out.select(*docs.columns)).isEmpty()


def test_classify_knows_orders_of_words(spark):
    # the same letters and nearly all the same byte trigrams: only the order of the words differs
    good = [" ".join(["one two three four five six seven eight nine ten"] * 4)] * 12
    rows = [(k, t, "en") for k, t in enumerate(good)] + [(99, " ".join(["ten nine eight seven six five four three two one"] * 4), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(11)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in K.classify(docs, labels).collect()}
    assert kept[11] and not kept[99]
