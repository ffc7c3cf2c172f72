"""The pipeline's near-duplicate stage against comparing every pair."""

import random
import re
from itertools import combinations

import numpy as np

import corpus_pipeline
from keyloom.llm.simhash import ENTRY, FAR, FAR_WIDE, ORDERS, block_keys, block_pairs, bucket_links, keep_one_of_each, near_groups, shingles, wide_fingerprint


def sets_of(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def kept_by_hand(texts):
    sets, root = sets_of(texts), list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if (not sets[a] and not sets[b]) or 5 * both >= 4 * len(sets[a] | sets[b]) > 0:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return {k for k, r in enumerate(root) if k == r}


def test_stage_drops_every_near_copy(spark):
    random.seed(4)
    texts = []
    for _ in range(12):
        words = [f"w{random.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 5, 9):  # nine single words: 45 of 116 shingles, below 0.8
            copy = list(words)
            for k in random.sample(range(0, 120, 6), edits):
                copy[k] = "edit"
            texts.append(" ".join(copy).upper())
    texts += ["", " ", "one two", "One  two", "one two three"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == kept_by_hand(texts) and 12 < len(kept) < len(texts) / 2 + 12


def test_bucket_links_join_through_a_later_member():
    texts = [" ".join(f"w{k}" for k in range(a, a + 100)) for a in (0, 16, 8)]
    sets = [shingles(t.encode(), 5) for t in texts]
    assert bucket_links([1, 2], sets[:2], 0.8) == []
    assert sorted(bucket_links([1, 2, 3], sets, 0.8)) == [(1, 3), (2, 3)]


def test_rows_of_one_id_are_decided_one_by_one(spark, tmp_path):
    a, b = ("a" + " ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(3, b), (5, b), (5, a), (5, a), (None, a)], "doc_id long, text string").write.parquet(path)
    kept = sorted((r.doc_id, r.text) for r in keep_one_of_each(spark.read.parquet(path)).collect())
    assert kept == [(3, b), (5, a)]


def test_large_buckets_are_parted_by_size_without_losing_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keyloom.llm.simhash.LARGE", 3)
    random.seed(6)
    shared = [f"s{k}" for k in range(200)]  # a passage that all have, and ends of all lengths
    texts = [" ".join(shared + [f"e{j}" for j in range(random.randrange(0, 240))]) for _ in range(60)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    assert {r.doc_id for r in keep_one_of_each(spark.read.parquet(path)).collect()} == kept_by_hand(texts)


def test_secrets_are_owned_in_the_whole_corpus(spark, tmp_path):
    """A value that six owners have is an example, although one document of them is left."""
    value = "q7Xv9Kd2Lm4Pz8Rt"
    rows = [(k, f"token={value} in text {k}", "en", f"s{k}", 30) for k in range(6)] + [(9, "token=w3Ye5Uj6Hn1Bg0Vc alone", "en", "s1", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.secret_scans(spark, docs.where("doc_id in (3, 9)"), str(tmp_path)).collect()}
    assert out[3].text == rows[3][1] and out[9].text == "token=[SECRET] alone" and out[9].n_chars == len(out[9].text)


def drawn_out(h):
    """The 1024 bits of a shingle's hash."""
    out = []
    for seed in np.random.default_rng(11).integers(0, 1 << 63, 16, np.uint64).tolist():
        x, most = (h ^ seed) * 0x9E3779B97F4A7C15, (1 << 64) - 1
        x = ((x & most) ^ (x & most) >> 30) * 0xBF58476D1CE4E5B9
        x = ((x & most) ^ (x & most) >> 27) * 0x94D049BB133111EB
        out += [((x & most) ^ (x & most) >> 31) >> k & 1 for k in range(64)]
    return np.array(out)


def test_wide_fingerprint_is_a_simhash():
    rng = np.random.default_rng(2)
    drawn = {h: drawn_out(h) for h in rng.integers(0, 1 << 63, 60, np.uint64).tolist()}
    for n in (0, 1, 2, 3, 4, 7, 8, 31, 60):
        hashes = list(drawn)[:n]
        want = 2 * sum((drawn[h] for h in hashes), np.zeros(1024, np.int64)) > n
        got = wide_fingerprint(np.array(hashes, np.uint64))
        assert (np.unpackbits(got.astype("<u8").view(np.uint8), bitorder="little") == want).all(), n
    many = rng.integers(0, 1 << 63, 9001, np.uint64)  # longer than what is counted at once
    assert (wide_fingerprint(many) == wide_fingerprint(many[::-1])).all()


def test_sets_at_the_limit_share_blocks():
    rng = np.random.default_rng(3)
    for both, own in ((8, 1), (80, 10), (400, 50)):
        wide = []
        for _ in range(300):
            h = rng.integers(0, 1 << 63, both + 2 * own, np.uint64)
            wide.append((wide_fingerprint(h[: both + own]), wide_fingerprint(np.append(h[:both], h[both + own :]))))
        a, b = (np.array(x) for x in zip(*wide))
        assert sum((block_keys(a, k) == block_keys(b, k)).sum(1) for k in range(ORDERS)).min() > 0
        assert np.bitwise_count(a[:, :2] ^ b[:, :2]).sum(1).max() <= FAR


def test_block_pairs_are_all_that_are_near(monkeypatch):
    rng = np.random.default_rng(5)
    entries = np.zeros(400, ENTRY)
    entries["key"], entries["size"], entries["class"] = rng.integers(0, 40, 400), rng.integers(50, 90, 400), rng.permutation(400)
    entries["sketch"] = rng.integers(0, 1 << 63, (3, 2), np.uint64)[rng.integers(0, 3, 400)]
    want = set()
    for a, b in combinations(entries, 2):
        few = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a["sketch"], b["sketch"])) <= FAR
        if a["key"] == b["key"] and few and min(a["size"], b["size"]) >= 0.8 * max(a["size"], b["size"]):
            want.add(tuple(sorted((int(a["class"]), int(b["class"])))))
    assert {tuple(x.tolist()) for x in block_pairs(entries, 0.8)} == want and len(want) > 100
    assert block_pairs(entries[:0], 0.8) == []
    monkeypatch.setattr("keyloom.llm.simhash.LARGE", 3)  # larger blocks are given whole
    found = block_pairs(entries, 0.8)
    assert want <= {p for x in found for p in combinations(x.tolist(), 2)} and max(map(len, found)) > 3


def test_sets_are_sent_in_rounds(spark, tmp_path, monkeypatch):
    """No shuffle carries half of the sets of all pairs, and no link is lost."""
    monkeypatch.setattr("keyloom.llm.simhash.ROUND_ROWS", 20, raising=False)
    random.seed(7)
    texts = []
    for _ in range(100):
        words = [f"w{random.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:399], "edit"])]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    assert {r.doc_id for r in keep_one_of_each(spark.read.parquet(path)).collect()} == kept_by_hand(texts)
    most = max(n for k, n in stages().items() if k not in before)
    assert most < len(texts) * 396 * 8 / 2


def edited(n, words, edits):
    """A text and copies of it, each with other words in some places: most pairs are candidates, few are linked."""
    base = [f"w{random.randrange(5000)}" for _ in range(words)]
    texts = [base]
    for j in range(n - 1):
        copy = list(base)
        for k in random.sample(range(0, words, 6), random.randrange(*edits)):
            copy[k] = f"edit{j}"
        texts.append(copy)
    return [" ".join(t) for t in texts]


def written_by(spark, path):
    """Bytes that all shuffles write, and what stays."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    kept = {r.doc_id for r in keep_one_of_each(spark.read.parquet(path)).collect()}
    return sum(n for k, n in stages().items() if k not in before), kept


def test_sets_of_a_cluster_are_sent_once(spark, tmp_path):
    random.seed(8)
    texts = edited(30, 4000, (20, 180))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    total, kept = written_by(spark, path)
    assert kept == kept_by_hand(texts) and 1 < len(kept) < 30
    assert total < 3 * len(texts) * 3996 * 8


def test_sets_of_a_cluster_beyond_one_task_are_sent_for_each_part(spark, tmp_path, monkeypatch):
    """In parts of about five sets: no link between two parts is lost, and no set is sent for each pair."""
    monkeypatch.setattr("keyloom.llm.simhash.HELD", 40_000, raising=False)
    random.seed(9)
    texts = edited(40, 4000, (20, 180)) + [" ".join(t.split()[:k]) for k, t in zip((3600, 3000, 2400), edited(3, 4000, (1, 2)))]
    random.shuffle(texts)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    total, kept = written_by(spark, path)
    assert kept == kept_by_hand(texts) and 1 < len(kept) < 43
    assert total < 20 * len(texts) * 3996 * 8


def test_near_groups_are_joined_by_paths():
    rng = np.random.default_rng(12)
    wide = rng.integers(0, 1 << 63, (3, 16), np.uint64)
    chain = [wide[0]]
    for k in range(3):  # each 256 bits from the last, 512 from the one before
        chain.append(chain[-1] ^ np.where(np.arange(16) // 4 == k, ~np.uint64(0), np.uint64(0)))
    rows = np.array([chain[2], wide[1], chain[0], chain[3], wide[2], chain[1]])
    assert [g.tolist() for g in near_groups(np.array([5, 9, 4, 8, 7, 6]), rows)] == [[4, 5, 6, 8]]
    assert near_groups(np.array([1, 2]), wide[:2]) == []


def test_sets_at_the_limit_are_near_in_all_bits():
    rng = np.random.default_rng(13)
    for both, own in (((4, 0), 1), ((8, 1), 1), ((80, 10), 10), ((400, 0), 100)):
        for _ in range(300):
            h = rng.integers(0, 1 << 63, sum(both) + own, np.uint64)
            a, b = wide_fingerprint(h[: sum(both)]), wide_fingerprint(np.append(h[: both[0]], h[sum(both) :]))
            assert np.bitwise_count(a ^ b).sum() <= FAR_WIDE
