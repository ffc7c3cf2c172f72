"""Learned operators on documents that they did not learn from, and scores by brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import quality_rules as R
from keyloom.llm import toxicity as T
from keyloom.llm.kneser_ney import classify

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grams_by_hand(word):
    code, out = [ord(c) for c in f"<{word}>"], []
    for at in range(len(code)):
        state = 0
        for n in range(1, 6):
            if at + n > len(code):
                break
            state = ((state ^ code[at + n - 1]) * 0x100000001B3 + n) % (1 << 64)
            if n >= 3:
                out.append((state * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - 18))
    return out


def test_toxicity_scores_by_hand(spark):
    docs, labels = read(spark, SMALL, "documents").select("doc_id", "text"), read(spark, SMALL, "labels")
    model = T.train(*T.training_sample(docs, labels))
    assert model.margin.any()
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    known = {}
    for k, text in texts.items():
        words, tops = text.lower().split(), []
        for a in range(0, len(words), 16):
            total = many = 0
            for w in set(words[a : a + 16]):
                if w not in known:
                    rows = grams_by_hand(w)
                    known[w] = (sum(float(model.margin[r]) for r in rows), len(rows))
                total, many = total + known[w][0], many + known[w][1]
            tops.append(total / max(many, 100) + model.bias)
        top = max(tops, default=model.bias)
        want = 1 / (1 + math.exp(-min(max(model.slope * top + model.shift, -30), 30)))
        assert math.isclose(got[k], want, rel_tol=1e-6), k


def test_labels_held_out_change_no_score(spark):
    docs, labels = read(spark, SMALL, "documents").select("doc_id", "text"), read(spark, SMALL, "labels")
    out = T.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert flipped.exceptAll(labels).count() > 5
    scores = [{r.doc_id: r.score for r in T.toxicity(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_sample_goes_on_after_a_text_that_does_not_fit(spark):
    rows = [(k, ("grumble words " if k % 2 else "plain words ") * 20) for k in range(80)] + [(200, "x y " * 400_000)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(200, 1)], "doc_id long, toxic int")
    texts, toxic, _ = T.training_sample(docs, labels, most_bytes=100_000)
    assert len(texts) > 40 and set(toxic) == {0, 1} and max(map(len, texts)) < 1000
    texts, *_ = T.training_sample(docs.where("doc_id < 80").union(docs.where("doc_id < 80")), labels, most_bytes=100_000)
    assert len(texts) > 40  # an id that comes twice is learned from once


def test_toxicity_on_labels_held_out(spark):
    docs, labels = read(spark, LARGE, "documents").select("doc_id", "text"), read(spark, LARGE, "labels")
    rows = T.toxicity(docs, labels).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    caught = [r.score >= 0.3 for r in rows if r.toxic == 1]
    marked = [r.score >= 0.3 for r in rows if r.toxic == 0]
    print(f"toxicity, held out: {sum(caught)} of {len(caught)} caught, {sum(marked)} of {len(marked)} others marked")
    assert np.mean(caught) > 0.8 and np.mean(marked) < 0.06


def test_quality_rules_on_labels_held_out(spark):
    rows = R.labelled_sample(read(spark, LARGE, "documents"), read(spark, LARGE, "labels"))
    rules = R.learn_rules([r for k, r in enumerate(rows) if k % 4])
    held = rows[::4]
    caught = [any(R.covers(x, r) for x in rules) for r in held if r["bad"]]
    marked = [any(R.covers(x, r) for x in rules) for r in held if not r["bad"]]
    print(f"quality rules, held out: {sum(caught)} of {len(caught)} bad covered, {sum(marked)} of {len(marked)} others; {[' and '.join(map(str, x)) for x in rules]}")
    assert np.mean(caught) > 0.8 and np.mean(marked) < 0.02


def test_quality_rules_learn_from_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "some words of a text")] * 50 + [(2, "other words"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 0)], "doc_id long, quality int")
    rows = R.labelled_sample(docs, labels, most=2)
    assert sorted((r["id"], r["bad"]) for r in rows) in ([(1, 1), (2, 0)], [(1, 1)], [(2, 0)])


def test_quality_rules_with_any_names(spark):
    names = "_text _words _lines _windows _distinct _upper _sorted _at _n_lines _row there id order bad".split()
    docs = spark.createDataFrame([(1, "a b " * 200_000), (1, "a b " * 200_000), (2, "z" * 2_000_000), (None, None)], "doc_id long, text string").selectExpr("*", *[f"'mine' as `{n}`" for n in names])
    out = R.quality_rules(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    assert out.where(" and ".join(f"`{n}` = 'mine'" for n in names)).count() == 4
    assert {(r.doc_id, r.n_words, r.n_repeat_words) for r in out.collect()} == {(1, 400_000, 400_000), (2, 1, 0), (None, 0, 0)}


def test_classifier_on_labels_held_out(spark):
    """Half of the labels train; the other half's good documents are kept and its bad ones mostly not."""
    sf = "/root/testdata/sf0.01"
    labels = read(spark, sf, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = classify(read(spark, sf, "documents").select("doc_id", "lang", "text"), labels.where(half), with_text=False).join(labels.where(~half), "doc_id").select("kept", "quality").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    print(f"classifier, held out: {sum(good)} of {len(good)} good kept, {sum(bad)} of {len(bad)} bad kept")
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4
