"""Redaction of texts with many or long secrets."""

import random
import string
import time

from pyspark.sql import functions as F

from keyloom.llm.secret_scan import SIGNS, looks_random, redact_live, secret_spans

LETTERS = string.ascii_letters + string.digits


def by_hand(text, values):
    for v in sorted(values, key=lambda v: (-len(v), v)):
        text = text.replace(v, "[SECRET]")
    return text


def test_pieces_give_what_one_after_another_gives(spark, monkeypatch):
    """Values within other runs, within each other, overlapping, with each separator, in texts with signs beyond the BMP."""
    random.seed(8)
    word = lambda n: "".join(random.choices(LETTERS, k=n)) + "a7"
    rows = []
    for k in range(30):
        own = [word(random.choice((12, 20, 40))) for _ in range(random.choice((1, 3, 9)))]
        own += [own[0] + random.choice("+/_.=-") + word(14), own[-1][3:] + word(9), own[0][:13] + "b8"]
        parts = [f"token={v}" for v in own] + [random.choice(("x", "😀", "")) + v + random.choice((".q", "=", "é", "")) for v in own] + [own[0] + own[-1][1:]]
        random.shuffle(parts)
        rows.append((k, random.choice((" ", "\n", "😀", '","')).join(parts), f"s{k % 2}"))
    docs = spark.createDataFrame([*rows, (99, None, "s0"), (98, "plain", "s1")], "doc_id long, text string, source string")
    live = {r.doc_id: r.spans.split(",") for r in secret_spans(docs).where("n_live > 0").collect()}
    want = {98: "plain", 99: None}
    for k, text, _ in rows:
        places = [x.split(":")[1:] for x in live[k] if x.startswith("live:")]
        want[k] = by_hand(text, {text[int(a) : int(b)] for a, b in places})
    monkeypatch.setattr("keyloom.llm.secret_scan.FEW_VALUES", 0)
    assert {r.doc_id: r.text for r in redact_live(docs).collect()} == want


def test_time_does_not_grow_with_values_times_length(spark):
    random.seed(9)
    text = "\n".join("token=" + "".join(random.choices(LETTERS, k=20)) + "a7" for _ in range(40_000))
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    began = time.time()
    assert redact_live(docs).first().text == "\n".join(["token=[SECRET]"] * 40_000)
    assert time.time() - began < 60


def test_a_long_value_is_not_cut_into_its_signs(spark):
    assert "split" not in str(looks_random(F.col("v")))
    values = ["abcdefg7", "abcdefghi", "1234567a", "aaaaaaa7", "abcdef+7", "ab-_./=7", "abcdEF7", "AbCdEfG7" * 1000]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", looks_random(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in rows} == {v: len(set(v)) >= 8 and any(c.isdigit() for c in v) for v in values}
    assert set("".join(values)) <= set(SIGNS)
