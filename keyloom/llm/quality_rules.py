"""Quality by a learned decision list over text statistics.

Statistics are DataFrame expressions. From labelled documents' statistics, sequential covering learns rules for bad
documents: a rule grows condition by condition on one part of the sample (by FOIL's gain), is pruned on the other, and
what it covers is taken away before the next. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE, unused

#: Bound of the labelled sample that rules are learned from.
SAMPLE_ROWS = 12_000

RATIOS = ("n_words", "chars_per_word", "symbol_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share")

#: A rule must be right this often, on the part that it was grown on and on the other.
LEAST_PRECISION = 0.97

REPEATED = 5  # words of the windows


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and RATIOS (double).

    Whole texts; null counts as empty. Windows of words are told apart by 64-bit hashes of five words in order, within a
    text. No shuffle. Columns named so are replaced, others may have any name.
    """
    keep = [c for c in docs.columns if c not in {text_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RATIOS}]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    row = F.struct(*[docs[c] for c in keep], F.lit(True).alias(unused(docs, "there")))  # so that no name clashes with ours
    names, keep = keep, ["_row"]
    docs = docs.select(row.alias("_row"), text.alias("_text"), F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    n = F.size("_words")
    window = lambda k: F.xxhash64(F.slice("_words", k, REPEATED))
    docs = docs.select(
        *keep, "_words", n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("_upper"),
        F.when(F.locate("\n", F.col("_text")) > 0, lines).otherwise(F.array(F.lit(""))).alias("_lines"),
        F.when(n >= REPEATED + 1, F.transform(F.sequence(F.lit(1), n - REPEATED + 1), window)).alias("_windows"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
    )
    repeats = F.col("_windows").isNotNull() & (F.size(F.array_distinct("_windows")) < F.size("_windows"))
    docs = docs.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").alias("_n_lines"), "_upper", "_distinct",
        F.when(repeats, F.array_sort(F.transform("_windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))).alias("_sorted"),
    )
    beside = lambda x, at: (x["h"] == F.get("_sorted", at - 1)["h"]) | (x["h"] == F.get("_sorted", at + 1)["h"])
    twice = F.filter("_sorted", lambda x, at: F.coalesce(beside(x, at), (at > 0) & (x["h"] == F.get("_sorted", at - 1)["h"]), (x["h"] == F.get("_sorted", at + 1)["h"]), F.lit(False)))
    docs = docs.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["k"]))).drop("_sorted")
    covered = F.transform("_at", lambda k, j: F.least(F.lit(REPEATED), F.coalesce(F.get("_at", j + 1) - k, F.lit(REPEATED))))
    docs = docs.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return docs.select(
        *[F.col("_row").getField(c).alias(c) for c in names], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("chars_per_word"), (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("_upper") / chars).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("_distinct") / words).alias("distinct_share"),
    )


# rules


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.limit if self.above else row[self.name] <= self.limit

    def column(self) -> Column:
        return F.col(self.name) > self.limit if self.above else F.col(self.name) <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def thresholds(rows: list[dict], name: str, most: int = 24) -> list[float]:
    """Midpoints between neighbouring quantiles of a statistic."""
    values = sorted({r[name] for r in rows})
    if len(values) > most:
        values = [values[k * (len(values) - 1) // most] for k in range(most + 1)]
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def precision(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[float, int]:
    p, n = sum(covers(rule, r) for r in bad), sum(covers(rule, r) for r in good)
    return (p / (p + n) if p + n else 0.0), p


def grow(bad: list[dict], good: list[dict], longest: int) -> Rule:
    """Conditions of the highest FOIL gain, until the rule covers no good document."""
    rule: Rule = ()
    while good and len(rule) < longest:
        base = math.log2(len(bad) / (len(bad) + len(good)))
        best = None
        for name in RATIOS:
            for limit in thresholds(bad + good, name):
                over_bad, over_good = sum(r[name] > limit for r in bad), sum(r[name] > limit for r in good)
                for above, p, n in ((True, over_bad, over_good), (False, len(bad) - over_bad, len(good) - over_good)):
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > (best[0] if best else 1e-9):
                        best = (gain, Condition(name, above, limit))
        if best is None:
            break
        rule += (best[1],)
        bad, good = [r for r in bad if best[1].holds(r)], [r for r in good if best[1].holds(r)]
    return rule


def prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """Without its last conditions, as many as make (p - n) / (p + n) highest."""
    def worth(r: Rule) -> float:
        p, n = sum(covers(r, x) for x in bad), sum(covers(r, x) for x in good)
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn_rules(rows: list[dict], most: int = 12, longest: int = 4, least: float = LEAST_PRECISION) -> list[Rule]:
    """Rules for rows of ``bad`` 1, in their order; none if there are no rows of both kinds.

    Rows are split, in the order given, into two parts for growing and one for pruning.
    """
    grown, pruned = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    bad, good = [r for r in grown if r["bad"]], [r for r in grown if not r["bad"]]
    bad_p, good_p = [r for r in pruned if r["bad"]], [r for r in pruned if not r["bad"]]
    rules: list[Rule] = []
    while bad and good and len(rules) < most:
        rule = prune(grow(bad, good, longest), bad_p, good_p)
        if not rule:
            break
        (on_grown, p), (on_pruned, q) = precision(rule, bad, good), precision(rule, bad_p, good_p)
        if on_grown < least or (on_pruned < least and q) or p < 3 or not q:
            break
        rules.append(rule)
        bad, good, bad_p, good_p = ([r for r in part if not covers(rule, r)] for part in (bad, good, bad_p, good_p))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds: the list as one ordered conditional expression."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Statistics and ``bad`` of at most ``most`` labelled documents, in the order of a hash of their ids.

    An id has one row, whatever repeats: it is bad if any label says so, and of its documents' statistics the least count.
    """
    labels = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    chosen = labels.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(most)  # 20 bytes a row
    rows = text_stats(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id"), "text")
    once = rows.groupBy("order", "id").agg(F.min(F.struct("bad", *RATIOS)).alias("s")).select("order", "id", "s.*")
    return [r.asDict() for r in sorted(once.collect(), key=lambda r: (r["order"], r["id"]))]  # at most ``most`` rows


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with their statistics, base_failed and kept. An empty table stays empty; repeated rows are judged one by one.

    base_failed: fewer than 10 words, or over a fifth of the words in windows of five that come twice or more. kept:
    false if base_failed, else the learned list's verdict.
    """
    rules = learn_rules(labelled_sample(docs, labels, most, id_col, text_col))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return text_stats(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
