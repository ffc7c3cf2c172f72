"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over words and grows with the text: ``kneser_words``. What it leaves to words that it hasn't seen is spelt
by the model here: the same over the letters of the trusted words, which are bytes in 64 classes, so of at most 2**18
counts whatever the corpus. A document is rejected if its perplexity is above a quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bpe import slices
from keyloom.llm.common import maybe_broadcast, unused, written
from keyloom.llm.kneser_words import Rounds, scores

#: Share of a language's trusted documents whose perplexity may lie below the threshold, and what is allowed above it.
QUANTILE, SLACK = 0.995, 1.02

#: Bytes of an average document that each perplexity is mixed with, so that very short texts aren't judged by chance.
PRIOR_BYTES = 80

#: Classes of bytes: the space, the end, each letter of a to z and A to Z, digits, full stop, comma, other ASCII, and six for parts of other signs.
CLASSES = 64


def byte_classes() -> np.ndarray:
    of = np.full(256, 57)
    of[[32, 0, ord("."), ord(",")]] = 0, 1, 55, 56
    of[97:123], of[65:91], of[48:58] = np.arange(2, 28), np.arange(28, 54), 54
    for (first, end), k in zip(((0xC2, 0xC4), (0xC4, 0xE0), (0xE0, 0xF0), (0xF0, 0x100), (0x80, 0xA0), (0xA0, 0xC0)), range(58, 64)):
        of[first:end] = k
    return of


def bytes_of(texts: list[str]) -> np.ndarray:
    """The texts' words, with two spaces before a text, one after each word, and a zero for the end."""
    return np.frombuffer(b"".join([b" ".join([b" ", *t.encode().split(), b"\0"]) for t in texts]), np.uint8)


def summed_counts(docs: DataFrame, size: int, places: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often ``places`` names each number below ``size``, over the whole texts of a frame whose one column is text."""
    text = docs.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, texts in slices(batches, text, 1 << 19):  # small arrays stay in the processor's memory
            total += np.bincount(places(bytes_of(texts)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["at", "n"])

    out = np.zeros(size, np.int64)
    for at, n in docs.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # at most ``size`` rows
        out[at] = n
    return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from how many counts are 1 to 4."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.array([0.0, *(min(max(x, 0.1), k - 0.1) for k, x in zip((1, 2, 3), d))])


def level(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Shares of the last axis after each context, mixed with ``lower`` ones."""
    off = discounts(n)[np.minimum(n, 3)]
    total = n.sum(-1, keepdims=True)
    seen = np.maximum(total, 1)
    return (n - off) / seen + np.where(total > 0, off.sum(-1, keepdims=True) / seen, 1.0) * lower


@dataclass(frozen=True)
class Letters:
    """Classes of bytes, and bits of a byte after two classes: 4 MB."""

    of: np.ndarray  # 256
    bits: np.ndarray  # CLASSES x CLASSES x 256, float32


def class_triples(b: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each byte as a class, with the two classes before it, but for the two spaces that begin a text."""
    c, ends = of.astype(np.int32)[b], b == 0
    triples = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    return triples[~(ends[:-2] | ends[1:-1])]


def letters_of(of: np.ndarray, counts: np.ndarray, triples: np.ndarray) -> Letters:
    """The model of counted bytes and triples of classes. Without any, every class is as likely as any other."""
    three = triples.reshape((CLASSES,) * 3)
    two = (three > 0).sum(0)
    share = level(three, level(two, level((two > 0).sum(0), np.full(CLASSES, 1 / CLASSES))))
    within = (counts + 1) / np.bincount(of, counts + 1, CLASSES)[of]
    return Letters(of, (-np.log2(share[:, :, of] * within)).astype(np.float32))


def train_letters(docs: DataFrame) -> Letters:
    """One pass over the whole texts of a frame whose one column is text; no shuffle but of each task's sums."""
    of = byte_classes()
    found = summed_counts(docs, 256 + CLASSES**3, lambda b: np.append(b.astype(np.int32), 256 + class_triples(b, of)))
    return letters_of(of, found[:256], found[256:])


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: Rounds = Rounds()) -> DataFrame:
    """``docs``, all rows and columns, with perplexity (of a byte), threshold and kept (boolean).

    Trained on all whole documents of label quality 1: words in tables that grow with them (``kneser_words``), above
    the spelling of unseen words. A trusted document is scored by what the other rows hold. A language's threshold is the
    quantile of its trusted documents' perplexities times ``slack``; null is a language of its own; one without trusted
    documents has no threshold, and its documents are kept. Null and empty texts, and those of white space, have the mean
    perplexity of trusted text. Rows without an id, or with one that no label has, don't train; repeated rows train and
    are judged one by one, repeated labels count once (any of quality 1). Columns named as the three are replaced, others
    may have any name; an empty table stays empty. Without ``with_text`` the text is left out.
    """
    docs = docs.drop("perplexity", "threshold", "kept")
    ident, trusted, bits, size = (unused(docs, x) for x in ("id", "trusted", "bits", "bytes"))
    ids = labels.where("quality = 1").select(F.col("doc_id").alias(ident)).where(F.col(ident).isNotNull()).distinct()
    ids = written(ids, "trusted")  # each round asks for them
    marked = docs.join(maybe_broadcast(ids, 16), docs[id_col] == F.col(ident), "left").withColumn(trusted, F.col(ident).isNotNull()).drop(ident)
    letters = train_letters(marked.where(trusted).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("words")))
    scored = scores(marked.withColumn(bits, F.col(trusted)), letters, id_col, text_col, bits, with_text, rounds, (bits, size))
    mean = scored.where(trusted).agg(F.sum(bits) / F.sum(size)).first()[0]
    mixed = (F.col(bits) + PRIOR_BYTES * (8.0 if mean is None else mean)) / (F.col(size) + PRIOR_BYTES)
    scored = scored.withColumn("perplexity", F.pow(F.lit(2.0), mixed)).drop(bits, size)
    language, of = F.coalesce(F.col(lang_col), F.lit("")), unused(scored, "of")
    limits = scored.where(trusted).groupBy(language.alias(of)).agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("threshold"))
    limits = written(limits, "thresholds")
    out = scored.drop(trusted).join(maybe_broadcast(limits, 64), language == F.col(of), "left").drop(of)
    return out.withColumn("kept", F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
