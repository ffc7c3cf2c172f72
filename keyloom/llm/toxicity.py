"""Toxicity by subword bags: character n-gram embeddings, averaged, into a linear softmax.

A word is its character n-grams between word marks; n-grams are hashed into a fixed number of rows, so that a word never
seen, or misspelled, shares vectors with words it resembles. The average over a window of words goes into a softmax of
two classes. Embeddings and softmax are trained jointly in numpy on the driver, on a bounded sample of labelled
documents. A window of a toxic document has that label, whether or not it is itself toxic. So a window's margin says
how much more toxic documents have such words; a document's score is a logistic function of its highest window.

After training only an n-gram's margin matters: the product of its vector and the softmax. Scoring adds up margins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bpe import slices
from keyloom.llm.common import resident, unused

#: Bound of the training sample: documents of each class, and bytes of text in all.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 16 << 20

ROWS, DIM, GRAMS, WINDOW, SEED = 1 << 18, 8, (3, 4, 5), 16, 42

#: N-grams of fewer sampled documents keep no vector: they tell documents apart, not classes.
LEAST_DOCS = 6

#: Margin from which a window of a toxic document counts as toxic itself once WARM_UP is over.
SURE = 2.0

#: Epochs in which every window has its document's label.
WARM_UP = 3

#: A window counts each word once, and as many n-grams at least: so a word that fills a text weighs no more than elsewhere.
LEAST_GRAMS = 100

#: Bytes of words that a worker remembers before it starts afresh, and what one takes beside its own.
REMEMBERED_BYTES, ENTRY_BYTES = 64 << 20, 190

#: Characters of a word whose n-grams are found at once; longer words are taken piece by piece.
PIECE = 1 << 16

_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - (ROWS.bit_length() - 1))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of all words, one after another, and how many each word has (at least one)."""
    parts = [_word_grams(words[a : a + 50_000]) for a in range(0, len(words), 50_000)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join([f"<{w}>" for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = _grams_of_codes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes)[owner], owner)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(words))


def _grams_of_codes(code: np.ndarray, end_of: np.ndarray, owner: np.ndarray, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and owners of the n-grams that end by ``end_of``, and that start below a place if one is given."""
    code, at = code.astype(np.uint64), np.arange(len(code))
    rows, owners = [], []
    state = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[: max(0, len(code) - n + 1)] = code[n - 1 :]
        state = (state ^ shifted) * _PRIME + np.uint64(n)
        if n in GRAMS:
            fits = at + n <= end_of
            if below is not None:
                fits &= at < below
            rows.append(((state[fits] * _MIX) >> _SHIFT).astype(np.int32))
            owners.append(owner[fits])
    return np.concatenate(rows), np.concatenate(owners)


def margin_sum(word: str, margin: np.ndarray) -> tuple[float, int]:
    """Sum of the margins of a long word's n-grams and how many it has, in pieces that overlap by less than an n-gram."""
    code, total, many = "<" + word + ">", 0.0, 0
    for a in range(0, len(code), PIECE):
        part = code[a : a + PIECE + max(GRAMS) - 1]
        at, _ = _grams_of_codes(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), np.full(len(part), len(part)), np.zeros(len(part), np.int64), PIECE)
        total, many = total + float(margin[at].sum(dtype=float)), many + len(at)
    return total, many


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass(frozen=True)
class Model:
    key: str
    margin: np.ndarray  # of each row, float32: what its vector adds to the toxic logit
    bias: float
    slope: float  # of the document's logistic function
    shift: float


def size_of(words) -> int:
    """Bytes that words take where they are remembered, about; one may have four for a character."""
    return sum(map(len, words)) * 2 + ENTRY_BYTES * len(words)


class Scorer:
    """Windows' margins from remembered sums of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.bytes = 0
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def learn(self, words: set[str]) -> None:
        new, long = [w for w in words if len(w) <= PIECE], [w for w in words if len(w) > PIECE]
        rows, counts = word_grams(new)
        ends = np.cumsum(counts)
        sums = np.add.reduceat(self.model.margin[rows].astype(float), ends - counts) if len(rows) else np.zeros(0)
        if long:
            got = [margin_sum(w, self.model.margin) for w in long]
            sums, counts = np.append(sums, [g[0] for g in got]), np.append(counts, [g[1] for g in got])
            new += long
        self.bytes += size_of(new)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.sums, self.counts = np.concatenate([self.sums, sums]), np.concatenate([self.counts, counts])

    def windows(self, docs: list[list[str]]) -> np.ndarray:
        """The margin of every window of documents that all have words."""
        missing: set[str] = set()
        for d in docs:
            missing |= set(d).difference(self.index)
        if missing:
            if self.bytes + size_of(missing) > REMEMBERED_BYTES:
                self.forget()
                missing = {w for d in docs for w in d}
            self.learn(missing)
        ids = np.fromiter((self.index[w] for d in docs for w in d), np.int64)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        many = -(-sizes // WINDOW)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = np.repeat(np.cumsum(many) - many, sizes) + within // WINDOW
        pairs = np.unique(window * len(self.sums) + ids)
        window, ids = pairs // len(self.sums), pairs % len(self.sums)
        sums, counts = np.bincount(window, self.sums[ids]), np.bincount(window, self.counts[ids])
        return sums / np.maximum(counts, LEAST_GRAMS) + self.model.bias

    def top_windows(self, texts: list[str]) -> np.ndarray:
        """The highest window's margin of each text; of a text without words, that of an empty window."""
        docs = [words_of(t) for t in texts]
        out = np.full(len(docs), self.model.bias)
        filled = [k for k, d in enumerate(docs) if d]
        if filled:
            sizes = [-(-len(docs[k]) // WINDOW) for k in filled]
            firsts = np.cumsum([0, *sizes[:-1]])
            out[filled] = np.maximum.reduceat(self.windows([docs[k] for k in filled]), firsts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.top_windows(texts) + self.model.shift, -30, 30)))


def train(texts: list[str], toxic: list[int], share: float | None = None, epochs: int = 12, rate: float = 0.1, seed: int = SEED) -> Model:
    """Embeddings and softmax by Adagrad over windows, then the logistic function on documents. One class alone: its share.

    ``share``: of toxic documents among all, if the sample has another.
    """
    random = np.random.default_rng(seed)
    y_doc = np.array(toxic, float)
    odds = lambda p: float(np.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3))))
    sampled = float(y_doc.mean()) if len(y_doc) else 0.0
    base = odds(sampled if share is None else share)
    empty = Model(uuid.uuid4().hex, np.zeros(ROWS, np.float32), base, 1.0, 0.0)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return empty
    docs = [words_of(t) for t in texts]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    if not vocabulary:
        return empty
    rows, counts = word_grams(list(vocabulary))
    ends = np.cumsum(counts)
    in_docs = np.zeros(ROWS, np.int32)
    spans = []
    for d in docs:
        ids = np.fromiter((vocabulary[w] for w in d), np.int64, len(d))
        spans.append(ids)
        if len(ids):
            distinct = np.unique(ids)
            in_docs[np.unique(np.concatenate([rows[ends[w] - counts[w] : ends[w]] for w in distinct.tolist()]))] += 1
    useful = in_docs >= LEAST_DOCS
    windows = [(k, np.unique(ids[a : a + WINDOW])) for k, ids in enumerate(spans) for a in range(0, len(ids), WINDOW)]
    y = np.array([y_doc[k] for k, _ in windows])
    vectors = (random.normal(0, 0.1, (ROWS, DIM)) * useful[:, None]).astype(np.float32)
    soft = random.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sq_vectors, sq_soft, sq_bias = np.full((ROWS, 1), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    batch = min(512, max(32, len(windows) // 200))  # small samples need as many steps
    of_doc = np.array([k for k, _ in windows])
    first_window = np.flatnonzero(np.concatenate([[True], of_doc[1:] != of_doc[:-1]]))
    for epoch in range(epochs):
        chosen = np.arange(len(windows))
        if epoch >= WARM_UP:
            # of toxic documents, the windows that look so by now, and the one that looks most so
            now = Scorer(replace(empty, margin=(vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), bias=float(bias[1] - bias[0]))).windows([d for d in docs if d])
            top = np.repeat(np.maximum.reduceat(now, first_window), np.diff(np.append(first_window, len(now))))
            # of the others, the one that looks most toxic, any that looks so at all, and some at random
            clean = (now >= np.minimum(top, 0)) | (random.random(len(now)) < 0.15)
            chosen = chosen[np.where(y == 0, clean, now >= np.minimum(top, SURE))]
        weight = np.where(y > 0, 0.5 / max(y[chosen].mean(), 1e-9), 0.5 / max(1 - y[chosen].mean(), 1e-9)).astype(np.float32)
        order = random.permutation(chosen)
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            words = np.concatenate([windows[k][1] for k in part])
            of_window = np.repeat(np.arange(len(part)), [len(windows[k][1]) for k in part])
            n = counts[words]
            gram_at = np.repeat(ends[words] - n.cumsum(), n) + np.arange(n.sum())
            own = rows[gram_at]
            win = np.repeat(of_window, n)
            many = np.bincount(win, minlength=len(part))
            starts = np.concatenate([[0], np.cumsum(many)[:-1]])
            many = np.maximum(many, LEAST_GRAMS).astype(np.float32)
            mean = np.add.reduceat(vectors[own], starts, axis=0) / many[:, None]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            target = np.stack([1 - y[part], y[part]], 1)
            error = ((p - target) * weight[part, None] / len(part)).astype(np.float32)
            g_soft, g_bias = mean.T @ error, error.sum(0)
            g_mean = (error @ soft.T) / many[:, None]
            by_row = np.argsort(own, kind="stable")
            sorted_own = own[by_row]
            first = np.flatnonzero(np.concatenate([[True], sorted_own[1:] != sorted_own[:-1]]))
            g_rows = np.add.reduceat(g_mean[win[by_row]], first, axis=0)
            touched = sorted_own[first]
            keep = useful[touched]
            touched, g_rows = touched[keep], g_rows[keep]
            sq_vectors[touched, 0] += (g_rows**2).mean(1)
            vectors[touched] -= rate * g_rows / np.sqrt(sq_vectors[touched])
            sq_soft += g_soft**2
            soft -= rate * g_soft / np.sqrt(sq_soft)
            sq_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(sq_bias)
    margin = (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    model = replace(empty, margin=margin, bias=float(bias[1] - bias[0]))
    top = Scorer(model).top_windows(texts)
    slope, shift = logistic(top, y_doc)
    return replace(model, slope=slope, shift=shift + base - odds(sampled))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the logistic regression of y on x, by Newton's method."""
    centre, scale = float(np.median(x)), float(x.std()) or 1.0
    z = np.stack([(x - centre) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0] / scale, 0.0)
    return float(slope), float(w[1] - slope * centre)


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learned from: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], float]:
    """Whole texts and labels of at most ``most`` documents of each class, and the share of toxic ones among all labels.

    Only labels of ids that aren't held out count. Documents are taken in the order of a hash of their ids while they stay within half of ``most_bytes``
    for each class; one that doesn't fit is left out, and those after it may still. An id has one text, its shortest. If
    there are documents of a class but none fits, that is an error.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "toxic", F.xxhash64("doc_id").alias("order"))
    share = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    labels, chosen = labels.distinct(), None
    for value in (0, 1):
        part = labels.where(F.col("toxic") == value).orderBy("order", "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow())  # at most 2 * most rows of 20 bytes
    found = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("words")).join(F.broadcast(chosen), "id")
    shortest = found.groupBy("order", "id", "toxic").agg(F.min(F.struct(F.octet_length("words").alias("n"), F.xxhash64("words").alias("mark"))).alias("s")).select("order", "id", "toxic", "s.*")
    within = []
    sizes = sorted(shortest.collect())  # at most 2 * most rows
    for value in (0, 1):
        left, own = most_bytes // 2, [r for r in sizes if r["toxic"] == value]
        for r in own:
            if r["n"] <= left:
                left -= r["n"]
                within.append(r)
        if own and not any(r["toxic"] == value for r in within):
            raise ValueError(f"no document of class {value} has at most {most_bytes // 2} bytes to learn from")
    if not within:
        return [], [], share
    allowed = docs.sparkSession.createDataFrame(within, shortest.schema)
    same = (found["id"] == allowed["id"]) & (found["toxic"] == allowed["toxic"]) & (F.octet_length(found["words"]) == allowed["n"]) & (F.xxhash64(found["words"]) == allowed["mark"])
    rows = found.join(F.broadcast(allowed), same, "left_semi").groupBy("order", "id", "toxic").agg(F.min("words").alias("words")).collect()  # within most_bytes
    rows.sort()
    return [r["words"] for r in rows], [int(r["toxic"]) for r in rows], share


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` without the text, with ``score_col`` (double, 0 to 1) of whole texts. Null and empty texts score as a window without words."""
    keep, plain = [c for c in docs.columns if c not in (text_col, score_col)], unused(docs, "text")
    schema = docs.select(*keep).schema.add(score_col, "double")
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key  # 2**18 floats: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(f"toxicity-{key}", lambda: Scorer(sent.value))
        for part, texts in slices(batches, plain):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(own.scores(texts))], [*keep, score_col])

    return docs.select(*keep, docs[text_col].cast("string").alias(plain)).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score: labels, of documents not held out, are learned; no other column is an input.

    Null and empty texts score as a window without words; null ids aren't learned from and repeated rows are scored one by
    one, each the same; labels other than 0 and 1 don't count, and without labels of both classes all scores are equal. A
    column named score is replaced, others may have any name. An empty table stays empty.
    """
    model = train(*training_sample(docs, labels, id_col=id_col, text_col=text_col))
    return score(docs, model, text_col)
