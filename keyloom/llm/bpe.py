"""Byte-level BPE encoding by a prefix-sharing trie, and decoding.

A prefix of a word is encoded by its last token and the encoding of what precedes that token. So a trie node needs only
its last token, and words that share a prefix share its nodes. Distinct words are visited in sorted order, which is the
depth-first order of their trie: the stack holds the nodes of the current path, and a word starts from the node where it
leaves the word before it.

At a node, a token that ends there is the last one if it and the last token of the prefix before it stay apart under
the merges. Of all candidates exactly one does: the published test of whether two tokens may stand side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keyloom.llm.common import resident, unused
from keyloom.llm.word_hashes import SPACES, Memory, bytes_at, grouped, mix, word_hashes

#: Pieces of the byte-level pre-tokenizer; white space by its Unicode property, as \\s of the engines differs.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes of words' ids that a worker remembers; beyond it, its memory starts afresh.
REMEMBERED_BYTES = 64 << 20

#: Bytes of the longest word that is remembered, and pairs of tokens.
LONGEST, PAIRS = 256, 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class TrieBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE, merges in the order of ids)."""

    def __init__(self, path: str, most_bytes: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (max([*self.id_of.values(), *self.special.values()]) + 1)
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes_of))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = bytes(letters[c] for c in left), bytes(letters[c] for c in right)
            self.merged[self.id_of[a], self.id_of[b]] = i = self.id_of[a + b]
            self.parts[i] = (self.id_of[a], self.id_of[b])
        self.by_end: dict[int, list[int]] = {}
        for token in self.id_of:
            self.by_end.setdefault(token[-1], []).append(len(token))
        self.lengths = {end: sorted(set(n), reverse=True) for end, n in self.by_end.items()}
        self.pieces = regex.compile(PIECES)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.apart: dict[int, bool] = {}  # by both tokens in one number
        self.memory = Memory(REMEMBERED_BYTES if most_bytes is None else most_bytes)
        # of each token, where its bytes are in one array of them all, and how many
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across their border would come before the merges that make tokens a and b."""
        key, limit, answer = a << 32 | b, len(self.bytes_of) + 1, True
        known = self.apart.get(key)
        if known is not None:
            return known
        while True:
            if self.merged.get((a, b), limit) < limit:
                answer = False
                break
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        break
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[key] = answer
        return answer

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian, 32 bits) of each distinct word, in one depth-first pass over their trie."""
        out: dict[bytes, bytes] = {}
        last: list[int] = [-1]  # last token at each depth of the current path
        before, ids, lengths, apart, stay = b"", self.id_of, self.lengths, self.apart, self.stay_apart
        bytes_of = self.bytes_of
        for word in sorted(set(words)):
            depth = len(commonprefix((before, word)))
            del last[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                for n in lengths[word[end - 1]]:
                    if n > end:
                        continue
                    token = ids.get(word[end - n : end])
                    if token is None:
                        continue
                    if n < end and not (known if (known := apart.get(last[end - n] << 32 | token)) is not None else stay(last[end - n], token)):
                        continue
                    last.append(token)
                    break
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end])
                end -= len(bytes_of[last[end]])
            out[word] = np.array(tokens[::-1], "<u4").tobytes()
            before = word
        return out

    def _pieces(self, text: str) -> bytes:
        """Ids of text without special tokens, from the pieces that the pre-tokenizer cuts."""
        pieces = [p.encode() for p in self.pieces.findall(text)]
        ids = self.encode_words(set(pieces))
        return b"".join([ids[p] for p in pieces])

    def _alone(self, text: str) -> bytes:
        """Ids of any text; strings of special tokens become their ids."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._pieces(text) if text else b""
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._pieces(p) for p in self.split_special.split(text) if p)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has: one trie holds the pieces of them all."""
        cut = [[p.encode() for p in self.pieces.findall(w)] for w in words]
        ids = self.encode_words({p for pieces in cut for p in pieces})
        own = [ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces]) for pieces in cut]
        return np.frombuffer(b"".join(own), np.uint32), np.array([len(x) // 4 for x in own], np.int64)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the library's ``encode(text, add_special_tokens=False)``.

        Before a space that follows no white space, or that black space follows, pieces part. So texts whose words stand
        between single spaces are taken word by word, with the space before them, from memory; others piece by piece.
        """
        raw = [t.encode() for t in texts]
        whole = b"\n".join([b"", *raw, b""])
        text = np.frombuffer(whole, np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.cumsum(lengths + 1) - lengths  # of texts
        gaps = np.flatnonzero(text == 32)
        starts = np.sort(np.append(gaps + 1, begins))  # of words: after each space and at each text
        of = np.searchsorted(begins, starts, "right") - 1
        sizes = np.minimum(np.append(starts[1:], len(text) + 1) - 1, (begins + lengths)[of]) - starts
        odd = np.zeros(len(texts), bool)
        head = starts == begins[of]
        white = (sizes == 0) | starts_white(text, starts)
        odd[of[white & ~(head & (sizes > 0))]] = True
        odd[[k for k, t in enumerate(texts) if any(s in t for s in self.special)]] = True
        use = np.flatnonzero(~odd[of])
        out = [b""] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._alone(texts[k])
        if not len(use):
            return out
        starts, sizes, of, head = starts[use], sizes[use], of[use], head[use]
        hashes = mix(word_hashes(text, starts, sizes), head.astype(np.uint64), 9, (1 << 64) - 1)
        at, back = grouped(hashes)

        def learn(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = zip(starts[at[left]].tolist(), sizes[at[left]].tolist(), head[at[left]].tolist())
            return self._learn([("" if first else " ") + whole[a : a + n].decode() for a, n, first in rows])

        first, many, ids = self.memory.look_up(hashes[at], sizes[at] <= LONGEST, learn)
        flat = ids[bytes_at(first[back], many[back])].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(of, many[back], len(texts)).astype(np.int64))
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if not odd[k]:
                out[k] = flat[a:b]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        own = np.frombuffer(ids, "<u4")
        return self.all_bytes[bytes_at(self.places[own], self.sizes[own])].tobytes().decode("utf-8", "replace")


def starts_white(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether white space (by Unicode's property or Python's) begins at each place of UTF-8."""
    padded = np.append(text, np.zeros(3, np.uint8))
    a, b, c = (padded[starts + k] for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return SPACES[a] | (a >= 28) & (a <= 31) | two | three


def loaded(path: str) -> TrieBpe:
    """A worker's encoder for a file."""
    return resident(f"bpe-{path}", lambda: TrieBpe(path))


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each has about ``most`` bytes of text, with the texts (null: empty)."""
    for batch in batches:
        at, column = 0, batch.column(batch.schema.get_field_index(text_col))
        per_row = max(1, column.nbytes // max(1, len(column)))
        step = max(1, most // per_row)
        while at < len(batch):
            part = batch.slice(at, step)
            yield part, [t or "" for t in column.slice(at, step).to_pylist()]
            at += step


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``ids_col`` (binary: little-endian unsigned 32-bit ids) and, if named, the text decoded from them.

    No shuffle; whole texts; a null text counts as empty, of no ids. Other columns pass through, whatever their names;
    repeated rows are encoded one by one. An empty table stays empty.
    """
    keep, plain = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)], unused(docs, "text")
    schema = docs.select(*keep).schema.add(ids_col, "binary")
    if decoded_col:
        schema = schema.add(decoded_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part, texts in slices(batches, plain, 2 << 20):
            ids = bpe.encode_batch(texts)
            columns = [part.column(k) for k in range(len(keep))] + [pa.array(ids, pa.binary())]
            names = [*keep, ids_col]
            if decoded_col:
                columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, docs[text_col].cast("string").alias(plain)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in place of them; null ids count as none."""
    keep = [c for c in encoded.columns if c not in (text_col, ids_col)]
    schema = encoded.select(*keep).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = pa.array([bpe.decode(i or b"") for i in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, text_col])

    return encoded.select(*keep, ids_col).mapInArrow(run, schema)
