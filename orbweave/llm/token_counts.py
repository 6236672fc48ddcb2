"""Token counts by rank-synchronous merging of byte-pair symbols held in ragged numpy arrays.

Texts of a slice are normalised (NFC, white space, lower case) and cut into pre-tokens on
arrays of code points. Every pre-token not met before becomes a run of symbols in one flat
array; in each round every run applies its lowest-ranked pair at all its places at once,
until no run has a pair left. The symbols that survive are counted, and a pre-token's count
is kept (in a bounded table) for later slices of the same task.

Defined cases: a null or empty text has 0 tokens; the strings of added tokens inside a text
count as one token each, as the library does by default; nothing is truncated; repeated rows
are counted each on their own; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import range_hashes, slices

MEMO = 1 << 20  #: pre-tokens whose counts a task remembers
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")  #: after an apostrophe, one pre-token with it
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class Characters:
    """Classes and lower cases of all code points as the library has them, whose Unicode version is neither Python's nor another package's.

    The library is asked once, on the driver; tasks get runs of equal class and the few lower cases that differ from Python's.
    """

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.normalizers import Lowercase
        from tokenizers.pre_tokenizers import Split

        every = [*range(0xD800), *range(0xE000, 0x110000)]
        text, code, kinds = "".join(map(chr, every)), np.array(every), np.zeros(0x110000, np.uint8)
        for kind, other in ((SPACE, r"\S"), (LETTER, r"\P{L}"), (NUMBER, r"\P{N}")):
            for _, (start, end) in Split(Regex(other), "removed").pre_tokenize_str(text):
                kinds[code[start:end]] = kind
        self.start = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])).astype(np.int32)
        self.kind = kinds[self.start]
        lines = "\n".join(map(chr, every))  # the line feed itself gives one line more
        pairs = zip([*every[:10], 10, *every[10:]], lines.replace("Σ", "σ").lower().split("\n"), Lowercase().normalize_str(lines).split("\n"), strict=True)
        self.lower = {ord("Σ"): "σ"} | {c: theirs for c, mine, theirs in pairs if mine != theirs}

    def classes(self) -> np.ndarray:
        """The class of every code point."""
        return np.repeat(self.kind, np.diff(np.append(self.start, 0x110000)))

    def normalised(self, text: str) -> str:
        """NFC, then lower case character by character (a capital sigma has one lower case here)."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.translate(self.lower).lower()


@lru_cache(1)
def characters() -> Characters:
    return Characters()


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merges of a BPE file with word-end symbols, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.added = [t["content"] for t in spec["added_tokens"]]
        byte = _byte_symbols()
        self.inner = np.array([ids.get(c, -1) for c in byte], np.int64)
        self.final = np.array([ids.get(c + end, -1) for c in byte], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        self.none = len(merges)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], self.none)

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many symbols survive in each pre-token ``data[start:end]`` (none is empty)."""
        size = end - start
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(start, size)
        symbol = self.inner[data[at]]
        symbol[off[1:] - 1] = self.final[data[end - 1]]
        token = np.repeat(np.arange(len(size)), size)
        out = np.zeros(len(size), np.int64)
        known = symbol >= 0
        symbol, token = symbol[known], token[known]
        while len(symbol):
            rank = np.full(len(symbol), self.none, np.int64)
            rank[:-1] = np.where(token[1:] == token[:-1], self.ranks(symbol[:-1], symbol[1:]), self.none)
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lowest = np.minimum.reduceat(rank, head)
            length = np.diff(np.append(head, len(symbol)))
            done = lowest == self.none
            out[token[head[done]]] = length[done]
            apply = (rank == np.repeat(lowest, length)) & (rank < self.none)
            # equal neighbours ("aaa") may give overlapping places: the first, third, ... of such a run apply
            place = np.flatnonzero(apply)
            if len(place):
                fresh = np.concatenate([[True], place[1:] != place[:-1] + 1])
                nth = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                place = place[nth % 2 == 0]
                symbol[place] = self.merged[rank[place]]
            keep = ~np.repeat(done, length)
            keep[place + 1] = False
            symbol, token = symbol[keep], token[keep]
        return out


def pretokens(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes (8 spare ones at the end), byte start and end, and text number of each pre-token of normalised texts."""
    joined = "\n".join(texts) + "\n"
    data = np.frombuffer(joined.encode("utf-8") + b"\0" * 8, dtype=np.uint8)
    if len(data) - 8 == len(joined):
        code, byte = data[:-8], None
    else:
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        byte = np.append(np.flatnonzero((data[:-8] & 0xC0) != 0x80), len(data) - 8)
    kind = classes[code]
    cut = np.ones(len(code) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero((code == 39) & cut[:-1] & cut[1:])
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        at = quote[quote + len(suffix) < len(code)]
        for i, c in enumerate(suffix):
            at = at[code[at + 1 + i] == ord(c)]
        cut[at + 1] = False
        cut[at + 1 + len(suffix)] = True
        quote = np.setdiff1d(quote, at, assume_unique=True)
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    shown = kind[start] != SPACE
    start, end = start[shown], end[shown]
    stop = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(stop, start, side="right")
    return data, (start if byte is None else byte[start]), (end if byte is None else byte[end]), of


class Counter:
    """Counts tokens of texts; remembers the counts of up to ``memo`` pre-tokens by their 64-bit hash and length."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO, known: Characters | None = None):
        self.vocabulary, self.memo = vocabulary, memo
        self.characters = known or characters()
        self.classes = self.characters.classes()
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.added = re.compile("|".join(map(re.escape, vocabulary.added))) if vocabulary.added else None

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        pieces, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.added and "<|" in text:
                total[i] += len(self.added.findall(text))
                for piece in self.added.split(text):
                    pieces.append(self.characters.normalised(piece))
                    owner.append(i)
            else:
                pieces.append(self.characters.normalised(text))
                owner.append(i)
        if not pieces:
            return total
        data, start, end, of = pretokens(pieces, self.classes)
        if not len(start):
            return total
        key, first, back = np.unique(range_hashes(data, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, key), max(0, len(self.known) - 1))
        hit = self.known[at] == key if len(self.known) else np.zeros(len(key), bool)
        count = np.zeros(len(key), np.int64)
        count[hit] = self.value[at[hit]]
        new = ~hit
        count[new] = self.vocabulary.count(data, start[first[new]], end[first[new]])
        if new.any() and len(self.known) < self.memo:
            known = np.concatenate([self.known, key[new]])
            order = np.argsort(known)
            self.known, self.value = known[order], np.concatenate([self.value, count[new]])[order]
        each = np.bincount(of, weights=count[back], minlength=len(pieces)).astype(np.int64)
        np.add.at(total, owner, each)
        return total


@lru_cache(4)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each text: UTF-8 bytes and tokens of the whole text.

    ``path``: the vocabulary file, at the same place on every executor; by default that of the installed package.
    """
    known = characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in slices(batches):
            counter = counter or Counter(_vocabulary(path or vocabulary_path()), known=known)
            texts = b.column(1).to_pylist()
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(counter(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
