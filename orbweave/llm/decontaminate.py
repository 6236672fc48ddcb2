"""Benchmark decontamination by a distributed positional inverted index.

The index stores, for each shard of training texts, the postings of every token that the test
items can ask for: one written row for each shard, with the tokens' places as compressed rows
(tokens in order, where each one's places begin, the places). A place is a word number in the
shard, so a text's words are a range of places.

A phrase is searched by intersecting lists: its terms are ordered by their frequency in the
whole corpus, the rarest term's places give candidate starts (place minus the term's offset in
the phrase), and each further term's list, adjusted by its offset, keeps the starts that it has
too. The lists of all phrases of a shard are intersected together, in numpy. A proximity
match asks instead for all terms near the rarest one, in any order: the list of each further
term is asked for the places next to it.

Bounds: items are searched in blocks of ``MOST_WORDS`` words at most (a longer item is cut into
pieces that overlap by a window less a word), one after the other: only one block's phrases are on
the driver and go to the tasks, ``MOST_WORDS * window * 9`` bytes at most.

Defined cases: a null or empty text has no words and no hits; an item of fewer than ``window``
words is one phrase, an item without words is never met; repeated rows each give a row; equal
items are each reported, items without an id count as hits but are not listed; an empty table of
items gives no hits; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, Texts, Words, covered, slices, sums
from .store import spare, written

WINDOW = 10
SPAN = 20  #: words on either side of a phrase's rarest term in which a proximity match has all others
MOST_WORDS = 400_000
INDEX = "shard string, doc_id array<long>, off array<int>, token array<long>, begin array<int>, place array<int>"


@dataclass(frozen=True)
class Phrases:
    """Windows of test items: hashes of their words (padded with 0), lengths, items; equal windows once, with all their items."""

    terms: np.ndarray
    size: np.ndarray
    window_of: np.ndarray
    item_of: np.ndarray
    items: list

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms[self.terms != 0])


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """All windows of ``window`` words of each item; an item of fewer words is one window."""
    words = Words(Texts(pa.array([t for _, t in items], pa.string())), ALNUM)
    h, n = words.hashes(), words.counts()
    first, size, item = [], [], []
    for i in np.flatnonzero(n):
        k = max(1, n[i] - window + 1)
        first.append(words.off[i] + np.arange(k))
        size.append(np.full(k, min(window, n[i])))
        item.append(np.full(k, i))
    if not first:
        z = np.zeros(0, np.int64)
        return Phrases(np.zeros((0, window), np.uint64), z, z, z, [])
    first, size, item = np.concatenate(first), np.concatenate(size), np.concatenate(item)
    at = first[:, None] + np.arange(window)
    terms = np.where(np.arange(window) < size[:, None], np.append(h, np.zeros(window, np.uint64))[at], np.uint64(0))
    terms, back = np.unique(terms, axis=0, return_inverse=True)
    pair = np.unique(np.stack([back.ravel(), item]), axis=1)
    return Phrases(terms, (terms != 0).sum(axis=1), pair[0], pair[1], [k for k, _ in items])


def indexer(vocabulary: np.ndarray | None):
    """Arrow batches of (doc_id, text) → one row of the index for each slice of texts."""
    ints = lambda x, t: pa.array([x], pa.list_(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(Texts(b.column(1)), ALNUM)
            h = words.hashes()
            asked = np.arange(len(h)) if vocabulary is None else np.flatnonzero(_among(vocabulary, h))
            order = asked[np.argsort(h[asked], kind="stable")]
            token, begin = np.unique(h[order], return_index=True)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex], pa.string()), ids, ints(words.off.astype(np.int32), pa.int32()), ints(token.view(np.int64), pa.int64()), ints(np.append(begin, len(order)).astype(np.int32), pa.int32()), ints(order.astype(np.int32), pa.int32())], names=["shard", "doc_id", "off", "token", "begin", "place"])

    return run


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The written index of all texts for the tokens of ``vocabulary`` (sorted hashes), or for every token."""
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(indexer(vocabulary), INDEX), "postings")


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each token of ``vocabulary`` occurs in the whole corpus. The vocabulary, bounded by its block, is broadcast before tokens are counted."""
    spark = index.sparkSession
    steps = F.transform(F.sequence(F.lit(1), F.size("token")), lambda i: F.struct(F.element_at("token", i).alias("t"), (F.element_at("begin", i + 1) - F.element_at("begin", i)).cast("long").alias("n")))
    rows = index.where(F.size("token") > 0).select(F.explode(steps).alias("x")).select("x.*")
    asked = spark.createDataFrame(pa.table({"t": pa.array(vocabulary.view(np.int64))}))
    return {r.t: r.n for r in rows.join(F.broadcast(asked), "t", "left_semi").groupBy("t").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Shard:
    off: np.ndarray
    token: np.ndarray
    begin: np.ndarray
    place: np.ndarray

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each term's places; equal where it has none."""
        if not len(self.token):
            return np.zeros(len(term), np.int64), np.zeros(len(term), np.int64)
        at = np.minimum(np.searchsorted(self.token, term), len(self.token) - 1)
        ok = self.token[at] == term
        return np.where(ok, self.begin[at], 0), np.where(ok, self.begin[at + 1], 0)


def shard(off, token, begin, place) -> Shard:
    return Shard(off.astype(np.int64), token.view(np.uint64), begin.astype(np.int64), place.astype(np.int64))


def rarest_first(terms: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Offsets of each phrase's terms by corpus frequency; padding comes last."""
    keys = np.array(sorted(np.int64(k).view(np.uint64) for k in counts), np.uint64) if counts else np.zeros(0, np.uint64)
    value = np.array([counts[int(k.view(np.int64))] for k in keys], np.int64)
    n = np.where(_among(keys, terms.ravel()), value[np.minimum(np.searchsorted(keys, terms.ravel()), max(0, len(keys) - 1))] if len(keys) else 0, 0).reshape(terms.shape)
    return np.argsort(np.where(terms == 0, np.iinfo(np.int64).max, n), axis=1, kind="stable")


def _candidates(s: Shard, p: Phrases, order: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, place of its rarest term) in blocks, one phrase at least; a phrase with a term that the shard doesn't have can't occur."""
    rows = np.arange(len(p.terms))
    lo, hi = s.lists(p.terms[rows, order[:, 0]])
    alive = hi > lo
    for k in range(1, order.shape[1]):
        term = p.terms[rows, order[:, k]]
        a, b = s.lists(term)
        alive &= (b > a) | (term == 0)
    rows = rows[alive]
    size = (hi - lo)[alive]
    ends = np.cumsum(size)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        part, n = rows[at:to], size[at:to]
        at = to
        yield np.repeat(part, n), s.place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = [np.zeros(0, np.int64)]
    return np.concatenate([x for x, _ in parts] + none), np.concatenate([y for _, y in parts] + none)


def exact(s: Shard, p: Phrases, order: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start place) of every occurrence of every phrase inside one text."""
    found = []
    for phrase, place in _candidates(s, p, order, block):
        start = place - order[phrase, 0]
        text = np.searchsorted(s.off, place, side="right") - 1
        ok = (start >= s.off[text]) & (start + p.size[phrase] <= s.off[text + 1])
        phrase, start = phrase[ok], start[ok]
        for k in range(1, order.shape[1]):
            if not len(phrase):
                break
            offset = order[phrase, k]
            term = p.terms[phrase, offset]
            a, b = s.lists(term)
            at = _first_from(s.place, a, b, start + offset)
            hit = (at < b) & (s.place[np.minimum(at, len(s.place) - 1)] == start + offset) | (term == 0)
            phrase, start = phrase[hit], start[hit]
        found.append((phrase, start))
    return _joined(found)


def _first_from(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of the first value not below ``want`` in each sorted list values[lo:hi]; hi if there is none."""
    lo, hi = lo.copy(), hi.copy()
    for _ in range(int(max(1, (hi - lo).max(initial=1))).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (values[np.minimum(mid, len(values) - 1)] < want)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(less | (lo >= hi), hi, mid)
    return lo


def near(s: Shard, p: Phrases, order: np.ndarray, span: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, text) where all terms of the phrase occur within ``span`` words of some occurrence of its rarest term."""
    found = []
    for phrase, place in _candidates(s, p, order, block):
        text = np.searchsorted(s.off, place, side="right") - 1
        for k in range(1, order.shape[1]):
            if not len(phrase):
                break
            term = p.terms[phrase, order[phrase, k]]
            a, b = s.lists(term)
            at = _first_from(s.place, a, b, place)
            right = s.place[np.minimum(at, len(s.place) - 1)]
            left = s.place[np.maximum(at - 1, 0)]
            hit = (at < b) & (right - place < span) & (right < s.off[text + 1]) | (at > a) & (place - left < span) & (left >= s.off[text]) | (term == 0)
            phrase, place, text = phrase[hit], place[hit], text[hit]
        one = np.unique(np.stack([phrase, text]), axis=1)
        found.append((one[0], one[1]))
    return _joined(found)


def _pieces(text: str, window: int) -> Iterator[tuple[str, int]]:
    """A text and the number of its words at most; texts of more than ``MOST_WORDS`` in pieces that hold each window once at least."""
    if len(text) // 2 + 1 <= MOST_WORDS:
        yield text, len(text) // 2 + 1
        return
    at = [m.start() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    step = max(1, MOST_WORDS - window + 1)
    for i in range(0, max(1, len(at) - window + 1), step):
        to = i + step + window - 1
        yield text[at[i] if at else 0 : at[to] if to < len(at) else None], min(to, len(at)) - i


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple[object, str]]]:
    """Test items in blocks of ``MOST_WORDS`` words at most (one piece at least); one empty block if there are none."""
    out: list[tuple[object, str]] = []
    words, met = 0, False
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        for piece, n in _pieces(r.text, window):
            if words + n > MOST_WORDS and out:
                yield out
                out, words, met = [], 0, True
            out.append((r.item_id, piece))
            words += n
    if out or not met:
        yield out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Shard]]:
    for b in batches:
        for i in range(b.num_rows):
            ids, *rest = (b.column(k)[i].values for k in ("doc_id", "off", "token", "begin", "place"))
            yield b.column("shard")[i].as_py(), ids, shard(*(x.to_numpy(zero_copy_only=False) for x in rest))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """Hits of each text: doc_id, n_words, n_hit (words inside an occurrence), items (ids, as strings in order), near_items.

    ``near_items`` are items with a window whose words all occur within ``span`` words of its rarest one in any order;
    without ``span`` it is empty.
    """
    blocks = _blocks(benchmark, window)
    block, more = next(blocks), next(blocks, None)
    p = phrases(block, window)
    if more is None:
        return _search(build_index(docs, p.vocabulary()), p, span).select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "near_items")
    index = build_index(docs)
    hits = None
    while block is not None:
        part = _search(index, phrases(block, window), span).where(F.size("hit") + F.size("near_items") > 0)
        part = written(part.select("key", "hit", "items", "near_items"), "hits")
        hits = part if hits is None else hits.unionByName(part)
        block, more = more, next(blocks, None)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = hits.groupBy("key").agg(flat("hit"), flat("items"), flat("near_items"))
    rows = index.select("shard", F.posexplode("doc_id").alias("i", "doc_id"), "off")
    rows = rows.select(F.concat_ws(".", "shard", "i").alias("key"), "doc_id", (F.element_at("off", F.col("i") + 2) - F.element_at("off", F.col("i") + 1)).cast("long").alias("n_words"))
    listed = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return rows.join(hits, "key", "left").select("doc_id", "n_words", F.size(listed("hit", "long")).cast("long").alias("n_hit"), *(listed(c, "string").alias(c) for c in ("items", "near_items")))


def _search(index: DataFrame, p: Phrases, span: int | None) -> DataFrame:
    order = rarest_first(p.terms, frequencies(index, p.vocabulary())).astype(np.int8)
    names = np.array([None if k is None else str(k) for k in p.items], dtype=object)
    by = np.searchsorted(p.window_of, np.arange(len(p.terms) + 1))  # pairs are sorted by window

    def items_of(window: np.ndarray, text: np.ndarray, n: int) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(n)]
        pair = np.unique(np.stack([text, window]), axis=1) if len(window) else np.zeros((2, 0), np.int64)
        for t, w in pair.T:
            out[t] += names[p.item_of[by[w] : by[w + 1]]].tolist()
        return [sorted(set(x) - {None}) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, s in _rows(batches):
            n, n_words = len(ids), int(s.off[-1])
            phrase, start = exact(s, p, order)
            text = np.searchsorted(s.off, start, side="right") - 1
            mask = np.zeros(n_words, bool)
            for size in np.unique(p.size[phrase]):
                mask |= covered(start[p.size[phrase] == size], int(size), n_words)
            close = near(s, p, order, span) if span else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            hits = np.flatnonzero(mask)
            each = sums(mask, s.off)
            hit = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(hits - np.repeat(s.off[:-1], each), pa.int64()))
            keys = [f"{name}.{i}" for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), ids, pa.array(np.diff(s.off), pa.int64()), hit, pa.array(items_of(phrase, text, n), pa.list_(pa.string())), pa.array(items_of(*close, n), pa.list_(pa.string()))], names=["key", "doc_id", "n_words", "hit", "items", "near_items"])

    return index.mapInArrow(run, "key string, doc_id long, n_words long, hit array<long>, items array<string>, near_items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text has no hit, all columns as they are.

    A text is told by a 64-bit hash, so each row is judged by its own text whatever its id, and repeated rows alike.
    """
    (name,) = spare(docs.columns, "_hit")
    tid = F.xxhash64("text")
    hit = find_matches(docs.select(tid.alias("doc_id"), "text"), benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(written(hit, "hits"), tid == F.col(name), "left_anti")
