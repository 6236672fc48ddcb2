"""Ranked lexical search by MaxScore over an inverted index in shards.

The index has a written row for each shard (a slice of texts of about ``SHARD_BYTES``): documents' ids and numbers of
terms, the terms' hashes in order, and each term's list of places in the shard with its frequencies there.
It holds every term of every text and serves any queries. Corpus counts (texts with terms, all terms, the
frequency of asked terms over texts) are aggregates over the shards.

A query is answered shard by shard. A term's bound is its weight times its largest impact in the shard's list. Texts
are passed in ranges of places, and the terms are parted anew at each range: those of the smallest bounds, as long as their
bounds' sum stays below the score of the best k-th text so far, are non-essential, for a text that has none but these can't qualify.
Candidates come from the lists of the essential terms; the non-essential lists are probed in order of
falling bounds, only for candidates that could still reach the threshold with all bounds that are left. A shard returns
its k best texts of each query, and the k best of all follow by a window that is cut to k rows before its exchange.

Scores are whole numbers (weights are floors of scaled logarithms), so they don't depend on the order of
addition. Terms are compared by 64-bit hashes.

Bounds: queries are searched in blocks of ``MOST_TERMS`` different (query, term) pairs (one query at least), one after the
other; only one block is on the driver and goes to the tasks. A shard has ``SHARD_BYTES`` of text, or one longer text.

Defined cases: a null or empty text, or one without a term, is no result and doesn't count among the texts; a query
without terms has no results; repeated rows are texts of their own, queries of the same id are each answered as one
(their terms together); equal scores go by ascending doc_id, rows without an id last; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import ALNUM, Texts, Words, slices
from .store import written

SHARD_BYTES = 8 << 20
MOST_TERMS = 200_000
SPAN = 512  #: places of a shard that are passed before terms are parted anew
TOP = 20
INDEX = "shard string, doc_id array<long>, n array<int>, token array<long>, begin array<int>, place array<int>, tf array<int>"
FOUND = "item int, doc_id long, score long"


def _lists(b: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(Texts(b.column(1)), ALNUM)
    h, text = words.hashes().view(np.int64), words.text_of()
    order = np.argsort(h, kind="stable")  # by term, then by place
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    token, begin = np.unique(h[first], return_index=True)
    one = lambda x, t: pa.array([x.astype(t)], pa.list_(pa.from_numpy_dtype(t)))
    ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0).cast(pa.int64()))
    columns = [pa.array([uuid.uuid4().hex], pa.string()), ids, one(words.counts(), np.int32), one(token, np.int64), one(np.append(begin, len(first)), np.int32), one(text[first], np.int32), one(tf, np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "n", "token", "begin", "place", "tf"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in slices(batches):
            held.append(b)
            size += b.column(1).nbytes
            if size >= shard_bytes:
                yield _lists(pa.concat_batches(held))
                held, size = [], 0
        if held:
            yield _lists(pa.concat_batches(held))

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "lists", 1)


@dataclass(frozen=True)
class Query:
    item: object
    token: np.ndarray  # different hashes
    times: np.ndarray  # how often each occurs


@dataclass(frozen=True)
class Corpus:
    texts: int  # with a term
    terms: int


def norms(n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """12 m of each text: m grows with its number of terms over the corpus's mean."""
    if len(n) and 25 * int(n.max()) * corpus.texts >= 1 << 63:  # beyond 64 bits only in a step
        return np.array([12 * (75 + 25 * int(x) * corpus.texts // corpus.terms) for x in n], np.int64)
    return 12 * (75 + 25 * n.astype(np.int64) * corpus.texts // max(1, corpus.terms))


def weight(df: int, texts: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + norm)


def max_score(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, top: int, span: int = SPAN) -> list[tuple[int, int]]:
    """(place, score) of the ``top`` best texts of one shard, by falling score, then rising ``ids``.

    ``lists``: (places ascending, impacts, weight) of each term; ``ids``: the texts' ids as they break ties.
    """
    bound = np.array([w * int(v.max()) for _, v, w in lists])
    order = np.argsort(bound, kind="stable")
    lists, bound = [lists[i] for i in order], bound[order]
    below = np.concatenate([[0], np.cumsum(bound)])  # of the first j terms
    best: list[tuple[int, int, int]] = []  # heap of (score, -id, place)
    for lo in range(0, len(ids), span):
        threshold = best[0][0] if len(best) == top else 1
        essential = int(np.searchsorted(below[1:], threshold, side="left"))  # bounds of the terms before it sum to less
        if essential == len(lists):
            break
        score = np.zeros(span, np.int64)
        for place, value, w in lists[essential:]:
            i, j = np.searchsorted(place, [lo, lo + span])
            score[place[i:j] - lo] += w * value[i:j]
        at = np.flatnonzero(score)
        for j in range(essential - 1, -1, -1):
            at = at[score[at] + below[j + 1] >= threshold]
            if not len(at):
                break
            place, value, w = lists[j]
            k = np.minimum(np.searchsorted(place, at + lo), len(place) - 1)
            score[at] += np.where(place[k] == at + lo, w * value[k], 0)
        at = at[score[at] >= threshold]
        for p, s in zip((at + lo).tolist(), score[at].tolist(), strict=True):
            row = (s, -int(ids[p]), p)
            if len(best) < top:
                heapq.heappush(best, row)
            elif row > best[0]:
                heapq.heapreplace(best, row)
    return [(p, s) for s, _, p in sorted(best, reverse=True)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            ids, *rest = (b.column(k)[i].values for k in ("doc_id", "n", "token", "begin", "place", "tf"))
            yield ids, *(x.to_numpy(zero_copy_only=False) for x in rest)


def corpus_of(index: DataFrame) -> Corpus:
    at = F.aggregate("n", F.struct(F.lit(0).cast("long").alias("texts"), F.lit(0).cast("long").alias("terms")), lambda s, x: F.struct((s["texts"] + (x > 0).cast("long")).alias("texts"), (s["terms"] + x).alias("terms")))
    r = index.select(at.alias("x")).agg(F.coalesce(F.sum("x.texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("x.terms"), F.lit(0)).alias("terms")).first()
    return Corpus(r.texts, r.terms)


def frequencies(index: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """In how many texts each of ``tokens`` (a block's, sorted) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                token, begin = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("token", "begin"))
                at = np.searchsorted(tokens, token)
                hit = tokens[np.minimum(at, len(tokens) - 1)] == token
                yield pa.RecordBatch.from_arrays([pa.array(token[hit]), pa.array(np.diff(begin)[hit].astype(np.int64))], names=["t", "n"])

    if not len(tokens):
        return {}
    rows = index.select("token", "begin").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return {r.t: r.n for r in rows.collect()}


def _blocks(items: DataFrame) -> Iterator[list[Query]]:
    """Queries in blocks of ``MOST_TERMS`` terms at most (one query at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(Texts(b.column(1)), ALNUM)
            key, times = np.unique(np.stack([words.text_of(), words.hashes().view(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(key[0])), pa.array(key[1]), pa.array(times.astype(np.int64))], names=["item_id", "token", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, token long, times long").groupBy("item_id", "token").agg(F.sum("times").alias("times"))
    block: list[Query] = []
    held, last, token, times = 0, object(), [], []
    for r in terms.orderBy("item_id", "token").toLocalIterator():
        if r.item_id != last:
            if token:
                block.append(Query(last, np.array(token, np.int64), np.array(times, np.int64)))
            if held >= MOST_TERMS:
                yield block
                block, held = [], 0
            last, token, times = r.item_id, [], []
        token.append(r.token)
        times.append(r.times)
        held += 1
    if token:
        yield [*block, Query(last, np.array(token, np.int64), np.array(times, np.int64))]


def search_block(index: DataFrame, block: list[Query], corpus: Corpus, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): the best texts of each shard for each query of the block; ``item`` is its place there."""
    tokens = np.unique(np.concatenate([q.token for q in block]))
    df = frequencies(index, tokens)
    weights = np.array([weight(df.get(int(t), 0), corpus.texts) for t in tokens], np.int64)
    queries = [(np.searchsorted(tokens, q.token), q.times) for q in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, token, begin, place, tf in _shards(batches):
            norm = norms(n, corpus)
            tie = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            at = np.searchsorted(token, tokens) if len(token) else np.zeros(len(tokens), int)
            known = {}
            for t in np.flatnonzero(token[np.minimum(at, len(token) - 1)] == tokens) if len(token) else ():
                a, b = begin[at[t]], begin[at[t] + 1]
                known[int(t)] = place[a:b], impacts(tf[a:b], norm[place[a:b]])
            out: list[tuple[int, int, int]] = []
            for i, (own, times) in enumerate(queries):
                lists = [(*known[t], int(weights[t]) * k) for t, k in zip(own.tolist(), times.tolist(), strict=True) if t in known and weights[t] > 0]
                if lists:
                    out += [(i, p, s) for p, s in max_score(lists, tie, top)]
            i, p, s = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), ids.take(pa.array(p)), pa.array(s)], names=["item", "doc_id", "score"])

    return index.drop("shard").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best texts of each item with a score above 0."""
    spark = docs.sparkSession
    index = build_index(docs, shard_bytes)
    corpus = corpus_of(index)
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in _blocks(items):
        names = spark.createDataFrame([(i, q.item) for i, q in enumerate(block)], f"item int, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = search_block(index, block, corpus, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        got = written(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found")
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


ORACLE = r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        qt AS (SELECT item_id, t, count(*) AS k FROM q GROUP BY ALL),
        c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
        f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
        wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, c),
        m AS (SELECT r, doc_id, 75 + 25 * len(w) * n_docs // n_terms AS m FROM d, c),
        s AS (SELECT item_id, r, doc_id, CAST(sum(k * w * (1000000000 * tf // (1000 * tf + 12 * m))) AS BIGINT) AS score
              FROM qt JOIN wt USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
        o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""
