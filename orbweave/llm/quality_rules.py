"""Quality rules: lines are labelled content or boilerplate by a linear-chain CRF.

Each text is cut at \\n; lines with a word form a sequence. Emission scores come from shape
features of the line, transition scores from the pair of neighbouring labels; the best label
sequence is found by Viterbi decoding. A text is kept when the base rules pass and the share
of its words that lie in content lines is at least ``share``.

Labels are given for texts, not lines, so the lines' labels are hidden and found along with the weights, on a
bounded sample: up to ``per_class`` labelled texts of each quality. A text's label only says on which side of one half
the share of its words in content lines lies. First each line is scored by a logistic regression of its text's label
on its features alone, so a clean line of a bad text counts as content; where the scores contradict the text's label,
the lines nearest to the other side change over (``constrained``). The CRF is fitted to these sequences by its exact
conditional likelihood (forward-backward), its marginals score the lines anew, and so on for ``ROUNDS`` rounds.
Without labels of both classes a fixed set of weights is used.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are
labelled each on their own; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PLAIN, Texts, Words, covered, gram_hashes, range_hashes, slices, sums, whole

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

ROUNDS = 2  #: fits of the CRF, each to line labels of the one before

FEATURES = ("bias", "short", "long", "symbols", "upper", "repeats", "shouts", "digits", "again", "pipes", "odd_words", "echo")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _is(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _DIGIT, _SHOUT = _is(SYMBOLS), _is(bytes(range(65, 91))), _is(b"0123456789"), _is(b"!?")
_LOWER = _is(bytes(range(97, 123)))


class Lines:
    """Counts of each text and shape features of each line that has a word."""

    def __init__(self, column: pa.Array):
        self.texts = texts = Texts(column)
        self.words = words = Words(texts, PLAIN)
        data, h = texts.data, words.hashes()
        n, n_words = len(data), len(words)
        self.n_words = words.counts()
        code = (data & 0xC0) != 0x80
        cum = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("code", code), ("symbol", _SYMBOL[data]), ("upper", _UPPER[data]), ("lower", _LOWER[data]), ("digit", _DIGIT[data]), ("shout", _SHOUT[data]))}
        of = words.text_of()
        chars = cum["code"][words.end] - cum["code"][words.start]
        self.word_chars = sums(chars, words.off)
        self.n_symbols = cum["symbol"][texts.off[1:]] - cum["symbol"][texts.off[:-1]]

        breaks = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([texts.off[:-1], breaks + 1]))
        start = start[start < n]
        line_of = np.searchsorted(start, words.start, side="right") - 1
        used, first = np.unique(line_of, return_index=True)
        self.first = np.append(first, n_words)  # line i has words first[i]:first[i + 1]
        self.text = of[first] if n_words else np.zeros(0, np.int64)
        begin = start[used]
        end = np.append(start, n)[used + 1] if n_words else begin
        end = np.minimum(end, texts.off[self.text + 1]) if n_words else end
        end = end - (data[end - 1] == 10) if n_words else end
        self.off = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.again = _seen_before(self.text, range_hashes(np.append(data, np.zeros(8, np.uint8)), begin, end))
        self.n_dup_lines = sums(self.again, self.off)

        grams = gram_hashes(h, REPEAT_WINDOW)
        ok = np.flatnonzero(whole(words.off, REPEAT_WINDOW, len(grams)))
        twice = ok[_often(of[ok], grams[ok])]
        self.repeated = covered(twice, REPEAT_WINDOW, n_words)
        self.n_repeat_words = sums(self.repeated, words.off)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

        count = np.diff(self.first)
        size = np.maximum(1, cum["code"][end] - cum["code"][begin])
        per = {k: (v[end] - v[begin]) for k, v in cum.items()}
        letters = np.maximum(1, per["upper"] + per["lower"])
        same = np.zeros(n_words, np.int64)
        same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
        pipe = (words.end - words.start == 1) & (data[words.start] == ord("|"))
        odd = (chars == 1) | (chars > 25)
        by_line = lambda x: sums(x, self.first) / np.maximum(1, count)
        self.line_words = count
        self.x = np.stack([
            np.ones(len(count)), count <= 3, count > 12, np.minimum(1, 5 * per["symbol"] / size), per["upper"] / letters * (per["upper"] > 3),
            by_line(same), np.minimum(1, per["shout"] / np.maximum(1, count)), np.minimum(1, 3 * per["digit"] / size), self.again, by_line(pipe), by_line(odd), by_line(self.repeated),
        ], axis=1).astype(np.float64) if n_words else np.zeros((0, len(FEATURES)))


def _seen_before(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where an earlier entry of the same group has the same key."""
    order = np.lexsort((key, group))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (group[order[1:]] == group[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    return again


def _often(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the group has the key twice or more."""
    order = np.lexsort((key, group))
    same = (group[order[1:]] == group[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


@dataclass(frozen=True)
class Chain:
    """Weights of the CRF. ``emit``: what a feature adds to label content over boilerplate; ``move[a, b]``: from label a to b."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray


#: Used where there are no labels of both classes.
DEFAULT = Chain(np.array([2.0, -0.3, 0.3, -6, -5, -8, -5, -2, -2, -6, -1.0, -4.0]), np.array([[0.7, -0.7], [-0.7, 0.7]]), np.zeros(2))


def _time_major(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences with entries, longest first, and how many are still running at each step."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    running = np.searchsorted(-size[order], -np.arange(1, (size[order[0]] if len(order) else 0) + 1), side="right")
    return order, running


def viterbi(chain: Chain, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Best label (1 content, 0 boilerplate) of each entry; sequence i is off[i]:off[i + 1]. Ties go to content."""
    e = x @ chain.emit
    order, running = _time_major(off)
    label = np.zeros(len(x), np.int8)
    if not len(order):
        return label
    back = np.zeros((len(x), 2), np.int8)
    begin = off[order]
    best = np.zeros((len(order), 2)) + chain.begin
    best[:, 1] += e[begin]
    for t in range(1, len(running)):
        m = running[t]
        at = begin[:m] + t
        stay, come = best[:m, None, :] * 0, best[:m, :, None] + chain.move[None]
        stay = come.max(axis=1)
        back[at] = come[:, 1, :] >= come[:, 0, :]
        stay[:, 1] += e[at]
        best[:m] = stay
    end = off[order + 1] - 1
    now = (best[:, 1] >= best[:, 0]).astype(np.int8)
    label[end] = now
    for t in range(len(running) - 1, 0, -1):
        m = running[t]
        at = begin[:m] + t
        now = back[at, label[at]]
        label[at - 1] = now
    return label


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _passes(chain: Chain, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums, marginals of each entry's labels, and the emission scores."""
    order, running = _time_major(off)
    begin = off[order]
    e = np.stack([np.zeros(len(x)), x @ chain.emit], axis=1)
    fwd, bwd = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    fwd[begin] = chain.begin + e[begin]
    for t in range(1, len(running)):
        at = begin[: running[t]] + t
        fwd[at] = _log_sum(fwd[at - 1][:, :, None] + chain.move[None], 1) + e[at]
    for t in range(len(running) - 1, 0, -1):
        at = begin[: running[t]] + t
        bwd[at - 1] = _log_sum(chain.move[None] + (e[at] + bwd[at])[:, None, :], 2)
    post = fwd + bwd
    return fwd, bwd, np.exp(post - _log_sum(post, 1)[:, None]), e


def marginals(chain: Chain, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability that each entry is content."""
    return _passes(chain, x, off)[2][:, 1]


def fit(x: np.ndarray, off: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.2, ridge: float = 1e-5) -> Chain:
    """Weights of greatest conditional likelihood (Adam on the exact gradient)."""
    order, _ = _time_major(off)
    n_feat = x.shape[1]
    w = np.zeros(n_feat + 6)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    begin, total = off[order], len(x)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * total
    inner = np.ones(total, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pair = np.zeros((len(at), 2, 2))
    pair[np.arange(len(at)), label[at - 1], label[at]] = 1
    first = np.zeros((len(begin), 2))
    first[np.arange(len(begin)), label[begin]] = 1
    gold = np.zeros_like(w)
    chain = _unpacked(w, n_feat)
    for s in range(1, steps + 1):
        fwd, bwd, post, e = _passes(chain, x, off)
        both = fwd[at - 1][:, :, None] + chain.move[None] + (e[at] + bwd[at])[:, None, :]
        both = np.exp(both - _log_sum(both.reshape(len(at), 4), 1)[:, None, None])
        gold[:n_feat] = x.T @ (weight * (label - post[:, 1]))
        gold[n_feat : n_feat + 4] = (weight[at, None, None] * (pair - both)).sum(axis=0).ravel()
        gold[n_feat + 4 :] = (weight[begin, None] * (first - post[begin])).sum(axis=0)
        g = gold / total - ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w + rate * (m1 / (1 - 0.9**s)) / (np.sqrt(m2 / (1 - 0.999**s)) + 1e-8)
        chain = _unpacked(w, n_feat)
    return chain


def _unpacked(w: np.ndarray, n_feat: int) -> Chain:
    return Chain(w[:n_feat].copy(), w[n_feat : n_feat + 4].reshape(2, 2).copy(), w[n_feat + 4 :].copy())


def logistic(x: np.ndarray, label: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Probability of label 1 of each row by a logistic regression on these rows, both labels weighing the same (Newton's method)."""
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (weight * (label - p)) - ridge * len(x) * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def constrained(score: np.ndarray, words: np.ndarray, off: np.ndarray, text_label: np.ndarray) -> np.ndarray:
    """Labels of lines with content probability ``score``, such that content has half of a good text's words or more, and less than half of a bad one's.

    Where the scores alone don't give that, lines change over in the order of their scores, the earlier of equals first, until it holds.
    """
    label = (score >= 0.5).astype(np.int64)
    have = sums(words * label, off)
    every = sums(words, off)
    for i in np.flatnonzero((every > 0) & ((2 * have >= every) != (text_label == 1))):
        part = slice(off[i], off[i + 1])
        order = np.argsort(-score[part] if text_label[i] else score[part], kind="stable")
        moved = np.cumsum(words[part][order])
        need = int(np.searchsorted(2 * moved, every[i], side="left" if text_label[i] else "right")) + 1
        own = np.full(len(order), 1 - text_label[i])
        own[order[:need]] = text_label[i]
        label[part] = own
    return label


def sample(docs: DataFrame, labels: DataFrame, per_class: int, column: str = "quality", where=None) -> DataFrame:
    """(doc_id, text, label): labelled texts, ``per_class`` ids of each class at most, those of smallest hash.

    The ids are few by construction, so they are broadcast to the one scan of the texts. Of rows that repeat an id
    one counts, that of the smallest text.
    """
    labels = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    labels = labels if where is None else labels.where(where)
    ids = None
    for k in (0, 1):
        some = labels.where(F.col("label") == k).groupBy("doc_id", "label").count().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "label")
        ids = some if ids is None else ids.unionByName(some)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def learn(x: np.ndarray, off: np.ndarray, words: np.ndarray, text_label: np.ndarray) -> Chain:
    """The CRF of texts with known labels and hidden line labels; text i has lines off[i]:off[i + 1], ``words`` words each."""
    score = logistic(x, np.repeat(text_label, np.diff(off)))
    for _ in range(ROUNDS):
        label = constrained(score, words, off, text_label)
        chain = fit(x, off, label)
        score = marginals(chain, x, off)
    return chain


def train(docs: DataFrame, labels: DataFrame, per_class: int = 400) -> Chain:
    """The CRF of a bounded sample: ``per_class`` labelled texts of each quality at most."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = Lines(b.column(1))
            ids, label = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            rows = [(int(ids[i]), int(label[i]), got.x[got.off[i] : got.off[i + 1]].ravel().tolist(), got.line_words[got.off[i] : got.off[i + 1]].tolist()) for i in range(b.num_rows) if got.off[i + 1] > got.off[i]]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "label", "x", "words"])

    rows = sample(docs, labels, per_class).mapInArrow(lines, "doc_id long, label int, x array<double>, words array<long>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    if {r.label for r in rows} != {0, 1}:
        return DEFAULT
    size = np.array([len(r.words) for r in rows])
    x = np.concatenate([np.array(r.x) for r in rows]).reshape(-1, len(FEATURES))
    return learn(x, np.concatenate([[0], np.cumsum(size)]), np.concatenate([r.words for r in rows]).astype(np.int64), np.array([r.label for r in rows]))


def line_labeller(chain: Chain) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) → one row for each line with a word: doc_id, place among the text's such lines, n_words, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = Lines(b.column(1))
            label = viterbi(chain, got.x, got.off)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got.text)), pa.array(np.arange(len(label)) - got.off[got.text] if len(label) else np.zeros(0, np.int64), pa.int64()), pa.array(got.line_words, pa.int64()), pa.array(label == 1)], names=["doc_id", "line", "n_words", "content"])

    return run


def label_lines(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row for each line that has a word, in order within its text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(line_labeller(chain), "doc_id long, line long, n_words long, content boolean")


def judge(docs: DataFrame, chain: Chain, share: float = 0.5) -> DataFrame:
    """One row for each text: base counts, content share (0 without words), verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = Lines(b.column(1))
            label = viterbi(chain, got.x, got.off)
            content = sums(got.line_words * (label == 1), got.off) / np.maximum(1, got.n_words)
            kept = ~got.base_failed & (content >= share)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words)), pa.array(got.base_failed), pa.array(content), pa.array(kept)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, chain: Chain, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are.

    Decided row by row in the same pass, so repeated rows and null ids need no join.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = Lines(b.column(at))
            label = viterbi(chain, got.x, got.off)
            content = sums(got.line_words * (label == 1), got.off) / np.maximum(1, got.n_words)
            yield b.filter(pa.array(~got.base_failed & (content >= share)))

    return docs.mapInArrow(run, schema)
