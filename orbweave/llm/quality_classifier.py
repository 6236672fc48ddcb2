"""Quality classification by pairwise ranking (Bradley-Terry).

A text's worth is linear in its features. Of a pair of labelled texts with different labels
the better one wins with probability sigmoid(worth difference); the weights maximise that
likelihood, that is logistic loss on feature differences. Pairs are drawn anew in each step
from a bounded sample of labelled rows (``per_class`` of each label at most). As a ranking has
no origin, a shift and a slope fitted on the same sample turn worth into a score in (0, 1).
``select`` marks the texts at or above a quantile of the scores of all texts.

Features are shares of the whole text (kinds of characters, words, lines) and their squares;
labels, lang, source and doc_id are never among them.

Defined cases: a null or empty text has features 0 and a score like any other; without labels
of both classes every score is 0.5; a null doc_id stays null (and its ``held_out`` in the query); repeated rows are scored each on their own; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import quantiles
from .arrays import slices, sums
from .quality_rules import FEATURES, Lines, sample
from .store import written

SCHEMA = "doc_id long, score double"


def features(column: pa.Array) -> np.ndarray:
    """A row of features of each text."""
    got = Lines(column)
    n, lines = np.maximum(1, got.n_words), np.maximum(1, np.diff(got.off))
    words = np.stack([sums((got.x[:, k] * got.line_words * 1e6).astype(np.int64), got.off) / 1e6 / n for k in range(1, len(FEATURES))], axis=1)
    dense = np.stack([
        np.log1p(got.n_words) / 10, np.minimum(1, got.n_symbols / n), got.n_dup_lines / lines, got.n_repeat_words / n,
        np.minimum(1, got.word_chars / n / 20), np.minimum(1, lines / n), got.n_words == 0, got.n_words < 20,
    ], axis=1)
    x = np.concatenate([words, dense], axis=1)
    return np.concatenate([x, x * x, np.sqrt(np.maximum(0, x))], axis=1)


@dataclass(frozen=True)
class Ranker:
    """``score = sigmoid(slope * worth + shift)`` with ``worth = ((x - mean) / scale) @ weights``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worth(x) + self.shift, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, steps: int = 1500, pairs: int = 2048, rate: float = 0.03, ridge: float = 1e-4, seed: int = 11) -> Ranker:
    """Weights by Adam on batches of pairs, then slope and shift by Newton's method."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    m, v, r = np.zeros_like(w), np.zeros_like(w), np.random.default_rng(seed)
    for s in range(1, steps + 1):
        d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
        g = d.T @ (1 / (1 + np.exp(np.clip(d @ w, -500, 500)))) / pairs - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-8)
    t = z @ w
    a, b = 1.0 / max(1e-9, t.std()), 0.0
    u, mu = (t - t.mean()) * a, t.mean()
    coef, design = np.array([1.0, 0.0]), np.stack([u, np.ones_like(u)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        coef = coef + np.linalg.solve(hess, design.T @ (label - p) - 1e-2 * coef)
    slope = max(1e-6, coef[0]) * a
    b = coef[1] - slope * mu
    return Ranker(mean, scale, w, float(slope), float(b))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, where: str | None = None) -> Ranker | None:
    """A ranker from ``per_class`` labelled texts of each quality at most; ``where`` restricts the labelled ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(features(b.column(1))), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sample(docs, labels, per_class, where=where).mapInArrow(rows, "doc_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.label, r.x))
    if {r.label for r in got} != {0, 1}:
        return None
    return fit(np.array([r.x for r in got]), np.array([r.label for r in got]))


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """One row for each text: its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = ranker.score(features(b.column(1))) if ranker else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def select(docs: DataFrame, ranker: Ranker | None, quantile: float) -> DataFrame:
    """(doc_id, score, selected): each text's score, and whether it lies at or above the given quantile of all scores (exact,
    interpolated between neighbours). Equal scores are selected together; without a ranker all are."""
    scored = written(score(docs, ranker), "scores")
    edge = quantiles(scored, "score", [quantile]).first()
    edge = edge.q[0] if edge and edge.q[0] is not None else 0.0  # no texts
    return scored.withColumn("selected", F.col("score") >= edge)
