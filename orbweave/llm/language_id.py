"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes forwards and backwards and labels every position with a
distribution over languages; a text's probabilities are pooled over the positions of all its
letters (geometric mean). It is written in numpy and trained by backpropagation through time.

A text of any length is read whole, as consecutive segments of ``STEPS`` bytes. Each segment
also reads ``WARM`` bytes of its neighbours on either side, whose positions are not pooled,
so the states have context before the first pooled position. All segments of a slice advance
together, one byte a step.

Training takes a bounded sample of the rows that the caller passes as labelled: ``per_lang`` different
texts of each language at most, and of all their segments, wherever in a text they lie, ``most_segments`` at most, as many of
each language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; labels that are
null are not learned; with nothing to learn from every text is ``und``; repeated rows are
labelled each on their own and count once in training; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import Texts, slices
from .store import written

STEPS, WARM, HIDDEN = 96, 8, 8
SCHEMA = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"
_A_LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """``table``: what each byte adds to the update, reset and candidate inputs; ``gates``, ``turn``: recurrent weights."""

    table: np.ndarray
    gates: np.ndarray
    turn: np.ndarray


@dataclass
class Network:
    langs: list[str]
    forth: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.forth.table, self.forth.gates, self.forth.turn, self.back.table, self.back.gates, self.back.turn, self.out, self.bias]


def fresh(langs: list[str], seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    h = HIDDEN
    one = lambda: Direction(r.normal(0, 0.3, (256, 3 * h)).astype(np.float32), r.normal(0, h**-0.5, (h, 2 * h)).astype(np.float32), r.normal(0, h**-0.5, (h, h)).astype(np.float32))
    return Network(langs, one(), one(), r.normal(0, 0.3, (2 * h, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def states(d: Direction, steps: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states after each row of ``steps`` (time, sequence); ``trace`` gets what the gradient needs."""
    t, n = steps.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((t, n, HIDDEN), np.float32)
    for i in range(t):
        x = d.table[steps[i]]
        g = h @ d.gates
        g += x[:, : 2 * HIDDEN]
        g = _sigmoid(g)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        rh = r * h
        c = rh @ d.turn
        c += x[:, 2 * HIDDEN :]
        np.tanh(c, out=c)
        if trace is not None:
            trace.append((h, z, r, rh, c))
        h = c + z * (h - c)
        out[i] = h
    return out


def gradient(d: Direction, steps: np.ndarray, trace: list, dout: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time: gradients of table, gates and turn from those of the states."""
    gt, gg, gu = np.zeros_like(d.table), np.zeros_like(d.gates), np.zeros_like(d.turn)
    dh = np.zeros_like(dout[0])
    for i in range(len(steps) - 1, -1, -1):
        h, z, r, rh, c = trace[i]
        dh = dh + dout[i]
        da = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        drh = da @ d.turn.T
        dr = drh * h * r * (1 - r)
        dg = np.concatenate([dz, dr], axis=1)
        gu += rh.T @ da
        gg += h.T @ dg
        np.add.at(gt, steps[i], np.concatenate([dg, da], axis=1))
        dh = dh * z + drh * r + dg @ d.gates.T
    return [gt, gg, gu]


def segments(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(time, segment) bytes of all texts, 0 beyond a text's ends, and the text of each segment."""
    size = np.diff(texts.off)
    count = -(-size // STEPS)
    of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = texts.off[of] + nth * STEPS
    at = begin[None, :] + np.arange(-WARM, STEPS + WARM)[:, None]
    inside = (at >= texts.off[of]) & (at < texts.off[of + 1])
    return np.where(inside, texts.data[np.clip(at, 0, max(0, len(texts.data) - 1))] if len(texts.data) else 0, 0).astype(np.uint8), of


def is_letter(b: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of characters beyond ASCII."""
    return ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)


def position_scores(net: Network, steps: np.ndarray) -> np.ndarray:
    """Log probabilities (position, segment, language) of the pooled positions."""
    forth = states(net.forth, steps[: WARM + STEPS])[WARM:]
    back = states(net.back, steps[WARM:][::-1])[::-1][:STEPS]
    logits = forth.reshape(-1, HIDDEN) @ net.out[:HIDDEN]
    logits += back.reshape(-1, HIDDEN) @ net.out[HIDDEN:]
    logits += net.bias
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits.reshape(STEPS, steps.shape[1], -1)


def pooled(net: Network, texts: Texts, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Mean log probabilities of each text over its letters, and how many letter bytes there are."""
    steps, of = segments(texts)
    n = len(texts)
    total, letters = np.zeros((n, len(net.langs))), np.zeros(n)
    for at in range(0, len(of), block):
        part, own = steps[:, at : at + block], of[at : at + block]
        mask = is_letter(part[WARM : WARM + STEPS])
        seg = np.einsum("tsl,ts->sl", position_scores(net, part), mask.astype(np.float32), optimize=False)
        np.add.at(total, own, seg)
        np.add.at(letters, own, mask.sum(axis=0))
    return total / np.maximum(1, letters)[:, None], letters


def loss_and_gradient(net: Network, part: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross entropy of all letter positions of (time, segment) bytes, and its gradient by each array of the network."""
    tf, tb = [], []
    fs, bs = part[: WARM + STEPS], part[WARM:][::-1]
    hf, hb = states(net.forth, fs, tf), states(net.back, bs, tb)
    both = np.concatenate([hf[WARM:], hb[::-1][:STEPS]], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=2, keepdims=True)
    p /= total
    mask = is_letter(part[WARM : WARM + STEPS])
    each = mask * weight / max(1, mask.sum())
    own = np.arange(len(label))
    loss = float((each * (np.log(total[:, :, 0]) - logits[:, own, label])).sum())
    p[:, own, label] -= 1
    p *= each[:, :, None].astype(p.dtype)
    d = p @ net.out.T
    df, db = np.zeros_like(hf), np.zeros_like(hb)
    df[WARM:] = d[:, :, :HIDDEN]
    db[WARM:] = d[:, :, HIDDEN:][::-1]
    return loss, [*gradient(net.forth, fs, tf, df), *gradient(net.back, bs, tb, db), np.einsum("tsh,tsl->hl", both, p), p.sum(axis=(0, 1))]


def fit(parts: list[bytes], labels: list[str], batch: int = 256, most_steps: int = 400, rate: float = 0.01, seed: int = 7) -> Network | None:
    """A network for the labels met, from segments (as ``segments`` cuts them), by Adam on the mean cross entropy of all letter positions."""
    langs = sorted(set(labels))
    if not langs:
        return None
    net = fresh(langs, seed)
    steps = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), STEPS + 2 * WARM).T
    if len(langs) == 1:
        return net
    number = {v: i for i, v in enumerate(langs)}
    y = np.array([number[v] for v in labels])
    r = np.random.default_rng(seed)
    batch = min(batch, len(parts))
    order = np.concatenate([r.permutation(len(parts)) for _ in range(-(-most_steps * batch // len(parts)))])
    # languages weigh the same whatever their share of the sample
    weight = (1 / np.bincount(y, minlength=len(langs)).clip(1))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    params = net.arrays()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for s in range(1, most_steps + 1):
        pick = order[(s - 1) * batch : s * batch]
        _, grads = loss_and_gradient(net, steps[:, pick], y[pick], weight[pick])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        now = rate * (1 - (s - 1) / most_steps * 0.8)
        for i, (w, g) in enumerate(zip(params, grads, strict=True)):
            g = g * scale
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w -= (now * (m[i] / (1 - 0.9**s)) / (np.sqrt(v[i] / (1 - 0.999**s)) + 1e-8)).astype(np.float32)
    return net


def train(labelled: DataFrame, per_lang: int = 200, most_segments: int = 160_000) -> Network | None:
    """A network from (text, lang) rows: of each language ``per_lang`` different texts at most, those of smallest hash.

    Copies of a text count once, however many there are. Texts are cut into segments where they lie, whole; each language
    gives an equal share of ``most_segments``, those of smallest hash, so what comes to the driver (112 bytes a segment)
    grows neither with the texts' lengths nor with the number of languages.
    """
    rows = labelled.select("text", "lang").where("lang IS NOT NULL AND length(text) > 0").withColumn("h", F.xxhash64("text"))
    distinct = written(rows.select("lang", "h").distinct(), "texts")
    count = distinct.groupBy("lang").count()
    # the sample lies far below this hash, so one task sees few rows of any language
    below = (F.col("h").cast("double") + 2.0**63) * F.col("count") <= 2.0**64 * (2 * per_lang + 64)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = distinct.join(F.broadcast(count), "lang").where(below).withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "h")
    some = rows.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            steps, of = segments(Texts(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(of)), pa.array([s.tobytes() for s in np.ascontiguousarray(steps.T)], pa.binary())], names=["lang", "part"])

    parts = some.select("text", "lang").mapInArrow(cut, "lang string, part binary").withColumn("h", F.xxhash64("part"))
    share = most_segments // max(1, count.count())
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    found = sorted((r.lang, r.h, bytes(r.part)) for r in parts.withColumn("nth", nth).where(F.col("nth") <= max(1, share)).select("lang", "h", "part").collect())
    return fit([p for _, _, p in found], [k for k, _, _ in found]) if found else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row for each text: its language and the pooled probability of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = Texts(b.column(1))
            name, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if net is not None:
                mean, letters = pooled(net, texts)
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = mean.argmax(axis=1)
                ascii_ = np.add.reduceat(np.append(is_letter(texts.data) & (texts.data < 128), False), texts.off[:-1].clip(max=len(texts.data))) if len(texts.data) else np.zeros(len(texts))
                for i in np.flatnonzero(letters > 0):
                    if ascii_[i] or _A_LETTER.search(b.column(1)[int(i)].as_py()):
                        name[i], score[i] = net.langs[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
