"""Texts of an Arrow batch as flat numpy arrays: words, word hashes, n-gram hashes.

Words are located on the UTF-8 bytes of a whole slice of texts at once. Separators are
ASCII bytes, so no multi-byte character is ever cut. A word's 64-bit hash depends on its
bytes alone and is the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)
_KEEP = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=np.uint64)


def _table(separators: bytes, lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 32
    return t


SPACES = bytes([0x20, *range(0x09, 0x0E)])
PLAIN = _table(SPACES, False)  #: words [^\x20\x09-\x0D]+ as they are
LOWER = _table(SPACES, True)  #: the same, A-Z lower-cased
ALNUM = _table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S33
    return x


class Texts:
    """The bytes of some texts one after the other; text i is ``data[off[i]:off[i + 1]]``."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, values = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        base, end = (int(off[0]), int(off[-1])) if len(column) else (0, 0)
        self.off = off - base
        self.data = np.frombuffer(values, dtype=np.uint8)[base:end] if values is not None else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.off) - 1


class Words:
    """Words of ``texts``: byte ranges ``start``/``end`` in the translated ``data``; text i has words ``off[i]:off[i + 1]``."""

    def __init__(self, texts: Texts, table: np.ndarray):
        n = len(texts.data)
        self.data = np.zeros(n + 8, dtype=np.uint8)
        np.take(table, texts.data, out=self.data[:n])
        inside = self.data[:n] != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = texts.off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]  # a text's end also ends a word
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, texts.off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ``data`` has 8 spare bytes at its end."""
    size = end - start
    eight = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = size.astype(np.uint64) * _M3
    long = np.flatnonzero(size > 64)
    todo, at = np.flatnonzero(size <= 64), 0
    while len(todo):
        left = size[todo] - at
        chunk = eight[start[todo] + at] & _KEEP[np.minimum(left, 8)]
        h[todo] = mix(h[todo] ^ chunk) + _M3
        todo, at = todo[left > 8], at + 8
    for i in long:
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries; entry j is that of h[j:j + k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, c = np.zeros(n, np.uint64), np.uint64(k)
    for i in range(k):
        c = np.uint64((int(c) * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF) | np.uint64(1)
        out += h[i : i + n] * c
    return mix(out)


def whole(off: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n starts have their k entries inside one text."""
    ok = np.zeros(max(0, n), bool)
    if n > 0:
        last = np.repeat(off[1:], np.diff(off))[:n]
        ok = np.arange(n) + k <= last
    return ok


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in a range [s, s + k) of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:n]) > 0


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each range off[i]:off[i + 1]; empty ranges give 0."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = Texts(batch.column(batch.schema.get_field_index(column))).off
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
