"""Removal of word sequences that repeat anywhere in the corpus, found by FM-indexes over shards.

A window is ``window`` consecutive words of one text; a word goes if any window over it has the
same words as a window that starts elsewhere, in the same text or another.

Sharding by content. In each window the 8-word gram of smallest hash is its anchor, so equal
windows have equal anchors. Neighbouring windows with the same anchor place form a segment (at
most 62 words for windows of 35). All occurrences of a window lie in segments of one anchor key;
segments are counted by key, keys met once are done with, equal segments are merged with their
number before anything larger is shuffled, and only segments that differ from others of their
key are fetched and sent, by key, to a shard. A shard holds segments of whole keys up to a
bounded number of words; a key with very many different segments is split over several shards
and the windows that its parts have in common are matched by their hashes afterwards.

Each shard's FM-index (wavelet matrix with packed ranks) takes the segments as a stream of
queries: backward search gives matching statistics at chosen ends, a match of ``window`` words
or more that occurs twice marks its windows, and halving covers the rest of the segment.

Defined cases: a null or empty text has no words and nothing to remove; repeated rows (same id
or not) are occurrences of their own, so their windows repeat; texts shorter than the window
keep all words; a text may have any number of words (a task holds about 100 bytes for each word of its longest text); an
empty table gives an empty result; other columns of the input are ignored. Segments are fetched from one of the
rows of the same id and text, so such rows add to the numbers of their segments and to nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import PLAIN, Texts, Words, covered, gram_hashes, mix, slices, sums, whole
from .fm_index import FMIndex
from .store import spare, written

WINDOW, GRAM = 35, 8
NONE = -(1 << 63)  #: stands for a null id
SHARD_WORDS = 400_000
PART = 512  #: different segments of one key that go to one part
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BITS = 26  #: of a gram's hash that give way to its place while the smallest is sought


def _lowest(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the gram of smallest hash (the first of equal ones) among each ``span`` in a row, worked out in blocks of 2**26 places."""
    low_bits = np.uint64((1 << _BITS) - 1)
    out = np.zeros(len(grams) - span + 1, np.int64)
    block = (1 << _BITS) - span
    for at in range(0, len(out), block):
        part = grams[at : at + block + span - 1]
        low = (part & ~low_bits) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        out[at : at + len(low)] = (low & low_bits).astype(np.int64) + at
    return out


def anchors(words: Words, h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Segments of all texts: anchor key, hash of the segment's words, text, first window (word number), number of windows."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    grams = gram_hashes(h, GRAM)
    place = _lowest(grams, window - GRAM + 1)
    ok = whole(words.off, window, n - window + 1)
    fresh = ok.copy()
    fresh[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    run = np.cumsum(fresh)[ok]
    count = np.bincount(run, minlength=len(first) + 1)[1:] if len(first) else none
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R, np.uint64)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R_INV, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:n])])
        end = first + count + window - 1
        seg = mix((total[end] - total[first]) * back[first] + count.astype(np.uint64) * np.uint64(_R))
    text = np.searchsorted(words.off, first, side="right") - 1
    return grams[place[first]].view(np.int64), seg.view(np.int64), text, first, count


def _identified(docs: DataFrame) -> DataFrame:
    """text and what tells it from any other: the row's id (null: the least long) and a hash of the text."""
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("did")).withColumn("tid", F.xxhash64("text"))


def segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, seg, did, tid, w0, nw): one row for each segment of each text; w0 counts words within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(Texts(b.column(0)), PLAIN)
            key, seg, text, first, count = anchors(words, words.hashes(), window)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), b.column(1).take(row), b.column(2).take(row), pa.array(first - words.off[text], pa.int32()), pa.array(count, pa.int32())], names=["key", "seg", "did", "tid", "w0", "nw"])

    return _identified(docs).select("text", "did", "tid").mapInArrow(run, "key long, seg long, did long, tid long, w0 int, nw int")


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bit w of entry i: window w of the segment that begins at begin[i] occurs twice or more in the shard."""
    mask = np.zeros(len(begin), np.int64)
    seg, a, b = np.arange(len(begin)), np.zeros(len(begin), np.int64), count.astype(np.int64)
    while len(seg):
        mid = (a + b) >> 1
        end = begin[seg] + mid + window
        length = index.statistics(text, begin[seg] + a, end, least=2)
        left = mid + window - length  # the first window whose words up to here are all in the match
        long = length >= window
        # a match of the window or more: windows left..mid repeat
        bits = (np.int64(1) << (mid + 1)) - (np.int64(1) << np.minimum(left, mid + 1))
        np.bitwise_or.at(mask, seg[long], bits[long])
        # a shorter one: no window that holds it and the word before it repeats, that is mid..left - 1
        lo_b = np.where(long, np.minimum(left, mid + 1), mid)
        hi_a = np.where(long, mid + 1, np.minimum(np.maximum(left, mid + 1), b))
        seg, a, b = np.concatenate([seg, seg]), np.concatenate([a, hi_a]), np.concatenate([lo_b, b])
        go = a < b
        seg, a, b = seg[go], a[go], b[go]
    return mask


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole (key, part) groups, about ``SHARD_WORDS`` words at a time; rows come sorted, and of equal (key, seg) one is held."""
    held: list[pa.RecordBatch] = []
    size = 0
    last = None

    def fresh(b: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal last
        key, seg = b.column(0).to_numpy(), b.column(3).to_numpy()
        new = np.append((key[0], seg[0]) != last, (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]))
        last = (key[-1], seg[-1])
        return b if new.all() else b.filter(pa.array(new))

    def last_group(b: pa.RecordBatch) -> int:
        key, part = b.column(0).to_numpy(), b.column(1).to_numpy()
        other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        return int(other[-1]) + 1 if len(other) else 0

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            b = batch.slice(at, 1000)
            at += b.num_rows
            b = fresh(b)
            held.append(b)
            size += len(b.column(5).flatten()) if b.num_rows else 0
            if size >= SHARD_WORDS:
                every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = last_group(every)
                if cut:
                    yield every.slice(0, cut)
                held = [every.slice(cut)]
                size = len(held[0].column(5).flatten())
    if held:
        yield from (t for t in pa.Table.from_batches(held).combine_chunks().to_batches() if t.num_rows)


def _search(window: int):
    """(key, part, parts, seg, c, words) → (key, seg, mask) and, for split keys, each part's windows (kind 1) and open windows (kind 2)."""
    names = ["kind", "key", "seg", "mask", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shards(batches):
            key, seg = b.column(0).to_numpy(), b.column(3).to_numpy()
            words = b.column(5)
            size = np.diff(words.offsets.to_numpy())
            h = words.flatten().to_numpy().view(np.uint64)
            symbol = np.unique(h, return_inverse=True)[1] + 1
            # pieces one after the other with a 0 between
            begin = np.cumsum(size + 1) - size - 1
            text = np.zeros(int(size.sum() + len(size)), np.int64)
            at = np.arange(len(h)) + np.repeat(np.arange(len(size)), size)
            text[at] = symbol
            weight = np.ones(len(text), np.int64)
            weight[at] = np.repeat(b.column(4).to_numpy(), size)
            index = FMIndex(text, 2 * window - GRAM, weight)
            count = size - window + 1
            mask = repeated_windows(index, text, begin, count, window)
            key, seg, split = b.column(0), b.column(3), np.flatnonzero(b.column(2).to_numpy() > 1)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), key, seg, pa.array(mask), seg], names=names)
            if not len(split):
                continue
            off = np.concatenate([[0], np.cumsum(size)])
            hashes = np.append(gram_hashes(h, window), np.zeros(window, np.uint64)).view(np.int64)
            owner = np.repeat(split, count[split])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
            own = hashes[off[owner] + nth]
            part = b.column(1).to_numpy()[owner].astype(np.int64)
            k = key.to_numpy()[owner]
            one = np.unique(np.stack([k, part, own], axis=1), axis=0)
            z = np.zeros(len(one), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(one), np.int8)), pa.array(one[:, 0]), pa.array(z), pa.array(z), pa.array(one[:, 2])], names=names)
            open_ = (mask[owner] >> nth & 1) == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(open_.sum(), 2, np.int8)), pa.array(k[open_]), pa.array(seg.to_numpy()[owner[open_]]), pa.array(np.int64(1) << nth[open_]), pa.array(own[open_])], names=names)

    return run


def _fetch(window: int):
    """(text, did, tid, x) → the words of the segments x; of rows of one id and text the first of the task gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in slices(batches):
            b = b.filter(b.column(3).is_valid())
            new = []
            for pair in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                new.append(pair not in done)
                done.add(pair)
            b = b.filter(pa.array(new, pa.bool_()))
            if not b.num_rows:
                continue
            words = Words(Texts(b.column(0)), PLAIN)
            h = words.hashes().view(np.int64)
            x = b.column(3)
            row = np.repeat(np.arange(b.num_rows), np.diff(x.offsets.to_numpy()))
            x = x.flatten()
            w0, nw = x.field("w0").to_numpy(), x.field("nw").to_numpy()
            size = nw.astype(np.int64) + window - 1
            off = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(words.off[row] + w0, size)
            yield pa.RecordBatch.from_arrays([*(x.field(k) for k in ("key", "part", "parts", "seg", "c")), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h[at]))], names=["key", "part", "parts", "seg", "c", "words"])

    return run


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(did, tid, x) of the texts with repeated windows; x: segments (w0, nw, mask), bit w of mask being window w0 + w."""
    if not GRAM <= window <= 60:
        raise ValueError(f"a window has {GRAM} to 60 words")
    every = segments(docs, window)
    # as a table of its own, so that a hot key's segments can be split over tasks
    shared = written(every.groupBy("key").count().where("count > 1").select("key"), "keys")
    rows = written(every.join(shared, "key"), "segments")
    place = F.struct("did", "tid", "w0", "nw")
    distinct = rows.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("p"))
    split = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART)
    split = written(split.select("key", F.ceil(F.col("m") / PART).cast("int").alias("parts")), "parts")
    parts = F.coalesce("parts", F.lit(1))
    x = F.struct("key", "seg", parts.alias("parts"), F.pmod("seg", parts).cast("int").alias("part"), F.least("c", F.lit(2)).cast("int").alias("c"), F.col("p.w0").alias("w0"), F.col("p.nw").alias("nw"))
    wanted = distinct.join(split, "key", "left").select(F.col("p.did").alias("did"), F.col("p.tid").alias("tid"), x.alias("x"))
    by_text = wanted.groupBy("did", "tid").agg(F.collect_list("x").alias("x"))
    texts = _identified(docs)

    # both uses of the texts are left joins on the same columns, so the plan shuffles them once
    pieces = texts.join(by_text, ["did", "tid"], "left").select("text", "did", "tid", "x").mapInArrow(_fetch(window), "key long, part int, parts int, seg long, c int, words array<long>")
    found = pieces.repartition("key", "part").sortWithinPartitions("key", "part", "seg").mapInArrow(_search(window), "kind byte, key long, seg long, mask long, hash long")
    # windows that two parts of a split key have; a part gives each of its windows once, so the groups are small
    parts_with = F.sum((F.col("kind") == 1).cast("int")).over(Window.partitionBy("key", "hash"))
    met = found.withColumn("n", parts_with).where("kind = 0 OR kind = 2 AND n > 1")
    masks = met.groupBy("key", "seg").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    # dealt anew, so that the join has an exchange of its own on either side and a hot segment's rows can be split
    masks = masks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.join(masks, ["key", "seg"]).groupBy("did", "tid").agg(F.collect_set(F.struct("w0", "nw", "mask")).alias("x"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row's doc_id and text (null: empty), and its repeated windows x (null: none)."""
    return _identified(docs).join(spans(docs, window), ["did", "tid"], "left").select(F.nullif(F.col("did"), F.lit(NONE)).alias("doc_id"), "text", "x")


def _removed(words: Words, x: pa.ListArray, window: int) -> np.ndarray:
    """Which words are covered by a repeated window."""
    row = np.repeat(np.arange(len(x)), np.where(x.is_valid().to_numpy(zero_copy_only=False), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0))
    x = x.flatten()
    w0, nw, mask = (x.field(k).to_numpy() for k in ("w0", "nw", "mask"))
    start = [words.off[row[ok]] + w0[ok] + w for w in range(int(nw.max(initial=0))) for ok in [(nw > w) & (mask >> w & 1 == 1)]]
    return covered(np.concatenate(start).astype(np.int64) if start else np.zeros(0, np.int64), window, len(words))


def digests(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and SHA-256 of the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(Texts(b.column(1)), PLAIN)
            gone = _removed(words, b.column(2), window)
            kept = np.flatnonzero(~gone)
            start, size = words.start[kept], words.end[kept] - words.start[kept] + 1
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            data = words.data[at]
            data[np.cumsum(size) - 1] = 32
            stop = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(kept, words.off)]
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[i : max(i, j - 1)]).hexdigest() for i, j in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts(), pa.int64()), pa.array(sums(gone, words.off), pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _without(text: pa.Array, x: pa.Array, window: int) -> pa.Array:
    """Texts without their repeated words and the white space after each."""
    texts = Texts(text)
    words = Words(texts, PLAIN)
    gone = np.flatnonzero(_removed(words, x, window))
    after = np.append(words.start, len(texts.data))[gone + 1]
    own = np.searchsorted(words.off, gone, side="right") - 1
    cut = np.zeros(len(texts.data) + 1, np.int32)
    np.add.at(cut, words.start[gone], 1)
    np.add.at(cut, np.minimum(after, texts.off[own + 1]), -1)
    keep = np.cumsum(cut[:-1]) == 0
    off = np.concatenate([[0], np.cumsum(keep)])[texts.off].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off.tobytes()), pa.py_buffer(texts.data[keep].tobytes())).cast(pa.string())


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words taken out of ``text`` (and ``n_chars``, if there, brought up to date).

    A text that had words and has none left goes; all other columns are as they are.
    """
    d, t, x = spare(docs.columns, "_did", "_tid", "_x")
    found = spans(docs, window).select(F.col("did").alias(d), F.col("tid").alias(t), F.col("x").alias(x))
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans_ = b.column(len(names))
            columns = [b.column(i) for i in range(len(names))]
            if spans_.null_count < b.num_rows:
                new = _without(columns[at], spans_, window)
                columns[at] = pc.if_else(spans_.is_valid(), new, columns[at])
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pc.if_else(spans_.is_valid(), pc.utf8_length(new).cast(columns[k].type), columns[k])
                left = np.diff(Words(Texts(new), PLAIN).off) > 0
                columns = [c.filter(pa.array(left | ~spans_.is_valid().to_numpy(zero_copy_only=False))) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.join(found, [d, t], "left").select(*names, x).mapInArrow(run, docs.schema)
