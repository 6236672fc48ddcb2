"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are classes of texts with the same set of word n-grams, columns are 64-bit
n-gram hashes. The columns are multiplied in blocks, overlap counts are accumulated, and after each block the
count so far and the columns that the two sets have left bound the overlap from above: two sets of sizes m
and n reach the threshold only with an overlap of o(m, n) n-grams, so pairs that can't get there are discarded.

Block 1 holds each set's prefix, n - ceil(t n) + 1 columns: any pair at threshold t shares a column within
both prefixes, whichever order of columns they are taken in, so long as all sets use the same. Here columns
with more than ``COMMON`` entries among the sets' columns of smallest hash come last, the others go by hash.
Where a set's columns of smallest hash don't make up for the common ones passed over, its prefix is taken from
all of its columns; a set that has too few others even so is compared by all its columns, as below. Only columns
that come up in more than ``COMMON`` of these later prefixes can still be long. The product of block 1 is a join of its entries by column, the counts are sums of its terms, and the places of the
shared columns and the ends of the prefixes tell how many columns are left. The remaining blocks are ``BLOCKS``
ranges of hashes: the surviving pairs' sets are read again and multiplied range by range, one row with all of
its partners at a time; the sums over all ranges are the overlaps.

No long column's entries are multiplied pair by pair. Columns of up to twice ``COMMON`` entries compare all
of them. Classes of longer ones, or without a prefix of other columns, are mostly members of large families;
they are taken again by all their columns, in order of rarity among themselves, which makes the prefix exact and tells how many columns
are a class's own. A pair comes up only in columns that may be the first it shares: there the places in
both orders bound the overlap from above, so members of a family with many columns of their own drop
out by size alone. In the first round over these prefixes each column pairs its entries with one of
them, its leader, that of fewest own columns; linked classes form components. In later rounds entries
outside a column's largest component, ``LEADERS`` at a time, meet the entries of other components, until every pair was
compared, bounded out or connected. A group of near copies thus takes about one comparison for each member.

Defined cases: null, empty or wordless texts have no n-grams and are linked with nothing (each row
its own component); a text of fewer words than n has its whole sequence as its one n-gram; repeated
rows and equal sets are linked (J = 1); null ids count as the smallest long and come out as null
unless their component holds no other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import LOWER, Texts, Words, gram_hashes, mix, slices, sums, whole
from .components import components
from .store import release, spare, written

NONE = -(1 << 63)
SPARE, COMMON, LEADERS, BLOCKS = 12, 8, 512, 4
BITS = 1 << 26  #: size of the bitmap of wanted texts, 8 MB; fuller bitmaps let more other texts through, which costs time only


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one text after the other, and where each text's begin."""
    words = Words(Texts(column), LOWER)
    h = words.hashes()
    grams = gram_hashes(h, k)
    at = np.flatnonzero(whole(words.off, k, len(grams)))
    text = np.searchsorted(words.off, at, side="right") - 1
    grams = grams[at]
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence, never equal to a full n-gram
        own = np.repeat(np.arange(len(short)), n[short])
        at = np.concatenate([np.arange(words.off[i], words.off[i + 1]) for i in short])
        place = at - words.off[short][own]
        seq = sums(mix(h[at] + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), np.concatenate([[0], np.cumsum(n[short])])).view(np.uint64)
        text, grams = np.concatenate([text, short]), np.concatenate([grams, mix(seq ^ np.uint64(0x5851F42D4C957F2D))])
    grams = grams.view(np.int64)
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    text, grams = text[keep], grams[keep]
    return grams, np.searchsorted(text, np.arange(len(words.off)))


def _class_ids(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    n = np.diff(off)
    place = np.arange(len(grams)) - np.repeat(off[:-1], n)
    x = mix(grams.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    y = sums(x, off).view(np.uint64) ^ mix(n.astype(np.uint64) + np.uint64(77))
    return mix(y).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(NONE).cast("long")).alias("did"), F.xxhash64("text").alias("tid"))


def prefix(n, percent: int):
    """The number of columns, first in any order, of which two sets at the threshold share one."""
    return n - F.ceil(F.lit(percent) * n / 100).cast("int") + 1


def incidence(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, cid, did, tid, low) of every row, written: its set's size and id, and its columns of smallest hash; cid is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            grams, off = sets(b.column(1), k)
            n, cid = np.diff(off), _class_ids(grams, off)
            first = n * (100 - percent) // 100 + 1
            size = np.minimum(n, first + first // 8 + SPARE)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(off[:-1], size)
            low = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(grams[at], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(cid, pa.int64(), mask=n == 0), b.column(2), b.column(3), low], names=["doc_id", "n", "cid", "did", "tid", "low"])

    return written(_rows(docs).mapInArrow(run, "doc_id long, n int, cid long, did long, tid long, low array<long>"), "incidence")


def classes(rows: DataFrame) -> DataFrame:
    """(cid, n, did, tid, low): each class of equal non-empty sets, one of its rows, its columns of smallest hash."""
    one = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.max("n").alias("n"), F.min(F.struct("did", "tid", "low")).alias("x"))
    return one.select("cid", "n", "x.did", "x.tid", "x.low")


def _columns(texts: DataFrame, k: int) -> DataFrame:
    """(cid, n, s) of all columns of (cid, text), a text for each cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 19):
            grams, off = sets(b.column(1), k)
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n), pa.int32()), pa.array(grams, pa.int64())], names=["cid", "n", "s"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, n int, s long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the classes (cid, did, tid): one text each, also where rows repeat.

    A bitmap of text hashes, broadcast, keeps most texts that aren't wanted out of the exchange.
    """
    wanted = written(wanted, "wanted")
    h = F.pmod("tid", F.lit(BITS))
    bits = wanted.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    rows = _rows(docs).select("did", "tid", "text", F.bitmap_bucket_number(h).alias("bucket"), F.bitmap_bit_position(h).alias("bit"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 + 1 AS int), 1)), 16, 10) AS int)")
    rows = rows.join(F.broadcast(written(bits, "bits")), "bucket").where(F.call_function("shiftright", byte, F.expr("cast(bit % 8 AS int)")).bitwiseAND(F.lit(1)) == 1)
    rows = rows.select("did", "tid", "text").join(wanted, ["did", "tid"])
    return rows.groupBy("did", "tid").agg(F.first("cid").alias("cid"), F.first("text").alias("text")).select("cid", "text")


def prefixes(docs: DataFrame, found: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(cid, n, others, late, whole): each class's prefix in order, whether it was taken from all columns, whether it is a whole one; (s) of long columns.

    The order has no column with more than ``COMMON`` entries in the sets' columns of smallest hash.
    """
    low = found.select("cid", F.explode("low").alias("s"))
    common = written(low.groupBy("s").count().where(F.col("count") > COMMON).select("s"), "common")  # as a table, so that a hot column's side can be split
    own = written(low.join(common, "s", "left_semi").groupBy("cid").agg(F.collect_list("s").alias("common")), "own")
    first = prefix(F.col("n"), percent)
    left = found.select("cid", "n", "did", "tid", F.size("low").alias("left")).join(own.select("cid", F.size("common").alias("gone")), "cid")
    few = written(left.where(F.col("left") - F.col("gone") < first).select("cid", "n", "did", "tid"), "few")
    every = _columns(_texts(docs, few.select("cid", "did", "tid")), k).join(common, "s", "left_anti")
    every = every.groupBy("cid").agg(F.sort_array(F.collect_list("s")).alias("others"))
    every = few.select("cid", "n").join(every, "cid", "left").select("cid", "n", F.coalesce("others", F.array().cast("array<long>")).alias("others"))
    others = found.select("cid", "n", "low").join(own, "cid", "left").select("cid", "n", F.coalesce(F.array_except("low", "common"), "low").alias("others"))
    chosen = others.where(F.size("others") >= first).withColumn("late", F.lit(False)).unionByName(every.withColumn("late", F.lit(True)))
    chosen = written(chosen.select("cid", "n", F.slice("others", F.lit(1), first).alias("others"), "late", (F.size("others") >= first).alias("whole")), "prefixes")
    # other prefixes hold a column COMMON times at most
    long = chosen.where("late").select(F.explode("others").alias("s")).groupBy("s").count().where(F.col("count") > COMMON).select("s")
    return chosen, written(long, "long")


def needed(m, n, percent: int):
    """The least overlap of sets of sizes m and n at the threshold: 100 i >= percent (m + n - i)."""
    return F.ceil(F.lit(percent) * (m + n) / (100 + percent))


def product(chosen: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b, c, ra, rb), a > b: how many columns of block 1 two classes share, and the places of the last of them in their orders.

    Rows without b count a class's long columns, which are passed over. All terms come from one exchange of the entries.
    """
    rows = chosen.select("cid", F.posexplode("others").alias("r", "s")).select("s", "cid", (F.col("r") + 1).alias("r"))
    short = rows.join(long, "s", "left_anti")
    both = short.select("s", F.col("cid").alias("a"), F.col("r").alias("ra")).join(short.select("s", F.col("cid").alias("b"), F.col("r").alias("rb")), "s").where("a > b")
    terms = both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("c"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    none = F.lit(None)
    over = rows.join(long, "s", "left_semi").groupBy(F.col("cid").alias("a")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    return terms.unionByName(over.select("a", none.cast("long").alias("b"), "c", none.cast("int").alias("ra"), none.cast("int").alias("rb")))


def bounded(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of the products (a, b, c, ra, rb), the pairs that the overlap within block 1 doesn't rule out.

    The set whose prefix ends first has n - p columns after that end, the other one n - r at most, r being the
    place of the last shared column. Shared columns of block 1 that were passed over as too long (skip) are taken as shared.
    """
    side = lambda x: sizes.select(F.col("cid").alias(x), *[F.col(c).alias(c + x) for c in ("n", "p", "last", "skip")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    left = lambda x, y: F.col(f"n{x}") - F.when(F.col(f"last{x}") <= F.col(f"last{y}"), F.col(f"p{x}")).otherwise(F.col(f"r{x}"))
    most = F.col("c") + F.least("skipa", "skipb") + F.least(left("a", "b"), left("b", "a"))
    return both.where(F.least(most, "na", "nb") >= needed(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _overlaps(k: int, percent: int):
    """Rows (a, salt, who, text) sorted by a, salt, its own row first → the pairs at the threshold (the remaining blocks)."""
    edges = np.array([(i << 64) // BLOCKS - (1 << 63) for i in range(1, BLOCKS)], np.int64)

    def row_times_partners(own: np.ndarray, part: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which sets part[off[i]:off[i + 1]] reach the threshold with ``own``: overlaps are summed block by block."""
        n, m = np.diff(off), len(own)
        cuts = np.concatenate([[0], np.searchsorted(own, edges), [m]])
        block = np.searchsorted(edges, part, side="right")
        overlap, met, alive = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), n > 0
        for i in range(BLOCKS):
            mine = own[cuts[i] : cuts[i + 1]]
            of = block == i
            met += sums(of, off)
            if len(mine):
                at = np.flatnonzero(of & np.repeat(alive, n))
                hit = np.zeros(len(part), bool)
                hit[at] = mine[np.minimum(np.searchsorted(mine, part[at]), len(mine) - 1)] == part[at]
                overlap += sums(hit, off)
            most = overlap + np.minimum(m - cuts[i + 1], n - met)
            alive &= 100 * most >= percent * (m + n - most)
            if not alive.any():
                break
        return alive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, np.int64)
        for b in slices(batches):
            grams, off = sets(b.column(3), k)
            a, who = b.column(0).to_numpy(), b.column(2).to_numpy()
            out_a, out_b = [], []
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for i, j in zip(starts, np.append(starts[1:], len(a)), strict=True):
                if lead != a[i]:
                    lead, own = a[i], grams[off[i] : off[i + 1]]
                ok = row_times_partners(own, grams[off[i] : off[j]], off[i : j + 1] - off[i]) & (who[i:j] != lead)
                out_a.append(np.full(ok.sum(), lead))
                out_b.append(who[i:j][ok])
            z = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a + z), pa.int64()), pa.array(np.concatenate(out_b + z), pa.int64())], names=["a", "b"])

    return run


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int, part: int = 1000) -> DataFrame:
    """Of pairs (a, b), those whose sets reach the threshold. Each a's text goes once to each part of its partners."""
    asked = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(1 << 30)).alias("h"), F.col("b").alias("who"))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    asked = asked.join(many, "a").select("a", F.pmod("h", "parts").cast("int").alias("salt"), "who")
    leads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("a").alias("who"))
    rows = asked.unionByName(leads).join(texts.withColumnRenamed("cid", "who"), "who").select("a", "salt", "who", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("who") != F.col("a"))
    return rows.mapInArrow(_overlaps(k, percent), "a long, b long").distinct()


def by_rarity(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(s, cid, n, u, r): each class's exact prefix when columns go from the rarest to the commonest among these classes.

    r is the column's place in the class's order, u the number of columns that no other of the classes has.
    """
    rows = _columns(texts, k)
    shared = written(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "columns")
    of = rows.join(shared, "s").groupBy("cid").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))  # columns of its own need not be sent
    of = of.withColumn("u", F.col("n") - F.size("x"))
    of = of.select("cid", "n", "u", F.posexplode(F.slice("x", F.lit(1), F.greatest(F.lit(0), prefix(F.col("n"), percent) - F.col("u")).cast("int"))).alias("r", "x"))
    return of.select("x.s", "cid", "n", "u", (F.col("r") + F.col("u") + 1).alias("r"))


def _meeting(left: DataFrame, right: DataFrame, percent: int, also=None) -> DataFrame:
    """Pairs (a > b) of entries x and y (s, x, nx, rx; y likewise) of one column, where it may be the first that a linked pair shares.

    Of sets of sizes m and n that share no earlier column at most the rest can overlap, so the column's place is
    m - o(m, n) + 1 at most in the one and n - o(m, n) + 1 in the other.
    """
    nx, ny = F.col("nx"), F.col("ny")
    o = needed(nx, ny, percent)
    ok = (F.col("x") != F.col("y")) & (F.col("rx") <= nx - o + 1) & (F.col("ry") <= ny - o + 1)
    both = left.alias("l").join(right.alias("r"), (F.col("l.s") == F.col("r.s")) & (ok if also is None else ok & also))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _side(entries_: DataFrame, x: str, *more: str) -> DataFrame:
    return entries_.select("s", F.col("cid").alias(x), *[F.col(c).alias(c + x) for c in ("n", "r", *more)])


def component_of_classes(docs: DataFrame, found: DataFrame, names: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, comp) of the classes in any link. ``found``, the classes of ``docs``, is deleted once the prefixes are written; ``names`` has their (cid, did, tid)."""
    chosen, long = prefixes(docs, found, k, percent)
    release(found)
    block = written(product(chosen, long), "block")
    over = block.where("b IS NULL").select(F.col("a").alias("cid"), F.col("c").alias("skip"))
    last = F.when(F.col("whole"), F.element_at("others", -1)).otherwise(F.lit((1 << 63) - 1))
    sizes = chosen.select("cid", "n", F.size("others").alias("p"), last.alias("last"), "whole").join(over, "cid", "left").withColumn("skip", F.coalesce("skip", F.lit(0)))
    sizes = written(sizes, "sizes")
    pairs = written(bounded(block.where("b IS NOT NULL"), sizes, percent), "pairs")
    release(chosen, block)
    long = written(sizes.where("skip > 0 OR NOT whole").select("cid"), "long")
    needs = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(long).distinct()
    texts = written(_texts(docs, names.join(needs, "cid")), "texts")
    links = written(linked(pairs, texts, k, percent), "links")

    ent = written(by_rarity(texts.join(long, "cid", "left_semi"), k, percent), "entries")
    first = written(ent.groupBy("s").agg(F.min(F.struct("u", "n", "cid", "r")).alias("z"), F.count(F.lit(1)).alias("m")).where("m > 1").select("s", "z.*"), "leaders")
    led = first.select("s", F.col("cid").alias("x"))
    pairs = written(_meeting(_side(first, "x"), _side(ent, "y"), percent), "pairs")
    compared = pairs
    links = links.unionByName(written(linked(pairs, texts, k, percent), "links"))
    comp = held = None
    while True:
        if comp is None:  # new links
            comp = components(links)
            rows = ent.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
            size = rows.groupBy("s", "comp").count()
            top = size.groupBy("s").agg(F.max(F.struct("count", "comp")).alias("z"), F.count(F.lit(1)).alias("c")).where("c > 1").select("s", F.col("z.comp").alias("top"))
            held = written(rows.join(written(top, "mixed"), "s"), "mixed")
        small = _side(held.where("comp <> top"), "x", "u", "comp").join(led, ["s", "x"], "left_anti")
        place = F.row_number().over(Window.partitionBy("s").orderBy("ux", "x"))
        lead = written(small.withColumn("place", place).where(F.col("place") <= LEADERS), "leaders")
        if lead.isEmpty():
            return comp
        led = led.unionByName(lead.select("s", "x"))
        pairs = _meeting(lead, _side(held, "y", "comp"), percent, F.col("compx") != F.col("compy"))
        pairs = written(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = compared.unionByName(pairs)
        more = written(linked(pairs, texts, k, percent), "links")
        if not more.isEmpty():
            links, comp = links.unionByName(more), None


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of every row, and (cid, did, tid, comp) of every class."""
    rows = incidence(docs, k, percent)
    found = written(classes(rows), "classes")
    members, names = written(rows.select("doc_id", "n", "cid"), "members"), written(found.select("cid", "did", "tid"), "names")
    release(rows)
    comp = component_of_classes(docs, found, names, k, percent).withColumnRenamed("id", "cid")
    return members, names.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id of its component)."""
    rows, ids = _grouped(docs, k, percent)
    least = ids.groupBy("comp").agg(F.min("did").alias("least"))
    named = ids.join(least, "comp").select("cid", "least")
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cid").join(named, "cid", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("least"), F.lit(NONE))).alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the rows of its smallest doc_id, all columns.

    Rows without n-grams stay. Of several rows with that id one stays, that of smallest text hash.
    """
    _, ids = _grouped(docs, k, percent)
    d, t, empty, kd, kt = spare(docs.columns, "_d", "_t", "_empty", "_kd", "_kt")
    kept = ids.groupBy("comp").agg(F.min(F.struct("did", "tid")).alias("x")).select(F.col("x.did").alias(kd), F.col("x.tid").alias(kt))
    did, tid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({d: did, t: tid, empty: ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    wordless = rows.where(F.col(empty))
    full = rows.where(~F.col(empty)).join(kept, (F.col(d) == F.col(kd)) & (F.col(t) == F.col(kt)), "left_semi")
    # only where ids and texts repeat together do whole rows need a second look
    twice = full.groupBy(d, t).count().where("count > 1").limit(1).count()
    full = full.dropDuplicates([d, t]) if twice else full
    return full.unionByName(wordless).select(*docs.columns)
