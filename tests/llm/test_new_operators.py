"""Sharding, filter audit and ranked search against brute force, and on awkward tables."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import filter_audit, ranked_search, sharding

SCHEMA = "doc_id long, text string, source string, row string, shard long, n int, part int, mask int, item_id string"


def rows(spark, docs):
    """(doc_id, text, source) with columns whose names clash."""
    return spark.createDataFrame([(*d, "r", 7, 1, 2, 3, "i") for d in docs], SCHEMA).repartition(3)


WORDS = "Alpha beta GAMMA delta épsilon 日本 x1 x2 x3 the of a".split()


@pytest.fixture(scope="module")
def documents():
    r = random.Random(5)
    out = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 90))) + r.choice(["", " #", " |\n", "  "]), f"s{i % 3}") for i in range(60)]
    out += [(i + 100, out[i % 7][1], "hot") for i in range(40)]
    out += [(None, out[0][1], None), (None, None, "s1"), (None, None, "s1"), (500, None, ""), (501, "", "s0"), (502, " \t\n", "s0"), (3, out[3][1], "s2"), (3, "other words", "s2"), (3, "other words", "s2"), (600, "CAPITALS " * 80, "s1"), (-5, out[1][1], "s1"), (700, " ".join(f"w{i}" for i in range(20_000)), "s1")]
    return out


# sharding


def plain_place(x, n, seed):
    """The network written with whole numbers, and the walk as a loop."""
    a, b = sharding.halves(n)
    while True:
        half, size = [x // b, x % b], [a, b]
        for i, (c1, m1, c2, m2) in enumerate(sharding.round_keys(seed)):
            own = i % 2
            half[own] = (half[own] + ((half[1 - own] + c1) * m1 % sharding.PRIMES[0] + c2) * m2 % sharding.PRIMES[1]) % size[own]
        x = half[0] * b + half[1]
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_places_are_a_permutation_and_can_be_turned_back(spark, n):
    df = sharding.place(spark.range(n).toDF("row"), n, 5, 9)
    got = {r.row: (r.shard, r.slot) for r in df.collect()}
    assert got == {x: (plain_place(x, n, 9) % 5, plain_place(x, n, 9) // 5) for x in range(n)}
    assert sorted(s * 5 + k for k, s in got.values()) == list(range(n))
    back = sharding.row_at(df.withColumnRenamed("row", "was"), n, 5, 9)
    assert all(r.row == r.was for r in back.collect())
    assert sharding.row_at(df, n, 5, 9).where("shard = 0").count() == -(-n // 5)


def test_the_walk_is_as_long_as_it_has_to_be(spark):
    for n in (2, 3, 5, 10, 17, 1009):
        a, b = sharding.halves(n)
        assert n <= a * b < n + a and sharding.halves(n) == (math.ceil(math.sqrt(n)), -(-n // math.ceil(math.sqrt(n))))
        assert 0 <= sharding.walk_length(spark, n, 1) <= a * b - n


def test_shards_look_shuffled(spark):
    n = 20_000
    got = sharding.place(spark.range(n).toDF("row"), n, 16, 1).groupBy((F.col("row") / 1250).cast("int").alias("block"), "shard").count().collect()
    expected = n / 256
    chi = sum((r["count"] - expected) ** 2 / expected for r in got) + (256 - len(got)) * expected
    assert chi < 330  # 225 degrees of freedom
    other = sharding.place(sharding.place(spark.range(n).toDF("row"), n, 16, 1).withColumnsRenamed({"shard": "s1", "slot": "t1"}), n, 16, 2)
    assert other.where("s1 = shard").count() < n / 16 * 1.2


def test_assign(spark, documents):
    got = sharding.assign(rows(spark, documents)).collect()
    n = len(documents)
    want = sorted(((d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _ in documents)
    place = [plain_place(x, n, sharding.SEED) for x in range(n)]
    expect = Counter((k[1] if k[0] else None, size, crc, p % 16, p // 16) for ((k, crc, size), p) in zip(want, place, strict=True))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == expect
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())


def test_assign_does_not_depend_on_how_rows_lie(spark, documents):
    a = sharding.assign(rows(spark, documents)).drop("row").collect()
    b = sharding.assign(rows(spark, documents[::-1]).repartition(7)).drop("row").collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_many_equal_rows_are_spread(spark):
    df = spark.range(30_000).select(F.when(F.col("id") > 9, F.col("id") % 1).alias("doc_id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slim = sharding.written(sharding._measured(df).select("_id", "_size", "_crc", "_key"), "t")
        numbers, n = sharding.number(slim, ["_id", "_crc", "_size", "_key"])
        files = slim.repartitionByRange("_id", "_crc", "_size", "_key").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == 30_000 and files < 15_000
    assert numbers.agg(F.min("row"), F.max("row"), F.countDistinct("row")).first() == (0, n - 1, n)


def test_write_shards_keeps_whole_rows(spark, documents, tmp_path):
    df = rows(spark, documents)
    got = sharding.write_shards(df, f"{tmp_path}/out", 4, run=10)
    assert Counter(tuple(r.record) for r in got.collect()) == Counter(tuple(r) for r in df.collect())
    where = Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.assign(df, 4).collect())
    assert where == Counter((r.record.doc_id, zlib.crc32((r.record.text or "").encode()), r.shard, r.slot) for r in got.collect())


# filter audit


def plain_audit(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    failed = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A"} if len(w) < 50 else set()
        if 100 * len(set(w)) < 65 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            bad.add("C")
        if re.search("[#$%&*|]", t):
            bad.add("D")
        if d is not None and d > least[t]:
            bad.add("E")
        failed.append((s or "", bad, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for i, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                stay = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                out[part, "".join(order), i + 1] = [len(stay), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), c]
                left = stay
        for key in out:
            if key[0] == part:
                out[key][6] = shapley[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark, documents):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(3, 0, 1), (3, 0, 1), (None, 1, 1), (6, None, None), (-5, 1, 0)]
    df = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.interactions(rows(spark, documents), df).collect()}
    assert got == plain_audit(documents, labels)


def test_long_form_is_of_fixed_size(spark):
    assert filter_audit.long_form(spark, "ABCDE").count() == 32 * 120 * 5
    assert filter_audit.long_form(spark, "AB").orderBy("mask", "filter_order", "step").where("mask = 3 AND filter_order = 'BA'").select("filter", "fails", "gone").collect() == [("B", True, False), ("A", True, True)]
    with pytest.raises(ValueError):
        filter_audit.long_form(spark, "ABCDEFGH")


def test_audit_without_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(rows(spark, documents).limit(0), labels).count() == 0
    assert {r.good_lost for r in filter_audit.interactions(rows(spark, documents), labels).select("good_lost").distinct().collect()} == {0}


# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=20):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t, _ in docs]
    bags = [b for b in bags if b[2]]
    total = sum(b[2] for b in bags)
    df = Counter(t for b in bags for t in b[1])
    asked = {}
    for i, t in items:
        asked[i] = asked.get(i, Counter()) + Counter(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for d, bag, n in bags:
            m = 75 + 25 * n * len(bags) // total
            s = sum(k * math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, k in q.items() if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top])]
    return out


ITEMS = [("a", "Alpha alpha beta"), ("b", "w5 w77 the of"), ("c", None), ("d", ""), (None, "gamma"), ("e", "nothing here is found zzz"), ("a", "delta"), ("f", "日本 x1"), ("g", "the " * 500 + "Épsilon épsilon")]


def test_shards_of_a_task_are_read_one_by_one(spark):
    docs = spark.range(0, 5, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("alpha "), 400_000).alias("text"))  # each a slice, and a shard
    index = ranked_search.build_index(docs, shard_bytes=1)
    assert index.count() == index.select(F.input_file_name()).distinct().count() == 5


@pytest.mark.parametrize("shard_bytes", [1, 2000, ranked_search.SHARD_BYTES])
def test_search_equals_brute_force(spark, documents, shard_bytes, monkeypatch):
    monkeypatch.setattr(ranked_search, "MOST_TERMS", 4)  # several blocks
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id string, text string, doc_id int")
    got = ranked_search.search(rows(spark, documents), items, shard_bytes=shard_bytes)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_search(documents, ITEMS)))


def test_search_without_rows(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert ranked_search.search(rows(spark, documents).limit(0), items).count() == 0
    assert ranked_search.search(rows(spark, documents), items.limit(0)).count() == 0
    assert ranked_search.search(rows(spark, documents), items.where("item_id = 'd'")).count() == 0


def test_max_score_is_exact_and_passes_texts_over():
    r = np.random.default_rng(3)
    n = 4000
    lists = []
    for share, w in ((0.9, 3), (0.5, 40), (0.05, 3000), (0.01, 9000), (0.002, 11000)):
        place = np.flatnonzero(r.random(n) < share)
        lists.append((place, r.integers(1, 900, len(place)), w))
    score = np.zeros(n, np.int64)
    for p, v, w in lists:
        score[p] += v * w
    ids = r.permutation(n)
    want = sorted(((-int(s), int(i), p) for p, (s, i) in enumerate(zip(score, ids, strict=True)) if s > 0))[:20]
    probed = []

    class Watched(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, np.ndarray):
                probed.append(len(k))
            return np.asarray(self)[k] if isinstance(k, np.ndarray) else super().__getitem__(k)

    seen = [(p.view(Watched), v, w) for p, v, w in lists]
    for span in (1, 64, 512, 8000):
        assert ranked_search.max_score(lists, ids, 20, span) == [(p, -s) for s, _, p in want]
    probed.clear()
    ranked_search.max_score(seen, ids, 20, 64)
    assert sum(probed) < n  # the lists of frequent terms are probed for few texts


def test_ties_go_by_id_and_equal_bounds_stay():
    place = np.arange(100)
    assert [p for p, _ in ranked_search.max_score([(place, np.full(100, 7), 2)], np.arange(100)[::-1], 5, 10)] == [99, 98, 97, 96, 95]
    assert ranked_search.norms(np.array([3_000_000], np.int32), ranked_search.Corpus(10**12, 10**15)).tolist() == [12 * (75 + 25 * 3_000_000 * 10**12 // 10**15)]
