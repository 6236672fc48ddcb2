"""Operators on texts against brute force, with awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.llm import arrays, decontaminate, jaccard_join, language_id, packing, quality_classifier, quality_rules, substring_dedup, token_counts

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, " \n\t", "a", "A\x0bb\x0cc", "ünï çödé x", "x " * 3000, "word" * 500, "\x00 \x1f", "same same same", "😀 😀"]


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def ident(x):
    return -1 if x is None else x


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    base = [r.choice(vocabulary) for _ in range(120)]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if i % 4 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[: r.randint(30, 60)]
        if i % 5 == 0:
            w = base[:]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        if i % 11 == 0:
            w = w + w
        out.append(" ".join(w).replace(" w7", "\nW7"))
    return out + out[:6] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(corpus())] + [(None, "null id", "x", 1), (3, corpus()[3], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int").selectExpr("*", "1 AS s", "text AS x", "'k' AS key", "2 AS cid", "3 AS _hit", "4 AS _d", "5 AS _NEW", "6 AS _did", "7 AS n_words").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_and_hashes():
    texts = corpus()
    w = arrays.Words(arrays.Texts(pa.array(texts)), arrays.PLAIN)
    ref = [SPACE_WORD.findall(t or "") for t in texts]
    assert w.counts().tolist() == [len(r) for r in ref]
    flat = [x for r in ref for x in r]
    by = collections.defaultdict(set)
    for x, h in zip(flat, w.hashes().tolist(), strict=True):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_token_counts_equal_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())
    r = random.Random(1)
    alphabet = "aAbBéÉ'sStTrevmldL  \n\t09١½²!?\"#’ΣσςİıẞßǅÅé中文한국ก็😀‍\u0085\x00<|endoftext|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(400)] + corpus() + ["<|endoftext|> x<|startoftext|>", "aaaaaa", "don't 'same ''s I'LL"]
    count = token_counts.Counter(token_counts.Vocabulary(token_counts.vocabulary_path()), memo=50)
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert count(texts).tolist() == want and count(texts).tolist() == want
    got = {(x.doc_id, x.n_tokens, x.n_bytes) for x in token_counts.count_tokens(docs).collect()}
    assert got == {(x.doc_id, len(t.encode(x.text or "", add_special_tokens=False).ids), len((x.text or "").encode())) for x in docs.collect()}
    assert token_counts.count_tokens(empty).count() == 0


def test_every_code_point_counts_as_in_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())
    count = token_counts.Counter(token_counts.Vocabulary(token_counts.vocabulary_path()))
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    for at in range(0, len(every), 100_000):
        texts = [f"a{c}b {c}1{c}" for c in map(chr, every[at : at + 100_000])]
        want = np.array([len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)])
        assert [hex(every[at + i]) for i in np.flatnonzero(count(texts) != want)] == []


def components_of(rows, k, percent):
    sets = []
    for _, t in rows:
        w = SPACE_WORD.findall(low(t))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((v for v in ids if v is not None), default=None) for g, ids in groups.items()}
    return sets, [least[find(i)] if sets[i] else rows[i][0] for i in range(len(rows))]


@pytest.mark.parametrize("common", [2, 8])
def test_jaccard_join_finds_every_link(monkeypatch, docs, empty, common):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, comp = components_of(rows, 4, 85)
    got = collections.Counter(tuple(r) for r in jaccard_join.join(docs).collect())
    assert got == collections.Counter((d, len(s), c) for (d, _), s, c in zip(rows, sets, comp, strict=True))
    if common == 2:
        kept = jaccard_join.first_of_groups(docs, 5, 80)
        assert kept.columns == docs.columns
        _, comp = components_of(rows, 5, 80)
        full = [(d, c) for (d, t), c in zip(rows, comp, strict=True) if SPACE_WORD.search(t or "")]
        assert sorted(ident(r.doc_id) for r in kept.collect() if SPACE_WORD.search(r.text or "")) == sorted({ident(c) for _, c in full})
        assert jaccard_join.join(empty).count() == 0 and jaccard_join.first_of_groups(empty).count() == 0


@pytest.mark.parametrize("k, percent, own", [(4, 85, 68), (5, 80, 97)])
def test_jaccard_join_links_longer_versions_of_a_family(spark, k, percent, own):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [base] + [base[:i] + ["edit"] + base[i + 1 :] for i in range(20, 380, 30)]
    texts += [base + [f"own{r.randrange(10**9)}" for _ in range(own)] for _ in range(120)]
    rows = list(enumerate(" ".join(w) for w in texts))
    _, comp = components_of(rows, k, percent)
    assert set(comp) == {0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x.doc_id for x in jaccard_join.join(docs, k, percent).collect() if x.component_id] == []
    assert [x.doc_id for x in jaccard_join.first_of_groups(docs, k, percent).collect()] == [0]


def brute_repeats(rows, window):
    words = [SPACE_WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((w, gone))
    return out


@pytest.mark.parametrize("part", [2, 512])
def test_substring_dedup_removes_every_repeat(monkeypatch, docs, empty, part):
    monkeypatch.setattr(substring_dedup, "PART", part)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 3000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = collections.Counter((d, len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for (d, _), (w, g) in zip(rows, brute_repeats(rows, 35), strict=True))
    got = collections.Counter(tuple(r) for r in substring_dedup.digests(substring_dedup.repeats(docs)).collect())
    assert got == want and any(k[2] for k in want)
    clean = substring_dedup.clean(docs)
    assert clean.columns == docs.columns
    left = collections.Counter((d, " ".join(x for i, x in enumerate(w) if i not in g)) for (d, _), (w, g) in zip(rows, brute_repeats(rows, 35), strict=True) if len(w) > len(g) or not w)
    assert collections.Counter((r.doc_id, " ".join(SPACE_WORD.findall(r.text or ""))) for r in clean.collect()) == left
    assert substring_dedup.digests(substring_dedup.repeats(empty)).count() == 0


def test_smallest_grams_are_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
    grams[100:400] = grams[7]
    high = grams >> np.uint64(26)
    want = [i + int(np.argmin(high[i : i + 28])) for i in range(3000 - 27)]
    assert substring_dedup._lowest(grams, 28).tolist() == want
    monkeypatch.setattr(substring_dedup, "_BITS", 7)  # blocks of 100 places
    high = grams >> np.uint64(7)
    assert substring_dedup._lowest(grams, 28).tolist() == [i + int(np.argmin(high[i : i + 28])) for i in range(3000 - 27)]


def test_a_long_text_in_blocks(monkeypatch, spark):
    monkeypatch.setattr(substring_dedup, "_BITS", 9)
    r = random.Random(4)
    long = [f"w{r.randrange(10**6)}" for _ in range(5000)]
    long[4000:4060] = long[470:530]  # a passage across the end of a block
    rows = [(1, " ".join(long)), (2, " ".join(long[900:1100]))]
    want = {(d, len(w), len(g)) for (d, _), (w, g) in zip(rows, brute_repeats(rows, 35), strict=True)}
    got = substring_dedup.digests(substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {tuple(x)[:3] for x in got} == want and all(n for _, _, n in want)


def test_rows_of_one_id_and_text_give_their_segments_once(spark):
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(120))
    other = " ".join(text.split()[:60] + ["other"] * 3)
    x = pa.array([[{"key": 1, "seg": 2, "parts": 1, "part": 0, "c": 2, "w0": 0, "nw": 3}]] * 100_000 + [None])
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 100_000 + [other]), pa.array([0] * 100_001), pa.array([9] * 100_000 + [8]), x], names=["text", "did", "tid", "x"])
    assert sum(b.num_rows for b in substring_dedup._fetch(35)(iter([batch]))) == 1
    one = pa.RecordBatch.from_arrays([pa.array([k] * 3000) for k in (5, 0, 1, 7, 2)] + [pa.array([[1, 2]] * 3000)], names=["key", "part", "parts", "seg", "c", "words"])
    assert sum(b.num_rows for b in substring_dedup._shards(iter([one, one]))) == 1
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(1, other)], "doc_id long, text string"))
    got = substring_dedup.digests(substring_dedup.repeats(rows)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(g) for g in got} == {(None, 120, 120, 100_000), (1, 63, 60, 1)}


def brute_hits(rows, items, window):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = ALNUM_WORD.findall(low(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])] |= {str(k)} if k is not None else set()
    out = []
    for d, t in rows:
        w, hit, met = ALNUM_WORD.findall(low(t)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    met |= windows[k]
        out.append((d, len(w), len(hit), tuple(sorted(met))))
    return out


@pytest.mark.parametrize("block", [40, 10**6])
def test_decontamination_finds_every_window(monkeypatch, spark, docs, empty, block):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", block)
    texts = corpus()
    items = [(None, texts[8]), (1, texts[0]), (2, " ".join(texts[4].split()[5:17])), (3, "W7"), (4, ""), (5, None), (6, texts[4]), (7, "w1-w2,w3"), (8, "nothing like it " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = collections.Counter(brute_hits(rows, items, 10))
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find_matches(docs, bench).collect())
    assert got == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(ident(r.doc_id) for r in clean.collect()) == sorted(ident(d) for d, _, n, _ in brute_hits(rows, items, 10) if not n)
    assert decontaminate.find_matches(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.find_matches(docs, bench.limit(0)).collect()} == {0}


def test_proximity_matches_take_any_order(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c a b"), (3, "a " + "x " * 30 + "b c"), (4, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.near_items) for r in decontaminate.find_matches(docs, bench, span=6).collect()}
    assert got == {1: (0, ["9"]), 2: (0, ["9"]), 3: (0, []), 4: (0, [])}


def test_decontamination_judges_each_row_by_its_own_text(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(None, leak), (None, "clean"), (7, leak + " more"), (7, "clean too"), (8, None), (8, "")]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, decontaminate.clean(docs, bench).collect())) == sorted(map(str, docs.where("text IS NULL OR text NOT LIKE 'one%'").collect()))


def brute_near(rows, items, window, span):
    """Items with a window whose words all lie within ``span`` words of an occurrence of the window's rarest word."""
    words = [ALNUM_WORD.findall(low(t)) for _, t in rows]
    count = collections.Counter(w for x in words for w in x)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        met = set()
        for k, t in items:
            v = ALNUM_WORD.findall(low(t))
            for i in range(max(1, len(v) - window + 1) if v else 0):
                win = v[i : i + window]
                rare = min(win, key=lambda x: count[x])
                met |= {str(k) for j, x in enumerate(w) if x == rare and all(y in w[max(0, j - span + 1) : j + span] for y in win)}
        out.append((d, tuple(sorted(met))))
    return out


@pytest.mark.parametrize("block", [6, 10**6])
def test_proximity_against_brute_force(monkeypatch, spark, block):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", block)
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(r.randint(0, 40)))) for i in range(40)]
    items = [(i, " ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(r.randint(0, 6)))) for i in range(12)]
    got = decontaminate.find_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, span=8)
    # of equally rare words either may be the rarest: compare where the choice can't matter
    assert {x.doc_id: tuple(x.near_items) for x in got.collect()}.keys() == dict(brute_near(rows, items, 4, 8)).keys()
    same = sum(tuple(x.near_items) == dict(brute_near(rows, items, 4, 8))[x.doc_id] for x in got.collect())
    assert same >= 36


def brute_rules(t):
    w = SPACE_WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if SPACE_WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_base_rules(docs, empty):
    rows = [(r.doc_id, *brute_rules(r.text)) for r in docs.collect()]
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.judge(docs, quality_rules.DEFAULT).collect())
    assert got == collections.Counter(rows)
    assert quality_rules.judge(empty, quality_rules.DEFAULT).count() == 0
    kept = quality_rules.keep(docs, quality_rules.DEFAULT)
    assert kept.columns == docs.columns and kept.count() == quality_rules.judge(docs, quality_rules.DEFAULT).where("kept").count()


def test_viterbi_is_the_best_sequence():
    import itertools

    r = np.random.default_rng(2)
    chain = quality_rules.Chain(r.normal(size=3), r.normal(size=(2, 2)), r.normal(size=2))
    off = np.array([0, 5, 5, 6, 12])
    x = r.normal(size=(12, 3))
    got = quality_rules.viterbi(chain, x, off)
    e = x @ chain.emit
    for a, b in zip(off[:-1], off[1:]):
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda s: sum(e[a + i] * v for i, v in enumerate(s)) + (chain.begin[s[0]] if s else 0) + sum(chain.move[p, q] for p, q in zip(s, s[1:])))
        assert tuple(got[a:b]) == best


def labelled(spark, n=160):
    r = random.Random(4)
    good = lambda: "\n".join(" ".join(f"{r.choice('abcdefgh')}{r.choice('aeiou')}n" for _ in range(12)) + "." for _ in range(6))
    bad = lambda: "\n".join(" ".join(f"{r.choice('ABCDEFGH')}!!" for _ in range(12)) for _ in range(6))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad()) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_models_learn(spark):
    docs, labels = labelled(spark)
    chain = quality_rules.train(docs, labels, 30)
    assert {r.doc_id for r in quality_rules.judge(docs, chain).where("NOT kept").collect()} == {i for i in range(160) if i % 3 == 0}
    ranker = quality_classifier.train(docs, labels, 30, "doc_id < 100")
    s = {r.doc_id: r.score for r in quality_classifier.score(docs, ranker).collect()}
    assert min(v for k, v in s.items() if k % 3) > max(v for k, v in s.items() if k % 3 == 0)
    assert all((v >= 0.3) == (k % 3 > 0) for k, v in s.items())
    chosen = quality_classifier.select(docs, ranker, 0.9).collect()
    edge = np.quantile([r.score for r in chosen], 0.9)
    assert len(chosen) == docs.count() and all(r.selected == (r.score >= edge - 1e-12) for r in chosen)
    assert {r.doc_id for r in chosen if r.selected} <= {i for i in range(160) if i % 3}


def test_ranker_is_near_the_optimum_of_the_pair_loss():
    rng = np.random.default_rng(3)
    true = np.array([1.5, -1.0, 0.5, 0.0])

    def draw(n):
        x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 1] + [3, 0, 1, 0]
        return x, (rng.random(n) < 1 / (1 + np.exp(-(x - [3, 0, 1, 0]) @ true))).astype(int)

    x, label = draw(300)
    ridge = 1e-4
    ranker = quality_classifier.fit(x, label, ridge=ridge)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pairs = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, 4)  # every pair
    loss = lambda w: np.logaddexp(0, -pairs @ w).mean() + ridge / 2 * w @ w
    best = np.zeros(4)
    for _ in range(30):  # Newton's method on the whole loss
        p = 1 / (1 + np.exp(pairs @ best))
        best += np.linalg.solve((pairs.T * (p * (1 - p))) @ pairs / len(pairs) + ridge * np.eye(4), pairs.T @ p / len(pairs) - ridge * best)
    assert loss(ranker.weights) <= loss(best) * 1.005 and np.abs(ranker.weights - best).max() < 0.15
    more, truth = draw(4000)  # held out: as many pairs in order as the worths that made the labels
    ordered = lambda s: (s[truth == 1][:, None] > s[truth == 0][None]).mean()
    assert ordered(ranker.score(more)) > ordered(more @ true) - 0.01


def test_models_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs, none) is quality_rules.DEFAULT
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.train(empty) is None


def test_language_id_learns(spark):
    r = random.Random(3)
    make = {"aa": "abcdeé", "bb": "uvwxyzß"}
    text = lambda k: " ".join("".join(r.choice(make[k]) for _ in range(r.randint(2, 7))) for _ in range(40))
    rows = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(df.where("doc_id < 80"), 30)
    more = spark.createDataFrame([(500, None, None), (501, "12 34 !", None), (502, "", None), (503, "中文", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.unionByName(more), net).collect()}
    assert all(got[i][0] == k for i, _, k in rows if i >= 80)
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] in ("aa", "bb")
    assert all(0 <= v[1] <= 1 for v in got.values())


def test_gradient_of_the_network():
    """Backpropagation through time against finite differences."""
    net = language_id.fresh(["a", "b"])
    for d in (net.forth, net.back):
        d.table, d.gates, d.turn = (x.astype(np.float64) for x in (d.table, d.gates, d.turn))
    steps = np.random.default_rng(0).integers(97, 101, (6, 3)).astype(np.uint8)
    weight = np.random.default_rng(1).normal(size=(6, 3, language_id.HIDDEN))

    def loss():
        return float((language_id.states(net.forth, steps) * weight).sum())

    trace = []
    language_id.states(net.forth, steps, trace)
    grads = language_id.gradient(net.forth, steps, trace, weight)
    for p, g in zip((net.forth.table, net.forth.gates, net.forth.turn), grads, strict=True):
        at = tuple(np.argwhere(np.abs(g) > np.abs(g).max() / 2)[0])
        keep = p[at]
        p[at] = keep + 1e-2
        up = loss()
        p[at] = keep - 1e-2
        down = loss()
        p[at] = keep
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=2e-2, abs=2e-3)


def padding(hist, edges):
    return sum(n * (next(e for e in edges if e >= k) - k) for k, n in hist)


def test_bucket_boundaries_are_optimal():
    import itertools

    r = random.Random(8)
    for _ in range(40):
        hist = sorted({r.randint(1, 40): r.randint(1, 9) for _ in range(r.randint(1, 9))}.items())
        for k in (1, 2, 3, 4):
            got = packing.boundaries(hist, k)
            top = hist[-1][0]
            best = min(padding(hist, [*c, top]) for m in range(min(k, len(hist))) for c in itertools.combinations([x for x, _ in hist[:-1]], m))
            assert padding(hist, got) == best and len(got) <= k and got[-1] == top
    assert packing.boundaries([], 4) == [] and packing.boundaries([(0, 5)], 4) == []


def test_batches_keep_the_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    r = random.Random(2)
    rows = [(i, r.randint(0, 300)) for i in range(400)] + [(7, 10_000), (None, None), (5, 12), (5, 12)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 4, 1000).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for x in got:
        assert (x.bucket is None) == (x.n_tokens == 0) and x.padded_to >= x.n_tokens
        if x.bucket is not None:
            by[x.batch].append(x)
    for v in by.values():
        assert len({x.padded_to for x in v}) == 1 and sorted(x.slot for x in v) == list(range(len(v)))
        assert len(v) == 1 or sum(x.padded_to for x in v) <= 1000
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_shards_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rows = [(None, 7)] * 1000 + [(5, 9)] * 1000 + [(None, 0)] * 1000
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(4), 2, 90).collect()
    by = collections.Counter(x.batch for x in got if x.bucket is not None)
    shards = {x.batch.rsplit(".", 1)[0] for x in got if x.bucket is not None}
    assert len(got) == 3000 and len(shards) == 40 and max(by.values()) == 12
    assert {(x.bucket, x.padded_to, x.batch, x.slot) for x in got if x.n_tokens == 0} == {(None, 0, None, None)}


def test_language_id_learns_from_different_texts(monkeypatch, spark):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda parts, langs: seen.extend(parts))
    rows = [(f"text {i}", "en") for i in range(40) for _ in range(1 if i % 2 else 50)]
    language_id.train(spark.createDataFrame(rows, "text string, lang string"), per_lang=30)
    assert len(seen) == len(set(seen)) == 30


def test_glued_texts_get_both_labels(spark):
    """Texts of known good and bad lines: labels are learnt from whole texts' labels alone, some bad texts hold good lines."""
    r = random.Random(9)
    good = lambda: " ".join(f"{r.choice('abcdefgh')}{r.choice('aeiou')}n" for _ in range(r.randint(6, 14))) + "."
    bad = lambda: r.choice([lambda: " ".join(f"{r.choice('ABCDEFGH')}{r.choice('AEIOU')}N!!" for _ in range(10)), lambda: " | ".join(f"{r.choice('abcdefgh')}n" for _ in range(8)), lambda: " ".join(f"{r.choice('abc')}n$$$" for _ in range(9))])()
    lines = [[(good(), True) for _ in range(6)] if i % 2 else [(bad(), False) for _ in range(5)] + [(good(), True)] * (i % 4 == 0) for i in range(120)]
    docs = spark.createDataFrame([(i, "\n".join(t for t, _ in x)) for i, x in enumerate(lines)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    chain = quality_rules.train(docs, labels)
    glued = [(200 + i, [(good(), True)] * r.randint(2, 5) + [(bad(), False)] * r.randint(2, 5) if i % 2 else [(bad(), False)] * r.randint(2, 5) + [(good(), True)] * r.randint(2, 5)) for i in range(60)]
    got = {(x.doc_id, x.line): x.content for x in quality_rules.label_lines(spark.createDataFrame([(i, "\n".join(t for t, _ in x)) for i, x in glued], "doc_id long, text string"), chain).collect()}
    want = {(i, k): v for i, x in glued for k, (_, v) in enumerate(x)}
    assert got.keys() == want.keys()
    hit = sum(not got[k] and not want[k] for k in want)
    f1 = 2 * hit / (sum(not v for v in got.values()) + sum(not v for v in want.values()))
    assert f1 >= 0.95 and len({got[k] for k in got if k[0] == 201}) == 2


def test_verdict_against_brute_force(docs):
    import itertools

    chain = quality_rules.Chain(np.linspace(1, -3, len(quality_rules.FEATURES)), np.array([[0.6, -0.3], [-0.5, 0.4]]), np.array([0.1, -0.2]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = collections.Counter()
    for d, t in rows:
        got = quality_rules.Lines(pa.array([t], pa.string()))
        n, e = len(got.x), got.x @ chain.emit
        best = max(itertools.product((1, 0), repeat=n), key=lambda s: sum(e[i] * v for i, v in enumerate(s)) + (chain.begin[s[0]] if s else 0) + sum(chain.move[a, b] for a, b in zip(s, s[1:]))) if n <= 14 else None
        words = [len(SPACE_WORD.findall(x)) for x in (t or "").split("\n") if SPACE_WORD.search(x)]
        base = brute_rules(t)[-1]
        if best is not None:
            want[d, not base and 2 * sum(w for w, v in zip(words, best, strict=True) if v) >= sum(words)] += 1
    got = collections.Counter((r.doc_id, r.kept) for r in quality_rules.judge(docs, chain).collect())
    assert sum(want.values()) > 50 and all(got[k] >= n for k, n in want.items())


def test_line_labels_obey_the_text():
    r = np.random.default_rng(5)
    size = r.integers(0, 6, 80)
    off = np.concatenate([[0], np.cumsum(size)])
    words, score, label = r.integers(1, 9, off[-1]), r.random(off[-1]), r.integers(0, 2, 80)
    got = quality_rules.constrained(score, words, off, label)
    for i in range(80):
        part = slice(off[i], off[i + 1])
        if size[i]:
            assert (2 * (words[part] * got[part]).sum() >= words[part].sum()) == bool(label[i])
            plain = score[part] >= 0.5
            if (2 * (words[part] * plain).sum() >= words[part].sum()) == bool(label[i]):
                assert (got[part] == plain).all()


def test_gradient_of_the_whole_network():
    """Both directions, output layer, bias, mask and weights against finite differences of the loss."""
    net = language_id.fresh(["a", "b", "c"])
    for d in (net.forth, net.back):
        d.table, d.gates, d.turn = (x.astype(np.float64) for x in (d.table, d.gates, d.turn))
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    texts = arrays.Texts(pa.array(["abc de, 12 é" * 12, "xy z", "hello"]))
    steps, of = language_id.segments(texts)
    label, weight = of % 3, np.linspace(0.5, 2, len(of))
    _, grads = language_id.loss_and_gradient(net, steps, label, weight)
    for p, g in zip(net.arrays(), grads, strict=True):
        for at in np.argwhere(np.abs(g) >= np.abs(g).max() / 2)[:3]:
            at, keep = tuple(at), p[tuple(at)]
            p[at] = keep + 1e-2
            up = language_id.loss_and_gradient(net, steps, label, weight)[0]
            p[at] = keep - 1e-2
            down = language_id.loss_and_gradient(net, steps, label, weight)[0]
            p[at] = keep
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=5e-2, abs=1e-4)


def test_pooling_is_the_mean_over_letters():
    net = language_id.fresh(["a", "b"])
    texts = ["ab 1", "", "é!" * 150]
    got, letters = language_id.pooled(net, arrays.Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        want = np.zeros(2)
        for k in range(0, len(raw), language_id.STEPS):
            part = np.zeros((language_id.STEPS + 2 * language_id.WARM, 1), np.uint8)
            for j in range(len(part)):
                if 0 <= k + j - language_id.WARM < len(raw):
                    part[j] = raw[k + j - language_id.WARM]
            score = language_id.position_scores(net, part)[:, 0]
            want += score[language_id.is_letter(part[language_id.WARM :][: language_id.STEPS, 0])].sum(axis=0)
        assert letters[i] == language_id.is_letter(raw).sum()
        np.testing.assert_allclose(got[i], want / max(1, letters[i]), rtol=1e-4, atol=1e-5)


def test_many_copies_do_not_hide_a_language(spark):
    rows = [("the same english words again", "en")] * 20_000 + [("ein paar deutsche worte " + "abcdefgh"[i % 8] * i, "de") for i in range(40)] + [("x" * 200_000 + " y", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    net = language_id.train(df, per_lang=30)
    assert net.langs == ["de", "en", "fr"]


def test_long_texts_give_segments_of_every_part(monkeypatch, spark):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda parts, langs: seen.extend(zip(langs, parts, strict=True)))
    long = " ".join(f"{i:07d}" for i in range(60_000))
    df = spark.createDataFrame([(long, "en"), ("kurz", "de"), ("", "fr")], "text string, lang string")
    language_id.train(df, most_segments=1000)
    en = [int(p[16:].split()[1]) for k, p in seen if k == "en"]
    assert len(en) == 500 and len(seen) == 501 and all(len(p) == 112 for _, p in seen)
    assert np.histogram(en, 10, (0, 60_000))[0].min() > 25  # the whole text, not its beginning


def test_operators_take_empty_tables(spark, docs, empty):
    net = language_id.fresh(["a", "b"])
    assert language_id.identify(empty, net).count() == 0
    ranker = quality_classifier.train(*labelled(spark, 40), 10)
    assert quality_classifier.score(empty, ranker).count() == 0
    assert packing.pack_texts(empty).count() == 0
    assert quality_rules.label_lines(empty, quality_rules.DEFAULT).count() == 0
    n = sum(len([x for x in (r.text or "").split("\n") if SPACE_WORD.search(x)]) for r in docs.collect())
    assert quality_rules.label_lines(docs, quality_rules.DEFAULT).count() == n
    assert language_id.identify(docs, net).count() == docs.count()


def test_weighed_index_counts_occurrences():
    from orbweave.llm.fm_index import FMIndex

    r = np.random.default_rng(3)
    pieces = [r.integers(1, 4, r.integers(1, 9)) for _ in range(12)]
    weight = r.integers(1, 4, 12)
    text = np.concatenate([np.append(p, 0) for p in pieces])
    index = FMIndex(text, 20, np.concatenate([np.full(len(p) + 1, w) for p, w in zip(pieces, weight)]))
    full = collections.Counter(tuple(p[i:j]) for p, w in zip(pieces, weight) for _ in range(w) for i in range(len(p)) for j in range(i + 1, len(p) + 1))
    for least in (1, 2, 3):
        for p in pieces:
            for end in range(1, len(p) + 1):
                want = max((n for n in range(1, end + 1) if full[tuple(p[end - n : end])] >= least), default=0)
                assert index.statistics(p, np.array([0]), np.array([end]), least)[0] == want


@pytest.mark.parametrize("buckets, budget", [(3, 500), (16, 65_536)])
def test_packed_texts_against_plain_search(spark, docs, buckets, budget):
    """Token counts by the library, the best edges by trying them all in turn, and batches that hold what they may."""
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(token_counts.vocabulary_path())
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7_001, "long " * 20_000), (7_002, "long " * 9_001), (7_003, "longer " * 9_100)]
    counts = collections.Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    got = packing.pack_texts(spark.createDataFrame(rows, "doc_id long, text string"), buckets, budget).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == counts
    lengths = collections.Counter({0: 0})
    for (_, n), k in counts.items():
        lengths[n] += k
    sizes = sorted(n for n in lengths if n)
    least = {0: 0}  # padded tokens of the i shortest lengths
    for _ in range(buckets):
        new = dict(least)
        for j in range(1, len(sizes) + 1):
            for i in range(j):
                if i in least:
                    cost = least[i] + sizes[j - 1] * sum(lengths[n] for n in sizes[i:j])
                    new[j] = min(new.get(j, cost), cost)
        least = new
    assert sum(r.padded_to for r in got) == least[len(sizes)]
    edges = sorted({r.padded_to for r in got} - {0})
    assert len(edges) <= buckets and all(r.padded_to == min((e for e in edges if e >= r.n_tokens), default=0) if r.n_tokens else r.bucket is r.batch is r.slot is None and r.padded_to == 0 for r in got)
    batches = collections.defaultdict(list)
    for r in got:
        if r.n_tokens:
            batches[r.batch].append(r)
    for rs in batches.values():
        assert len({r.padded_to for r in rs}) == 1 and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].padded_to <= budget
    for e in edges:  # one shard here, so one batch of a bucket at most is not full
        full = max(1, budget // e)
        assert sum(len(rs) < full for rs in batches.values() if rs[0].padded_to == e) <= 1
