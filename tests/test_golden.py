"""Small cases worked out by hand."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from orbweave.functions import scalar as S
from orbweave.operators import catalog as C
from orbweave.operators import climate, geometry, hexgrid, mapequation, metrics, nulls, paths, stats
from orbweave.operators import community as H
from orbweave.operators import network as N
from orbweave.schema import locator

NAN = float("nan")


def col(df, name):
    return [r[name] for r in df.collect()]


def one(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}").repartition(1).sortWithinPartitions("i")


def test_digitize(spark):
    x = one(spark, [-3.0, -2.0, -0.5, 0.0, 0.5, 2.0, NAN])
    edges = [F.lit(v) for v in (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0)]
    assert col(x.select(S.digitize(F.col("x"), edges, -3, "last").alias("c")), "c") == [-3, -2, 0, 0, 1, 3, 3]
    assert col(x.select(S.digitize(F.col("x"), edges, -3).alias("c")), "c")[-1] is None


def test_regrid(spark):
    x = one(spark, [-180.0, -176.5, 0.0, 3.3, 179.9, 181.0, 359.0, NAN, -169.5])
    assert col(x.select(S.cell_lon(F.col("x"), 7, True).alias("c")), "c") == [-180, -180, 2, 2, 177, 184, 184, -180, -173]
    assert col(x.select(S.cell_lon(F.col("x"), 7).alias("c")), "c")[7] is None


def test_time_window_is_strict(spark):
    times = [dt.datetime(1980, 1, 1), dt.datetime(1980, 1, 1, 6), dt.datetime(1980, 12, 31), dt.datetime(1980, 12, 30, 18), dt.datetime(1980, 12, 31, 6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i long, time timestamp")
    assert sorted(col(C.time_window(df, (1980, 1980)), "i")) == [1, 3]


def test_cut_and_quantile_labels(spark):
    x = one(spark, [0.0, 1.0, 2.0, 3.0])
    assert col(x.select(S.cut_label(F.col("x"), [0, 1, 2]).alias("c")), "c") == [None, 0, 1, None]
    y = one(spark, [float(v) for v in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9)]).withColumn("trackid", F.col("i"))
    got, edges = C.feature_classes(y, "x", False, 4)
    assert [r["class"] - 1 for r in got.orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]
    assert [r.edge for r in edges.orderBy("i").collect()] == [1, 2.25, 4.5, 6.75, 9]


def test_equal_quantile_edges_fail(spark):
    same = one(spark, [1.0] * 8).withColumn("trackid", F.col("i"))
    with pytest.raises(Exception, match="unique"):
        C.feature_classes(same, "x", False, 4)[0].collect()


def test_lifetime_remainder_goes_last(spark):
    start = dt.datetime(2000, 1, 1)
    rows = [(t, s, start + dt.timedelta(hours=t * (s - 1))) for t in range(11) for s in (1,)]
    df = spark.createDataFrame(rows, "trackid long, seq long, time timestamp")
    got = C.lifetime_classes(df, 4)[0].orderBy("trackid", "seq")
    assert col(got, "class") == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3, 3]


def test_sustained_phase_starts_late(spark):
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(9)]
    df = spark.createDataFrame([(d, float(v)) for d, v in zip(days, (0, 1, 1, 1, 1, 1, 1, 0, 1))], "month_start date, v double")
    got = climate.sustained_phases(df, "v", 0.5, 5, zscore=False).orderBy("month_start")
    assert col(got, "phase") == [0, 0, 0, 0, 0, 1, 1, 0, 0]


def test_daily_fill_stops_at_the_last_month(spark):
    df = spark.createDataFrame([(dt.date(2023, 11, 1), 1), (dt.date(2023, 12, 1), 2)], "month_start date, v int")
    got = climate.daily(df, "v").orderBy("day").collect()
    assert len(got) == 31 and got[-1].day == dt.date(2023, 12, 1) and got[-1].v == 2 and got[-2].v == 1


def test_day_night_islands(spark):
    h = [8, 9, 20, 10]
    df = spark.createDataFrame([("a", i + 1, dt.datetime(2000, 1, 1, x)) for i, x in enumerate(h)], "trackid string, seq long, local_time timestamp")
    got = C.day_night_tracks(df).collect()
    assert {r.trackid for r in got} == {"a_1"} and len(got) == 2


def test_consensus_rules(spark):
    e = spark.createDataFrame([(0, 1, 20.0), (2, 3, 16.0), (4, 5, 9.0), (4, 5, 30.0), (6, 7, 10.0), (6, 7, 10.0)], "orig long, dest long, weight double")
    got = {(r.orig, r.dest): r.weight for r in N.consensus(e, 2, 10, 8).collect()}
    assert got == {(0, 1): 10.0, (6, 7): 10.0}


def test_entry_region(spark):
    cells = ["o", "o", "R", "R", "o", "R"]
    df = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(cells)] + [(2, 1, "o")], "trackid long, seq long, coord_idx string")
    region = spark.createDataFrame([("R",)], "cell string")
    assert sorted(col(C.to_entry_region(df, region), "seq")) == [1, 2, 3, 4]
    assert sorted(col(C.to_entry_region(df, region, False), "seq")) == [1, 2, 3]


def test_landfall_at_birth_is_a_self_pair(spark):
    df = spark.createDataFrame([(1, 1, 7, 1.0, 5.0), (1, 2, 8, 1.0, None)], "trackid long, seq long, coord_idx long, mean_ivt double, lf_lon double")
    r = C.pairs(df, "birth-landfall").first()
    assert (r.orig, r.dest) == (7, 7)
    with pytest.raises(ValueError, match="birth-death"):
        C.pairs(df, "noon")


def test_null_cells_are_bridged(spark):
    df = spark.createDataFrame([(1, 1, 7, 1.0), (1, 2, None, 2.0), (1, 3, 9, 3.0)], "trackid long, seq long, coord_idx long, mean_ivt double")
    assert [(r.orig, r.dest) for r in C.pairs(df).collect()] == [(7, 9)]


def test_end_tracks_go(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3)], "trackid long")
    assert col(C.drop_end_tracks(df), "trackid") == [2]


def test_benjamini_hochberg_with_a_missing_p(spark):
    p = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03), (1, 4, None)], "cell long, model long, p double")
    got = {r.model: r.p_adj for r in stats.benjamini_hochberg(p).collect()}
    assert got == {1: pytest.approx(0.03), 3: pytest.approx(0.04), 2: pytest.approx(0.04)}


def test_unknown_locator():
    with pytest.raises(ValueError):
        locator("tail_end")


def brute_betweenness(nodes, edges, weighted=True):
    """All shortest paths by enumeration."""
    out = {(a, b): 0.0 for a, b, _ in edges}
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, 1 / w if weighted else 1))

    def walk(path, length):
        yield path, length
        for b, w in adj.get(path[-1], []):
            if b not in path:
                yield from walk([*path, b], length + w)

    for s in nodes:
        best = {}
        for path, length in walk([s], 0.0):
            best.setdefault(path[-1], []).append((length, path))
        for t, found in best.items():
            if t != s:
                low = min(x for x, _ in found)
                short = [p for x, p in found if abs(x - low) < 1e-12]
                for p in short:
                    for k in zip(p, p[1:]):
                        out[k] += 1 / len(short)
    n = len(nodes)
    return {k: v / (n * (n - 1)) for k, v in out.items()}


@pytest.mark.parametrize("weighted", [True, False])
def test_edge_betweenness_against_enumeration(spark, weighted):
    edges = [(a, b, float(1 + (a * 7 + b * 3) % 4)) for a in range(6) for b in range(6) if a != b and (a + 2 * b) % 3]
    nodes = list(range(7))
    n = spark.createDataFrame([(i,) for i in nodes], "coord_id long")
    e = spark.createDataFrame(edges, "orig long, dest long, weight double")
    got = {(r.orig, r.dest): r.edge_betweenness for r in metrics.edge_betweenness(n, e, weighted).collect()}
    ref = brute_betweenness(nodes, edges, weighted)
    assert got == {k: pytest.approx(v) for k, v in ref.items()}


def plain_walk(n, links):
    """Visit rates and flows by the same PageRank, without Spark."""
    out = [sum(w for a, _, w in links if a == v) for v in range(n)]
    p = [1 / n] * n
    for _ in range(200):
        lost = sum(p[v] for v in range(n) if not out[v])
        new = [0.85 * lost / n + 0.15 / n] * n
        for a, b, w in links:
            new[b] += 0.85 * p[a] * w / out[a]
        p = new
    flow = {(a, b): p[a] * w / out[a] for a, b, w in links}
    total = sum(flow.values())
    return p, {k: f / total for k, f in flow.items()}


def plain_codelength(p, flow, module, within=None, extra=0.0):
    h = mapequation._h
    q, inside = {}, {}
    for v, c in module.items():
        inside[c] = inside.get(c, 0) + p[v]
    for (a, b), f in flow.items():
        if a in module and module[a] != module.get(b):
            q[module[a]] = q.get(module[a], 0) + f
    return h(extra + sum(q.values())) - 2 * sum(map(h, q.values())) - sum(h(p[v]) for v in module) + sum(h(q.get(c, 0) + x) for c, x in inside.items())


CLIQUES = [(a + o, b + o, 1.0) for o in (0, 5) for a in range(5) for b in range(5) if a != b] + [(0, 5, 0.1), (5, 0, 0.1)]


@pytest.mark.parametrize("local", [50_000, 0])
def test_modules_of_two_cliques(spark, local, monkeypatch):
    """In one task, and by rounds of joins."""
    monkeypatch.setattr(mapequation, "LOCAL_LINKS", local)
    nodes = spark.createDataFrame([(i,) for i in range(11)], "coord_id long")
    edges = spark.createDataFrame([*CLIQUES, (3, 3, 5.0)], "orig long, dest long, weight double")
    got = {}
    for r in H.communities(nodes, edges, (1, 2), still=1e-3).collect():
        got.setdefault(r.seed, {})[r.node] = r.community
    for m in got.values():
        assert len(m) == 11 and len({m[i] for i in range(5)}) == 1 and len({m[i] for i in range(5, 10)}) == 1 and len(set(m.values())) == 3


def test_codelength_of_a_search(spark):
    links = [(a, b, float(1 + (a * b) % 3)) for a in range(8) for b in range(8) if (a + b) % 3 == 1 and a != b] + [(8, 0, 2.0), (9, 8, 1.0), (8, 9, 1.0)]
    p, flow = plain_walk(10, links)
    nodes, edges = spark.createDataFrame([(i,) for i in range(10)], "coord_id long"), spark.createDataFrame(links, "orig long, dest long, weight double")
    m = {r.node: r.community for r in H.communities(nodes, edges, (1,)).collect()}
    rates, flows = mapequation.random_walk(nodes, edges, steps=200, tol=1e-13)
    got = H.codelength(rates, flows, spark.createDataFrame(list(m.items()), "node long, community long")).first()[0]
    assert got == pytest.approx(plain_codelength(p, flow, m)) and got <= plain_codelength(p, flow, dict.fromkeys(range(10), 0)) + 1e-9


def test_greedy_moves_take_the_extra_flow_into_account():
    import numpy as np

    out = np.zeros(10)
    for a, _, w in CLIQUES:
        out[a] += w / 41
    links = {(a, b): w / 41 for a, b, w in CLIQUES}
    for seed in range(3):
        m = mapequation.greedy(np.full(10, 0.1), out, links, 0.0, seed)
        assert len(set(m[:5])) == 1 and len(set(m[5:])) == 1 and m[0] != m[5]
        p, flow = dict(enumerate([0.1] * 10)), links
        assert plain_codelength(p, flow, dict(enumerate(m))) < plain_codelength(p, flow, dict.fromkeys(range(10), 0))


def test_hierarchy_of_cliques_of_cliques(spark):
    """Four groups of three cliques: the tree has two levels that nest, and its code is shorter than any single level's."""
    links = [(12 * g + 4 * c + i, 12 * g + 4 * c + j, 10.0) for g in range(4) for c in range(3) for i in range(4) for j in range(4) if i != j]
    links += [(12 * g + 4 * c, 12 * g + 4 * d, 1.5) for g in range(4) for c in range(3) for d in range(3) if c != d]
    links += [(12 * g + 1, 12 * h + 1, 0.02) for g in range(4) for h in range(4) if g != h]
    nodes, edges = spark.createDataFrame([(i,) for i in range(48)], "coord_id long"), spark.createDataFrame(links, "orig long, dest long, weight double")
    tree = H.hierarchical_communities(nodes, edges).cache()
    level = {}
    for r in tree.collect():
        level.setdefault(r.level, {})[r.node] = r.community
    assert sorted(level) == list(range(len(level))) and not set(level[0].values()) & set(level[max(level)].values()) or len(level) == 1
    for k in range(1, len(level)):
        assert len({(level[k][v], level[k - 1][v]) for v in range(48)}) == len(set(level[k].values()))
    rates, flows = mapequation.random_walk(nodes, edges)
    bits = mapequation.hierarchical_codelength(rates, flows, tree).first()[0]
    p = {r.node: r.rate for r in rates.collect()}
    flow = {(r.src, r.dst): r.flow for r in flows.collect()}
    single = [plain_codelength(p, flow, {v: f(v) for v in range(48)}) for f in (lambda v: 0, lambda v: v // 12, lambda v: v // 4)]
    assert bits <= min(single) + 1e-9
    two = spark.createDataFrame([(0, v, v // 12) for v in range(48)] + [(1, v, 100 + v // 4) for v in range(48)], "level long, node long, community long")
    h = mapequation._h
    q = lambda f: [sum(x for (a, b), x in flow.items() if f(a) == c and f(b) != c) for c in range(f(47) + 1)]
    top, low = q(lambda v: v // 12), q(lambda v: v // 4)
    want = h(sum(top)) - sum(map(h, top)) + sum(h(top[g] + sum(low[3 * g : 3 * g + 3])) - h(top[g]) - sum(map(h, low[3 * g : 3 * g + 3])) for g in range(4))
    want += sum(h(low[c] + sum(p[v] for v in range(4 * c, 4 * c + 4))) - h(low[c]) - sum(h(p[v]) for v in range(4 * c, 4 * c + 4)) for c in range(12))
    assert mapequation.hierarchical_codelength(rates, flows, two).first()[0] == pytest.approx(want)


def test_clustering_of_a_full_triangle(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a in range(3) for b in range(3) if a != b], "orig long, dest long, weight double")
    n = spark.createDataFrame([(i,) for i in range(4)], "coord_id long")
    assert {r.coord_id: r.clustering for r in metrics.clustering(n, e).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}


def test_hexgrid_round_trip(spark):
    g = hexgrid.AxialHexGrid()
    cells = g.all_cells(spark, 1).select("coord_id", "lat", "lon")
    back = cells.where("lon >= -180 AND lon < 180").select("coord_id", g.encode(F.col("lat"), F.col("lon"), 1).alias("b"))
    assert back.where("coord_id <> b").count() == 0


def test_walks_are_reproducible_and_anchored(spark):
    lattice = nulls.rect_lattice(spark, 45)
    a = lattice.select("orig").first()[0]
    tracks = spark.createDataFrame([(1, 6, a, a), (2, 3, a, a)], "trackid long, n long, first string, last string")
    runs = [sorted(map(tuple, nulls.random_walks(tracks.repartition(k), lattice, 2, end="last", seed=3).collect())) for k in (1, 2)]
    assert runs[0] == runs[1] and len(runs[0]) == 18
    assert all(c == a for r, t, s, c in runs[0] if s == {1: 6, 2: 3}[t])


def test_unwrap(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([170.0, 179.0, -175.0, -170.0, 175.0])], "trackid long, seq long, lon double")
    assert col(geometry.unwrap(df, "lon").orderBy("seq"), "lon") == [170, 179, 185, 190, 175]


def test_ami_of_equal_partitions_is_one(spark):
    p = spark.createDataFrame([(s, n, n % 3) for s in (1, 2) for n in range(12)], "seed long, node long, community long")
    assert H.adjusted_mutual_info(p).first().ami == pytest.approx(1.0)
    assert H.adjusted_rand(p).first().ari == pytest.approx(1.0)
    assert math.isclose(H.heterogeneity(p).first().heterogeneity, 0.0, abs_tol=1e-12)


def test_segments_at_the_date_line(spark):
    df = spark.createDataFrame([(0, 180.0, 0.0, 170.0, 5.0), (1, -180.0, 0.0, -170.0, 5.0), (2, 170.0, 1.0, -180.0, 2.0), (3, 170.0, 1.0, -170.0, 2.0), (4, -170.0, 1.0, 170.0, 2.0), (5, 10.0, 1.0, 20.0, 2.0)], "i int, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {(r.i, r.segment): (r.x1, r.y1, r.x2, r.y2) for r in geometry.split_at_meridian(df).collect()}
    assert got == {
        (0, 0): (-180, 0, -179.5, 0), (0, 1): (180, 5, 170, 5), (1, 0): (-180, 0, -170, 5),
        (2, 0): (170, 1, 180, 1), (2, 1): (-179.5, 2, -180, 2), (3, 0): (170, 1, 180, 1), (3, 1): (-180, 2, -170, 2),
        (4, 0): (-170, 1, -180, 1), (4, 1): (180, 2, 170, 2), (5, 0): (10, 1, 20, 2),
    }
    curve = geometry.curve_control(spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "x1 double, y1 double, x2 double, y2 double"))
    assert [(r.cx, r.cy) for r in curve.collect()] == [(5.0, 7.0)]


def test_null_models_lose_nothing(spark):
    lattice = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)], "orig long, dest long, weight double")
    tracks = spark.createDataFrame([(1, 5, 1, 1), (2, 5, 77, 1), (3, 5, None, 1), (4, 5, 3, 1), (5, 0, 1, 1)], "trackid long, n long, first long, last long")
    walks = {}
    for r in nulls.random_walks(tracks, lattice, 1).orderBy("seq").collect():
        walks.setdefault(r.trackid, []).append(r.coord_idx)
    assert set(walks) == {1, 4} and walks[1][0] == 1 and walks[4] == [3]  # 77 and null are no cells, 3 has no way on
    edges = spark.createDataFrame([(9, 2, 4.0), (1, 3, 2.0)], "orig long, dest long, weight double")
    assert sorted(map(tuple, nulls.rewire(edges, lattice, 1, 1).collect())) == [(0, 1, 2, 2.0), (0, 9, 2, 4.0)]


def test_a_hub_forms_no_wedges(spark):
    arcs = [(0, i, 1.0) for i in range(1, 400)] + [(1, 2, 1.0), (2, 0, 1.0)]
    edges = spark.createDataFrame(arcs, "orig long, dest long, weight double")
    ties, tri = metrics._triangles(edges)
    assert ties.count() == 400 and [tuple(r) for r in tri.select("a", "b", "c").collect()] == [(1, 2, 0)]


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0, 9.0], [float(i * i % 97) for i in range(500)], [0.5] * 50 + [2.5] * 49])
def test_exact_quantiles(spark, values):
    import numpy as np

    from orbweave.functions.running import quantiles

    df = spark.createDataFrame([(v,) for v in [*values, None, NAN]], "x double")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert quantiles(df, "x", at).first().q == pytest.approx(np.quantile(values, at).tolist())
    weighed = df.where("x IS NOT NULL").groupBy("x").count()
    assert quantiles(weighed, "x", at, "count").first().q == pytest.approx(np.quantile(values, at).tolist())
    assert quantiles(df.limit(0), "x", [0.5]).first().q == [None]


def test_equal_lifetimes_are_spread(spark):
    times = [dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 2)]
    cat = spark.createDataFrame([(t, s, times[s]) for t in range(400) for s in (0, 1)], "trackid long, seq long, time timestamp")
    got, edges = C.lifetime_classes(cat, 4)
    assert {(r["class"], r["count"]) for r in got.groupBy("class").count().collect()} == {(k, 200) for k in range(4)}
    assert col(edges, "edge") == [86400.0] * 5
    assert C.lifetime_classes(cat.limit(1), 4)[0].count() == 1 and C.lifetime_classes(cat.limit(0), 4)[0].count() == 0


def test_average_networks_follow_the_values(spark):
    from orbweave.schema import Network

    nodes = spark.createDataFrame([(1, 0.0, 0.0, 4.0), (2, 1.0, 1.0, 8.0)], "coord_id long, lat double, lon double, sign double").withColumn("more", F.lit(1.0))
    edges = lambda w, s: spark.createDataFrame([(1, 2, w, s), (2, 1, w, 3.0)], "orig long, dest long, weight double, sign double")
    full = N.average_networks(Network(nodes, edges(1.0, 1.0), True), Network(nodes, edges(3.0, 5.0), True), "sign")
    assert {(r.orig, r.weight, r.sign) for r in full.edges.collect()} == {(1, 2.0, 3.0), (2, 2.0, 3.0)} and full.nodes.columns == ["coord_id", "lat", "lon", "sign"]
    gaps = N.average_networks(Network(nodes, edges(1.0, None), True), Network(nodes, edges(3.0, 5.0), True), "sign")
    assert "sign" not in gaps.edges.columns and "sign" in gaps.nodes.columns


def test_operators_take_empty_tables(spark):
    cat = spark.createDataFrame([], "trackid long, seq long, time timestamp, coord_idx long, mean_ivt double, lf_lon double, continent string, lat double, lon double")
    edges = spark.createDataFrame([], "orig long, dest long, weight double")
    nodes = spark.createDataFrame([], "coord_id long, lat double, lon double")
    pairs = C.pairs(cat)
    frames = [pairs, C.in_continent(cat, "ASIA"), C.in_box(cat, [0, 1, 0, 1], F.col("lon"), F.col("lat")), C.track_ends(cat), C.paths(cat), C.track_means(cat, "mean_ivt"), C.run_dedup(cat), C.sample_tracks(cat, 3),
              N.transport_matrix(pairs), N.build_edges(N.transport_matrix(pairs)), N.consensus(edges, 2, 0, 0), N.average(edges, "weight"), metrics.clustering(nodes, edges), metrics.cycle_clustering(nodes, edges),
              metrics.node_transport(pairs), metrics.edge_transport(pairs), geometry.split_at_meridian(N.edge_places(edges, nodes)), nulls.rewire(edges, edges, 2), nulls.random_walks(C.track_ends(cat), edges, 2)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pagerank_without_edges_and_with_a_hub(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "coord_id long")
    none = spark.createDataFrame([], "orig long, dest long, weight double")
    assert {r.pagerank for r in metrics.pagerank(nodes, none, steps=2, tol=None).collect()} == {0.25}
    hub = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0)], "orig long, dest long, weight double")
    got = {r.coord_id: r.pagerank for r in metrics.pagerank(nodes, hub, steps=1, tol=None).collect()}
    spread = 0.85 * 0.75 / 4 + 0.15 / 4
    want = {0: spread, 1: spread + 0.85 / 16, 2: spread + 0.85 * 3 / 16, 3: spread}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_metrics_of_many_graphs_are_those_of_each(spark):
    import random

    r = random.Random(2)
    edges = [(g, a, b, float(r.randrange(1, 5))) for g in range(2) for a in range(8) for b in range(8) if a != b and r.random() < 0.3 + 0.3 * g]
    edges.append((2, 0, 1, 2.0))
    nodes = [(g, i) for g in range(3) for i in range(8 if g < 2 else 2)]
    e = spark.createDataFrame([(g, f"r{g}", a, b, w) for g, a, b, w in edges], "model long, realization string, orig long, dest long, weight double")
    n = spark.createDataFrame([(g, f"r{g}", i) for g, i in nodes], "model long, realization string, coord_id long")
    by = ["model", "realization"]
    many = {
        "pagerank": metrics.pagerank(n, e, tol=1e-2, every=2, by=by), "clustering": metrics.clustering(n, e, by), "cycle_clustering": metrics.cycle_clustering(n, e, by),
        "edge_betweenness": metrics.edge_betweenness(n, e, by=by),
    }
    for g in (0, 2):
        e1, n1 = e.where(f"model = {g}").drop(*by), n.where(f"model = {g}").drop(*by)
        one = {"pagerank": metrics.pagerank(n1, e1, tol=1e-2, every=2), "clustering": metrics.clustering(n1, e1), "cycle_clustering": metrics.cycle_clustering(n1, e1), "edge_betweenness": metrics.edge_betweenness(n1, e1)}
        for name, df in one.items():
            got = {tuple(x[:-1]): x[-1] for x in many[name].where(f"model = {g}").drop(*by).collect()}
            assert got == {tuple(x[:-1]): pytest.approx(x[-1], abs=1e-12) for x in df.collect()}, (g, name)


def test_betweenness_from_some_sources_adds_up(spark):
    edges = [(a, b, float(1 + (a * 7 + b * 3) % 4)) for a in range(6) for b in range(6) if a != b and (a + 2 * b) % 3] + [(0, 0, 9.0), (5, 7, 0.0)]
    n = spark.createDataFrame([(i,) for i in range(8)], "coord_id long")
    e = spark.createDataFrame(edges, "orig long, dest long, weight double")
    total = {}
    for part in ("coord_id < 2", "coord_id >= 2"):
        for r in metrics.edge_betweenness(n, e, normalised=False, sources=n.where(part)).collect():
            total[r.orig, r.dest] = total.get((r.orig, r.dest), 0) + r.edge_betweenness
    assert total == {(r.orig, r.dest): pytest.approx(r.edge_betweenness) for r in metrics.edge_betweenness(n, e, normalised=False).collect()}
    assert total[5, 7] == 0 and total[0, 0] == 0
    assert metrics.edge_betweenness(n.where("coord_id < 0"), e.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [True, False])
def test_betweenness_in_groups_is_that_in_rounds(spark, monkeypatch, weighted):
    """paths counted where a source's arcs meet, with ties, parallel arcs, cycles, nodes that lead nowhere and lists in pieces; ends of paths take no round."""
    rows = [(g, a, b, float(1 + (a * b + ord(g)) % 3)) for g in ("x", "y") for a in range(9) for b in range(12) if a != b and (3 * a + b * b + ord(g)) % 4 == 0]
    e = spark.createDataFrame([*rows, ("x", *rows[0][1:]), ("y", 20, 21, 0.0)], "g string, orig long, dest long, weight double")
    n = N.end_nodes(e, ["g"])
    run = lambda: {(r.g, r.orig, r.dest): r.edge_betweenness for r in metrics.edge_betweenness(n, e, weighted, by=["g"]).collect()}
    monkeypatch.setattr(paths, "LIST", 2)
    monkeypatch.setattr(paths, "GROUP", 7)
    names, real = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: names.append(name) or real(df, name))
    got = run()
    assert "shortest" not in names and got["y", 20, 21] == (0 if weighted else pytest.approx(1 / (n.where("g = 'y'").count() * (n.where("g = 'y'").count() - 1))))
    monkeypatch.setattr(paths, "ARCS", 0)
    want = run()
    assert "shortest" in names and got == {k: pytest.approx(x) for k, x in want.items()}


def test_sources_share_the_arcs_that_they_meet(monkeypatch):
    """an arc comes once for all sources of a group, 0 -> 2, 1 -> 2, 2 -> {3, 4} -> 5."""
    import pyarrow as pa

    near = pa.table({"v": [0, 1, 2, 2, 3, 4], "on": [[{"w": w, "len": 1.0}] for w in (2, 2, 3, 4, 5, 5)]})
    far = pa.table({"src": [0, 0, 0, 0, 1, 1, 1, 1], "v": [0, 2, 3, 4, 1, 2, 3, 4], "d": [0.0, 1.0, 2.0, 2.0, 0.0, 1.0, 2.0, 2.0]})
    for most in (1, 1_000_000):
        monkeypatch.setattr(paths, "SLICE", most)
        got = {(r["orig"], r["dest"]): r["_b"] for r in paths._counter([])(near, far).to_pylist()}
        assert got == {(0, 2): 4, (1, 2): 4, (2, 3): 3, (2, 4): 3, (3, 5): 1, (4, 5): 1}


@pytest.mark.parametrize("few", [1, 64])
def test_betweenness_of_some_groups_at_a_time(spark, monkeypatch, few):
    arcs = [(a, b, float(1 + (a * b) % 3)) for a in range(9) for b in range(12) if a != b and (3 * a + b * b) % 4 == 0]
    e = spark.createDataFrame(arcs, "orig long, dest long, weight double")
    run = lambda: {(r.orig, r.dest): r.edge_betweenness for r in metrics.edge_betweenness(N.end_nodes(e), e).collect()}
    want = run()
    monkeypatch.setattr(paths, "GROUP", 60)
    monkeypatch.setattr(paths, "TASKS", few)
    assert run() == {k: pytest.approx(x) for k, x in want.items()}


def test_large_gain_walks_once(spark, monkeypatch):
    """rates and flows of the network are found once, for the search and for the code lengths."""
    from types import SimpleNamespace

    from orbweave.plans import community_queries as Q

    arcs = [(a + k, b + k, 1.0) for k in (0, 10) for a in range(4) for b in range(4) if a != b] + [(3, 10, 1.0)]
    calls, real = [], Q.mapequation.random_walk
    monkeypatch.setattr(Q.mapequation, "random_walk", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(Q.mapequation, "LOCAL_LINKS", 5)  # by rounds of joins
    row = Q._large_gain(SimpleNamespace(trade=spark.createDataFrame(arcs, "orig long, dest long, weight double"))).first()
    assert tuple(row) == (8, True) and len(calls) == 1


def test_walks_take_many_steps_by_the_draws(spark):
    """A plain walk with the same draws, beyond one chunk of steps, also against the links."""
    import hashlib

    links = {(a, b): float(1 + (a + 2 * b) % 3) for a in range(7) for b in range(7) if a != b and (a * b + a) % 4 != 1}
    lattice = spark.createDataFrame([(*k, w) for k, w in links.items()], "orig long, dest long, weight double")
    tracks = spark.createDataFrame([(t, 3 + 5 * t, t % 7, (t + 3) % 7) for t in range(6)], "trackid long, n long, first long, last long")
    for end in (None, "last"):
        want = []
        for k in range(2):
            for t in range(6):
                at, path = ((t + 3) % 7 if end else t % 7), []
                for step in range(1, 3 + 5 * t + 1):
                    path.append(at)
                    near = sorted((b, w) if not end else (a, w) for (a, b), w in links.items() if (b if end else a) == at)
                    if not near:
                        break
                    u = int(hashlib.md5(f"4:{k}:{t}:{step}".encode()).hexdigest()[:13], 16) / 2**52 * sum(w for _, w in near)
                    run = 0.0
                    for c, w in near:
                        run += w
                        if run > u:
                            at = c
                            break
                path = path[: 3 + 5 * t]
                want += [(k, t, i + 1, c) for i, c in enumerate(path[::-1] if end else path)]
        assert sorted(map(tuple, nulls.random_walks(tracks, lattice, 2, end=end, seed=4).collect())) == sorted(want)


def test_quantiles_of_groups(spark):
    """Groups of very different size, a hot value, a group of unknown values only, weights; and with a grouping by two columns."""
    import numpy as np

    from orbweave.functions.running import quantiles

    r = np.random.default_rng(4)
    rows = [("a", 1, float(x)) for x in r.integers(0, 50, 3000)] + [("a", 2, 7.0)] * 500 + [("b", 1, float(x)) for x in r.normal(size=40)] + [("b", 2, None), ("b", 2, float("nan")), (None, 1, 1.5), (None, 1, 2.5)]
    df = spark.createDataFrame(rows, "g string, h long, v double").repartition(5)
    at = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(x.g, x.h): x.q for x in quantiles(df, "v", at, by=["g", "h"]).collect()}
    known = {}
    for g, h, v in rows:
        known.setdefault((g, h), []).extend([v] if v is not None and v == v else [])
    assert set(got) == set(known)
    for k, v in known.items():
        assert got[k] == (pytest.approx(np.quantile(v, at).tolist()) if v else [None] * 5)
    weighed = df.where("g = 'a'").groupBy("h", "v").count()
    assert {x.h: x.q for x in quantiles(weighed, "v", at, "count", ["h"]).collect()} == {h: pytest.approx(np.quantile(known["a", h], at).tolist()) for h in (1, 2)}


def test_groups_of_hubs_are_summed_before_they_meet(spark):
    """Totals of an origin or a community come from aggregates, not from windows that hold a hub in one task; NULL is a group too."""
    edges = spark.createDataFrame([("x", 0, i, 2.0) for i in range(1, 9)] + [(None, 0, 1, 1.0), (None, 0, 2, 3.0), ("x", 5, 6, 0.0)], "class string, orig long, dest long, weight double")
    prob = N.normalize_outgoing(edges, ["class"])
    assert sorted(((r["class"] or "", r.orig, r.dest, r.probability) for r in prob.collect())) == sorted([("x", 0, i, 0.125) for i in range(1, 9)] + [("", 0, 1, 0.25), ("", 0, 2, 0.75), ("x", 5, 6, 0.0)])
    relative = N.build_edges(edges.withColumnRenamed("weight", "cnt"), weighing="relative", by=["class"])
    assert relative.where("class = 'x'").agg(F.sum("weight")).first()[0] == pytest.approx(1) and relative.where("class IS NULL").count() == 2
    parts = spark.createDataFrame([(1, i, 7) for i in range(30)] + [(1, 30, 8), (2, 0, None)], "seed long, node long, community long")
    small = H.unassign_small(parts, 10)
    assert {(r.seed, r.community) for r in small.collect()} == {(1, 7), (1, -999), (2, -999)}
    levels = spark.createDataFrame([(0, i, 1) for i in range(20)] + [(1, i, 10 + i // 15) for i in range(20)], "level long, node long, community long")
    flagged = H.filter_small(levels, 10)
    assert {(r.level, r.node) for r in flagged.where("small").collect()} == {(1, i) for i in range(15, 20)}
    for df in (prob, relative, small):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    numbers = N.dense_index(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "cell long").repartition(7))
    assert {r.cell: r.idx for r in numbers.collect()} == {i: i for i in range(50)}
    assert "Window [row_number" not in numbers._jdf.queryExecution().optimizedPlan().toString()


def test_two_sample_p_values(spark):
    a, b = [1.0, 2.0, 2.0, 3.5, 9.0, 11.0], [2.0, 4.0, 5.0, 9.5, 12.0, 13.0, 14.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    d = max(abs(sum(x <= t for x in a) / 6 - sum(x <= t for x in b) / 7) for t in a + b)
    t = math.sqrt(42 / 13) * d
    r = stats.kolmogorov_smirnov(df, "v", "g", "a", "b").first()
    assert (r.statistic, r.p) == (pytest.approx(d), pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))
    r = stats.mann_whitney(df, "v", "g", "a", "b").first()
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), abs=1e-9)
    tails = spark.createDataFrame([(z,) for z in (0.0, 0.3, 1.96, 5.0, 11.9, 40.0)], "z double").select("z", stats.normal_tails(F.col("z")).alias("p"))
    assert all(x.p == pytest.approx(math.erfc(x.z / math.sqrt(2)), abs=1e-9) for x in tails.collect())
    assert tuple(stats.kolmogorov_smirnov(df.where("g = 'a'"), "v", "g", "a", "b").first()) == (None, None)
    assert stats.mann_whitney(df.where("g = 'a'"), "v", "g", "a", "b").first().z is None


def test_equal_earth_and_arcs(spark):
    seg = spark.createDataFrame([(1, -180.0, 0.0, 180.0, 0.0), (2, 0.0, 90.0, 0.0, -90.0), (3, 10.0, 20.0, 10.0, 20.0), (4, None, 0.0, 0.0, 0.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.id, r.step): r for r in geometry.projected_arcs(seg, 0.2, 4).collect()}
    assert len(got) == 20
    wide = 2.7066299836960748  # half of the map's width and height on the unit sphere
    assert got[1, 0].px == pytest.approx(-wide) and got[1, 4].px == pytest.approx(wide) and got[1, 2].px == pytest.approx(0)
    assert got[1, 2].py == pytest.approx(0.2 * wide) and got[1, 2].heading == pytest.approx(0)  # half way to the control point
    assert got[2, 0].py == pytest.approx(1.3173627591574133) and got[2, 4].py == pytest.approx(-1.3173627591574133)
    assert (got[3, 0].px, got[3, 0].py) == (got[3, 3].px, got[3, 3].py) and got[4, 2].px is None


def test_walks_in_pieces_and_by_joins_are_those_of_one_task(spark, monkeypatch):
    """Walks taken in their own tasks, in short pieces or by joins are the same, also on a lattice with a dead end; and one round of few plans does a whole walk."""
    links = [(a, b, 1.0 + (a * b) % 3) for a in range(6) for b in range(7) if a != b]
    lattice = spark.createDataFrame(links, "orig long, dest long, weight double")  # 6 leads nowhere
    tracks = spark.createDataFrame([(t, t, t % 7, (t + 2) % 7) for t in range(7)], "trackid long, n long, first long, last long")
    for end in ("last",):
        run = lambda: sorted(map(tuple, nulls.random_walks(tracks, lattice, 1, end=end, seed=5).collect()))  # noqa: B023, E731
        want = run()
        with monkeypatch.context() as m:
            m.setattr(nulls, "CHUNK", 3)
            assert run() == want
        with monkeypatch.context() as m:
            m.setattr(nulls.walk, "__defaults__", (0, 0))
            assert run() == want
    done = []
    real = nulls.written
    monkeypatch.setattr(nulls, "written", lambda df, name: done.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join"))) or real(df, name))
    long = spark.createDataFrame([(1, 80, 1, 1)], "trackid long, n long, first long, last long")
    assert nulls.random_walks(long, lattice.where("dest < 6"), 2, seed=5).count() == 160
    assert [joins <= 5 for name, joins in done if name == "walk"] == [True]  # sixteen joins a round, six rounds before


def test_null_models_read_the_catalog_few_times(spark, monkeypatch):
    """F8, F9: the tracks are read once for three models, the network once for all uses, whatever the plans that follow."""
    from orbweave.plans import community_queries as Q
    from orbweave.plans import ensembles
    from orbweave.plans.fixtures import Fixtures

    path, scans = "/root/testdata/sf0.001", []
    if not os.path.isdir(path):
        pytest.skip("test tables are absent")
    plans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("event_id")
    for module in (nulls, ensembles, Q):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, real=real: scans.append((name, plans(df))) or real(df, name))
    Q._graphs(Fixtures(spark, path), 2)
    assert {name for name, n in scans if n} == {"tracks", "edges"}
    scans.clear()
    Q._walked(Fixtures(spark, path), start=None)
    assert {name for name, n in scans if n} == {"lattice", "walk"}


def test_walkers_of_names_and_of_both_ways_share_a_batch(spark):
    """Cells of any type, ways that only one cell has, and walkers that begin off the lattice or have no steps left."""
    lattice = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 2.0)], "orig string, dest string, weight double")
    walkers = spark.createDataFrame([(1, 9, 1, "a"), (2, 9, -1, "c"), (3, 9, 1, "z"), (4, 1, 1, "b"), (5, 3, 1, "b"), (6, 9, -1, "a")], "id long, n long, way int, cell string").coalesce(1)
    got = {r.id: r.cells for r in nulls.walk(walkers, nulls.ways_on(lattice, [1, -1]), ["id"]).collect()}
    assert got == {1: ["a", "b", "c", "d"], 2: ["c", "b", "a"], 3: ["z"], 4: ["b"], 5: ["b", "c", "d"], 6: ["a"]}


def test_tracks_of_equal_values_are_of_one_class(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last place, and the median lies between them."""
    values = {0: [0.0, 0.0], 1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [1.0, 1.0]}
    df = spark.createDataFrame([(t, i, x) for t, xs in values.items() for i, x in enumerate(xs)], "trackid long, seq long, x double")
    got = dict(map(tuple, C.feature_classes(df.coalesce(1), "x", True, 2)[0].select("trackid", "class").distinct().collect()))
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


def test_some_edges_lack_the_attribute_on_tables_of_any_size(spark):
    """On large tables every edge weighs more than 5."""
    from orbweave.plans import network_queries as Q
    from orbweave.plans.fixtures import Fixtures

    fx = Fixtures(spark, "")
    fx._made["fx_cells"] = spark.createDataFrame([(c, 0.0, 0.0, "Sea") for c in (1, 2, 3)], "cell long, lat double, lon double, continent string")
    fx._made["fx_edges"] = spark.createDataFrame([(n, 1, d, 90.0 + d + n) for n in (0, 1) for d in (2, 3)], "net long, orig long, dest long, weight double")
    assert N.average_networks(Q._gaps(fx, 0), Q._gaps(fx, 1), "x").edges.columns == ["orig", "dest", "weight", "edge_betweenness"]


def test_hubs_that_own_no_tie_form_no_wedges(spark):
    """Many nodes that share a pair of hubs without a tie between them: no wedge, and the ties are counted once."""
    arcs = [(i, h, 1.0) for i in range(10, 60) for h in (1, 2)] + [(10, 11, 1.0), (11, 10, 1.0)]
    edges = spark.createDataFrame(arcs, "orig long, dest long, weight double")
    ties, tri = metrics._triangles(edges)
    assert sorted(tuple(r) for r in tri.select("a", "b", "c", "ab", "ac", "bc").collect()) == [(10, 11, 1, 2, 1, 1), (10, 11, 2, 2, 1, 1)]
    assert "left_semi" in tri._jdf.queryExecution().analyzed().toString().lower().replace("leftsemi", "left_semi")
    assert {(r.u, r.v): r.m for r in ties.collect()}[(10, 11)] == 2
    ends = metrics.degree_centrality(None, edges).collect()
    assert {r.coord_id: r.degree for r in ends} == {r.coord_id: r.degree for r in metrics.degree_centrality(N.end_nodes(edges), edges).collect()}


def test_shuffles_of_a_written_step_are_gone(spark):
    """Wedges move as one row for two ends, and what a written table was shuffled through goes with the write."""
    import os
    from orbweave.sources import scratch

    def shuffled():
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
        return sum(n.startswith("shuffle_") for _, _, names in os.walk(folder) for n in names)

    was = spark.conf.get(scratch._CLEANUP)
    before = shuffled()
    scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffled() <= before and spark.conf.get(scratch._CLEANUP) == was
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(8) for b in range(a)], "orig long, dest long, weight double")
    _, tri = metrics._triangles(edges)
    assert tri.count() == 56 and "array_intersect" in tri._jdf.queryExecution().analyzed().toString()


def test_a_place_is_encoded_once(spark):
    """Rows of one place are counted before the place is encoded."""
    from orbweave.plans import community_queries as Q
    from orbweave.plans.fixtures import Fixtures

    fx = Fixtures(spark, "")
    fx._made["fx_catalog_a"] = spark.createDataFrame([(10.0, 20.0, r, 1.0) for r in "aab" * 5], "centroid_lat double, centroid_lon double, regime string, mean_ivt double")
    plan = Q._regimes(fx)._jdf.queryExecution().optimizedPlan().toString()
    assert [line.strip().split("[")[1].split("#")[0] for line in plan.splitlines() if "Aggregate" in line][-1] == "centroid_lat"
    assert [r.community for r in Q._regimes(fx).collect()] == ["a"]
