"""Queries over communities, null ensembles and statistics, and the composite pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import catalog as C
from ..operators import climate, icosphere, mapequation, metrics, nulls, stats
from ..operators import community as H
from ..operators import network as N
from ..sources import tables
from ..sources.scratch import written
from . import ensembles, oracles, pipelines
from .network_queries import GRID, net0, sphere_cell, places
from .registry import register

_P = "SELECT * FROM fx_partitions"
_ANY = "p AS (SELECT * FROM fx_partitions), sz AS (SELECT seed, community, count(*) AS n FROM p GROUP BY 1, 2)"
_SET = "p AS (SELECT * FROM fx_partitions WHERE community <> -999), sz AS (SELECT seed, community, count(*) AS n FROM p GROUP BY 1, 2)"
_CT = """ct AS (SELECT a.seed AS s1, a.community AS c1, b.seed AS s2, b.community AS c2, count(*) AS n FROM p a JOIN p b USING (node) WHERE a.seed <> b.seed GROUP BY 1, 2, 3, 4),
         jc AS (SELECT s1, c1, s2, c2, ct.n / (x.n + y.n - ct.n) AS j FROM ct JOIN sz x ON x.seed = s1 AND x.community = c1 JOIN sz y ON y.seed = s2 AND y.community = c2),
         nj AS (SELECT a.node, a.seed AS s1, a.community AS c1, b.seed AS s2, j FROM p a JOIN p b USING (node) JOIN jc ON jc.s1 = a.seed AND jc.c1 = a.community AND jc.s2 = b.seed AND jc.c2 = b.community)"""

register("F14_small_unassigned", lambda fx: H.unassign_small(fx.partitions, 12), "SELECT seed, node, CASE WHEN count(*) OVER (PARTITION BY seed, community) < 12 THEN -999 ELSE community END AS community FROM fx_partitions")
register("F17_both_assigned", lambda fx: H.both_assigned(fx.partitions.select("node", F.col("seed").alias("s1"), F.col("community").alias("a")).join(fx.partitions.select("node", F.col("seed").alias("s2"), F.col("community").alias("b")), "node").where("s1 < s2"), "a", "b").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")),
         "SELECT x.seed AS s1, y.seed AS s2, count(*) AS n FROM fx_partitions x JOIN fx_partitions y USING (node) WHERE x.seed < y.seed AND x.community <> -999 AND y.community <> -999 GROUP BY 1, 2")
register("H1_communities", lambda fx: H.communities(fx.nodes, net0(fx), (1, 2, 3)))
register("H2_hierarchical", lambda fx: H.hierarchical_communities(fx.nodes, net0(fx)))
register("H3_filter_small_levels", lambda fx: H.filter_small(fx.levels, 7), "WITH s AS (SELECT *, (count(*) OVER (PARTITION BY level, community) < 7)::INT AS x FROM fx_levels) SELECT level, node, community, CAST(max(x) OVER (PARTITION BY node ORDER BY level) AS BIGINT) AS small FROM s")
_MF = "mf AS (SELECT a.level, a.community AS c1, b.community AS c2, sum(flow) AS flow FROM fx_flow JOIN fx_levels a ON a.node = src JOIN fx_levels b ON b.node = dst AND b.level = a.level GROUP BY 1, 2, 3), tt AS (SELECT level, c2 AS c, sum(flow) AS total FROM mf GROUP BY 1, 2)"
register("H4_J9_module_flow", lambda fx: H.module_flow(fx.levels, fx.flow)[0], f"WITH {_MF} SELECT level, c1, c2, round(flow, 6) AS flow FROM mf")
register("H4_module_totals", lambda fx: H.module_flow(fx.levels, fx.flow)[1], f"WITH {_MF} SELECT level, c, round(total, 6) AS total FROM tt")
register("H5_W4_filter_by_flow", lambda fx: H.filter_by_flow(fx.levels, H.module_flow(fx.levels, fx.flow)[1], 0.7),
         f"""WITH {_MF}, k AS (SELECT level, c, (sum(total) OVER (PARTITION BY level ORDER BY total DESC, c) - total) / sum(total) OVER (PARTITION BY level) < 0.7 AS keep FROM tt),
             o AS (SELECT l.level, node, community, max((NOT coalesce(keep, false))::INT) OVER (PARTITION BY node ORDER BY l.level) AS gone FROM fx_levels l LEFT JOIN k ON k.level = l.level AND c = community)
             SELECT level, node, CASE WHEN gone = 1 THEN -999 ELSE community END AS community FROM o""")  # fmt: skip
_modules = lambda fx: fx.levels.where("level = 0").select("node", "community")
_M0 = "m AS (SELECT node, community FROM fx_levels WHERE level = 0), f AS (SELECT a.community AS c1, b.community AS c2, flow FROM fx_flow JOIN m a ON a.node = src JOIN m b ON b.node = dst)"
register("H6_flow_ratio", lambda fx: H.flow_ratio(fx.flow, _modules(fx)), f"WITH {_M0} SELECT c1 AS community, round(sum(flow) FILTER (c1 = c2) / nullif(sum(flow) FILTER (c1 <> c2), 0), 6) AS ratio FROM f GROUP BY 1")
register("H7_jaccard", lambda fx: H.set_jaccard(fx.partitions), f"WITH {_ANY}, {_CT} SELECT s1, c1, s2, c2, round(j, 6) AS jaccard FROM jc")
_sets = lambda fx: fx.partitions.where("community <> -999").groupBy(F.col("community").alias("group"), F.col("seed").alias("i")).agg(F.sort_array(F.collect_list("node")).alias("members"))
register("H8_mean_similarity", lambda fx: H.mean_set_similarity(_sets(fx)), """WITH s AS (SELECT community AS g, seed AS i, list(node) AS m FROM fx_partitions WHERE community <> -999 GROUP BY 1, 2)
         SELECT x.g AS "group", round(avg(len(list_intersect(x.m, y.m)) / len(list_distinct(list_concat(x.m, y.m)))), 6) AS mean FROM s x JOIN s y ON x.g = y.g AND x.i < y.i GROUP BY 1""")  # fmt: skip
register("H9_heterogeneity", lambda fx: H.heterogeneity(fx.partitions), f"WITH {_ANY}, {_CT}, k AS (SELECT node, max(community) AS mx FROM p GROUP BY 1), h AS (SELECT node, 1 - avg(j) AS h FROM nj WHERE s1 < s2 GROUP BY 1) SELECT node, CASE WHEN mx <> -999 THEN round(h, 6) END AS heterogeneity FROM k LEFT JOIN h USING (node)")
_BEST = "mj AS (SELECT node, s1, c1, round_even(avg(j), 12) AS m FROM nj GROUP BY 1, 2, 3), sc AS (SELECT p.node, seed, community, coalesce(m, -1) AS m FROM p LEFT JOIN mj ON mj.node = p.node AND s1 = seed), best AS (SELECT node, seed, community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY m DESC, seed) AS k FROM sc) WHERE k = 1)"
register("H10_most_consistent", lambda fx: H.most_consistent(fx.partitions), f"WITH {_SET}, {_CT}, {_BEST} SELECT * FROM best")
register("H11_consensus_communities", lambda fx: H.consensus_communities(fx.partitions),
         f"""WITH {_SET}, {_CT}, {_BEST}, mem AS (SELECT seed, community, list(node ORDER BY node) AS ms FROM p GROUP BY 1, 2), kn AS (SELECT node, ms FROM best JOIN mem USING (seed, community)),
             fi AS (SELECT ms, row_number() OVER (ORDER BY min(node)) AS id FROM kn GROUP BY 1), al AS (SELECT DISTINCT node FROM fx_partitions)
             SELECT node, coalesce(id, -999) AS community FROM al LEFT JOIN kn USING (node) LEFT JOIN fi USING (ms)""")  # fmt: skip
register("H12_realisation_centrality", lambda fx: H.realisation_centrality(fx.partitions), f"WITH {_ANY}, {_CT}, d AS (SELECT s1 AS seed, node, 1 - avg(j) AS d FROM nj GROUP BY 1, 2), c AS (SELECT seed, avg(d) AS c FROM d GROUP BY 1) SELECT seed, round(c, 6) AS centrality, CAST(row_number() OVER (ORDER BY round_even(c, 12), seed) = 1 AS BIGINT) AS best FROM c")
register("H13_A8_pick_seed", lambda fx: H.pick_seed(fx.partitions, H.heterogeneity(fx.partitions)),
         f"""WITH {_ANY}, {_CT}, k AS (SELECT node, max(community) AS mx FROM p GROUP BY 1), h AS (SELECT node, 1 - avg(j) AS h FROM nj WHERE s1 < s2 GROUP BY 1), het AS (SELECT node, CASE WHEN mx <> -999 THEN h END AS h FROM k LEFT JOIN h USING (node)),
             per AS (SELECT seed, community, avg(h) AS m, count(*) AS n FROM p JOIN het USING (node) GROUP BY 1, 2), sc AS (SELECT seed, CASE WHEN count(m) = count(*) THEN sum(m * n) / sum(n) END AS score FROM per GROUP BY 1)
             SELECT seed, round(score, 6) AS score, CAST(coalesce(row_number() OVER (ORDER BY round_even(score, 12) NULLS LAST, seed) = 1 AND score IS NOT NULL, false) AS BIGINT) AS best FROM sc""")  # fmt: skip
register("H14_node_flow_ratios", lambda fx: H.node_flow_ratios(net0(fx), _modules(fx)), "WITH m AS (SELECT node, community FROM fx_levels WHERE level = 0), r AS (SELECT a.community, sum(weight) FILTER (a.community = b.community) / sum(weight) AS ratio FROM fx_edges JOIN m a ON a.node = orig JOIN m b ON b.node = dest WHERE net = 0 GROUP BY 1) SELECT node, round(ratio, 6) AS ratio FROM m LEFT JOIN r USING (community)")
register("H15_relabel_dense", lambda fx: H.relabel_dense(fx.partitions), "SELECT seed, node, dense_rank() OVER (PARTITION BY seed ORDER BY community) - 1 AS community FROM fx_partitions")
register("H16_seed_ensemble", lambda fx: H.unassign_small(H.relabel_dense(H.communities(fx.nodes, net0(fx), (1, 2, 3, 4))), 2))
_ARI = """WITH p AS (SELECT * FROM fx_partitions WHERE community <> -999), c AS (SELECT a.seed AS s1, b.seed AS s2, a.community AS c1, b.community AS c2, count(*) AS n FROM p a JOIN p b USING (node) WHERE a.seed < b.seed GROUP BY 1, 2, 3, 4),
            x AS (SELECT s1, s2, sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM c GROUP BY 1, 2), a AS (SELECT s1, s2, sum(n * (n - 1) / 2) AS a FROM (SELECT s1, s2, c1, sum(n) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
            b AS (SELECT s1, s2, sum(n * (n - 1) / 2) AS b FROM (SELECT s1, s2, c2, sum(n) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
            SELECT s1, s2, round((x - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM x JOIN a USING (s1, s2) JOIN b USING (s1, s2)"""
register("H17_J13_adjusted_rand", lambda fx: H.adjusted_rand(fx.partitions), _ARI)
register("H18_adjusted_mutual_info", lambda fx: H.adjusted_mutual_info(fx.partitions), oracles.ADJUSTED_INFORMATION)


def _regimes(fx):
    """The regime that most steps in a cell of the sphere have; of several the first by name."""
    return places(fx, "regime").groupBy(sphere_cell(0).alias("cell"), "regime").agg(F.sum("n").alias("n")).groupBy("cell").agg(F.min_by("regime", F.struct(-F.col("n"), "regime")).alias("community"))


register("H19_boundary_sides", lambda fx: H.boundary_cells(_regimes(fx).withColumnRenamed("cell", "node"), GRID.sides(_regimes(fx)).select(F.col("cell").alias("node"), "neighbour")), oracles.ICO_SIDES)
register("H19_outlines", lambda fx: icosphere.ring_areas(icosphere.outlines(GRID, _regimes(fx))), oracles.ICO_OUTLINES)
_LOG = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"
register("H_codelength", lambda fx: H.codelength(_rates(fx), fx.flow, _modules(fx)),
         f"""WITH {_M0}, ra AS (SELECT src AS node, sum(flow) AS rate FROM fx_flow GROUP BY 1), q AS (SELECT c1 AS community, coalesce(sum(flow) FILTER (c1 <> c2), 0) AS q FROM f GROUP BY 1),
             i AS (SELECT community, sum(rate) AS p, sum({_LOG.format('rate')}) AS e FROM ra JOIN m USING (node) GROUP BY 1), t AS (SELECT coalesce(q, 0) AS q, p, e FROM i LEFT JOIN q USING (community)), s AS (SELECT sum(q) AS qq, sum({_LOG.format('q')}) AS hq, sum(e) AS e, sum({_LOG.format('(q + p)')}) AS hqp FROM t)
             SELECT round({_LOG.format('qq')} - 2 * hq - e + hqp, 6) AS codelength FROM s""")  # fmt: skip


def _rates(fx):
    return fx.flow.groupBy(F.col("src").alias("node")).agg(F.sum("flow").alias("rate"))


register("S12_flow_tree", lambda fx: tables.flow_tree(fx.levels, _rates(fx)), "WITH p AS (SELECT node, string_agg(CAST(community AS VARCHAR), ':' ORDER BY level) AS path FROM fx_levels GROUP BY 1), ra AS (SELECT src AS node, sum(flow) AS rate FROM fx_flow GROUP BY 1) SELECT printf('%s %.9f \"%s\" %s', path, rate, CAST(node AS VARCHAR), CAST(node AS VARCHAR)) AS value FROM p JOIN ra USING (node)")


def _gain(fx):
    """Nodes with a module, and whether the modules found describe the walk in no more bits than one module of all nodes."""
    found = H.communities(fx.nodes, net0(fx), (1,)).select("node", "community")
    flow = fx.flow
    one = H.codelength(_rates(fx), flow, found.withColumn("community", F.lit(0).cast("long"))).withColumnRenamed("codelength", "one")
    best = H.codelength(_rates(fx), flow, found)
    return found.agg(F.count(F.lit(1)).alias("nodes")).join(best, F.lit(True)).join(one, F.lit(True)).select("nodes", (F.col("codelength") <= F.col("one") + 1e-9).alias("better"))


register("H1_codelength_gain", _gain, "SELECT count(*) AS nodes, CAST(1 AS BIGINT) AS better FROM fx_cells")


def _large_gain(fx):
    """The same on the network that grows with the tables, too large for one task at most sizes."""
    trade = written(fx.trade, "trade")
    nodes = written(N.end_nodes(trade), "nodes")
    rates, flow = mapequation.random_walk(nodes, trade)
    found = written(H.communities(nodes, trade, (1,), walk=(rates, flow)).select("node", "community"), "found")
    one = H.codelength(rates, flow, found.withColumn("community", F.lit(0).cast("long"))).withColumnRenamed("codelength", "one")
    return found.agg(F.count(F.lit(1)).alias("nodes")).join(H.codelength(rates, flow, found), F.lit(True)).join(one, F.lit(True)).select("nodes", (F.col("codelength") < F.col("one")).alias("better"))


register("H1_large_network", _large_gain, "SELECT count(*) AS nodes, CAST(1 AS BIGINT) AS better FROM (SELECT orig FROM fx_trade UNION SELECT dest FROM fx_trade) n")
_nested = lambda fx: fx.cells.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("level"), F.floor(F.col("cell") / 10).alias("community")), F.struct(F.lit(1).cast("long").alias("level"), (F.floor(F.col("cell") / 5) + 100).alias("community")))).alias("x"), F.col("cell").alias("node")).select("x.level", "node", "x.community")
register("H2_codelength", lambda fx: mapequation.hierarchical_codelength(_rates(fx), fx.flow, _nested(fx)),
         f"""WITH v AS (SELECT 0 AS level, cell AS node, floor(cell / 10) AS c FROM fx_cells UNION ALL SELECT 1, cell, floor(cell / 5) + 100 FROM fx_cells), ra AS (SELECT src AS node, sum(flow) AS rate FROM fx_flow GROUP BY 1),
             q AS (SELECT a.level, a.c, sum(flow) AS q FROM fx_flow JOIN v a ON a.node = src JOIN v b ON b.node = dst AND b.level = a.level WHERE a.c <> b.c GROUP BY 1, 2),
             t AS (SELECT level, c, coalesce(q, 0) AS q, p, e FROM (SELECT level, c, sum(rate) AS p, sum({_LOG.format('rate')}) AS e FROM v JOIN ra USING (node) GROUP BY 1, 2) i LEFT JOIN q USING (level, c)),
             u AS (SELECT DISTINCT a.c AS up, b.c AS c FROM v a JOIN v b ON a.node = b.node AND a.level = 0 AND b.level = 1), k AS (SELECT up FROM u GROUP BY 1 HAVING count(*) > 1),
             x AS (SELECT up, sum(q) AS s, sum({_LOG.format('q')}) AS h FROM u JOIN k USING (up) JOIN t ON t.c = u.c AND level = 1 GROUP BY 1),
             b AS (SELECT {_LOG.format('sq')} - hq AS b FROM (SELECT sum(q) AS sq, sum({_LOG.format('q')}) AS hq FROM t WHERE level = 0) z
                   UNION ALL SELECT {_LOG.format('(q + s)')} - {_LOG.format('q')} - h FROM x JOIN t ON t.c = up AND level = 0 UNION ALL SELECT {_LOG.format('(q + p)')} - {_LOG.format('q')} - e FROM t WHERE level = 1)
             SELECT round(sum(b), 6) AS codelength FROM b""")  # fmt: skip


def _nesting(fx):
    """Nodes at the top, whether each module lies in one of the level above, and whether the tree takes no more bits than one module."""
    tree = written(H.hierarchical_communities(fx.nodes, net0(fx)), "tree")
    up = tree.select((F.col("level") + 1).alias("level"), "node", F.col("community").alias("above"))
    apart = tree.join(up, ["level", "node"]).groupBy("level", "community").agg(F.count_distinct("above").alias("k")).agg(F.coalesce(F.max("k"), F.lit(1)).alias("k"))
    rates, flow = mapequation.random_walk(fx.nodes, net0(fx))
    one = H.codelength(rates, flow, tree.where("level = 0").select("node", F.lit(0).cast("long").alias("community"))).withColumnRenamed("codelength", "one")
    top = tree.where("level = 0").agg(F.count(F.lit(1)).alias("nodes"))
    return top.join(apart, F.lit(True)).join(mapequation.hierarchical_codelength(rates, flow, tree), F.lit(True)).join(one, F.lit(True)).select("nodes", (F.col("k") == 1).alias("nested"), (F.col("codelength") <= F.col("one") + 1e-9).alias("better"))


register("H2_nesting", _nesting, "SELECT count(*) AS nodes, CAST(1 AS BIGINT) AS nested, CAST(1 AS BIGINT) AS better FROM fx_cells")
_flows = lambda fx: H.module_flow(fx.levels.where("level = 0"), fx.flow)[0].select("c1", "c2", "flow")
register("M12_module_graph", lambda fx: metrics.module_graph(_flows(fx), 0.3)[1],
         f"""WITH {_M0}, g AS (SELECT c1, c2, sum(flow) AS flow FROM f GROUP BY 1, 2), ids AS (SELECT c1 AS c FROM g UNION SELECT c2 FROM g), al AS (SELECT a.c AS c1, b.c AS c2, coalesce(flow, 0) AS flow FROM ids a CROSS JOIN ids b LEFT JOIN g ON c1 = a.c AND c2 = b.c),
             q AS (SELECT quantile_cont(flow, 0.3) AS q FROM al) SELECT c1, c2, round(flow, 6) AS flow FROM g, q WHERE c1 <> c2 AND flow > q""")  # fmt: skip
register("M13_O2_conductance", lambda fx: metrics.conductance(_flows(fx), 20), f"WITH {_M0}, c AS (SELECT c1 AS c, coalesce(sum(flow) FILTER (c1 <> c2), 0) / sum(flow) AS x FROM f GROUP BY 1) SELECT c, round(x, 6) AS conductance, row_number() OVER (ORDER BY x DESC, c) AS rank FROM c ORDER BY rank LIMIT 20")

# null ensembles and statistics
_real = lambda fx: fx.cells.select("cell", (F.col("cell") * 37 % 100).cast("double").alias("metric"))
_RE = "re AS (SELECT cell, CAST(cell * 37 % 100 AS DOUBLE) AS metric FROM fx_cells)"
_P1 = f"{_RE}, pv AS (SELECT n.cell, model, (count(*) FILTER (n.metric >= re.metric) + 1) / (count(*) + 1) AS p FROM fx_null n JOIN re USING (cell) GROUP BY 1, 2)"
_BH = "ra AS (SELECT *, p * count(*) OVER (PARTITION BY cell) / row_number() OVER (PARTITION BY cell ORDER BY p, model) AS a FROM pv), bh AS (SELECT cell, model, p, least(1.0, min(a) OVER (PARTITION BY cell ORDER BY p DESC, model DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM ra)"
_one = lambda fx: stats.p_values(_real(fx), fx.null, "metric")
register("N6_J2_one_sided_p", _one, f"WITH {_P1} SELECT cell, model, round(p, 6) AS p FROM pv")
register("N7_two_sided_p", lambda fx: stats.p_values(_real(fx), fx.null, "metric", True), f"WITH {_RE}, mu AS (SELECT cell, model, avg(metric) AS mu FROM fx_null GROUP BY 1, 2) SELECT n.cell, n.model, round((count(*) FILTER (abs(n.metric - mu) >= abs(re.metric - mu) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM fx_null n JOIN re USING (cell) JOIN mu ON mu.cell = n.cell AND mu.model = n.model GROUP BY 1, 2")
_adj = lambda fx: stats.significant(stats.benjamini_hochberg(_one(fx)), alpha=0.4)
register("N8_benjamini_hochberg", lambda fx: stats.benjamini_hochberg(_one(fx)), f"WITH {_P1}, {_BH} SELECT cell, model, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM bh")
register("N9_significant", lambda fx: _adj(fx).select("cell", "model", "significant"), f"WITH {_P1}, {_BH} SELECT cell, model, CAST(p_adj < 0.4 AS BIGINT) AS significant FROM bh")
_W = "w AS (SELECT cell, bool_or(p_adj < 0.4) FILTER (model = 1) AS s1, bool_or(p_adj < 0.4) FILTER (model = 2) AS s2, bool_or(p_adj < 0.4) FILTER (model = 3) AS s3, bool_or(p_adj < 0.4) FILTER (model = 4) AS s4 FROM bh GROUP BY 1)"
register("N10_populations", lambda fx: stats.populations(stats.wide_flags(_adj(fx))).select("cell", *[f"pop{i}" for i in range(5)]), f"WITH {_P1}, {_BH}, {_W} SELECT cell, (NOT s1)::INT::BIGINT AS pop0, s1::INT::BIGINT AS pop1, (s1 AND s4)::INT::BIGINT AS pop2, (s1 AND s4 AND s2)::INT::BIGINT AS pop3, (s1 AND s2 AND s3 AND s4)::INT::BIGINT AS pop4 FROM w")
register("N11_raw_flags", lambda fx: stats.significant(_one(fx), "p", 0.3).select("cell", "model", "significant"), f"WITH {_P1} SELECT cell, model, CAST(p < 0.3 AS BIGINT) AS significant FROM pv")
register("N12_kde", lambda fx: stats.kde(fx.pairs.select((F.col("dest_ivt") - F.col("orig_ivt")).alias("d")), "d", -100, 100, 41),
         "WITH s AS (SELECT dest_ivt - orig_ivt AS d FROM fx_pairs), h AS (SELECT stddev_samp(d) * pow(count(*), -0.2) AS h, count(*) AS n FROM s) SELECT CAST(i AS BIGINT) AS i, CAST(-100 + 5 * i AS DOUBLE) AS x, round(sum(exp(-pow((-100 + 5 * i - d) / h, 2) / 2)) / (max(h) * max(n) * sqrt(2 * pi())), 6) AS density FROM s, h, unnest(range(0, 41)) AS t(i) GROUP BY 1, 2")
register("N13_histogram", lambda fx: stats.histogram(fx.catalog_a, "mean_ivt", 100), "WITH r AS (SELECT min(mean_ivt) AS a, max(mean_ivt) AS b FROM fx_catalog_a), k AS (SELECT CAST(least(99, floor((mean_ivt - a) * 100 / (b - a))) AS BIGINT) AS bin, a, b FROM fx_catalog_a, r) SELECT bin, round(a + bin * (b - a) / 100, 6) AS low, count(*) AS n FROM k GROUP BY bin, a, b")
_two = lambda fx: fx.catalog_a.select(F.col("mean_ivt").alias("v"), (F.col("trackid") % 2).alias("g"))
_EC = """v AS (SELECT mean_ivt AS v, trackid % 2 AS g FROM fx_catalog_a), d AS (SELECT v, count(*) FILTER (g = 0) AS na, count(*) FILTER (g = 1) AS nb FROM v GROUP BY 1),
         ec AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, na, nb, sum(na) OVER (ORDER BY v) AS ca, sum(nb) OVER (ORDER BY v) AS cb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM d)"""
register("N14_wasserstein", lambda fx: stats.wasserstein(_two(fx), "v", "g", 0, 1), f"WITH {_EC}, s AS (SELECT var_pop(v) FILTER (g = 0) AS va, var_pop(v) FILTER (g = 1) AS vb FROM v) SELECT round((SELECT sum(abs(ca / ta - cb / tb) * (nx - v)) FROM ec) / sqrt((va + vb) / 2), 6) AS distance FROM s")
register("N15_kolmogorov_smirnov", lambda fx: stats.kolmogorov_smirnov(_two(fx), "v", "g", 0, 1),
         f"WITH {_EC}, kd AS (SELECT max(abs(ca / ta - cb / tb)) AS d, sqrt(max(ta) * max(tb) / (max(ta) + max(tb))) AS s FROM ec) SELECT round(d, 6) AS statistic, round(CASE WHEN s * d > 0.2 THEN least(1, greatest(0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * s * d * s * d)) FROM range(1, 101) AS r(k)))) ELSE 1 END, 6) AS p FROM kd")
register("N16_mann_whitney", lambda fx: stats.mann_whitney(_two(fx), "v", "g", 0, 1),
         f"""WITH {_EC}, r AS (SELECT CAST(sum((ca + cb - (na + nb) + (na + nb + 1) / 2) * na) AS DOUBLE) AS r, CAST(max(ta) AS DOUBLE) AS na, CAST(max(tb) AS DOUBLE) AS nb, CAST(sum(pow(na + nb, 3) - (na + nb)) AS DOUBLE) AS t FROM ec),
             u AS (SELECT *, r - na * (na + 1) / 2 AS u, na + nb AS n FROM r), z AS (SELECT u, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM u),
             g AS (SELECT sum((CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i * greatest(z, 0) / 1000, 2) / 2)) * max(greatest(z, 0)) / 3000 AS g FROM z, range(0, 1001) AS t(i))
             SELECT round(u, 6) AS u, round(z, 6) AS z, round(CASE WHEN z > 12 THEN 0 ELSE least(1, greatest(0, 1 - 2 * g / sqrt(2 * pi()))) END, 6) AS p FROM z, g""")  # fmt: skip
register("N17_A4_group_median", lambda fx: stats.group_median(fx.catalog_a, "mean_ivt", "regime"), "SELECT regime, round(quantile_cont(mean_ivt, 0.5), 6) AS median FROM fx_catalog_a GROUP BY 1")
register("N18_percentile", lambda fx: stats.group_percentile(fx.null, "metric", 0.95, "model"), "SELECT model, round(quantile_cont(metric, 0.95), 6) AS q FROM fx_null GROUP BY 1")
register("N19_summary", lambda fx: stats.summary(fx.catalog_a, "mean_ivt", "regime"), "SELECT regime, round(avg(mean_ivt), 6) AS mean, round(var_pop(mean_ivt), 6) AS \"var\", round(quantile_cont(mean_ivt, 0.25), 6) AS q25, round(quantile_cont(mean_ivt, 0.75), 6) AS q75, round(quantile_cont(mean_ivt, 0.75) - quantile_cont(mean_ivt, 0.25), 6) AS iqr FROM fx_catalog_a GROUP BY 1")
_lattice = lambda fx: net0(fx)
_tracks = lambda fx: C.track_ends(fx.catalog_a.where("coord_idx IS NOT NULL"))


def _walked(fx, **how):
    """Length, ends and steps off the lattice of each walk."""
    lattice = written(_lattice(fx), "lattice")  # a pass over the events
    walks = nulls.random_walks(_tracks(fx), lattice, 2, **how)
    steps = walks.withColumn("to", F.lead("coord_idx").over(Window.partitionBy("realization", "trackid").orderBy("seq")))
    known = lattice.select(F.col("orig").alias("coord_idx"), F.col("dest").alias("to"), F.lit(1).alias("on"))
    ends = lambda f: f("coord_idx", "seq")
    return steps.join(known, ["coord_idx", "to"], "left").groupBy("realization", "trackid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("to").isNotNull() & F.col("on").isNull()).alias("off"), ends(F.min_by).alias("first"), ends(F.max_by).alias("last"))


_WALK = "SELECT CAST(r AS BIGINT) AS realization, trackid, count(*) AS n, CAST(0 AS BIGINT) AS off{} FROM fx_catalog_a, unnest([0, 1]) AS t(r) WHERE coord_idx IS NOT NULL GROUP BY 1, 2"
register("N2_free_walks", lambda fx: _walked(fx, start=None).drop("first", "last"), _WALK.format(""))
register("N3_genesis_walks", lambda fx: _walked(fx).drop("last"), _WALK.format(", arg_min(coord_idx, seq) AS first"))
register("N3_termination_walks", lambda fx: _walked(fx, end="last").drop("first"), _WALK.format(", arg_max(coord_idx, seq) AS last"))
_grid = lambda fx: fx.cells.select("cell", F.floor(F.col("cell") / 5).alias("i"), (F.col("cell") % 5).alias("j"))


def _rewired(fx):
    """Weight of each origin's rewired edges, and how many end beyond two steps of a lattice of neighbouring cells or at their origin."""
    a, b = (_grid(fx).select(*[F.col(c).alias(c + k) for c in ("cell", "i", "j")]) for k in "ab")
    near = a.join(F.broadcast(b), F.col("ib").between(F.col("ia") - 1, F.col("ia") + 1)).where("abs(ja - jb) <= 1 AND cella <> cellb")
    edges = nulls.rewire(net0(fx), near.select(F.col("cella").alias("orig"), F.col("cellb").alias("dest")), 2, 2)
    placed = edges.join(a, F.col("orig") == F.col("cella")).join(b, F.col("dest") == F.col("cellb"))
    return placed.groupBy("realization", "orig").agg(F.sum("weight").alias("w"), F.count_if((F.greatest(F.abs(F.col("ia") - F.col("ib")), F.abs(F.col("ja") - F.col("jb"))) > 2) | (F.col("orig") == F.col("dest"))).alias("far"))


register("N4_rewired", _rewired, "SELECT CAST(r AS BIGINT) AS realization, orig, sum(weight) AS w, CAST(0 AS BIGINT) AS far FROM fx_edges, unnest([0, 1]) AS t(r) WHERE net = 0 GROUP BY 1, 2")
register("N5_ensemble_average", lambda fx: N.consensus(fx.edges, 2, 0, 0), "SELECT orig, dest, sum(weight) / 2 AS weight FROM fx_edges GROUP BY 1, 2")

# primitives
_CENTS = "CAST(sum(CAST(mean_ivt AS DECIMAL(18, 2))) AS DOUBLE)"  # exact, so both engines give the same double
register("A1_A6_aggregates", lambda fx: fx.catalog_a.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.expr(_CENTS).alias("s"), (F.expr(_CENTS) / F.count(F.lit(1))).alias("m"), F.countDistinct("trackid").alias("tracks")), f"SELECT cell, count(*) AS n, {_CENTS} AS s, {_CENTS} / count(*) AS m, count(DISTINCT trackid) AS tracks FROM fx_catalog_a GROUP BY 1", as_is=True)
register("A2_group_broadcast", lambda fx: C.feature_classes(fx.catalog_a, "mean_ivt", True, [0.0, 40.0, 1000.0])[0].groupBy("trackid", "class").agg(F.count(F.lit(1)).alias("n")), "WITH m AS (SELECT trackid, avg(mean_ivt) AS v, count(*) AS n FROM fx_catalog_a GROUP BY 1) SELECT trackid, CAST(1 + (v > 40)::INT AS BIGINT) AS class, n FROM m WHERE v > 0 AND v <= 1000")
register("A5_mode", lambda fx: fx.catalog_a.groupBy("trackid").agg(F.mode("cell", True).alias("cell")), "WITH n AS (SELECT trackid, cell, count(*) AS n FROM fx_catalog_a GROUP BY 1, 2) SELECT trackid, cell FROM (SELECT *, row_number() OVER (PARTITION BY trackid ORDER BY n DESC, cell) AS k FROM n) WHERE k = 1")
register("A7_first_last", lambda fx: fx.catalog_a.groupBy("regime").agg(F.min_by("cell", F.struct("trackid", "seq")).alias("first"), F.max_by("cell", F.struct("trackid", "seq")).alias("last")), "SELECT regime, arg_min(cell, trackid * 1000 + seq) AS first, arg_max(cell, trackid * 1000 + seq) AS last FROM fx_catalog_a GROUP BY 1")
register("W1_W3_islands", lambda fx: C.day_night_tracks(fx.catalog_a.withColumn("local_time", F.col("time"))).groupBy("class").agg(F.countDistinct("trackid").alias("runs"), F.count(F.lit(1)).alias("n")),
         "WITH d AS (SELECT *, hour(time) BETWEEN 6 AND 17 AS x FROM fx_catalog_a), e AS (SELECT *, row_number() OVER (PARTITION BY trackid ORDER BY seq) - row_number() OVER (PARTITION BY trackid, x ORDER BY seq) AS g FROM d), r AS (SELECT trackid, x, g, count(*) AS n FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT CASE WHEN x THEN 'day' ELSE 'night' END AS class, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
register("O1_ordered_head", lambda fx: fx.catalog_a.orderBy(F.desc("mean_ivt"), "trackid", "seq").limit(25).select("trackid", "seq", "mean_ivt"), "SELECT trackid, seq, round(mean_ivt, 6) AS mean_ivt FROM fx_catalog_a ORDER BY fx_catalog_a.mean_ivt DESC, trackid, seq LIMIT 25")

# composite pipelines
_C2 = "c AS (SELECT CAST(trackid % 2 AS BIGINT) AS net, orig, dest, count(*) AS n FROM fx_pairs WHERE orig <> dest GROUP BY 1, 2, 3 HAVING count(*) >= 4), k AS (SELECT orig, dest, sum(n) / 2 AS weight FROM c GROUP BY 1, 2 HAVING bool_and(n >= 5) AND sum(n) / 2 > 4)"
register("entry_a_consensus", lambda fx: pipelines.consensus_strengths(fx.catalog_a, fx.nodes, 4, 5), f"WITH {_C2}, o AS (SELECT orig AS cell, sum(weight) AS o FROM k GROUP BY 1), i AS (SELECT dest AS cell, sum(weight) AS i FROM k GROUP BY 1) SELECT cell AS coord_id, coalesce(o, 0) AS out_strength, coalesce(i, 0) AS in_strength FROM fx_cells LEFT JOIN o USING (cell) LEFT JOIN i USING (cell)")
# twelve places: means of values with two decimals often end in a five at the seventh
register("entry_b_highways", lambda fx: pipelines.highways(fx.catalog_a, fx.nodes, 8).select("orig", "dest", "weight", (F.round("ivt_diff", 12) + F.lit(0.0)).alias("ivt_diff"), F.col("ivt_class").cast("long"), F.round("edge_betweenness", 6).alias("edge_betweenness")), oracles.HIGHWAYS, as_is=True)
register("entry_c_community_ensemble", lambda fx: pipelines.community_ensemble(fx.nodes, net0(fx), (1, 2, 3), 2))
_parts2 = lambda fx: fx.catalog_a.withColumn("class", F.col("trackid") % 2)
_near = lambda fx: fx.spark.sql(ensembles.NEIGHBOURS.replace("fx_cells", "{cells}"), cells=fx.cells)
_graphs = lambda fx, n: ensembles.graphs(_parts2(fx), pipelines.consensus_edges(fx.catalog_a, 4, 5), _near(fx), n)
register("entry_d_significance", lambda fx: ensembles.node_importance(_graphs(fx, 9), 0.4), ensembles.sql_importance(9, 0.4))
register("central_edges", lambda fx: ensembles.central_edges(_graphs(fx, 3), 0.5), ensembles.sql_central(3, 0.5))
register("N6_N10_significance", lambda fx: pipelines.node_significance(_real(fx), fx.null, "metric", 0.4), f"WITH {_P1}, {_BH}, {_W}, rr AS (SELECT cell, metric FROM re) SELECT cell, metric, s1::INT::BIGINT AS s1, s2::INT::BIGINT AS s2, s3::INT::BIGINT AS s3, s4::INT::BIGINT AS s4 FROM rr LEFT JOIN w USING (cell)")
register("seasonal_networks", lambda fx: pipelines.class_networks(fx.catalog_b, "season", {"DJF": 1, "MAM": 1, "JJA": 2, "SON": 2}),
         "WITH s AS (SELECT *, CASE WHEN month(time) IN (12,1,2) THEN 'DJF' WHEN month(time) < 6 THEN 'MAM' WHEN month(time) < 9 THEN 'JJA' ELSE 'SON' END AS class FROM fx_catalog_b), p AS (SELECT class, coord_idx AS orig, lead(coord_idx) OVER (PARTITION BY class, trackid ORDER BY seq) AS dest FROM s), c AS (SELECT class, orig, dest, count(*) AS n FROM p WHERE dest IS NOT NULL AND orig <> dest GROUP BY 1, 2, 3) SELECT class, orig, dest, CAST(n AS DOUBLE) AS weight FROM c WHERE n >= CASE WHEN class IN ('JJA', 'SON') THEN 2 ELSE 1 END")
register("upstream_network", lambda fx: pipelines.upstream_network(fx.catalog_a, fx.levels.where("level = 0").select(F.col("node").alias("hex_id"), "community"), 2, 2),
         "WITH r AS (SELECT *, coalesce(coord_idx IN (SELECT node FROM fx_levels WHERE level = 0 AND community = 2), false) AS r FROM fx_catalog_a), b AS (SELECT *, min(CASE WHEN r THEN seq END) OVER (PARTITION BY trackid) AS en FROM r), k AS (SELECT trackid, seq, coord_idx FROM b WHERE seq <= en AND coord_idx IS NOT NULL), p AS (SELECT coord_idx AS orig, lead(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS dest FROM k) SELECT orig, dest, CAST(count(*) AS DOUBLE) AS weight FROM p WHERE dest IS NOT NULL AND orig <> dest GROUP BY 1, 2 HAVING count(*) >= 2")
register("ensemble_stability", lambda fx: pipelines.ensemble_stability(fx.partitions), f"WITH ari AS ({_ARI}), ami AS ({oracles.ADJUSTED_INFORMATION}) SELECT count(*) AS pairs, round(avg(ari), 6) AS mean, round(min(ari), 6) AS least, round(avg(ami), 6) AS mean_ami, round(min(ami), 6) AS least_ami FROM ari JOIN ami USING (s1, s2)")
register("basin_highways", lambda fx: pipelines.basin_highways(fx.catalog_a, fx.levels, 0, 2, 2, 0.5),
         "WITH r AS (SELECT *, coalesce(coord_idx IN (SELECT node FROM fx_levels WHERE level = 0 AND community = 2), false) AS r FROM fx_catalog_a), b AS (SELECT *, min(CASE WHEN r THEN seq END) OVER (PARTITION BY trackid) AS en FROM r), k AS (SELECT trackid, seq, coord_idx FROM b WHERE seq <= en AND coord_idx IS NOT NULL), p AS (SELECT coord_idx AS orig, lead(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS dest FROM k), e AS (SELECT orig, dest, CAST(count(*) AS DOUBLE) AS weight FROM p WHERE dest IS NOT NULL AND orig <> dest GROUP BY 1, 2 HAVING count(*) >= 2) SELECT * FROM e WHERE weight >= 0.5 * (SELECT max(weight) FROM e)")
_LEVEL = "x AS (SELECT a.level, a.community AS c1, b.community AS c2, flow FROM fx_flow JOIN fx_levels a ON a.node = src JOIN fx_levels b ON b.node = dst AND b.level = a.level), l AS (SELECT level, c1, sum(CASE WHEN c1 <> c2 THEN flow ELSE 0 END) / sum(flow) AS x FROM x GROUP BY 1, 2), rl AS (SELECT level, count(*) AS modules, avg(x) AS mean FROM l GROUP BY 1)"
register("level_conductance", lambda fx: pipelines.level_conductance(fx.flow, fx.levels), f"WITH {_LEVEL} SELECT level, modules, round(mean, 6) AS mean FROM rl")
_null_means = lambda fx: fx.null.groupBy("realization").agg((F.avg("metric") / 50 - 0.1).alias("mean")).withColumn("level", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
register("conductance_significance", lambda fx: pipelines.conductance_significance(fx.flow, fx.levels, _null_means(fx)),
         f"WITH {_LEVEL}, nm AS (SELECT realization, avg(metric) / 50 - 0.1 AS o FROM fx_null GROUP BY 1) SELECT level, round(any_value(mean), 6) AS mean, round(avg((o <= mean)::INT), 6) AS p FROM rl, nm GROUP BY level")
