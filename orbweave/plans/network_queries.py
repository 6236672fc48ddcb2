"""Queries over networks: construction, combination, metrics, drawing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as C
from ..operators import geometry as G
from ..operators import icosphere, metrics, nulls
from ..operators import network as N
from ..schema import Network
from ..sources import tables
from ..sources.scratch import new_path, written
from . import oracles
from .registry import register

net0 = lambda fx: fx.edges.where("net = 0").select("orig", "dest", "weight")
counts = lambda fx: N.transport_matrix(fx.pairs)
_CNT = "cnt AS (SELECT orig, dest, count(*) AS cnt FROM fx_pairs GROUP BY 1, 2)"
_E0 = "e AS (SELECT orig, dest, weight FROM fx_edges WHERE net = 0)"
E3 = ["orig", "dest", "weight"]

register("G1_transport_matrix", counts, f"WITH {_CNT} SELECT * FROM cnt")
register("G1_cell_index", lambda fx: N.dense_index(N.cell_ids(fx.pairs)), "WITH i AS (SELECT orig AS cell FROM fx_pairs UNION SELECT dest FROM fx_pairs) SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS idx FROM i")
register("G2_no_loops", lambda fx: N.no_loops(counts(fx)), f"WITH {_CNT} SELECT * FROM cnt WHERE orig <> dest")
_S = "s AS (SELECT orig, dest, sum(cnt) / 2 AS s FROM (SELECT * FROM cnt WHERE orig <> dest UNION ALL SELECT dest, orig, cnt FROM cnt WHERE orig <> dest) GROUP BY 1, 2)"
register("G3_weighted_undirected", lambda fx: N.build_edges(counts(fx), True, False, 5), f"WITH {_CNT}, {_S} SELECT orig, dest, s AS weight FROM s WHERE s >= 5 AND orig < dest")
register("G3_relative", lambda fx: N.build_edges(counts(fx), True, False, 5, weighing="relative"), f"WITH {_CNT}, {_S}, r AS (SELECT *, sum(s) OVER (PARTITION BY orig) AS t FROM s) SELECT orig, dest, round(s / t, 6) AS weight FROM r WHERE s >= 5 AND orig < dest")
register("G4_unweighted_directed", lambda fx: N.build_edges(counts(fx), False, True, 6), f"WITH {_CNT} SELECT orig, dest, CAST(1 AS DOUBLE) AS weight FROM cnt WHERE orig <> dest AND cnt >= 6")
register("G5_weighted_directed", lambda fx: N.build_edges(counts(fx), eps=8), f"WITH {_CNT} SELECT orig, dest, CAST(cnt AS DOUBLE) AS weight FROM cnt WHERE orig <> dest AND cnt >= 8")
register("G5_relative_loops", lambda fx: N.build_edges(counts(fx), eps=8, self_links=True, weighing="relative"), f"WITH {_CNT}, r AS (SELECT *, sum(cnt) OVER (PARTITION BY orig) AS t FROM cnt) SELECT orig, dest, round(cnt / t, 6) AS weight FROM r WHERE cnt >= 8")
register("G6_unweighted_undirected", lambda fx: N.build_edges(counts(fx), False, False, 8, True), f"WITH {_CNT} SELECT DISTINCT least(orig, dest) AS orig, greatest(orig, dest) AS dest, CAST(1 AS DOUBLE) AS weight FROM cnt WHERE cnt >= 8")
register("G7_end_nodes", lambda fx: N.end_nodes(N.build_edges(counts(fx), eps=16)), f"WITH {_CNT}, e AS (SELECT * FROM cnt WHERE orig <> dest AND cnt >= 16) SELECT orig AS coord_id FROM e UNION SELECT dest FROM e")
register("G8_G9_network_nodes", lambda fx: N.generate_network(counts(fx), fx.nodes, eps=12).nodes, f"WITH {_CNT}, e AS (SELECT * FROM cnt WHERE orig <> dest AND cnt >= 12), n AS (SELECT orig AS cell FROM e UNION SELECT dest FROM e) SELECT cell AS coord_id, lat, lon FROM n JOIN fx_cells USING (cell)")


def _classed_counts(fx):
    df, _ = C.condition(fx.catalog_a.withColumn("teleconnection", F.col("trackid") % 2), "teleconnection")
    return N.transport_matrix(C.pairs(df), ["class"])


register("G9_eps_per_class", lambda fx: N.build_edges(_classed_counts(fx), eps=fx.spark.createDataFrame([(0, 4.0), (1, 8.0)], "class long, eps double"), by=["class"]),
         "WITH c AS (SELECT CAST(trackid % 2 AS BIGINT) AS class, orig, dest, count(*) AS n FROM fx_pairs WHERE orig <> dest GROUP BY 1, 2, 3) SELECT class, orig, dest, CAST(n AS DOUBLE) AS weight FROM c WHERE n >= CASE WHEN class = 0 THEN 4 ELSE 8 END")
register("G10_transport_by_class", _classed_counts, "SELECT CAST(trackid % 2 AS BIGINT) AS class, orig, dest, count(*) AS cnt FROM fx_pairs GROUP BY 1, 2, 3")
register("G11_relabel", lambda fx: N.relabel(net0(fx), fx.cells.select(F.col("cell").alias("old"), F.floor(F.col("cell") / 3).alias("new"))),
         f"WITH {_E0}, r AS (SELECT CAST(floor(orig / 3) AS BIGINT) AS a, CAST(floor(dest / 3) AS BIGINT) AS b, *, row_number() OVER (PARTITION BY floor(orig / 3), floor(dest / 3) ORDER BY orig DESC, dest DESC) AS k FROM e) SELECT a AS orig, b AS dest, weight FROM r WHERE k = 1")
register("G12_node_numbers", lambda fx: N.dense_index(fx.catalog_b.select(F.col("trackid").alias("coord_id")).distinct(), "coord_id"), "SELECT trackid AS coord_id, row_number() OVER (ORDER BY trackid) - 1 AS idx FROM (SELECT DISTINCT trackid FROM fx_catalog_b)")
_GRID = "g AS (SELECT -90 + 30 * a AS lat, -180 + 30 * b AS lon FROM unnest(range(0, 7)) x(a), unnest(range(0, 13)) y(b))"
_HASH = "CAST(CAST(concat('0x', substr(sha256(printf('%.6f_%.6f', CAST(lat AS DOUBLE), CAST(lon AS DOUBLE))), 1, 16)) AS UBIGINT) AS VARCHAR)"
_visited = lambda fx: fx.catalog_a.groupBy(S.cell_lat(F.col("centroid_lat"), 30).alias("lat"), S.cell_lon(F.col("centroid_lon"), 30).alias("lon")).agg(F.count(F.lit(1)).alias("v")).select(S.cell_id(F.col("lat"), F.col("lon")).alias("coord_id"), "lat", "lon", "v")
_PLACED = "p AS (SELECT CAST(-90 + 30 * least(6, greatest(0, ceil((centroid_lat + 90) / 30 - 0.5))) AS BIGINT) AS lat, CAST(-180 + 30 * least(12, greatest(0, ceil((centroid_lon + 180) / 30 - 0.5))) AS BIGINT) AS lon, count(*) AS v FROM fx_catalog_a GROUP BY 1, 2)"
register("G13_complete_nodes", lambda fx: N.complete_nodes(_visited(fx), N.rect_cells(fx.spark, 30)),
         f"WITH {_GRID}, {_PLACED} SELECT {_HASH} AS coord_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, v FROM g LEFT JOIN p USING (lat, lon)")
GRID = icosphere.IcosaGrid()
# rows of one place together, so that a place is encoded once however many rows it has
places = lambda fx, *more: fx.catalog_a.groupBy("centroid_lat", "centroid_lon", *more).agg(F.count(F.lit(1)).alias("n"), F.sum("mean_ivt").alias("ivt"))
sphere_cell = lambda res: GRID.encode(F.col("centroid_lat"), F.col("centroid_lon"), res)
register("P6_sphere_encode", lambda fx: places(fx).groupBy(sphere_cell(1).alias("coord_id")).agg(F.sum("n").alias("n")), oracles.ICO_ENCODE)
register("G13_hex_cells", lambda fx: GRID.all_cells(fx.spark, 1).join(places(fx).groupBy(sphere_cell(1).alias("coord_id")).agg(F.sum("n").alias("n"), F.sum("ivt").alias("ivt")), "coord_id", "left"), oracles.ICO_CELLS)
register("G14_probabilities", lambda fx: N.normalize_outgoing(net0(fx)), f"WITH {_E0} SELECT orig, dest, weight, round(weight / sum(weight) OVER (PARTITION BY orig), 6) AS probability FROM e")
register("G15_invert", lambda fx: N.invert_weights(net0(fx)), f"WITH {_E0} SELECT orig, dest, round(1 / weight, 6) AS weight FROM e")
_mask = lambda fx: fx.catalog_a.select(F.floor(F.col("k") / 10).cast("long").alias("row"), (F.col("k") % 10).alias("col"), (F.col("k") * 7 % 4).alias("value")).distinct()
_MASK = "mask AS (SELECT DISTINCT CAST(floor(k / 10) AS BIGINT) AS r, k % 10 AS c, k * 7 % 4 AS v FROM fx_catalog_a)"
register("G16_downsample", lambda fx: N.downsample(_mask(fx), 3), f"WITH {_MASK}, n AS (SELECT r // 3 AS r, c // 3 AS c, v, count(*) AS n FROM mask GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, v) AS k FROM n) SELECT r AS \"row\", c AS col, v AS value FROM k WHERE k = 1 AND r < (SELECT (max(r) + 1) // 3 FROM mask) AND c < (SELECT (max(c) + 1) // 3 FROM mask)")
register("G17_assign_continent", lambda fx: N.assign_continent(fx.nodes.select("coord_id", "lat", "lon"), fx.spark.range(6 * 12).select(F.floor(F.col("id") / 12).alias("row"), (F.col("id") % 12).alias("col"), (F.col("id") % 5).alias("value")), 30),
         "SELECT cell AS coord_id, lat, lon, CAST((12 * least(5, greatest(0, ceil((lat + 90) / 30 - 0.5))) + least(11, greatest(0, ceil((lon + 180) / 30 - 0.5)))) % 5 AS BIGINT) AS continent FROM fx_cells")

register("K1_consensus", lambda fx: N.consensus(fx.edges, 2, 4, 3), "SELECT orig, dest, sum(weight) / 2 AS weight FROM fx_edges GROUP BY 1, 2 HAVING bool_and(weight = 0 OR weight >= 4) AND sum(weight) / 2 > 3")
register("K1q_consensus_nodes", lambda fx: N.consensus_nodes(fx.nodes.select("coord_id", "lat", "lon").unionByName(fx.nodes.select("coord_id", (F.col("lat") + 0.001).alias("lat"), "lon").where("coord_id % 2 = 0"))), "SELECT cell AS coord_id, lat, lon FROM fx_cells")
register("K2_average", lambda fx: N.average(fx.edges.withColumn("ebc", F.col("weight") / 7), "weight", "ebc"), "SELECT orig, dest, round(avg(weight), 6) AS weight, round(avg(weight / 7), 6) AS ebc FROM fx_edges GROUP BY 1, 2")


def _two(fx, i):
    return Network(fx.nodes.select("coord_id", "lat", "lon", (F.col("lat") + i).alias("x")), fx.edges.where(f"net = {i}").select("orig", "dest", "weight", (F.col("weight") * 2).alias("d")))


register("K2_average_networks", lambda fx: N.average_networks(_two(fx, 0), _two(fx, 1), "d").edges, "SELECT orig, dest, round(avg(weight), 6) AS weight, CAST(0 AS DOUBLE) AS edge_betweenness, round(avg(2 * weight), 6) AS d FROM fx_edges GROUP BY 1, 2")


def _gaps(fx, i):
    """Light edges lack x; the lightest do whatever their weight, so that some do on tables of any size."""
    net = _two(fx, i)
    least = net.edges.agg(F.min("weight").alias("_least"))
    x = F.when((F.col("weight") > 5) & (F.col("weight") > F.col("_least")), F.col("d"))
    return Network(net.nodes, net.edges.join(F.broadcast(least), F.lit(True)).withColumn("x", x).drop("_least"))


register("K2_attribute_of_some_edges", lambda fx: N.average_networks(_gaps(fx, 0), _gaps(fx, 1), "x").edges, "SELECT orig, dest, round(avg(weight), 6) AS weight, CAST(0 AS DOUBLE) AS edge_betweenness FROM fx_edges GROUP BY 1, 2")
register("K2_average_nodes", lambda fx: N.average_networks(_gaps(fx, 0), _gaps(fx, 1), "x").nodes, "SELECT cell AS coord_id, lat, lon, lat + 0.5 AS x FROM fx_cells")
_Q6 = "quantile_cont({0}, 0.05) AS a, quantile_cont({0}, 0.15) AS b, quantile_cont({0}, 0.25) AS c, quantile_cont({0}, 0.75) AS d, quantile_cont({0}, 0.85) AS e, quantile_cont({0}, 0.95) AS f"
register("K3_A3_pooled_thresholds", lambda fx: _pooled(fx), f"WITH s AS (SELECT dest_ivt - orig_ivt AS d FROM fx_pairs), q AS (SELECT {_Q6.format('d')} FROM s) SELECT round(a, 6) AS t0, round(b, 6) AS t1, round(c, 6) AS t2, round(d, 6) AS t3, round(e, 6) AS t4, round(f, 6) AS t5 FROM q")


def _pooled(fx):
    d = fx.pairs.select((F.col("dest_ivt") - F.col("orig_ivt")).alias("d"))
    return N.pooled_thresholds(d, "d").select(*[F.col("q")[i].alias(f"t{i}") for i in range(6)])


# joins and set operations of networks
register("J3_J5_edge_attribute", lambda fx: N.add_edge_attribute(net0(fx), fx.edges.where("net = 1").select("orig", "dest", F.col("weight").alias("other")), "other", -1.0), f"WITH {_E0} SELECT e.orig, e.dest, e.weight, coalesce(o.weight, -1) AS other FROM e LEFT JOIN (SELECT * FROM fx_edges WHERE net = 1) o USING (orig, dest)")
register("J6_node_attribute", lambda fx: N.add_node_attribute(fx.nodes.select("coord_id"), net0(fx).groupBy(F.col("orig").alias("coord_id")).agg(F.sum("weight").alias("s")).where("s > 100"), "s", -1.0), f"WITH {_E0}, s AS (SELECT orig AS cell, sum(weight) AS s FROM e GROUP BY 1 HAVING sum(weight) > 100) SELECT cell AS coord_id, coalesce(s, -1) AS s FROM fx_cells LEFT JOIN s USING (cell)")
register("J7_dictionary_encode", lambda fx: fx.pairs.join(N.dense_index(N.cell_ids(fx.pairs)).select(F.col("cell").alias("orig"), F.col("idx").alias("i")), "orig").join(N.dense_index(N.cell_ids(fx.pairs)).select(F.col("cell").alias("dest"), F.col("idx").alias("j")), "dest").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")), "WITH d AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS idx FROM (SELECT orig AS cell FROM fx_pairs UNION SELECT dest FROM fx_pairs)) SELECT a.idx AS i, b.idx AS j, count(*) AS n FROM fx_pairs JOIN d a ON a.cell = orig JOIN d b ON b.cell = dest GROUP BY 1, 2")
register("J8_edge_places", lambda fx: N.edge_places(net0(fx), fx.nodes), f"WITH {_E0} SELECT orig, dest, weight, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM e JOIN fx_cells a ON a.cell = orig JOIN fx_cells b ON b.cell = dest")
register("J4_combine", lambda fx: G.combined(metrics.visits(fx.catalog_a).where("coord_id > 4"), metrics.visits(fx.catalog_b).where("coord_id < 18"), "visits"),
         "WITH a AS (SELECT coord_idx AS c, count(*) AS v FROM fx_catalog_a WHERE coord_idx > 4 GROUP BY 1), b AS (SELECT coord_idx AS c, count(*) AS v FROM fx_catalog_b WHERE coord_idx < 18 GROUP BY 1) SELECT c AS coord_id, CAST(coalesce(a.v, 0) AS DOUBLE) AS a, CAST(coalesce(b.v, 0) AS DOUBLE) AS b, coalesce(a.v, b.v) AS first FROM a FULL JOIN b USING (c)")
register("J10_semi_region", lambda fx: fx.catalog_a.join(fx.cells.where("continent = 'ASIA'").select(F.col("cell").alias("coord_idx")), "coord_idx", "left_semi").groupBy("coord_idx").agg(F.count(F.lit(1)).alias("n")), "SELECT coord_idx, count(*) AS n FROM fx_catalog_a WHERE coord_idx IN (SELECT cell FROM fx_cells WHERE continent = 'ASIA') GROUP BY 1")
register("J11_nearest_cell", lambda fx: fx.catalog_a.groupBy(S.cell_lon(F.col("centroid_lon"), 30).alias("x"), S.cell_lat(F.col("centroid_lat"), 30).alias("y")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(-180 + 30 * least(12, greatest(0, ceil((centroid_lon + 180) / 30 - 0.5))) AS DOUBLE) AS x, CAST(-90 + 30 * least(6, greatest(0, ceil((centroid_lat + 90) / 30 - 0.5))) AS DOUBLE) AS y, count(*) AS n FROM fx_catalog_a GROUP BY 1, 2")
register("J15_point_in_polygon", lambda fx: G.point_in_polygon(fx.catalog_a.select("k", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat")).distinct(), fx.cells.select(F.col("cell").alias("poly"), G.rect_boundary(F.col("lon"), F.col("lat"), 23.7).alias("boundary"))).select("k", "poly"),
         "SELECT DISTINCT k, c.cell AS poly FROM fx_catalog_a a JOIN fx_cells c ON abs(centroid_lon - c.lon) < 11.85 AND abs(centroid_lat - c.lat) < 11.85")
register("U1_U2_U3_sets", lambda fx: N.end_nodes(net0(fx)).intersect(N.end_nodes(fx.edges.where("net = 1"))).unionByName(fx.nodes.select("coord_id").subtract(N.end_nodes(net0(fx)))), "(SELECT orig AS coord_id FROM fx_edges WHERE net = 0 UNION SELECT dest FROM fx_edges WHERE net = 0) INTERSECT (SELECT orig FROM fx_edges WHERE net = 1 UNION SELECT dest FROM fx_edges WHERE net = 1) UNION ALL (SELECT cell FROM fx_cells EXCEPT (SELECT orig FROM fx_edges WHERE net = 0 UNION SELECT dest FROM fx_edges WHERE net = 0))")

# metrics
_OUT = "o AS (SELECT orig AS cell, sum(weight) AS o FROM e GROUP BY 1), i AS (SELECT dest AS cell, sum(weight) AS i FROM e GROUP BY 1)"
register("M1_degree", lambda fx: metrics.degree_centrality(fx.nodes, net0(fx)), f"WITH {_E0}, {_OUT} SELECT cell AS coord_id, coalesce(o, 0) + coalesce(i, 0) AS degree FROM fx_cells LEFT JOIN o USING (cell) LEFT JOIN i USING (cell)")
register("M1a_degree_by_area", lambda fx: metrics.degree_by_area(fx.nodes, net0(fx)), f"WITH {_E0}, s AS (SELECT orig AS cell, sum(weight * cos(radians(lat))) AS s FROM e JOIN fx_cells ON cell = dest GROUP BY 1) SELECT cell AS coord_id, round(coalesce(s, 0) / (SELECT sum(cos(radians(lat))) FROM fx_cells), 6) AS degree FROM fx_cells LEFT JOIN s USING (cell)")
register("M2_divergence", lambda fx: metrics.divergence(fx.nodes, net0(fx)), f"WITH {_E0}, {_OUT} SELECT cell AS coord_id, coalesce(o, 0) - coalesce(i, 0) AS divergence FROM fx_cells LEFT JOIN o USING (cell) LEFT JOIN i USING (cell)")
register("M3_pagerank_fixed", lambda fx: metrics.pagerank(fx.nodes, net0(fx), steps=3, tol=None, every=3),
         f"""WITH {_E0}, p AS (SELECT orig, dest, weight / sum(weight) OVER (PARTITION BY orig) AS p FROM e), n AS (SELECT count(*) AS n FROM fx_cells),
             d AS (SELECT cell, cell NOT IN (SELECT orig FROM e) AS lost FROM fx_cells),
             r0 AS (SELECT cell, lost, 1.0 / n AS r FROM d, n),
             r1 AS (SELECT cell, lost, 0.85 * (coalesce((SELECT sum(r * p) FROM p JOIN r0 x ON x.cell = orig WHERE dest = r0.cell), 0) + (SELECT coalesce(sum(r), 0) FROM r0 WHERE lost) / n) + 0.15 / n AS r FROM r0, n),
             r2 AS (SELECT cell, lost, 0.85 * (coalesce((SELECT sum(r * p) FROM p JOIN r1 x ON x.cell = orig WHERE dest = r1.cell), 0) + (SELECT coalesce(sum(r), 0) FROM r1 WHERE lost) / n) + 0.15 / n AS r FROM r1, n),
             r3 AS (SELECT cell, lost, 0.85 * (coalesce((SELECT sum(r * p) FROM p JOIN r2 x ON x.cell = orig WHERE dest = r2.cell), 0) + (SELECT coalesce(sum(r), 0) FROM r2 WHERE lost) / n) + 0.15 / n AS r FROM r2, n)
             SELECT cell AS coord_id, round(r, 6) AS pagerank FROM r3""")  # fmt: skip
register("M3_pagerank", lambda fx: metrics.pagerank(fx.nodes, net0(fx), tol=1e-14, normalised=True),
         f"""WITH RECURSIVE {_E0}, n AS (SELECT count(*) AS n FROM fx_cells), s AS (SELECT orig, sum(weight) AS t FROM e GROUP BY 1),
             mx AS (SELECT a.cell AS o, b.cell AS d, CASE WHEN t IS NULL THEN 1.0 / n ELSE coalesce(weight, 0) / t END AS p FROM fx_cells a CROSS JOIN fx_cells b CROSS JOIN n LEFT JOIN s ON s.orig = a.cell LEFT JOIN e ON e.orig = a.cell AND e.dest = b.cell),
             r(step, cell, r) AS (SELECT 0, cell, CAST(1 AS DOUBLE) / n FROM fx_cells, n UNION ALL SELECT step + 1, d, 0.85 * sum(r * p) + 0.15 / any_value(n) FROM r JOIN mx ON o = cell CROSS JOIN n WHERE step < 100 GROUP BY step, d)
             SELECT cell AS coord_id, round(100 * r, 6) AS pagerank FROM r WHERE step = 100""")  # fmt: skip
_ARC = "a AS (SELECT DISTINCT orig, dest FROM fx_edges WHERE net = 0)"
register("M4_J14_clustering", lambda fx: metrics.clustering(fx.nodes, net0(fx)),
         f"""WITH {_ARC}, s AS (SELECT u, v, count(*) AS m FROM (SELECT orig AS u, dest AS v FROM a UNION ALL SELECT dest, orig FROM a) GROUP BY 1, 2),
             t AS (SELECT x.u AS cell, sum(x.m * y.m * z.m) AS t FROM s x JOIN s y ON y.u = x.v JOIN s z ON z.u = y.v AND z.v = x.u GROUP BY 1),
             d AS (SELECT u AS cell, sum(m) AS d, count(*) FILTER (m = 2) AS r FROM s GROUP BY 1)
             SELECT cell AS coord_id, CASE WHEN coalesce(t, 0) = 0 THEN 0 ELSE round(t / (2 * (d * (d - 1) - 2 * r)), 6) END AS clustering FROM fx_cells LEFT JOIN t USING (cell) LEFT JOIN d USING (cell)""")  # fmt: skip
register("M5_cycle_clustering", lambda fx: metrics.cycle_clustering(fx.nodes, net0(fx)),
         f"""WITH {_ARC}, m AS (SELECT x.orig AS u, x.dest AS v FROM a x JOIN a y ON y.orig = x.dest AND y.dest = x.orig),
             r AS (SELECT u AS cell, count(*) AS r FROM m GROUP BY 1), e AS (SELECT x.u AS cell, count(*) AS e FROM m x JOIN m y ON y.u = x.u JOIN a ON a.orig = x.v AND a.dest = y.v GROUP BY 1)
             SELECT cell AS coord_id, CASE WHEN r >= 2 THEN round(coalesce(e, 0) / (r * (r - 1)), 6) ELSE 0 END AS cycle_clustering FROM fx_cells LEFT JOIN r USING (cell) LEFT JOIN e USING (cell)""")  # fmt: skip
_DIG = "CAST(CASE WHEN v IS NULL THEN NULL ELSE (v >= a)::INT + (v >= b)::INT + (v >= c)::INT + (v >= d)::INT + (v >= e)::INT + (v >= f)::INT - 3 END AS BIGINT)"
register("M6_node_transport", lambda fx: metrics.node_transport(fx.pairs),
         f"""WITH o AS (SELECT orig AS id, avg(dest_ivt) AS o FROM fx_pairs GROUP BY 1), i AS (SELECT dest AS id, avg(orig_ivt) AS i FROM fx_pairs GROUP BY 1),
             n AS (SELECT id, o - i AS v FROM o FULL JOIN i USING (id)), q AS (SELECT {_Q6.format('v')} FROM n) SELECT id AS coord_id, round(v, 6) AS ivt_diff, {_DIG} AS ivt_class FROM n, q""")  # fmt: skip
register("M7_edge_transport", lambda fx: metrics.edge_transport(fx.pairs),
         f"""WITH s AS (SELECT orig, dest, dest_ivt - orig_ivt AS x FROM fx_pairs), g AS (SELECT orig, dest, avg(x) AS v FROM s GROUP BY 1, 2), q AS (SELECT {_Q6.format('x')} FROM s)
             SELECT orig, dest, round(v, 6) AS ivt_diff, {_DIG} AS ivt_class FROM g, q""")  # fmt: skip
register("M7_manual_thresholds", lambda fx: metrics.edge_transport(fx.pairs, thresholds=(-60, -30, -10, 10, 30, 60)), "WITH g AS (SELECT orig, dest, avg(dest_ivt - orig_ivt) AS v FROM fx_pairs GROUP BY 1, 2) SELECT orig, dest, round(v, 6) AS ivt_diff, CAST((v >= -60)::INT + (v >= -30)::INT + (v >= -10)::INT + (v >= 10)::INT + (v >= 30)::INT + (v >= 60)::INT - 3 AS BIGINT) AS ivt_class FROM g")
register("M8_edge_betweenness", lambda fx: metrics.edge_betweenness(fx.nodes, net0(fx)), oracles.EDGE_BETWEENNESS)
register("M8_hop_betweenness", lambda fx: metrics.edge_betweenness(fx.nodes, net0(fx), weighted=False), oracles.HOP_BETWEENNESS)


# the same on a network whose nodes grow with the tables
def _of_trade(fx, metric, **how):
    """A metric of it; its links are summed once and written."""
    trade = written(fx.trade, "trade")
    return metric(N.end_nodes(trade), trade, **how)


_TRADERS = "n AS (SELECT orig AS cell FROM fx_trade UNION SELECT dest FROM fx_trade)"
register("M1_large_network", lambda fx: metrics.degree_centrality(None, fx.trade), "SELECT cell AS coord_id, sum(weight) AS degree FROM (SELECT orig AS cell, weight FROM fx_trade UNION ALL SELECT dest, weight FROM fx_trade) e GROUP BY 1")
register("M3_large_network", lambda fx: _of_trade(fx, metrics.pagerank, steps=3, tol=None, every=3).withColumn("pagerank", 1e6 * F.col("pagerank")), oracles.pagerank("SELECT * FROM fx_trade", "SELECT orig AS cell FROM fx_trade UNION SELECT dest FROM fx_trade", 3))
register("M8_large_network", lambda fx: _of_trade(fx, metrics.edge_betweenness, normalised=False), oracles.LARGE_BETWEENNESS)
register("M4_large_network", lambda fx: _of_trade(fx, metrics.clustering),
         f"""WITH {_TRADERS}, s AS (SELECT u, v, count(*) AS m FROM (SELECT orig AS u, dest AS v FROM fx_trade UNION ALL SELECT dest, orig FROM fx_trade) GROUP BY 1, 2),
             w AS (SELECT x.u AS a, x.v AS b, y.v AS c, x.m * y.m * z.m AS t FROM s x JOIN s y ON y.u = x.v AND x.u < x.v AND x.v < y.v JOIN s z ON z.u = y.v AND z.v = x.u),
             t AS (SELECT cell, 2 * sum(t) AS t FROM (SELECT unnest([a, b, c]) AS cell, t FROM w) GROUP BY 1),
             d AS (SELECT u AS cell, sum(m) AS d, count(*) FILTER (m = 2) AS r FROM s GROUP BY 1)
             SELECT cell AS coord_id, CASE WHEN coalesce(t, 0) = 0 THEN 0 ELSE round(t / (2 * (d * (d - 1) - 2 * r)), 6) END AS clustering FROM n LEFT JOIN t USING (cell) LEFT JOIN d USING (cell)""")  # fmt: skip
register("M9_visits", lambda fx: metrics.visits(fx.catalog_a), "SELECT coord_idx AS coord_id, count(*) AS visits FROM fx_catalog_a WHERE coord_idx IS NOT NULL GROUP BY 1")
register("M10_widths", lambda fx: metrics.edge_widths(net0(fx), True), f"WITH {_E0} SELECT orig, dest, weight, round(log10(weight) / max(log10(weight)) OVER (), 6) AS width, CAST(NOT bool_and(weight = 1) OVER () AS BIGINT) AS weighted FROM e")
register("M10_sign_widths", lambda fx: metrics.sign_widths(metrics.edge_transport(fx.pairs, thresholds=(-60, -30, -10, 10, 30, 60)), "ivt_class", 2.0).groupBy("ivt_class", "width").count(), "WITH g AS (SELECT orig, dest, avg(dest_ivt - orig_ivt) AS v FROM fx_pairs GROUP BY 1, 2), c AS (SELECT CAST((v >= -60)::INT + (v >= -30)::INT + (v >= -10)::INT + (v >= 10)::INT + (v >= 30)::INT + (v >= 60)::INT - 3 AS BIGINT) AS ivt_class FROM g) SELECT ivt_class, CAST(2 * CASE WHEN ivt_class = 0 THEN 0.5 ELSE abs(ivt_class) END AS DOUBLE) AS width, count(*) AS count FROM c GROUP BY 1, 2")
register("M11_F13_ensemble_threshold", lambda fx: metrics.ensemble_threshold(fx.null, "metric", 0.9), "WITH q AS (SELECT model, quantile_cont(metric, 0.9) AS q FROM fx_null GROUP BY 1) SELECT round(max(q), 6) AS threshold FROM q")
register("F12_F13_above", lambda fx: metrics.above(net0(fx), "weight", 9.0), f"WITH {_E0} SELECT * FROM e WHERE weight >= 9")

# drawing tables
register("P13_P14_bearings", lambda fx: G.edge_bearings(net0(fx), fx.nodes).select("orig", "dest", "bearing"),
         f"""WITH {_E0}, p AS (SELECT orig, dest, radians(a.lat) AS y1, radians(b.lat) AS y2, radians(b.lon - a.lon) AS d FROM e JOIN fx_cells a ON a.cell = orig JOIN fx_cells b ON b.cell = dest),
             q AS (SELECT orig, dest, degrees(atan2(sin(d) * cos(y2), cos(y1) * sin(y2) - sin(y1) * cos(y2) * cos(d))) AS g FROM p) SELECT orig, dest, round(CASE WHEN g < 0 THEN g + 360 ELSE g END, 6) AS bearing FROM q""")  # fmt: skip
register("P15_direction_bins", lambda fx: G.direction_bins(G.edge_bearings(net0(fx), fx.nodes)).groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
         f"""WITH {_E0}, p AS (SELECT orig, dest, radians(a.lat) AS y1, radians(b.lat) AS y2, radians(b.lon - a.lon) AS d FROM e JOIN fx_cells a ON a.cell = orig JOIN fx_cells b ON b.cell = dest),
             q AS (SELECT degrees(atan2(sin(d) * cos(y2), cos(y1) * sin(y2) - sin(y1) * cos(y2) * cos(d))) AS g FROM p), r AS (SELECT CASE WHEN g < 0 THEN g + 360 ELSE g END / 360 AS g FROM q)
             SELECT CAST(floor((g - lo) / ((hi - lo) / 7) + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM r, (SELECT min(g) AS lo, max(g) AS hi FROM r) GROUP BY 1""")  # fmt: skip
register("P16_wrap_longitude", lambda fx: fx.cells.select("cell", S.wrap(F.col("lon") * 3).alias("lon")), "SELECT cell, (lon * 3 + 180) - 360 * floor((lon * 3 + 180) / 360) - 180 AS lon FROM fx_cells")
# the places shifted by 36 degrees either way, so that ends lie on 180 and on -180; wrapped, split, and the cut moved where it meets an end
_SHIFT = "(VALUES (36), (-36)) AS s(shift)"
_SEG = f"""p AS (SELECT orig, dest, CAST(shift AS BIGINT) AS shift, a.lat AS y1, b.lat AS y2, CASE WHEN a.lon + shift >= 180 THEN a.lon + shift - 360 ELSE a.lon + shift END AS x1, CASE WHEN b.lon + shift >= 180 THEN b.lon + shift - 360 ELSE b.lon + shift END AS x2 FROM e JOIN fx_cells a ON a.cell = orig JOIN fx_cells b ON b.cell = dest, {_SHIFT}),
          seg AS (SELECT orig, dest, shift, CAST(0 AS BIGINT) AS segment, x1, y1, x2, y2 FROM p WHERE abs(x1 - x2) <= 180
                  UNION ALL SELECT orig, dest, shift, 0, x1, y1, CASE WHEN x1 > x2 THEN 180 WHEN x1 = -180 THEN -179.5 ELSE -180 END, y1 FROM p WHERE abs(x1 - x2) > 180
                  UNION ALL SELECT orig, dest, shift, 1, CASE WHEN x1 < x2 THEN 180 WHEN x2 = -180 THEN -179.5 ELSE -180 END, y2, x2, y2 FROM p WHERE abs(x1 - x2) > 180)"""


def _shifted(fx):
    places = N.edge_places(net0(fx), fx.nodes).withColumn("shift", F.explode(F.array(F.lit(36), F.lit(-36))))
    return places.withColumns({"lon1": F.col("lon1") + F.col("shift"), "lon2": F.col("lon2") + F.col("shift")})


_COLS = ["orig", "dest", "shift", "segment", "x1", "y1", "x2", "y2"]
_SEGMENTS = "SELECT orig, dest, shift, segment, CAST(x1 AS DOUBLE) AS x1, y1, CAST(x2 AS DOUBLE) AS x2, y2 FROM seg"
register("P17_V3_split_meridian", lambda fx: G.split_at_meridian(_shifted(fx)).select(*_COLS), f"WITH {_E0}, {_SEG} {_SEGMENTS}")
register("P18_discard_long", lambda fx: G.discard_long(G.split_at_meridian(_shifted(fx)), 80).select(*_COLS), f"WITH {_E0}, {_SEG} {_SEGMENTS} WHERE abs(x1 - x2) <= 80")
_flat = lambda c: F.concat_ws(";", F.transform(c, lambda p: F.concat_ws(" ", F.format_string("%.1f", p["lon"]), F.format_string("%.1f", p["lat"]))))
register("P19_split_polygons", lambda fx: G.split_polygons(fx.cells.select("cell", F.transform(G.rect_boundary(F.col("lon") - 36, F.col("lat"), 10), lambda p: F.struct(S.wrap(p["lon"]).alias("lon"), p["lat"].alias("lat"))).alias("boundary"))).select("cell", "part", F.size("boundary").alias("n")),
         "SELECT cell, CAST(p AS BIGINT) AS part, CAST(5 AS BIGINT) AS n FROM fx_cells, unnest(CASE WHEN lon - 36 = -180 THEN [0, 1] ELSE [0] END) AS t(p)")
register("P20_rect_boundary", lambda fx: fx.cells.select("cell", _flat(G.rect_boundary(F.col("lon"), F.col("lat"), 7)).alias("ring")), "SELECT cell, printf('%.1f %.1f;%.1f %.1f;%.1f %.1f;%.1f %.1f;%.1f %.1f', lon - 3.5, lat - 3.5, lon + 3.5, lat - 3.5, lon + 3.5, lat + 3.5, lon - 3.5, lat + 3.5, lon - 3.5, lat - 3.5) AS ring FROM fx_cells")
_sides = lambda fx: GRID.sides(places(fx).select(sphere_cell(0).alias("coord_id")).distinct(), "coord_id")
register("P20_hex_boundary", lambda fx: _sides(fx).groupBy("coord_id").agg((F.count(F.lit(1)) + 1).alias("n")), f"SELECT coord_id, count(*) + 1 AS n FROM ({oracles.ICO_CORNERS}) r GROUP BY 1")
register("P20_hex_corners", lambda fx: _sides(fx).select("coord_id", F.col("start").alias("corner"), *[c.alias(n) for n, c in zip(("lat", "lon"), GRID.center(F.col("start")), strict=True)]), oracles.ICO_CORNERS)
_shifted_nodes = lambda fx: fx.nodes.withColumn("lon", F.col("lon") + 36)
register("plot_table", lambda fx: G.plot_table(net0(fx), _shifted_nodes(fx)).select("orig", "dest", "segment", "x1", "x2", "weight", "bin"),
         f"WITH {_E0}, {_SEG}, q AS (SELECT round_even(min(weight), 0) AS a, round_even(quantile_cont(weight, 0.999), 0) AS b FROM e) SELECT orig, dest, segment, CAST(x1 AS DOUBLE) AS x1, CAST(x2 AS DOUBLE) AS x2, weight, CAST(floor((least(greatest(weight, a), b) - a) * 6 / (b - a)) AS BIGINT) AS bin FROM seg JOIN e USING (orig, dest), q WHERE shift = 36 AND abs(x1 - x2) <= 180")
register("plot_nodes", lambda fx: G.node_table(fx.nodes.select("coord_id"), metrics.degree_centrality(fx.nodes, net0(fx))), "WITH e AS (SELECT * FROM fx_edges WHERE net = 0), d AS (SELECT c, sum(w) AS degree FROM (SELECT orig AS c, weight AS w FROM e UNION ALL SELECT dest, weight FROM e) GROUP BY 1) SELECT cell AS coord_id, coalesce(degree, 0) AS degree, CAST(CASE WHEN degree > 0 THEN 0.6 ELSE 0.1 END AS DOUBLE) AS alpha FROM fx_cells LEFT JOIN d ON c = cell")
register("plot_curves", lambda fx: G.curve_control(G.split_at_meridian(_shifted(fx))).select("orig", "dest", "shift", "segment", "cx", "cy"), f"WITH {_E0}, {_SEG} SELECT orig, dest, shift, segment, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2 + 0.2 * (x2 - x1), 6) AS cy FROM seg")
register("plot_arcs", lambda fx: G.projected_arcs(G.split_at_meridian(_shifted(fx))).select("orig", "dest", "shift", "segment", "step", "px", "py", F.cos("heading").alias("towards_x"), F.sin("heading").alias("towards_y")), f"""WITH {_E0}, {_SEG},
             ends AS (SELECT orig, dest, shift, segment, unnest([0, 1]) AS k, unnest([x1, x2]) AS lon, unnest([y1, y2]) AS lat FROM seg), t AS (SELECT *, asin(sqrt(3) / 2 * sin(radians(lat))) AS t FROM ends),
             xy AS (SELECT *, 2 * sqrt(3) * radians(lon) * cos(t) / (3 * (9 * 0.003796 * pow(t, 8) + 7 * 0.000893 * pow(t, 6) - 3 * 0.081106 * pow(t, 2) + 1.340264)) AS x, 0.003796 * pow(t, 9) + 0.000893 * pow(t, 7) - 0.081106 * pow(t, 3) + 1.340264 * t AS y FROM t),
             arc AS (SELECT a.orig, a.dest, a.shift, a.segment, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 + 0.2 * (b.x - a.x) AS cy FROM xy a JOIN xy b ON a.orig = b.orig AND a.dest = b.dest AND a.shift = b.shift AND a.segment = b.segment AND a.k = 0 AND b.k = 1),
             pt AS (SELECT *, s / 10 AS t FROM arc, range(11) r(s)), d AS (SELECT *, (1 - t) * (cx - ax) + t * (bx - cx) AS dx, (1 - t) * (cy - ay) + t * (by_ - cy) AS dy FROM pt)
             SELECT orig, dest, shift, segment, s AS step, (1 - t) * (1 - t) * ax + 2 * t * (1 - t) * cx + t * t * bx AS px, (1 - t) * (1 - t) * ay + 2 * t * (1 - t) * cy + t * t * by_ AS py,
                 CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE dx / sqrt(dx * dx + dy * dy) END AS towards_x, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy / sqrt(dx * dx + dy * dy) END AS towards_y FROM d""")
register("V2_pivot", lambda fx: fx.edges.groupBy("orig").pivot("net", [0, 1]).agg(F.sum("weight")).select("orig", F.col("0").alias("a"), F.col("1").alias("b")), "SELECT orig, sum(weight) FILTER (net = 0) AS a, sum(weight) FILTER (net = 1) AS b FROM fx_edges GROUP BY 1")


# exchange of networks
def _parquet(fx):
    path = new_path(fx.spark, "net")
    tables.write_network(Network(fx.nodes, fx.edges), path, "net")
    return tables.read_network(fx.spark, path).edges.groupBy("net").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


def _gml(fx):
    path = new_path(fx.spark, "gml")
    tables.write_gml(fx.edges.withColumnRenamed("net", "realization"), fx.nodes.select("coord_id", "lat", "lon"), path)
    return tables.read_gml(fx.spark, path).select(F.col("realization").cast("long"), F.col("orig").cast("long"), F.col("dest").cast("long"), "weight")


def _ragged(fx):
    path = new_path(fx.spark, "ragged")
    C.paths(fx.catalog_a.where("coord_idx IS NOT NULL")).write.parquet(path)
    return tables.read_catalog(fx.spark, path).select("trackid", F.size("path").alias("n"), F.element_at("path", -1).alias("last"))


register("S8_ragged_lists", _ragged, "SELECT trackid, count(*) AS n, arg_max(coord_idx, seq) AS last FROM fx_catalog_a WHERE coord_idx IS NOT NULL GROUP BY 1")
register("S5_gexf", lambda fx: tables.parse_gexf(fx.spark, tables.gexf(Network(fx.nodes, net0(fx)))).select(F.col("orig").cast("long"), F.col("dest").cast("long"), "weight"), f"WITH {_E0} SELECT * FROM e")
register("S6_parquet_network", _parquet, "SELECT net, count(*) AS n, sum(weight) AS w FROM fx_edges GROUP BY 1")
register("S6_gml", _gml, "SELECT net AS realization, orig, dest, weight FROM fx_edges")
register("S7_geojson", lambda fx: tables.geojson(fx.cells.select("cell", G.rect_boundary(F.col("lon"), F.col("lat"), 7).alias("boundary"))).select(F.get_json_object("value", "$.properties.cell").cast("long").alias("cell"), F.get_json_object("value", "$.geometry.coordinates[0][0][0]").cast("double").alias("x")), "SELECT cell, lon - 3.5 AS x FROM fx_cells")


def _polygons(fx):
    path = new_path(fx.spark, "polygons")
    tables.geojson(fx.cells.select("cell", "continent", G.rect_boundary(F.col("lon"), F.col("lat"), 7).alias("boundary"))).write.text(path)
    return tables.read_geojson(fx.spark, path, "cell bigint, continent string")


register("S7_read_polygons", lambda fx: _polygons(fx).select("cell", "continent", _flat("boundary").alias("ring")), "SELECT cell, continent, printf('%.1f %.1f;%.1f %.1f;%.1f %.1f;%.1f %.1f;%.1f %.1f', lon - 3.5, lat - 3.5, lon + 3.5, lat - 3.5, lon + 3.5, lat + 3.5, lon - 3.5, lat + 3.5, lon - 3.5, lat - 3.5) AS ring FROM fx_cells")

register("N1_rect_lattice", lambda fx: nulls.rect_lattice(fx.spark, 30).join(_visited(fx).select(F.col("coord_id").alias("orig"), "v"), "orig").join(_visited(fx).select(F.col("coord_id").alias("dest"), F.col("v").alias("w")), "dest", "left").groupBy("orig", "v").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("around")),
         f"""WITH g AS (SELECT -90 + 30 * a AS lat, -180 + 30 * b AS lon FROM unnest(range(0, 7)) x(a), unnest(range(0, 12)) y(b)), {_PLACED},
             w AS (SELECT DISTINCT g.lat, g.lon, lat + 30 * da AS la, (lon + 30 * db + 540) % 360 - 180 AS lo FROM g, unnest([-1, 0, 1]) x(da), unnest([-1, 0, 1]) y(db) WHERE (da <> 0 OR db <> 0) AND lat + 30 * da BETWEEN -90 AND 90)
             SELECT {_HASH.replace("lat", "w.lat").replace("lon", "w.lon")} AS orig, p.v, count(*) AS n, CAST(coalesce(sum(q.v), 0) AS BIGINT) AS around FROM w JOIN p ON p.lat = w.lat AND p.lon = w.lon LEFT JOIN p q ON q.lat = la AND q.lon = lo GROUP BY 1, 2""")  # fmt: skip


def _sphere_lattice(fx):
    """Neighbours of each visited cell, and the visits of these."""
    seen = places(fx).groupBy(sphere_cell(0).alias("coord_id")).agg(F.sum("n").alias("n")).where("coord_id IS NOT NULL")
    near = nulls.sphere_lattice(GRID, fx.spark, 0).join(seen.withColumnRenamed("coord_id", "orig"), "orig").join(seen.select(F.col("coord_id").alias("dest"), F.col("n").alias("m")), "dest", "left")
    return near.groupBy(F.col("orig").alias("coord_id"), "n").agg(F.count(F.lit(1)).alias("neighbours"), F.coalesce(F.sum("m"), F.lit(0)).alias("around"))


register("N1_sphere_lattice", _sphere_lattice, oracles.ICO_NEIGHBOURS)
