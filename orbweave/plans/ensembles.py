"""Real networks against ensembles of null models: walks and rewired edges, metrics of all graphs at once, p-values.

The graphs of an ensemble are rows with (model, realization); the real one is model 0. So each metric is computed by one plan or one
loop for all graphs. Models: 1 free walks, 2 walks from the tracks' first cells, 3 walks to their last ones, 4 rewired edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import metrics, nulls, stats
from ..operators import network as N
from ..operators.paths import edge_betweenness
from ..sources.scratch import written

GRAPH = ["model", "realization"]
EDGE = [*GRAPH, "orig", "dest", "weight"]


def walk_networks(catalog: DataFrame, lattice: DataFrame, realizations: int, seed: int = 0) -> DataFrame:
    """(model, realization, orig, dest, weight) of models 1 to 3: mean over the classes (catalogs) of ``catalog`` of the counts of steps between cells."""
    tracks = written(C.track_ends(catalog.where("coord_idx IS NOT NULL")), "tracks")  # each model begins with them
    lattice = written(lattice, "lattice")
    runs = tracks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(realizations - 1).cast("long"))).alias("realization"))
    key = [*GRAPH, "class", "trackid"]
    start = lambda model, anchor, way: nulls.anchored(runs.withColumn("model", F.lit(model).cast("long")), lattice, key, anchor, way, seed)
    walkers = start(1, None, 1).unionByName(start(2, "first", 1)).unionByName(start(3, "last", -1))
    steps = nulls.steps_of(nulls.walk(walkers, nulls.ways_on(lattice, [1, -1]), key, seed), [*GRAPH, "class"]).where("a <> b")
    back = F.col("model") == 3  # taken from the end
    ends = steps.select(*GRAPH, "class", F.when(back, F.col("b")).otherwise(F.col("a")).alias("orig"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("dest"))
    counts = ends.groupBy(*GRAPH, "class", "orig", "dest").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return N.consensus(counts, 2, 0, 0, GRAPH)


def graphs(catalog: DataFrame, edges: DataFrame, lattice: DataFrame, realizations: int, maxdist: int = 2, seed: int = 0) -> DataFrame:
    """(model, realization, orig, dest, weight): the real network ``edges`` as model 0, and the four null models of it and of ``catalog`` (with a class for each of two catalogs)."""
    edges = written(edges, "edges")  # a pass over the catalog
    real = edges.select(F.lit(0).cast("long").alias("model"), F.lit(0).cast("long").alias("realization"), "orig", "dest", "weight")
    rewired = nulls.rewire(edges, lattice, realizations, maxdist, seed).where("orig <> dest").withColumn("model", F.lit(4).cast("long"))
    return written(real.unionByName(walk_networks(catalog, lattice, realizations, seed).select(*EDGE)).unionByName(rewired.select(*EDGE)), "graphs")


def node_importance(all_: DataFrame, alpha: float = 0.1, rounds: int = 10) -> DataFrame:
    """(metric, cell, value, s1..s4): strength, divergence (two-sided) and PageRank of the real network's nodes, and of which
    null models (of ``graphs``) they stand out, after correction over the models. A graph without the node doesn't count."""
    nodes = N.end_nodes(all_, GRAPH)
    of = {
        "strength": (metrics.degree_centrality(nodes, all_, GRAPH), "degree", False),
        "divergence": (metrics.divergence(nodes, all_, GRAPH), "divergence", True),
        "pagerank": (metrics.pagerank(nodes, all_, steps=rounds, tol=None, by=GRAPH), "pagerank", False),
        "clustering": (metrics.clustering(nodes, all_, GRAPH), "clustering", False),
    }
    out = None
    for name, (table, column, two_sided) in of.items():
        values = table.select(*GRAPH, F.col("coord_id").alias("cell"), F.col(column).alias("value"))
        real, null = values.where("model = 0").select("cell", "value"), values.where("model > 0")
        p = stats.significant(stats.benjamini_hochberg(stats.p_values(real, null, "value", two_sided)), alpha=alpha)
        rows = real.join(stats.wide_flags(p), "cell", "left").select(F.lit(name).alias("metric"), "cell", "value", "s1", "s2", "s3", "s4")
        out = rows if out is None else out.unionByName(rows)
    return out


def central_edges(all_: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(orig, dest, edge_betweenness, threshold, central): the real network's edges, and whether their betweenness is at least the threshold: the
    largest over the null models of the alpha quantile of their pooled values. Paths of all graphs go through the same rounds."""
    central = written(edge_betweenness(N.end_nodes(all_, GRAPH), all_, by=GRAPH), "central")
    top = metrics.ensemble_threshold(central.where("model > 0"), "edge_betweenness", alpha)
    real = central.where("model = 0").join(F.broadcast(top), F.lit(True))
    high = (F.col("edge_betweenness") > 0) & (F.col("edge_betweenness") >= F.col("threshold") - 1e-12)
    return real.select("orig", "dest", "edge_betweenness", "threshold", high.alias("central"))


#: the 5 x 5 cells of the fixture as a lattice
NEIGHBOURS = "SELECT a.cell AS orig, b.cell AS dest, CAST(1 AS DOUBLE) AS weight FROM fx_cells a JOIN fx_cells b ON abs(floor(a.cell / 5) - floor(b.cell / 5)) <= 1 AND abs(a.cell % 5 - b.cell % 5) <= 1 AND a.cell <> b.cell"


def sql_draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT)"


def sql_graphs(realizations: int, eps: float = 4, thresh: float = 5, maxdist: int = 2) -> str:
    """Common table expressions (recursive) up to ``al`` (model, realization, orig, dest, weight), as ``graphs`` of the fixture."""
    key = "model, realization, class, trackid"
    runs = f"unnest(range(0, {realizations})) AS r(realization)"
    reach = " UNION ".join(["SELECT orig, dest FROM lat", "SELECT a.orig, b.dest FROM lat a JOIN lat b ON a.dest = b.orig WHERE a.orig <> b.dest"][:maxdist])
    return f"""lat AS MATERIALIZED ({NEIGHBOURS}),
        cc AS (SELECT CAST(trackid % 2 AS BIGINT) AS class, orig, dest, count(*) AS n FROM fx_pairs WHERE orig <> dest GROUP BY 1, 2, 3 HAVING count(*) >= {eps}),
        real AS MATERIALIZED (SELECT orig, dest, sum(n) / 2 AS weight FROM cc GROUP BY 1, 2 HAVING bool_and(n >= {thresh}) AND sum(n) / 2 > {eps}),
        tr AS MATERIALIZED (SELECT CAST(trackid % 2 AS BIGINT) AS class, trackid, count(*) AS n, arg_min(coord_idx, seq) AS f, arg_max(coord_idx, seq) AS l FROM fx_catalog_a WHERE coord_idx IS NOT NULL GROUP BY 1, 2),
        nums AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS num, count(*) OVER () AS k FROM fx_cells),
        near AS MATERIALIZED (SELECT *, sum(weight) OVER (PARTITION BY way, cell ORDER BY x) AS hi, sum(weight) OVER (PARTITION BY way, cell ORDER BY x) - weight AS lo, sum(weight) OVER (PARTITION BY way, cell) AS total
              FROM (SELECT 1 AS way, orig AS cell, dest AS x, weight FROM lat UNION ALL SELECT -1, dest, orig, weight FROM lat)),
        run AS MATERIALIZED (SELECT tr.*, CAST(realization AS BIGINT) AS realization FROM tr, {runs}),
        wk AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS model, realization, class, trackid, n, 1 AS way, nums.cell FROM run JOIN nums ON num = {sql_draw("'0'", "'1'", "realization", "class", "trackid", "'0'")} % k
              UNION ALL SELECT 2, realization, class, trackid, n, 1, f FROM run UNION ALL SELECT 3, realization, class, trackid, n, -1, l FROM run),
        wa({key}, n, way, step, cell) AS (SELECT {key}, n, way, 1, cell FROM wk UNION ALL
              SELECT {key}, n, wa.way, step + 1, x FROM (SELECT *, {sql_draw("'0'", "model", "realization", "class", "trackid", "step")} / CAST({1 << 52} AS DOUBLE) AS u FROM wa WHERE step < n) wa JOIN near ON near.way = wa.way AND near.cell = wa.cell AND lo <= u * total AND u * total < hi),
        st AS (SELECT model, realization, class, cell AS a, lead(cell) OVER (PARTITION BY {key} ORDER BY step) AS b FROM wa),
        en AS (SELECT model, realization, class, CASE WHEN model = 3 THEN b ELSE a END AS orig, CASE WHEN model = 3 THEN a ELSE b END AS dest FROM st WHERE b IS NOT NULL AND a <> b),
        wn AS (SELECT model, realization, orig, dest, count(*) / 2 AS weight FROM en GROUP BY ALL),
        rc AS (SELECT orig, list(dest ORDER BY dest) AS near FROM ({reach}) GROUP BY 1),
        rw AS (SELECT CAST(realization AS BIGINT) AS realization, real.orig, coalesce(near[{sql_draw("'0'", "realization", "real.orig", "dest")} % len(near) + 1], dest) AS dest, weight FROM real LEFT JOIN rc USING (orig), {runs}),
        al AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS model, CAST(0 AS BIGINT) AS realization, orig, dest, weight FROM real UNION ALL SELECT * FROM wn
              UNION ALL SELECT 4, realization, orig, dest, sum(weight) FROM rw WHERE orig <> dest GROUP BY ALL)"""


def sql_importance(realizations: int, alpha: float, rounds: int = 10) -> str:
    g = "model, realization"
    steps = ", ".join(
        f"""f{i} AS (SELECT {g}, dest AS cell, sum(r * p) AS f FROM pp JOIN r{i - 1} USING ({g}) WHERE r{i - 1}.cell = orig GROUP BY ALL),
        l{i} AS (SELECT {g}, sum(CASE WHEN o.cell IS NULL THEN r ELSE 0 END) AS lost FROM r{i - 1} LEFT JOIN (SELECT DISTINCT {g}, orig AS cell FROM al) o USING ({g}, cell) GROUP BY ALL),
        r{i} AS MATERIALIZED (SELECT {g}, cell, 0.85 * (coalesce(f, 0) + lost / n) + 0.15 / n AS r FROM nd LEFT JOIN f{i} USING ({g}, cell) JOIN l{i} USING ({g}) JOIN sz USING ({g}))"""
        for i in range(1, rounds + 1)
    )
    return f"""WITH RECURSIVE {sql_graphs(realizations)},
        nd AS MATERIALIZED (SELECT {g}, orig AS cell FROM al UNION SELECT {g}, dest FROM al), sz AS (SELECT {g}, count(*) AS n FROM nd GROUP BY ALL),
        io AS (SELECT {g}, cell, sum(o) AS o, sum(i) AS i FROM (SELECT {g}, orig AS cell, weight AS o, 0 AS i FROM al UNION ALL SELECT {g}, dest, 0, weight FROM al) GROUP BY ALL),
        pp AS MATERIALIZED (SELECT {g}, orig, dest, weight / sum(weight) OVER (PARTITION BY {g}, orig) AS p FROM al), r0 AS (SELECT {g}, cell, CAST(1 AS DOUBLE) / n AS r FROM nd JOIN sz USING ({g})), {steps},
        ty AS MATERIALIZED (SELECT {g}, least(orig, dest) AS u, greatest(orig, dest) AS v, count(*) AS m FROM al GROUP BY ALL),
        bo AS MATERIALIZED (SELECT {g}, u, v, m FROM ty UNION ALL SELECT {g}, v, u, m FROM ty),
        dg AS (SELECT {g}, u AS cell, sum(m) AS d, sum(CASE WHEN m = 2 THEN 1 ELSE 0 END) AS r FROM bo GROUP BY ALL),
        tg AS (SELECT a.model, a.realization, a.u AS cell, sum(a.m * b.m * c.m) AS t FROM bo a JOIN bo b ON a.model = b.model AND a.realization = b.realization AND a.u = b.u AND a.v < b.v
               JOIN ty c ON c.model = a.model AND c.realization = a.realization AND c.u = a.v AND c.v = b.v GROUP BY ALL),
        vs AS (SELECT 'strength' AS metric, {g}, cell, o + i AS v FROM io UNION ALL SELECT 'divergence', {g}, cell, o - i FROM io UNION ALL SELECT 'pagerank', {g}, cell, r FROM r{rounds}
               UNION ALL SELECT 'clustering', {g}, cell, coalesce(t / (d * (d - 1) - 2 * r), 0) FROM nd LEFT JOIN dg USING ({g}, cell) LEFT JOIN tg USING ({g}, cell)),
        mu AS (SELECT metric, model, cell, avg(v) AS mu FROM vs WHERE model > 0 GROUP BY ALL),
        pv AS (SELECT re.metric, re.cell, nu.model, (count(*) FILTER (CASE WHEN re.metric = 'divergence' THEN abs(nu.v - mu) >= abs(re.v - mu) - 1e-12 ELSE nu.v >= re.v - 1e-12 END) + 1) / (count(*) + 1) AS p
               FROM vs re JOIN vs nu ON re.model = 0 AND nu.model > 0 AND re.metric = nu.metric AND re.cell = nu.cell JOIN mu ON mu.metric = nu.metric AND mu.model = nu.model AND mu.cell = nu.cell GROUP BY ALL),
        ra AS (SELECT *, p * count(*) OVER (PARTITION BY metric, cell) / row_number() OVER (PARTITION BY metric, cell ORDER BY p, model) AS a FROM pv),
        bh AS (SELECT metric, cell, model, least(1.0, min(a) OVER (PARTITION BY metric, cell ORDER BY p DESC, model DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ra),
        fl AS (SELECT metric, cell, {", ".join(f"CAST(bool_or(q < {alpha}) FILTER (model = {i}) AS INT)::BIGINT AS s{i}" for i in range(1, 5))} FROM bh GROUP BY ALL)
        SELECT metric, cell, round(v, 6) AS value, s1, s2, s3, s4 FROM vs LEFT JOIN fl USING (metric, cell) WHERE model = 0"""


def sql_central(realizations: int, alpha: float) -> str:
    """The graphs side by side as one, their cells numbered apart."""
    from . import oracles

    apart = "(model * 1000 + realization) * 100"
    return f"""WITH RECURSIVE {sql_graphs(realizations)},
        {oracles.betweenness('1 / weight', f'SELECT {apart} + orig AS orig, {apart} + dest AS dest, weight FROM al', f'SELECT {apart} + orig AS cell FROM al UNION SELECT {apart} + dest FROM al')},
        sz AS (SELECT floor(cell / 100) AS g, count(*) AS n FROM node GROUP BY 1),
        ce AS (SELECT floor(o.orig / 100000) AS model, o.orig % 100 AS orig, o.dest % 100 AS dest, coalesce(b, 0) / (n * (n - 1)) AS x FROM e o LEFT JOIN b ON b.v = o.orig AND b.w = o.dest JOIN sz ON g = floor(o.orig / 100)),
        th AS (SELECT max(q) AS threshold FROM (SELECT model, quantile_cont(x, {alpha}) AS q FROM ce WHERE model > 0 GROUP BY 1))
        SELECT orig, dest, round(x, 6) AS edge_betweenness, round(threshold, 6) AS threshold, CAST(x > 0 AND x >= threshold - 1e-12 AS INT)::BIGINT AS central FROM ce, th WHERE model = 0"""
