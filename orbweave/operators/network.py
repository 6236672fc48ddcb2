"""Transport networks from origin-destination pairs, and their combination.

Edges are long tables (orig, dest, weight) with optional class columns; one plan serves all classes,
catalogs and realizations. Every aggregate has a map-side half; node dimensions are joined by id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.running import quantiles, running_places, with_group
from ..schema import Network


def transport_matrix(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many steps go from orig to dest (the same track may count again)."""
    return pairs.groupBy(*by, "orig", "dest").agg(F.count(F.lit(1)).alias("cnt"))


def cell_ids(pairs: DataFrame) -> DataFrame:
    """Every cell that is an origin or a destination."""
    return pairs.select(F.col("orig").alias("cell")).unionByName(pairs.select(F.col("dest").alias("cell"))).distinct()


def dense_index(ids: DataFrame, column: str = "cell") -> DataFrame:
    """``idx`` from 0 in order of the ids, which differ."""
    return running_places(ids.withColumn("_one", F.lit(1)), [column], "_one").withColumn("idx", F.col("before").cast("long")).select(*ids.columns, "idx")


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.where("orig <> dest")


def build_edges(counts: DataFrame, weighted: bool = True, directed: bool = True, eps: float | DataFrame = 1, self_links: bool = False, weighing: str = "absolute", by: Sequence[str] = ()) -> DataFrame:
    """Edges of a transport matrix (orig, dest, cnt): those of ``eps`` counts or more.

    Weighted and directed: the count, or with ``weighing='relative'`` its share of all counts from orig (before the
    threshold). Weighted and undirected: mean of both directions, orig < dest, never self-links; relative to the row
    sum of the smaller id. Unweighted: 1; undirected if either direction reaches eps. ``eps`` may be a frame of
    thresholds (by columns, eps).
    """
    if weighing not in ("absolute", "relative"):
        raise ValueError("weighing: absolute or relative")
    by = list(by)
    df = counts.select(*by, "orig", "dest", F.col("cnt").cast("double").alias("cnt"))
    if isinstance(eps, DataFrame):
        df = df.join(F.broadcast(eps), by)
        least = F.col("eps")
    else:
        df, least = df.withColumn("eps", F.lit(float(eps))), F.col("eps")
    if not self_links or (weighted and not directed):
        df = no_loops(df)
    if weighted and directed:
        if weighing == "relative":
            df = with_group(df, [*by, "orig"], _total=F.sum("cnt"))
        weight = F.col("cnt") / F.col("_total") if weighing == "relative" else F.col("cnt")
        return df.withColumn("weight", weight).where(F.col("cnt") >= least).select(*by, "orig", "dest", "weight")
    if weighted:
        both = df.unionByName(df.select(*by, F.col("dest").alias("orig"), F.col("orig").alias("dest"), "cnt", "eps"))
        half = both.groupBy(*by, "orig", "dest").agg((F.sum("cnt") / 2).alias("s"), F.max("eps").alias("eps"))
        if weighing == "relative":
            half = with_group(half, [*by, "orig"], _total=F.sum("s"))
        weight = F.col("s") / F.col("_total") if weighing == "relative" else F.col("s")
        return half.withColumn("weight", weight).where((F.col("s") >= least) & (F.col("orig") < F.col("dest"))).select(*by, "orig", "dest", "weight")
    met = df.where(F.col("cnt") >= least)
    if directed:
        return met.select(*by, "orig", "dest", F.lit(1.0).alias("weight"))
    if not isinstance(eps, DataFrame) and eps < 1:
        raise ValueError("an unweighted undirected network needs eps >= 1")
    return met.select(*by, F.least("orig", "dest").alias("orig"), F.greatest("orig", "dest").alias("dest")).distinct().withColumn("weight", F.lit(1.0))


def end_nodes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes that an edge begins or ends in."""
    return edges.select(*by, F.col("orig").alias("coord_id")).unionByName(edges.select(*by, F.col("dest").alias("coord_id"))).distinct()


def generate_network(counts: DataFrame, cells: DataFrame, weighted: bool = True, directed: bool = True, eps: float | DataFrame = 1, self_links: bool = False, weighing: str = "absolute", by: Sequence[str] = ()) -> Network:
    """The network of a transport matrix; ``cells`` (coord_id, lat, lon) give nodes their place, rounded to two decimals.

    An unweighted undirected network keeps all cells of the matrix, the others only ends of edges.
    """
    edges = build_edges(counts, weighted, directed, eps, self_links, weighing, by)
    nodes = end_nodes(edges if weighted or directed else counts, by)
    place = cells.select("coord_id", S.round2(F.col("lat")).alias("lat"), S.round2(F.col("lon")).alias("lon"))
    return Network(nodes.join(place, "coord_id", "left"), edges, directed)


def edge_places(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with lat1, lon1, lat2, lon2 of their ends."""
    a = nodes.select(F.col("coord_id").alias("orig"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("coord_id").alias("dest"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return edges.join(a, "orig").join(b, "dest")


def add_edge_attribute(edges: DataFrame, values: DataFrame, name: str, default: float = S.NAN) -> DataFrame:
    """A column of (orig, dest, name) on each edge; ``default`` where it is missing."""
    return edges.join(values.select("orig", "dest", name), ["orig", "dest"], "left").withColumn(name, F.coalesce(name, F.lit(default)))


def add_node_attribute(nodes: DataFrame, values: DataFrame, name: str, default: float = S.NAN) -> DataFrame:
    """A column of (coord_id, name) on each node; ``default`` where it is missing."""
    return nodes.join(values.select("coord_id", name), "coord_id", "left").withColumn(name, F.coalesce(name, F.lit(default)))


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends renamed by (old, new); of edges that fall together that of largest (old orig, old dest) stays."""
    a, b = mapping.select(F.col("old").alias("orig"), F.col("new").alias("a")), mapping.select(F.col("old").alias("dest"), F.col("new").alias("b"))
    named = edges.join(a, "orig").join(b, "dest")
    return named.groupBy("a", "b").agg(F.max_by("weight", F.struct("orig", "dest")).alias("weight")).select(F.col("a").alias("orig"), F.col("b").alias("dest"), "weight")


def axis_cells(spark, res: float) -> DataFrame:
    """Every cell (lat, lon) of the rectangular grid."""
    n_lon, n_lat = math.ceil((360 + res) / res - 1e-12), math.ceil((180 + res) / res - 1e-12)
    ids = spark.range(n_lon * n_lat)
    return ids.select((F.lit(-90.0) + F.lit(float(res)) * F.floor(F.col("id") / n_lon)).alias("lat"), (F.lit(-180.0) + F.lit(float(res)) * (F.col("id") % n_lon)).alias("lon"))


def rect_cells(spark, res: float) -> DataFrame:
    """(coord_id, lat, lon) of every cell of the rectangular grid."""
    return axis_cells(spark, res).select(S.cell_id(F.col("lat"), F.col("lon")).alias("coord_id"), "lat", "lon")


def complete_nodes(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Nodes and the cells that are no node yet, their other attributes missing."""
    return nodes.unionByName(cells.join(nodes.select("coord_id"), "coord_id", "left_anti"), allowMissingColumns=True)


def normalize_outgoing(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``probability``: weight over the origin's total, 0 where that isn't positive."""
    df = with_group(edges, [*by, "orig"], _total=F.sum("weight"))
    return df.withColumn("probability", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(0.0)).drop("_total")


def invert_weights(edges: DataFrame, attribute: str = "weight") -> DataFrame:
    """``attribute`` replaced by 1 / it; infinity where it isn't positive."""
    return edges.withColumn(attribute, F.when(F.col(attribute) > 0, 1 / F.col(attribute)).otherwise(F.lit(float("inf"))))


def downsample(mask: DataFrame, factor: int) -> DataFrame:
    """(row, col, value) in blocks of factor × factor: the commonest value, the smallest of equals; partial blocks go."""
    size = mask.agg((F.floor((F.max("row") + 1) / factor)).alias("_r"), (F.floor((F.max("col") + 1) / factor)).alias("_c"))
    block = mask.select(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), "value")
    counts = block.groupBy("row", "col", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("row", "col").agg(F.min(F.struct(-F.col("n"), "value"))["value"].alias("value"))
    return best.join(F.broadcast(size), (F.col("row") < F.col("_r")) & (F.col("col") < F.col("_c"))).select("row", "col", "value")


def assign_continent(nodes: DataFrame, mask: DataFrame, res: float) -> DataFrame:
    """``continent``: the mask's value (row, col, value) at the nearest of the axes -90, -90 + res, ... and -180, -180 + res, ..."""
    at = nodes.withColumns({"row": ((S.nearest_cell(F.col("lat"), -90.0, 90.0 - res, res) + 90) / res).cast("long"), "col": ((S.nearest_cell(F.col("lon"), -180.0, 180.0 - res, res) + 180) / res).cast("long")})
    return at.join(mask.select("row", "col", F.col("value").alias("continent")), ["row", "col"], "left").drop("row", "col")


# combination


def consensus(edges: DataFrame, n: int, thresh: float, eps: float, by: Sequence[str] = ()) -> DataFrame:
    """Edges of n networks stacked in one frame: kept if every weight is 0 or >= thresh and sum / n > eps; weight = sum / n."""
    out = edges.groupBy(*by, "orig", "dest").agg((F.sum("weight") / n).alias("weight"), F.bool_and((F.col("weight") == 0) | (F.col("weight") >= thresh)).alias("_all"))
    return out.where(F.col("_all") & (F.col("weight") > eps)).drop("_all")


def consensus_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of all networks, one for each cell; of different places the smallest."""
    return nodes.groupBy("coord_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("coord_id", "p.lat", "p.lon")


def average(edges: DataFrame, *attributes: str, by: Sequence[str] = ()) -> DataFrame:
    """Means of attributes over the networks that have the edge; a NaN makes the mean NaN."""
    return edges.groupBy(*by, "orig", "dest").agg(*[F.avg(a).alias(a) for a in attributes])


def average_networks(a: Network, b: Network, attribute: str | None = None) -> Network:
    """Mean weights (and edge_betweenness, 0 if missing) over the networks that have an edge; the nodes of both.

    ``attribute`` is averaged over edges only if every edge of both networks has a value of it, over nodes only if
    every node of both has; else the result lacks it.
    """
    names = ["weight", "edge_betweenness"]
    full = lambda x, y: attribute in x.columns and attribute in y.columns and x.select(attribute).unionByName(y.select(attribute)).where(F.col(attribute).isNull()).isEmpty()
    if attribute and full(a.edges, b.edges):
        names.append(attribute)
    one = lambda n: n.edges.select("orig", "dest", *[F.coalesce(c, F.lit(0.0)).alias(c) if c in n.edges.columns else F.lit(0.0).alias(c) for c in names])
    edges = average(one(a).unionByName(one(b)), *names)
    own = [attribute] if attribute and full(a.nodes, b.nodes) else []
    nodes = a.nodes.select("coord_id", "lat", "lon", *own).unionByName(b.nodes.select("coord_id", "lat", "lon", *own))
    return Network(nodes.groupBy("coord_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), *[F.avg(c).alias(c) for c in own]), edges, True)


def pooled_thresholds(values: DataFrame, column: str, at: Sequence[float] = (0.75, 0.85, 0.95)) -> DataFrame:
    """One row with ``q``: the six thresholds 1 - a and a of the pooled values, exact."""
    return quantiles(values, column, sorted([1 - a for a in at] + list(at)))
