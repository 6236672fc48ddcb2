"""Composite queries: from catalogs to networks, their metrics and their significance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import community as H
from ..operators import climate, geometry, metrics, stats
from ..operators import network as N


def consensus_edges(catalog: DataFrame, eps: float, thresh: float) -> DataFrame:
    """Consensus of the networks of two catalogs (tracks of even and odd id): one shuffle by track, one by edge."""
    two = catalog.withColumn("class", F.col("trackid") % 2)
    edges = N.build_edges(N.transport_matrix(C.pairs(two), ["class"]), eps=eps, by=["class"])
    return N.consensus(edges, 2, thresh, eps)


def consensus_strengths(catalog: DataFrame, nodes: DataFrame, eps: float, thresh: float) -> DataFrame:
    """Out- and in-strength of each node in the consensus network."""
    return metrics.strengths(nodes, consensus_edges(catalog, eps, thresh))


def highways(catalog: DataFrame, nodes: DataFrame, eps: float, quantiles: Sequence[float] = (0.6, 0.75, 0.9)) -> DataFrame:
    """Edges with weight, IVT class and betweenness: the moisture-weighted transport network."""
    pairs = C.pairs(catalog)
    edges = N.build_edges(N.transport_matrix(pairs), eps=eps)
    ivt = metrics.edge_transport(pairs, quantiles=quantiles)
    central = metrics.edge_betweenness(N.end_nodes(edges), edges)
    return edges.join(ivt, ["orig", "dest"], "left").join(central, ["orig", "dest"], "left")


def community_ensemble(nodes: DataFrame, edges: DataFrame, seeds: Sequence[int], least: int) -> DataFrame:
    """(node, community, heterogeneity): consensus of a seed ensemble and how much the seeds disagree on each node."""
    parts = H.unassign_small(H.communities(nodes, edges, seeds), least)
    return H.consensus_communities(parts).join(H.heterogeneity(parts), "node", "left")


def node_significance(real: DataFrame, null: DataFrame, metric: str, alpha: float = 0.1) -> DataFrame:
    """(cell, metric, s1..s4): real values and which null models they exceed after correction over the models."""
    p = stats.significant(stats.benjamini_hochberg(stats.p_values(real, null, metric)), alpha=alpha)
    return real.join(stats.wide_flags(p), "cell", "left")


def class_networks(catalog: DataFrame, cond: str, eps: dict) -> DataFrame:
    """(class, orig, dest, weight): a network for each class of a condition, with thresholds by class name."""
    df, _ = C.condition(catalog, cond)
    limits = catalog.sparkSession.createDataFrame([(k, float(v)) for k, v in eps.items()], "class string, eps double")
    return N.build_edges(N.transport_matrix(C.pairs(df), ["class"]), eps=limits, by=["class"])


def upstream_network(catalog: DataFrame, communities: DataFrame, community: int, eps: float) -> DataFrame:
    """The network of the tracks' parts up to where they enter a community."""
    part = C.to_entry_region(catalog, C.region_of(communities, community), False)
    return N.build_edges(N.transport_matrix(C.pairs(part)), eps=eps)




def regime_networks(catalog: DataFrame, phases: DataFrame, eps: float) -> DataFrame:
    """(class, orig, dest, weight): a network for each phase of a daily climate index (day, phase)."""
    df, _ = C.condition(climate.with_index(catalog, phases, "phase"), "teleconnection")
    return N.build_edges(N.transport_matrix(C.pairs(df), ["class"]), eps=eps, by=["class"])


def regime_change(catalog: DataFrame, phases: DataFrame, eps: float, a: int, b: int) -> DataFrame:
    """(coord_id, change): how a node's strength in the network of phase b differs from that in phase a, where it is a node of both."""
    edges = regime_networks(catalog, phases, eps)
    strength = lambda k: edges.where(F.col("class") == k).select(F.explode(F.array("orig", "dest")).alias("coord_id"), "weight").groupBy("coord_id").agg(F.sum("weight").alias("degree"))
    return geometry.change_table(strength(a), strength(b), "degree")


def typed_track_tests(catalog: DataFrame, edges: DataFrame, feature: str, attribute: str = "weight") -> DataFrame:
    """(statistic, p): the distributions of a track feature's mean among conformist and stray tracks, by Kolmogorov and Smirnov."""
    kinds = C.classify_tracks(catalog, edges, attribute).where("kind IN ('conformist', 'stray')").select("trackid", "kind")
    values = C.track_means(catalog, feature).join(kinds, "trackid").select(F.col(feature).alias("v"), "kind")
    return stats.kolmogorov_smirnov(values, "v", "kind", "conformist", "stray")


def ensemble_stability(partitions: DataFrame) -> DataFrame:
    """(pairs, mean, least, mean_ami, least_ami): adjusted Rand index and mutual information over all pairs of seeds."""
    pairs = H.adjusted_rand(partitions).join(H.adjusted_mutual_info(partitions), ["s1", "s2"])
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg("ari").alias("mean"), F.min("ari").alias("least"), F.avg("ami").alias("mean_ami"), F.min("ami").alias("least_ami"))


def basin_highways(catalog: DataFrame, levels: DataFrame, level: int, community: int, eps: float, share: float) -> DataFrame:
    """(orig, dest, weight): edges that tracks take before they enter a basin (a community of a level), those that carry at least a share of the largest weight."""
    basin = levels.where(F.col("level") == level).select(F.col("node").alias("hex_id"), "community")
    edges = upstream_network(catalog, basin, community, eps)
    top = edges.agg(F.max("weight").alias("_top"))
    return edges.join(F.broadcast(top), F.lit(True)).where(F.col("weight") >= share * F.col("_top")).drop("_top")


def level_conductance(flow: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, modules, mean): mean conductance (share of a module's outgoing flow that leaves it) of each level's modules."""
    a, b = levels.select("level", F.col("node").alias("src"), F.col("community").alias("c1")), levels.select(F.col("level").alias("l2"), F.col("node").alias("dst"), F.col("community").alias("c2"))
    ends = flow.join(a, "src").join(b, "dst").where("level = l2")
    each = ends.groupBy("level", "c1").agg((F.sum(F.when(F.col("c1") != F.col("c2"), F.col("flow")).otherwise(0.0)) / F.sum("flow")).alias("x"))
    return each.groupBy("level").agg(F.count(F.lit(1)).alias("modules"), F.avg("x").alias("mean"))


def conductance_significance(flow: DataFrame, levels: DataFrame, null: DataFrame) -> DataFrame:
    """(level, mean, p): the share of null realizations (level, realization, mean) whose mean conductance is at most the real one."""
    real = level_conductance(flow, levels)
    return real.join(null.withColumnRenamed("mean", "other"), "level", "left").groupBy("level", "mean").agg(F.avg((F.col("other") <= F.col("mean")).cast("double")).alias("p"))
