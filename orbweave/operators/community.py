"""Communities: search by the map equation, and the algebra of partitions.

Partitions are long tables (seed, node, community), levels (level, node, community), flows (src, dst, flow).
Community -999 is "unassigned". Similarities of communities come from their contingency counts: pairs of
communities that share a node, never pairs of nodes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.running import running_places, with_group
from ..schema import UNASSIGNED
from ..sources.scratch import written
from . import mapequation

# search by the map equation


def communities(nodes: DataFrame, edges: DataFrame, seeds: Sequence[int] = (1,), node_flow: str = "pagerank", still: float = mapequation.STILL, walk: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(seed, node, community): two-level partitions of short code, all seeds in one plan. Isolated nodes are alone. See ``mapequation``.

    ``walk``: rates and flows of ``mapequation.random_walk`` where they are at hand.
    """
    rates, flows = walk or mapequation.random_walk(nodes, edges, node_flow)
    each = F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed")
    flows = written(flows, "flows")
    out = flows.groupBy(F.col("src").alias("node")).agg(F.sum("flow").alias("out"))
    start = rates.join(out, "node", "left").select(each, F.col("node").alias("v"), F.col("rate").alias("size"), F.coalesce("out", F.lit(0.0)).alias("out"))
    extra = start.select("seed").distinct().withColumn("extra", F.lit(0.0))
    found = mapequation.search(start, mapequation.both_ends(flows).select(each, "v", "w", "o", "i"), extra, ["seed"], still)
    return _numbered(found.select("seed", F.col("v").alias("node"), F.col("a").alias("community")), nodes)


def _numbered(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities, named by a node, as the place of that node among all."""
    place = running_places(nodes.select(F.col("coord_id").alias("community")).distinct().withColumn("_one", F.lit(1)), ["community"], "_one").select("community", F.col("before").cast("long").alias("_place"))
    return parts.join(place, "community").withColumn("community", F.col("_place")).select(*parts.columns)


def hierarchical_communities(nodes: DataFrame, edges: DataFrame, seed: int = 1, least: int = 4, deepest: int = 6) -> DataFrame:
    """(level, node, community): top modules at level 0, each split again within itself where that shortens the code; a label never comes
    back at another level. All modules of a level are searched in one plan; those of fewer than ``least`` nodes stay whole.

    The parts of a module count all flow that leaves them, and the module's own leaving flow goes into their index codebook.
    """
    rates, flows = mapequation.random_walk(nodes, edges)
    flows = written(flows, "flows")
    out = flows.groupBy(F.col("src").alias("node")).agg(F.sum("flow").alias("out"))
    node = written(rates.join(out, "node", "left").select(F.lit(int(seed)).cast("long").alias("seed"), F.col("node").alias("v"), F.col("rate").alias("size"), F.coalesce("out", F.lit(0.0)).alias("out")), "nodes")
    zero = node.select("seed").distinct().withColumn("extra", F.lit(0.0))
    top = mapequation.search(node, mapequation.both_ends(flows).select(F.lit(int(seed)).cast("long").alias("seed"), "v", "w", "o", "i"), zero, ["seed"])
    level = [written(top.select("v", F.col("a").alias("module")), "level")]
    while len(level) < deepest:
        up = level[-1]
        home = flows.join(up.select(F.col("v").alias("src"), "module"), "src").join(up.select(F.col("v").alias("dst"), F.col("module").alias("_m")), "dst")
        leaves = home.where("module <> _m").groupBy("module").agg(F.sum("flow").alias("extra"))
        whole = node.join(up, "v").groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("p")).join(leaves, "module", "left").na.fill(0.0, ["extra"])
        whole = written(whole.where(F.col("n") >= least), "whole")
        if whole.isEmpty():
            break
        key = ["seed", "module"]
        inner = node.join(up, "v").join(whole.select("module"), "module", "left_semi").select(*key, "v", "size", "out")
        within = mapequation.both_ends(home.where("module = _m").join(whole.select("module"), "module", "left_semi").withColumn("seed", F.lit(int(seed)).cast("long")), key)
        parts = mapequation.search(inner, within, whole.select(F.lit(int(seed)).cast("long").alias("seed"), "module", "extra"), key)
        terms = mapequation.module_terms(rates, flows, parts.select("module", F.col("v").alias("node"), F.col("a").alias("community")), ["module"])
        # flow to other modules leaves a part too
        outer = home.where("module <> _m").join(parts.select(F.col("v").alias("src"), "a"), "src").groupBy("module", F.col("a").alias("community")).agg(F.sum("flow").alias("_o"))
        terms = terms.join(outer, ["module", "community"], "left").withColumn("q", F.col("q") + F.coalesce("_o", F.lit(0.0)))
        plogp = mapequation.plogp
        cost = terms.groupBy("module").agg(F.count(F.lit(1)).alias("k"), F.sum("q").alias("s"), F.sum(plogp(F.col("q") + F.col("p")) - 2 * plogp(F.col("q"))).alias("h"))
        gain = cost.join(whole, "module").where((F.col("k") > 1) & (plogp(F.col("s") + F.col("extra")) + F.col("h") < plogp(F.col("extra") + F.col("p")) - 1e-10)).select("module", F.lit(True).alias("splits"))
        gain = written(gain, "splits")
        if gain.isEmpty():
            break
        down = up.join(gain, "module", "left").join(parts.select("module", "v", "a"), ["module", "v"], "left")
        level.append(written(down.select("v", F.when(F.col("splits"), F.col("a")).otherwise(F.col("module")).alias("module")), "level"))
    many = nodes.select("coord_id").distinct().count()
    rows = None
    for i, df in enumerate(level):
        one = _numbered(df.select(F.lit(i).cast("long").alias("level"), F.col("v").alias("node"), F.col("module").alias("community")), nodes).withColumn("community", F.col("community") + i * many)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def codelength(rates: DataFrame, flows: DataFrame, modules: DataFrame) -> DataFrame:
    """The map equation as aggregates: rates (node, rate), flows (src, dst, flow), modules (node, community)."""
    h = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    ends = flows.join(modules.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").join(modules.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    leave = ends.groupBy(F.col("c1").alias("community")).agg(F.sum(F.when(F.col("c1") != F.col("c2"), F.col("flow")).otherwise(0.0)).alias("q"))
    inside = rates.join(modules, "node").groupBy("community").agg(F.sum("rate").alias("p"), F.sum(h(F.col("rate"))).alias("e"))
    rows = inside.join(leave, "community", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    total = rows.agg(F.sum("q").alias("q"), F.sum(h(F.col("q"))).alias("hq"), F.sum("e").alias("e"), F.sum(h(F.col("q") + F.col("p"))).alias("hqp"))
    return total.select((h(F.col("q")) - 2 * F.col("hq") - F.col("e") + F.col("hqp")).alias("codelength"))


# filters and flows


def filter_small(levels: DataFrame, least: int = 10) -> DataFrame:
    """``small``: the node is in a community of fewer than ``least`` nodes at this level or an earlier one."""
    flagged = with_group(levels, ["level", "community"], _n=F.count(F.lit(1))).withColumn("_s", (F.col("_n") < least).cast("int")).drop("_n")
    return flagged.withColumn("small", F.max("_s").over(Window.partitionBy("node").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_s")


def unassign_small(partitions: DataFrame, least: int = 10, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Communities of fewer than ``least`` nodes become -999."""
    sized = with_group(partitions, [*by, "community"], _n=F.count(F.lit(1)))
    return sized.withColumn("community", F.when(F.col("_n") < least, F.lit(UNASSIGNED)).otherwise(F.col("community"))).drop("_n")


def both_assigned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where((F.col(a) != UNASSIGNED) & (F.col(b) != UNASSIGNED))


def module_flow(levels: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow between communities at each level (level, c1, c2, flow), and each community's incoming total (level, c, total)."""
    some = levels.where(F.col("community") != UNASSIGNED)
    a = some.select("level", F.col("node").alias("src"), F.col("community").alias("c1"))
    b = some.select("level", F.col("node").alias("dst"), F.col("community").alias("c2"))
    matrix = flows.join(a, "src").join(b, ["level", "dst"]).groupBy("level", "c1", "c2").agg(F.sum("flow").alias("flow"))
    return matrix, matrix.groupBy("level", F.col("c2").alias("c")).agg(F.sum("flow").alias("total"))


def filter_by_flow(levels: DataFrame, totals: DataFrame, share: float = 0.8) -> DataFrame:
    """Communities kept are the largest by flow through the first to reach the share; the others are -999 here and at later levels."""
    w = Window.partitionBy("level").orderBy(F.desc("total"), "c")
    cum = F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0))
    keep = totals.withColumn("_before", cum - F.col("total")).withColumn("_all", F.sum("total").over(Window.partitionBy("level")))
    keep = keep.select("level", F.col("c").alias("community"), (F.col("_before") / F.col("_all") < share).alias("_keep"))
    rows = levels.join(keep, ["level", "community"], "left").withColumn("_out", (~F.coalesce("_keep", F.lit(False))).cast("int"))
    out = F.max("_out").over(Window.partitionBy("node").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) == 1
    return rows.withColumn("community", F.when(out, F.lit(UNASSIGNED)).otherwise(F.col("community"))).select("level", "node", "community")


def flow_ratio(flows: DataFrame, modules: DataFrame) -> DataFrame:
    """(community, ratio): flow inside over flow that leaves; NULL if none leaves. Unassigned nodes don't take part."""
    some = modules.where(F.col("community") != UNASSIGNED)
    ends = flows.join(some.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").join(some.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    inner, outer = F.sum(F.when(F.col("c1") == F.col("c2"), F.col("flow")).otherwise(0.0)), F.sum(F.when(F.col("c1") != F.col("c2"), F.col("flow")).otherwise(0.0))
    return ends.groupBy(F.col("c1").alias("community")).agg(S.share_or_null(inner, outer).alias("ratio"))


def node_flow_ratios(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(node, ratio): of the node's community, inner over total outgoing weight; NULL if there is none."""
    a, b = modules.select(F.col("node").alias("orig"), F.col("community").alias("c1")), modules.select(F.col("node").alias("dest"), F.col("community").alias("c2"))
    ends = edges.join(a, "orig").join(b, "dest")
    ratio = ends.groupBy(F.col("c1").alias("community")).agg(S.share_or_null(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("ratio"))
    return modules.join(ratio, "community", "left").select("node", "ratio")


# similarity of partitions


def contingency(partitions: DataFrame, assigned_only: bool = False) -> DataFrame:
    """(s1, c1, s2, c2, n, n1, n2) for all ordered pairs of seeds: how many nodes communities share, and their sizes."""
    p = partitions.where(F.col("community") != UNASSIGNED) if assigned_only else partitions
    size = p.groupBy("seed", "community").agg(F.count(F.lit(1)).alias("n"))
    a, b = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")), p.select("node", F.col("seed").alias("s2"), F.col("community").alias("c2"))
    met = a.join(b, "node").where("s1 <> s2").groupBy("s1", "c1", "s2", "c2").agg(F.count(F.lit(1)).alias("n"))
    return met.join(size.select(F.col("seed").alias("s1"), F.col("community").alias("c1"), F.col("n").alias("n1")), ["s1", "c1"]).join(size.select(F.col("seed").alias("s2"), F.col("community").alias("c2"), F.col("n").alias("n2")), ["s2", "c2"])


def jaccard(a, b):
    """Jaccard similarity of two array columns, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_jaccard(partitions: DataFrame) -> DataFrame:
    """(c1, c2, s1, s2, jaccard) of the communities of different seeds that share a node."""
    return contingency(partitions).select("s1", "c1", "s2", "c2", (F.col("n") / (F.col("n1") + F.col("n2") - F.col("n"))).alias("jaccard"))


def mean_set_similarity(sets: DataFrame) -> DataFrame:
    """(group, mean): mean Jaccard similarity over the pairs of a group's non-empty sets (group, i, members)."""
    some = sets.where(F.size("members") > 0)
    both = some.alias("x").join(some.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.i") < F.col("y.i")))
    mean = both.groupBy(F.col("x.group").alias("group")).agg(F.avg(jaccard(F.col("x.members"), F.col("y.members"))).alias("mean"))
    return sets.select("group").distinct().join(mean, "group", "left")


def heterogeneity(partitions: DataFrame) -> DataFrame:
    """(node, heterogeneity): one minus the mean Jaccard similarity of the node's communities over pairs of seeds.

    -999 counts as a community; NULL if the node is unassigned in every seed.
    """
    sim = set_jaccard(partitions)
    p = partitions
    a, b = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")), p.select("node", F.col("seed").alias("s2"), F.col("community").alias("c2"))
    each = a.join(b, "node").where("s1 < s2").join(sim, ["s1", "c1", "s2", "c2"])
    mean = each.groupBy("node").agg((1 - F.avg("jaccard")).alias("heterogeneity"))
    known = p.groupBy("node").agg(F.max((F.col("community") != UNASSIGNED).cast("int")).alias("k"))
    return known.join(mean, "node", "left").select("node", F.when(F.col("k") == 1, F.col("heterogeneity")).alias("heterogeneity"))


def most_consistent(partitions: DataFrame) -> DataFrame:
    """(node, seed, community): of each node's communities that most similar on average to the others; the first seed on ties. -999 excluded."""
    p = partitions.where(F.col("community") != UNASSIGNED)
    sim = contingency(partitions, True).select("s1", "c1", "s2", "c2", (F.col("n") / (F.col("n1") + F.col("n2") - F.col("n"))).alias("j"))
    a, b = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")), p.select("node", F.col("seed").alias("s2"), F.col("community").alias("c2"))
    mean = a.join(b, "node").where("s1 <> s2").join(sim, ["s1", "c1", "s2", "c2"]).groupBy("node", "s1", "c1").agg(F.bround(F.avg("j"), 12).alias("m"))
    scored = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")).join(mean, ["node", "s1", "c1"], "left")
    best = scored.groupBy("node").agg(F.max(F.struct(F.coalesce("m", F.lit(-1.0)), -F.col("s1"), F.col("s1").alias("seed"), F.col("c1").alias("community"))).alias("x"))
    return best.select("node", "x.seed", "x.community")


def consensus_communities(partitions: DataFrame) -> DataFrame:
    """(node, community): nodes whose most consistent communities have the same members share an id 1, 2, ... in node order; -999 without any."""
    best = most_consistent(partitions)
    p = partitions.where(F.col("community") != UNASSIGNED)
    # a community's members as a key: count and two hash sums stand for the sorted list
    key = p.groupBy("seed", "community").agg(F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.sum(F.hash("node").cast("long"))).alias("key"))
    keyed = best.join(key, ["seed", "community"]).select("node", "key")
    first = keyed.groupBy("key").agg(F.min("node").alias("first"))
    named = first.withColumn("community", F.row_number().over(Window.orderBy("first")).cast("long"))
    return partitions.select("node").distinct().join(keyed.join(named, "key").select("node", "community"), "node", "left").na.fill(UNASSIGNED, ["community"])


def realisation_centrality(partitions: DataFrame) -> DataFrame:
    """(seed, centrality): mean over nodes of one minus the mean similarity of the seed's community to those of other seeds; ``best`` marks the least."""
    sim = set_jaccard(partitions)
    p = partitions
    a, b = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")), p.select("node", F.col("seed").alias("s2"), F.col("community").alias("c2"))
    node = a.join(b, "node").where("s1 <> s2").join(sim, ["s1", "c1", "s2", "c2"]).groupBy("s1", "node").agg((1 - F.avg("jaccard")).alias("d"))
    out = node.groupBy(F.col("s1").alias("seed")).agg(F.avg("d").alias("centrality"))
    best = out.agg(F.min(F.struct(F.bround("centrality", 12).alias("c"), "seed"))["seed"].alias("_b"))
    return out.join(F.broadcast(best), F.lit(True)).select("seed", "centrality", (F.col("seed") == F.col("_b")).alias("best"))


def pick_seed(partitions: DataFrame, dispersion: DataFrame) -> DataFrame:
    """(seed, score, best): Σ over communities of mean dispersion (node, heterogeneity) times size, over nodes; NULL if a community has none known."""
    per = partitions.join(dispersion, "node", "left").groupBy("seed", "community").agg(F.avg("heterogeneity").alias("m"), F.count(F.lit(1)).alias("n"))
    score = per.groupBy("seed").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("s"), F.count("m").alias("k"), F.count(F.lit(1)).alias("all"))
    out = score.select("seed", F.when(F.col("k") == F.col("all"), F.col("s")).alias("score"))
    best = out.where("score IS NOT NULL").agg(F.min(F.struct(F.bround("score", 12).alias("c"), "seed"))["seed"].alias("_b"))
    return out.join(F.broadcast(best), F.lit(True)).select("seed", "score", F.coalesce(F.col("seed") == F.col("_b"), F.lit(False)).alias("best"))


def relabel_dense(partitions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Communities numbered from 0 in their order."""
    ids = partitions.select(*by, "community").distinct()
    named = ids.withColumn("_new", (F.row_number().over(Window.partitionBy(*by).orderBy("community")) - 1).cast("long"))
    return partitions.join(named, [*by, "community"]).withColumn("community", F.col("_new")).select(*partitions.columns)


def adjusted_rand(partitions: DataFrame) -> DataFrame:
    """(s1, s2, ari) for s1 < s2 over the nodes assigned in both."""
    p = partitions.where(F.col("community") != UNASSIGNED)
    a, b = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")), p.select("node", F.col("seed").alias("s2"), F.col("community").alias("c2"))
    cell = a.join(b, "node").where("s1 < s2").groupBy("s1", "s2", "c1", "c2").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    rows = cell.groupBy("s1", "s2", "c1").agg(F.sum("n").alias("n")).groupBy("s1", "s2").agg(F.sum(two(F.col("n"))).alias("a"), F.sum("n").alias("t"))
    cols = cell.groupBy("s1", "s2", "c2").agg(F.sum("n").alias("n")).groupBy("s1", "s2").agg(F.sum(two(F.col("n"))).alias("b"))
    both = cell.groupBy("s1", "s2").agg(F.sum(two(F.col("n"))).alias("x"))
    expected = F.col("a") * F.col("b") / two(F.col("t"))
    top = (F.col("a") + F.col("b")) / 2 - expected
    return both.join(rows, ["s1", "s2"]).join(cols, ["s1", "s2"]).select("s1", "s2", F.when((F.col("t") < 2) | (top == 0), 1.0).otherwise((F.col("x") - expected) / top).alias("ari"))


def _ami(part: pd.DataFrame) -> float:
    table = part.pivot_table(index="c1", columns="c2", values="n", fill_value=0).to_numpy(float)
    a, b, n = table.sum(1), table.sum(0), table.sum()
    if (len(a) == 1 and len(b) == 1) or n == 0:
        return 1.0
    p = table[table > 0] / n
    outer = np.outer(a, b)[table > 0] / n**2
    mi = float((p * np.log(p / outer)).sum())
    h = lambda x: float(-(x[x > 0] / n * np.log(x[x > 0] / n)).sum())
    lg = np.array([math.lgamma(i + 1) for i in range(int(n) + 1)])
    emi = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
            logp = lg[x] + lg[y] + lg[int(n) - x] + lg[int(n) - y] - lg[int(n)] - lg[k] - lg[x - k] - lg[y - k] - lg[int(n) - x - y + k]
            emi += float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    top = (h(a) + h(b)) / 2 - emi
    return (mi - emi) / (top if abs(top) > 1e-15 else math.copysign(1e-15, top or 1.0))


def adjusted_mutual_info(partitions: DataFrame) -> DataFrame:
    """(s1, s2, ami) for s1 < s2 over the nodes assigned in both; the expectation is computed from each pair's contingency table."""
    p = partitions.where(F.col("community") != UNASSIGNED)
    a, b = p.select("node", F.col("seed").alias("s1"), F.col("community").alias("c1")), p.select("node", F.col("seed").alias("s2"), F.col("community").alias("c2"))
    cell = a.join(b, "node").where("s1 < s2").groupBy("s1", "s2", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    run = lambda part: pd.DataFrame({"s1": [part["s1"].iloc[0]], "s2": [part["s2"].iloc[0]], "ami": [_ami(part)]})
    return cell.groupBy("s1", "s2").applyInPandas(run, "s1 long, s2 long, ami double")


def boundary_cells(modules: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(node, neighbour, community): sides of cells across which another community, or none, lies. Their union is the outline."""
    other = modules.select(F.col("node").alias("neighbour"), F.col("community").alias("_c"))
    return neighbours.join(modules, "node").join(other, "neighbour", "left").where("_c IS NULL OR _c <> community").select("node", "neighbour", "community")
