"""Node and edge metrics of networks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.running import quantiles
from ..sources.scratch import bucketed, release, written
from .paths import edge_betweenness  # noqa: F401


def strengths(nodes: DataFrame | None, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Out- and in-strength of each node, 0 for isolated ones; without ``nodes`` of the ends of edges."""
    ends = edges.select(*by, F.col("orig").alias("coord_id"), F.col("weight").alias("o"), F.lit(0.0).alias("i")).unionByName(edges.select(*by, F.col("dest").alias("coord_id"), F.lit(0.0).alias("o"), F.col("weight").alias("i")))
    total = ends.groupBy(*by, "coord_id").agg(F.sum("o").alias("out_strength"), F.sum("i").alias("in_strength"))
    if nodes is None:
        return total.na.fill(0.0, ["out_strength", "in_strength"])
    return nodes.select(*by, "coord_id").join(total, [*by, "coord_id"], "left").na.fill(0.0, ["out_strength", "in_strength"])


def degree_centrality(nodes: DataFrame | None, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """In- plus out-strength; a self-link counts twice."""
    return strengths(nodes, edges, by).select(*by, "coord_id", (F.col("out_strength") + F.col("in_strength")).alias("degree"))


def degree_by_area(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Σ weight · cos(lat of dest) over out-edges, relative to Σ cos(lat) of all nodes."""
    area = nodes.select("coord_id", F.cos(F.radians("lat")).alias("w"))
    total = area.agg(F.sum("w").alias("_t"))
    out = edges.join(area.withColumnRenamed("coord_id", "dest"), "dest").groupBy(F.col("orig").alias("coord_id")).agg(F.sum(F.col("weight") * F.col("w")).alias("s"))
    return nodes.select("coord_id").join(out, "coord_id", "left").join(F.broadcast(total), F.lit(True)).select("coord_id", (F.coalesce("s", F.lit(0.0)) / F.col("_t")).alias("degree"))


def divergence(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Out- minus in-strength."""
    return strengths(nodes, edges, by).select(*by, "coord_id", (F.col("out_strength") - F.col("in_strength")).alias("divergence"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 100, tol: float | None = 1e-6, normalised: bool = False, every: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, coord_id, pagerank) by power iteration: weighted links, uniform teleport, dangling mass spread evenly.

    ``by``: columns of nodes and edges that tell graphs apart; all go through the same rounds. A graph stops when the L1
    change falls below its n · tol, looked at every few steps (or after ``steps``; exactly then if tol is None). Each step is a written
    table; shares lie in buckets by origin, so only ranks and sums move. ``normalised``: in per cent.
    """
    by = list(by)
    key = [*by, "coord_id"]
    meet = lambda df, one: df.join(one, by) if by else df.join(F.broadcast(one), F.lit(True))
    total = edges.groupBy(*by, "orig").agg(F.sum("weight").alias("_total"))  # summed before the exchange: a hub's edges need not meet
    share = edges.join(total, [*by, "orig"]).select(*by, F.col("orig").alias("coord_id"), "dest", (F.col("weight") / F.col("_total")).alias("p"))
    share = bucketed(share, "share", key)
    size = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    linked = share.select(*key).distinct().withColumn("linked", F.lit(True))
    rank = written(meet(nodes.select(*key), size).join(linked, key, "left").select(*key, "linked", "n", (1 / F.col("n")).alias("r")), "rank")
    done: list[DataFrame] = []
    for step in range(1, steps + 1):
        lost = rank.groupBy(*by).agg(F.sum(F.when(F.col("linked").isNull(), F.col("r")).otherwise(0.0)).alias("_lost"))
        came = rank.join(share, key).select(*by, F.col("dest").alias("coord_id"), (F.col("r") * F.col("p")).alias("c"))
        none = lambda t: F.lit(None).cast(t)
        rows = rank.select(*key, "linked", "n", "r", none("double").alias("c")).unionByName(came.select(*key, none("boolean").alias("linked"), none("long").alias("n"), none("double").alias("r"), "c"))
        sums = rows.groupBy(*key).agg(F.max("linked").alias("linked"), F.max("n").alias("n"), F.max("r").alias("was"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("c")).where("n IS NOT NULL")
        new = meet(sums, lost).select(*key, "linked", "n", "was", (damping * (F.col("c") + F.col("_lost") / F.col("n")) + (1 - damping) / F.col("n")).alias("r"))
        rank = written(new, "rank")
        if tol is not None and step < steps and step % every == 0:
            moved = rank.groupBy(*by).agg((F.sum(F.abs(F.col("r") - F.col("was"))) < F.max("n") * tol).alias("_stop"))
            if by:
                judged = rank.join(moved, by)
                done.append(written(judged.where("_stop").select(*key, "r"), "rank"))
                rank = written(judged.where("NOT _stop").drop("_stop"), "rank")
                if rank.isEmpty():
                    break
            elif (moved.first() or [True])[0] in (True, None):
                break
        rank = rank.drop("was")
    out = rank.select(*key, "r")
    for df in done:
        out = out.unionByName(df)
    return out.select(*key, (F.col("r") * 100 if normalised else F.col("r")).alias("pagerank"))


def _triangles(edges: DataFrame, by: Sequence[str] = (), stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(by, u, v, m): the ties, m = 2 where both directions exist; (by, a, b, c, ab, ac, bc): each triangle once, with its ties' m.

    A tie belongs to its end of fewer ties (of equals that of smaller id), and wedges form over the ties of one end, so a hub
    forms none with its leaves and a graph of m ties at most m to the power 1.5. ``stage``: ``written`` where wedges are to be tables, so that
    the shuffles of one step are gone before the next.
    """
    u, v = F.least("orig", "dest"), F.greatest("orig", "dest")
    there, back = (F.max(F.when(F.col("orig") == x, 1).otherwise(0)) for x in (u, v))
    ties = written(edges.where("orig <> dest").groupBy(*by, u.alias("u"), v.alias("v")).agg((there + back).cast("long").alias("m")), "ties")
    size = written(ties.select(*by, "u").unionByName(ties.select(*by, F.col("v").alias("u"))).groupBy(*by, "u").agg(F.count(F.lit(1)).alias("k")), "size")
    one = written(ties.join(size.select(*by, "u", F.struct("k", F.col("u").alias("id")).alias("x")), [*by, "u"]).select(*by, "v", "x", "m"), "one")
    both = one.join(size.select(*by, F.col("u").alias("v"), F.struct("k", F.col("u").alias("id")).alias("y")), [*by, "v"])
    tie = written(both.select(*by, F.least("x", "y")["id"].alias("a"), F.struct(F.greatest("x", "y").alias("y"), "m").alias("t")), "both")
    release(one, size)
    # of each owner the far ends of its ties, by number of ties
    owned = written(tie.groupBy(*by, "a").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["y"]["id"].alias("id"), t["m"].alias("m"))).alias("on")), "owned")
    release(tie)
    # a wedge needs a tie from its nearer end to the farther one: ends that own none, as most hubs, form none
    owners = owned.select(*by, F.col("a").alias("b"))
    each = owned.select(*by, "a", F.posexplode("on").alias("i", "t")).select(*by, "a", (F.col("i") + 2).alias("from"), F.col("t.id").alias("b"), F.col("t.m").alias("ab"))
    near = stage(each.join(owners, [*by, "b"], "left_semi"), "near")
    ids = lambda on, m: F.transform(F.filter(on, lambda t: t["m"] == m), lambda t: t["id"])
    rest = F.slice("on", F.col("from"), F.size("on"))
    # the wedges of two ends in one row, so they move as lists
    wedges = stage(near.join(owned, [*by, "a"]).where(F.col("from") <= F.size("on")).select(*by, "a", "b", "ab", ids(rest, 1).alias("c1"), ids(rest, 2).alias("c2")), "wedges")
    far = owned.select(*by, F.col("a").alias("b"), ids(F.col("on"), 1).alias("d1"), ids(F.col("on"), 2).alias("d2"))
    closed = lambda i, j: F.transform(F.array_intersect(f"c{i}", f"d{j}"), lambda c: F.struct(c.alias("c"), F.lit(i).cast("long").alias("ac"), F.lit(j).cast("long").alias("bc")))
    found = wedges.join(far, [*by, "b"]).select(*by, "a", "b", "ab", F.explode(F.concat(*[closed(i, j) for i in (1, 2) for j in (1, 2)])).alias("t"))
    return ties, found.select(*by, "a", "b", "t.c", "ab", "t.ac", "t.bc")


def clustering(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Directed unweighted clustering coefficient (Fagiolo): triangles over possible ones, 0 without triangles."""
    ties, tri = _triangles(edges, by, written)
    degree = ties.select(*by, "u", "m").unionByName(ties.select(*by, F.col("v").alias("u"), "m")).groupBy(*by, "u").agg(F.sum("m").alias("d"), F.sum(F.when(F.col("m") == 2, 1).otherwise(0)).alias("r"))
    # each triangle counts twice the product of its ties at each of its corners in (A + A')³
    t = tri.select(*by, F.explode(F.array("a", "b", "c")).alias("coord_id"), (2 * F.col("ab") * F.col("ac") * F.col("bc")).alias("m")).groupBy(*by, "coord_id").agg(F.sum("m").alias("t"))
    t = written(t, "triangles")
    rows = nodes.select(*by, "coord_id").join(degree.withColumnRenamed("u", "coord_id"), [*by, "coord_id"], "left").join(t, [*by, "coord_id"], "left")
    return rows.select(*by, "coord_id", F.when(F.coalesce("t", F.lit(0)) == 0, 0.0).otherwise(F.col("t") / (2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("r")))).alias("clustering"))


def cycle_clustering(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of each node's reciprocal neighbours R: directed edges among them over |R|(|R| - 1); 0 if |R| < 2."""
    ties, tri = _triangles(edges, by, written)
    mutual = ties.where("m = 2")
    size = mutual.select(*by, "u").unionByName(mutual.select(*by, F.col("v").alias("u"))).groupBy(*by, F.col("u").alias("coord_id")).agg(F.count(F.lit(1)).alias("r"))
    corners = F.array(*[F.struct(F.col(i).alias("coord_id"), ((F.col(p) == 2) & (F.col(q) == 2)).alias("in"), F.col(o).alias("e")) for i, p, q, o in (("a", "ab", "ac", "bc"), ("b", "ab", "bc", "ac"), ("c", "ac", "bc", "ab"))])
    inner = tri.select(*by, F.explode(corners).alias("k")).where("k.in").groupBy(*by, F.col("k.coord_id").alias("coord_id")).agg(F.sum("k.e").alias("e"))
    rows = nodes.select(*by, "coord_id").join(size, [*by, "coord_id"], "left").join(inner, [*by, "coord_id"], "left")
    return rows.select(*by, "coord_id", F.when(F.col("r") >= 2, F.coalesce("e", F.lit(0)) / (F.col("r") * (F.col("r") - 1))).otherwise(0.0).alias("cycle_clustering"))


def node_transport(pairs: DataFrame, output: str = "classes", quantiles: Sequence[float] = (0.75, 0.85, 0.95), thresholds: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean next IVT over departures minus mean previous IVT over arrivals of each cell; class -3..3 by six thresholds.

    Cells without one side are missing (NULL).
    """
    out = pairs.groupBy(*by, F.col("orig").alias("coord_id")).agg(F.avg(S.no_nan(F.col("dest_ivt"))).alias("o"))
    into = pairs.groupBy(*by, F.col("dest").alias("coord_id")).agg(F.avg(S.no_nan(F.col("orig_ivt"))).alias("i"))
    diff = out.join(into, [*by, "coord_id"], "full_outer").select(*by, "coord_id", (F.col("o") - F.col("i")).alias("ivt_diff"))
    return _classed(diff, diff, "ivt_diff", output, quantiles, thresholds)


def edge_transport(pairs: DataFrame, output: str = "classes", quantiles: Sequence[float] = (0.75, 0.85, 0.95), thresholds: Sequence[float] | None = None, nan_class: str = "null", by: Sequence[str] = ()) -> DataFrame:
    """Mean IVT change of each edge's steps; class -3..3 by six thresholds, quantiles of the steps.

    A missing step makes its edge missing: class NULL, or 3 with nan_class='ref'.
    """
    steps = pairs.select(*by, "orig", "dest", (F.col("dest_ivt") - F.col("orig_ivt")).alias("d"))
    edges = steps.groupBy(*by, "orig", "dest").agg(F.avg(F.coalesce("d", F.lit(S.NAN))).alias("ivt_diff"))
    return _classed(edges, steps.select(S.no_nan(F.col("d")).alias("d")), "ivt_diff", output, quantiles, thresholds, "d", nan_class)


def _classed(df: DataFrame, pool: DataFrame, column: str, output: str, quantiles, thresholds, pooled: str | None = None, nan_class: str = "null") -> DataFrame:
    if output not in ("classes", "quantile", "values"):
        raise ValueError("output: classes, quantile or values")
    if output == "values":
        return df
    if thresholds is not None:
        if len(thresholds) != 6:
            raise ValueError("six thresholds")
        return df.withColumn("ivt_class", S.digitize(F.col(column), [F.lit(float(t)) for t in sorted(thresholds)], -3, "null" if nan_class == "null" else "last"))
    from .network import pooled_thresholds

    edge = pooled_thresholds(pool, pooled or column, quantiles).withColumnRenamed("q", "_q")
    out = df.join(F.broadcast(edge), F.lit(True))
    return out.withColumn("ivt_class", S.digitize(F.col(column), [F.col("_q")[i] for i in range(6)], -3, "null" if nan_class == "null" else "last")).drop("_q")


def visits(catalog: DataFrame, node: str = "coord_idx") -> DataFrame:
    """Rows in each cell."""
    return catalog.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("coord_id")).agg(F.count(F.lit(1)).alias("visits"))


def edge_widths(edges: DataFrame, log: bool = False) -> DataFrame:
    """``width``: weight relative to the largest, or log10 of it relative to the largest log10; ``weighted``: not all weights are 1."""
    w = F.log10("weight") if log else F.col("weight").cast("double")
    df = edges.withColumn("_w", w)
    top = df.agg(F.max("_w").alias("_top"), (~F.bool_and(F.col("weight") == 1)).alias("weighted"))
    return df.join(F.broadcast(top), F.lit(True)).withColumn("width", F.col("_w") / F.col("_top")).drop("_w", "_top")


def sign_widths(edges: DataFrame, attribute: str, linewidth: float = 1.0) -> DataFrame:
    """``width``: linewidth times the size of a class, 0.5 for class 0."""
    size = F.abs(F.col(attribute))
    return edges.withColumn("width", F.lit(linewidth) * F.when(size == 0, 0.5).otherwise(size))


def ensemble_threshold(values: DataFrame, column: str, alpha: float, model: str = "model") -> DataFrame:
    """The largest over models of the alpha quantile of the pooled values."""
    return quantiles(values, column, [alpha], by=[model]).agg(F.max(F.col("q")[0]).alias("threshold"))


def above(edges: DataFrame, attribute: str, threshold: float) -> DataFrame:
    """Edges whose attribute is known, not 0 and at the threshold or more."""
    a = S.no_nan(F.col(attribute))
    return edges.where(a.isNotNull() & (a != 0) & (a >= threshold))


def module_graph(flows: DataFrame, q: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Modules (size sqrt of row plus column flow; those without incoming flow go) and the links i ≠ j whose flow exceeds
    the q quantile of the whole flow matrix, zeros included. ``flows``: (c1, c2, flow)."""
    ids = flows.select(F.col("c1").alias("c")).unionByName(flows.select(F.col("c2").alias("c"))).distinct()
    total = flows.select(F.col("c1").alias("c"), "flow", F.lit(0.0).alias("into")).unionByName(flows.select(F.col("c2").alias("c"), "flow", F.col("flow").alias("into"))).groupBy("c").agg(F.sqrt(F.sum("flow")).alias("size"), F.sum("into").alias("into"))
    nodes = total.where("into > 0").select("c", "size")
    # the matrix's zeros need no rows: one stands for all of them
    cells = written(flows.groupBy("c1", "c2").agg(F.sum("flow").alias("flow")), "cells")
    n = ids.agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("n"))
    some = cells.where("flow > 0").select("flow", F.lit(1).cast("long").alias("n"))
    zeros = some.agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.lit(True)).select(F.lit(0.0).alias("flow"), (F.col("n") - F.col("k")).alias("n"))
    edge = quantiles(some.unionByName(zeros), "flow", [q], "n").select(F.col("q")[0].alias("_q"))
    links = cells.where("c1 <> c2").join(F.broadcast(edge), F.col("flow") > F.col("_q")).drop("_q")
    return nodes, links.join(nodes.select(F.col("c").alias("c1")), "c1").join(nodes.select(F.col("c").alias("c2")), "c2").select("c1", "c2", "flow")


def conductance(flows: DataFrame, k: int | None = 20) -> DataFrame:
    """Of each module the share of its outgoing flow that leaves it, NULL without flow; the k largest, ranked."""
    phi = flows.groupBy(F.col("c1").alias("c")).agg(S.share_or_null(F.sum(F.when(F.col("c1") != F.col("c2"), F.col("flow")).otherwise(0.0)), F.sum("flow")).alias("conductance"))
    ranked = phi.where("conductance IS NOT NULL").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("conductance"), "c")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
