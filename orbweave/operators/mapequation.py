"""The map equation (Rosvall and Bergstrom 2008) minimised for many graphs at once, of any size.

Tables carry ``key`` columns that tell searches apart, the first a seed: seeds of one graph, or the modules that a hierarchy splits again.
``nodes`` (key, v, size, out): visit rate and outgoing flow, ``ends`` (key, v, w, o, i): flow from v to w and back.

A search of at most ``LOCAL_LINKS`` links, counted first, is a group of its own: one task moves its nodes one by one. A larger one goes by rounds of
joins: every node finds the neighbouring module that would shorten the code most, and nodes move at the same time, but only those of modules that a
hash makes givers, and only into modules that it makes takers. A round that doesn't shorten a search's code is undone, and the next one
moves only nodes that are the best choice of both modules that they touch, then the single best one. When few bits are gained, or no
move gains any, modules become nodes and the search goes on with these, sooner or later in a group. Decisions are rows of
a table: neither a graph nor the list of searches is on the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import frame
from ..sources.scratch import bucketed, written
from .metrics import pagerank

ROUNDS = 200  #: of one search on one level; each shortens the code, so this only bounds the time
STILL = 0.02  #: two rounds that gain less than this share of the code end a level
LOCAL_LINKS = 500_000  #: rows of ``ends`` that one task takes, some 150 MB


def plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def random_walk(nodes: DataFrame, edges: DataFrame, node_flow: str = "pagerank", damping: float = 0.85, steps: int = 60, tol: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """(node, rate), (src, dst, flow): visit rates of a random walk (PageRank, or equal ones) and the flow along the links between nodes, 1 in all."""
    links = edges.where("orig <> dest AND weight > 0").select("orig", "dest", "weight")
    if node_flow == "pagerank":
        rates = written(pagerank(nodes, links, damping, steps, tol).select(F.col("coord_id").alias("node"), F.col("pagerank").alias("rate")), "rates")
    else:
        rates = written(nodes.select(F.col("coord_id").alias("node"), (1 / F.lit(float(max(1, nodes.count())))).alias("rate")), "rates")
    total = links.groupBy("orig").agg(F.sum("weight").alias("_t"))
    flow = links.join(total, "orig").join(rates.withColumnRenamed("node", "orig"), "orig").select(F.col("orig").alias("src"), F.col("dest").alias("dst"), (F.col("rate") * F.col("weight") / F.col("_t")).alias("flow"))
    flow = written(flow.groupBy("src", "dst").agg(F.sum("flow").alias("flow")), "flow")
    return rates, flow.join(F.broadcast(flow.agg(F.sum("flow").alias("_all"))), F.lit(True)).select("src", "dst", (F.col("flow") / F.col("_all")).alias("flow"))


def both_ends(flows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, v, w, o, i) of flows (key, src, dst, flow)."""
    zero = F.lit(0.0)
    rows = flows.select(*key, F.col("src").alias("v"), F.col("dst").alias("w"), F.col("flow").alias("o"), zero.alias("i")).unionByName(flows.select(*key, F.col("dst").alias("v"), F.col("src").alias("w"), zero.alias("o"), F.col("flow").alias("i")))
    return rows.groupBy(*key, "v", "w").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))


def _inside(at: DataFrame, ends: DataFrame, key: list[str], name: str) -> DataFrame:
    """``at`` with the flows ``so`` and ``si`` between each node and the rest of its module, which the column ``name`` holds."""
    mine, other = at.select(*key, "v", F.col(name).alias("_a")), at.select(*key, F.col("v").alias("w"), F.col(name).alias("_b"))
    flow = ends.join(other, [*key, "w"]).join(mine, [*key, "v"]).where("_a = _b").groupBy(*key, "v").agg(F.sum("o").alias("_o"), F.sum("i").alias("_i"))
    return at.join(flow, [*key, "v"], "left")


def _modules(at: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, q, p): flow that leaves each module, and its rate."""
    return at.groupBy(*key, "a").agg(F.greatest(F.sum(F.col("out") - F.col("so")), F.lit(0.0)).alias("q"), F.sum("size").alias("p"))


def _lengths(modules: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """(key, bits, all): code length but for what doesn't depend on modules, and what the index codebook counts."""
    sums = modules.groupBy(*key).agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q") + F.col("p")) - 2 * plogp(F.col("q"))).alias("h"))
    return sums.join(extra, key).select(*key, (plogp(F.col("q") + F.col("extra")) + F.col("h")).alias("bits"), (F.col("q") + F.col("extra")).alias("all"))


def _level(nodes: DataFrame, ends: DataFrame, extra: DataFrame, key: list[str], still: float) -> DataFrame:
    """(key, v, a) of nodes (key, v, size, out, a) after moves of single nodes; ``extra`` (key, extra): flow of the index codebook beside the modules'."""
    own = ["size", "out"]
    start = _inside(nodes.select(*key, "v", *own, "a"), ends, key, "a").select(*key, "v", *own, "a", F.coalesce("_o", F.lit(0.0)).alias("so"), F.coalesce("_i", F.lit(0.0)).alias("si"))
    at = written(start, "modules")
    searches = written(_lengths(_modules(at, key), extra, key).select(*key, "bits", F.lit(0).alias("mode"), F.lit(0).alias("slow")), "searches")
    ended: list[DataFrame] = []
    for round_ in range(1, ROUNDS + 1):
        mods = _modules(at, key)
        index = _lengths(mods, extra, key).select(*key, "all").join(searches.select(*key, "mode"), key)
        near = ends.join(at.select(*key, F.col("v").alias("w"), F.col("a").alias("b")), [*key, "w"]).groupBy(*key, "v", "b").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        rows = near.join(at, [*key, "v"]).where("a <> b").join(mods.withColumnsRenamed({"q": "qa", "p": "pa"}), [*key, "a"]).join(mods.withColumnsRenamed({"a": "b", "q": "qb", "p": "pb"}), [*key, "b"]).join(index, key)
        la = F.greatest(F.col("qa") - F.col("out") + F.col("so") + F.col("si"), F.lit(0.0))
        lb = F.greatest(F.col("qb") + F.col("out") - F.col("o") - F.col("i"), F.lit(0.0))
        rows = rows.withColumns({"la": la, "lb": lb})
        c = F.col
        d = plogp(c("all") - c("qa") - c("qb") + c("la") + c("lb")) - plogp(c("all")) - 2 * (plogp(c("la")) + plogp(c("lb")) - plogp(c("qa")) - plogp(c("qb")))
        d = d + plogp(c("la") + c("pa") - c("size")) + plogp(c("lb") + c("pb") + c("size")) - plogp(c("qa") + c("pa")) - plogp(c("qb") + c("pb"))
        side = lambda x: F.pmod(F.xxhash64(F.lit(round_), *[F.col(k) for k in key], F.col(x)), F.lit(2))  # noqa: B023, E731
        free = (c("mode") > 0) | (side("a") == 0) & (side("b") == 1)
        gains = rows.withColumn("d", d).where("d < -1e-10")
        moves = written(gains.groupBy(*key, "v", "a", "mode").agg(F.min(F.when(free, F.struct("d", "b"))).alias("m")).select(*key, "v", "a", "mode", "m.d", "m.b"), "moves")
        some = moves.where("b IS NOT NULL")
        claim = some.where("mode > 0").select(*key, F.explode(F.array("a", "b")).alias("module"), F.struct("d", "v").alias("t")).groupBy(*key, "module").agg(F.min("t")["v"].alias("first"))
        top = some.where("mode = 2").groupBy(*key).agg(F.min(F.struct("d", "v"))["v"].alias("only"))
        taken = some.join(claim.select(*key, F.col("module").alias("a"), F.col("first").alias("fa")), [*key, "a"], "left").join(claim.select(*key, F.col("module").alias("b"), F.col("first").alias("fb")), [*key, "b"], "left").join(top, key, "left")
        taken = taken.where((c("mode") == 0) | (c("mode") == 1) & (c("fa") == c("v")) & (c("fb") == c("v")) | (c("mode") == 2) & (c("only") == c("v")))
        next_ = at.join(taken.select(*key, "v", "b"), [*key, "v"], "left").withColumn("a2", F.coalesce("b", "a")).drop("b")
        next_ = written(_inside(next_, ends, key, "a2").withColumns({"so2": F.coalesce("_o", F.lit(0.0)), "si2": F.coalesce("_i", F.lit(0.0))}).drop("_o", "_i"), "modules")
        new = _lengths(_modules(next_.select(*key, "size", "out", F.col("a2").alias("a"), F.col("so2").alias("so")), key), extra, key).select(*key, c("bits").alias("new"))
        moved = next_.groupBy(*key).agg(F.bool_or(c("a2") != c("a")).alias("moved"))
        left = moves.groupBy(*key).agg(F.count(F.lit(1)).alias("left"))
        judged = searches.join(new, key).join(moved, key).join(left, key, "left").withColumn("better", c("new") < c("bits") - 1e-12)
        slow = F.when(c("better") & (c("bits") - c("new") < still * F.abs("bits")), c("slow") + 1).when(c("better"), 0).otherwise(c("slow"))
        mode = F.when(c("better"), F.when(c("mode") == 2, 1).otherwise(0)).when(c("moved"), F.least(c("mode") + 1, F.lit(2))).otherwise(c("mode"))
        goes_on = c("left").isNotNull() & (slow < 2) & ~((c("mode") == 2) & c("moved") & ~c("better"))
        judged = written(judged.select(*key, "better", goes_on.alias("goes_on"), F.when(c("better"), c("new")).otherwise(c("bits")).alias("bits"), mode.alias("mode"), slow.alias("slow")), "searches")
        chosen = next_.join(judged.select(*key, "better", "goes_on"), key)
        pick = lambda x: F.when(F.col("better"), F.col(f"{x}2")).otherwise(F.col(x)).alias(x)
        chosen = chosen.select(*key, "v", *own, pick("a"), pick("so"), pick("si"), "goes_on")
        ended.append(chosen.where("NOT goes_on").select(*key, "v", "a"))
        at, searches = chosen.where("goes_on").drop("goes_on"), judged.where("goes_on").drop("better", "goes_on")
        if searches.isEmpty():
            break
    else:
        ended.append(at.select(*key, "v", "a"))
    out = ended[0]
    for df in ended[1:]:
        out = out.unionByName(df)
    return written(out, "level")


def _h(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def greedy(size: np.ndarray, out: np.ndarray, links: dict[tuple[int, int], float], extra: float, seed: int) -> np.ndarray:
    """Modules of nodes 0, 1, ...: seeded moves of single nodes, then of modules, until none shortens the code."""
    rng = np.random.default_rng(seed)
    member = np.arange(len(size))
    while True:
        module = _moved(size, out, links, extra, rng)
        kept, module = np.unique(module, return_inverse=True)
        member = module[member]
        if len(kept) == len(size):
            return member
        merged: dict = defaultdict(float)
        inner = np.zeros(len(kept))
        for (a, b), f in links.items():
            if module[a] != module[b]:
                merged[int(module[a]), int(module[b])] += f
            else:
                inner[module[a]] += f
        links, size, out = dict(merged), np.bincount(module, size, len(kept)), np.maximum(np.bincount(module, out, len(kept)) - inner, 0)


def _moved(size: np.ndarray, out: np.ndarray, links: dict, extra: float, rng) -> np.ndarray:
    n = len(size)
    near_by: list[list[tuple[int, float, float]]] = [[] for _ in range(n)]
    for (a, b), f in links.items():
        near_by[a].append((b, f, 0.0))
        near_by[b].append((a, 0.0, f))
    total = float(extra + out.sum())
    # plain floats: the same sums as of arrays' elements, several times faster one by one
    module, leave, inside, size, out = list(range(n)), out.tolist(), size.tolist(), size.tolist(), out.tolist()
    h_leave, h_all = [_h(x) for x in leave], [_h(x + y) for x, y in zip(leave, inside, strict=True)]  # of each module
    for _ in range(50):
        changed = False
        for v in rng.permutation(n).tolist():
            near: dict[int, list[float]] = {}
            for w, to, back in near_by[v]:
                t = near.setdefault(module[w], [0.0, 0.0])
                t[0] += to
                t[1] += back
            a = module[v]
            leave_a = leave[a] - out[v] + sum(near.pop(a, (0.0, 0.0)))  # once v is out
            h_total, h_a, h_rest = _h(total), _h(leave_a), _h(leave_a + inside[a] - size[v])
            best, choice, ends = -1e-12, a, None
            for b, (to, back) in sorted(near.items()):
                leave_b = leave[b] + out[v] - to - back
                all_ = total - leave[a] - leave[b] + leave_a + leave_b
                d = _h(all_) - h_total - 2 * (h_a + _h(leave_b) - h_leave[a] - h_leave[b])
                d += h_rest + _h(leave_b + inside[b] + size[v]) - h_all[a] - h_all[b]
                if d < best:
                    best, choice, ends = d, b, (leave_a, leave_b, all_)
            if choice != a:
                leave[a], leave[choice], total = ends
                inside[a] -= size[v]
                inside[choice] += size[v]
                for m in (a, choice):
                    h_leave[m], h_all[m] = _h(leave[m]), _h(leave[m] + inside[m])
                module[v], changed = choice, True
        if not changed:
            break
    return np.array(module, dtype="int64")


def _group(key: list[str]):
    def run(nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("v")
        ids = nodes["v"].tolist()
        at = {v: i for i, v in enumerate(ids)}
        links = {(at[v], at[w]): o for v, w, o in zip(ends["v"].tolist(), ends["w"].tolist(), ends["o"].tolist(), strict=True) if o > 0}
        module = greedy(nodes["size"].to_numpy(float), nodes["out"].to_numpy(float), dict(sorted(links.items())), float(nodes["extra"].iloc[0]) if len(nodes) else 0.0, int(nodes[key[0]].iloc[0]) if len(nodes) else 0)
        first: dict = {}
        for i, c in enumerate(module.tolist()):
            first.setdefault(c, ids[i])
        return frame({**{k: nodes[k].tolist() for k in key}, "v": ids, "a": [first[c] for c in module.tolist()]})

    return run


def search(nodes: DataFrame, ends: DataFrame, extra: DataFrame, key: Sequence[str], still: float = STILL) -> DataFrame:
    """(key, v, a): modules of short code, named by one of their nodes; ``extra`` (key, extra): flow of the index codebook beside the modules'."""
    key = list(key)
    ends = written(ends, "ends")
    links = written(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("links")), "links")
    nodes = written(nodes.join(extra, key).join(links, key, "left"), "nodes")
    kinds = {k: nodes.schema[k].dataType.simpleString() for k in [*key, "v"]}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + f", a {kinds['v']}"
    few = nodes.where(f"links <= {LOCAL_LINKS}")
    some = ends.join(links.where(f"links <= {LOCAL_LINKS}").drop("links"), key, "left_semi")
    out = few.groupBy(*key).cogroup(some.groupBy(*key)).applyInPandas(_group(key), schema)
    out = written(out.unionByName(nodes.where("links IS NULL").select(*key, "v", F.col("v").alias("a"))), "labels")
    large = nodes.where(f"links > {LOCAL_LINKS}").drop("links", "extra")
    if large.isEmpty():
        return out
    # in buckets by their far ends: every round meets these first, so only what has met them moves
    theirs = bucketed(ends.join(links.where(f"links > {LOCAL_LINKS}").drop("links"), key, "left_semi"), "theirs", [*key, "w"])
    own_extra = extra.join(links.where(f"links > {LOCAL_LINKS}").drop("links"), key, "left_semi")
    labels = _level(large.withColumn("a", F.col("v")), theirs, own_extra, key, still)
    home = labels.select(*key, "v", F.col("a").alias("_a"))
    between = theirs.join(home, [*key, "v"]).join(home.select(*key, F.col("v").alias("w"), F.col("_a").alias("_b")), [*key, "w"]).where("_a <> _b")
    up_ends = between.groupBy(*key, F.col("_a").alias("v"), F.col("_b").alias("w")).agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    inner = _inside(large.join(labels, [*key, "v"]), theirs, key, "a")
    up_nodes = written(inner.groupBy(*key, F.col("a").alias("v")).agg(F.sum("size").alias("size"), F.greatest(F.sum(F.col("out") - F.coalesce("_o", F.lit(0.0))), F.lit(0.0)).alias("out")), "merged")
    if up_nodes.count() == large.count():  # no node has moved
        return out.unionByName(labels)
    up = search(up_nodes, up_ends, own_extra, key, still)
    return out.unionByName(written(labels.join(up.select(*key, F.col("v").alias("a"), F.col("a").alias("_a")), [*key, "a"]).select(*key, "v", F.col("_a").alias("a")), "labels"))


def module_terms(rates: DataFrame, flows: DataFrame, modules: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, community, q, p, e): flow that leaves each module, its rate, and the sum of plogp of its nodes' rates."""
    key = list(key)
    a, b = modules.select(*key, F.col("node").alias("src"), F.col("community").alias("c1")), modules.select(*key, F.col("node").alias("dst"), F.col("community").alias("c2"))
    leave = flows.join(a, "src").join(b, [*key, "dst"]).where("c1 <> c2").groupBy(*key, F.col("c1").alias("community")).agg(F.sum("flow").alias("q"))
    inside = modules.join(rates, "node").groupBy(*key, "community").agg(F.sum("rate").alias("p"), F.sum(plogp(F.col("rate"))).alias("e"))
    return inside.join(leave, [*key, "community"], "left").na.fill(0.0, ["q"])


def hierarchical_codelength(rates: DataFrame, flows: DataFrame, levels: DataFrame) -> DataFrame:
    """One row, ``codelength``: bits for each step of the walk, described by the tree of ``levels`` (level, node, community), 0 the top.

    The index of the top codes which of its modules is entered; that of a module with several parts codes which of these is entered, or
    that the walk leaves; a module without parts codes its nodes and that it is left. A module that is alone in the one above stands for it.
    """
    terms = written(module_terms(rates, flows, levels, ["level"]), "terms")
    child = levels.select((F.col("level") - 1).alias("level"), "node", F.col("community").alias("part"))
    below = written(levels.join(child, ["level", "node"], "left").select("level", "community", "part").distinct(), "tree")
    tree = below.groupBy("level", "community").agg(F.count("part").alias("parts"))
    top = terms.where("level = 0").agg(plogp(F.sum("q")).alias("x"), F.sum(plogp(F.col("q"))).alias("y")).select((F.col("x") - F.col("y")).alias("bits"))
    leaf = terms.join(tree.where("parts = 0").select("level", "community"), ["level", "community"]).select((plogp(F.col("q") + F.col("p")) - plogp(F.col("q")) - F.col("e")).alias("bits"))
    inner = below.join(tree.where("parts > 1").select("level", "community"), ["level", "community"])
    parts = inner.join(terms.select((F.col("level") - 1).alias("level"), F.col("community").alias("part"), F.col("q").alias("qc")), ["level", "part"]).groupBy("level", "community").agg(F.sum("qc").alias("s"), F.sum(plogp(F.col("qc"))).alias("h"))
    index = parts.join(terms, ["level", "community"]).select((plogp(F.col("q") + F.col("s")) - plogp(F.col("q")) - F.col("h")).alias("bits"))
    return top.unionByName(leaf).unionByName(index).agg(F.sum("bits").alias("codelength"))
