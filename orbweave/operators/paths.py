"""Shortest paths from many sources of many graphs at once, as tables (graph, src, node, ...).

Every round is a join of a frontier with the arcs, so no graph has to fit one place; graphs that are told apart by ``by``
columns go through the same rounds, and one that is finished has no rows in the frontier. Betweenness needs rounds for the
distances of nodes that lead on only: the arcs that a source meets then come together, some sources at a time, and their
paths are counted there. Where a source meets more than ARCS of them, rounds count the paths too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_places
from ..sources.scratch import release, written
from .network import invert_weights

ARCS = 2_000_000  #: arcs that a source may meet for its paths to be counted in one place
GROUP = 8_000_000  #: arcs of the sources that are counted together, about, each counted as often as a source meets it
FEW, TASKS = 500_000, 64  #: smaller groups, of no fewer than FEW arcs, where there are fewer than TASKS; so many are counted at a time
SLICE = 1_000_000  #: arcs of the sources that a group counts at once, about
LIST = 1_000  #: arcs of a node in one list, about


def arcs_of(edges: DataFrame, weighted: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, w, len): arcs between different nodes, 1 / weight or 1 long; those of no positive weight lead nowhere."""
    rows = edges.where("orig <> dest")
    length = F.col("weight") if weighted else F.lit(1.0)
    if weighted:
        rows = invert_weights(rows).where(F.col("weight") < float("inf"))
    return rows.select(*by, F.col("orig").alias("v"), F.col("dest").alias("w"), length.cast("double").alias("len"))


def distances(sources: DataFrame, arcs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, node, d): length of the shortest path from each source (by, src), 0 to itself; no row if there is none.

    Rounds relax the arcs of nodes that came nearer in the round before, until none does: as many as the most arcs of a shortest path.
    """
    key = [*by, "src", "node"]
    far = written(sources.select(*by, "src", F.col("src").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("new")), "far")
    while not far.where("new").isEmpty():
        step = far.where("new").withColumnRenamed("node", "v").join(arcs, [*by, "v"]).groupBy(*by, "src", F.col("w").alias("node")).agg(F.min(F.col("d") + F.col("len")).alias("d"))
        both = far.select(*key, "d", F.col("d").alias("was")).unionByName(step.select(*key, "d", F.lit(None).cast("double").alias("was")))
        least = both.groupBy(*key).agg(F.min("d").alias("d"), F.min("was").alias("was"))
        old, far = far, written(least.select(*key, "d", (F.col("was").isNull() | (F.col("d") < F.col("was"))).alias("new")), "far")
        release(old)
    return far.drop("new")


def shortest_arcs(far: DataFrame, arcs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, v, w): of each source the arcs that lie on its shortest paths."""
    begun = arcs.join(far.select(*by, "src", F.col("node").alias("v"), "d"), [*by, "v"]).select(*by, "src", "v", "w", (F.col("d") + F.col("len")).alias("d"))
    return written(begun.join(far.select(*by, "src", F.col("node").alias("w"), "d"), [*by, "src", "w", "d"]).select(*by, "src", "v", "w"), "shortest")


def path_counts(sources: DataFrame, ways: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(by, src, node, paths): the number of shortest paths from each source; and the most arcs that one has.

    A round carries the paths of k arcs to those of k + 1.
    """
    front = written(sources.select(*by, "src", F.col("src").alias("node"), F.lit(1.0).alias("paths")), "paths")
    all_, steps = front, 0
    while True:
        next_ = front.withColumnRenamed("node", "v").join(ways, [*by, "src", "v"]).groupBy(*by, "src", F.col("w").alias("node")).agg(F.sum("paths").alias("paths"))
        front = written(next_, "paths")
        if front.isEmpty():
            break
        steps += 1
        all_ = all_.unionByName(front)
    return written(all_.groupBy(*by, "src", "node").agg(F.sum("paths").alias("paths")), "sigma"), steps


def _in_rounds(start: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """(by, orig, dest, _b): betweenness of the arcs, each step of the paths a join."""
    far = distances(start, arcs, by)
    ways = shortest_arcs(far, arcs, by)
    counts, steps = path_counts(start, ways, by)
    front = counts.where("node <> src").select(*by, "src", "node", (1 / F.col("paths")).alias("x"))
    all_ = front
    for _ in range(steps - 1):
        front = front.withColumnRenamed("node", "w").join(ways.where("v <> src"), [*by, "src", "w"]).groupBy(*by, "src", F.col("v").alias("node")).agg(F.sum("x").alias("x"))
        front = written(front, "rest")
        all_ = all_.unionByName(front)
    rest = all_.groupBy(*by, "src", F.col("node").alias("w")).agg(F.sum("x").alias("x"))
    used = ways.join(counts.withColumnRenamed("node", "v"), [*by, "src", "v"]).join(rest, [*by, "src", "w"])
    return used.groupBy(*by, F.col("v").alias("orig"), F.col("w").alias("dest")).agg(F.sum(F.col("paths") * F.col("x")).alias("_b"))


def _in_groups(start: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame | None:
    """(by, orig, dest, _b): the same with the arcs that some sources meet in one place; None if those of a source are too many."""
    kind = arcs.schema["v"].dataType
    degree = written(arcs.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("k")), "degree")
    # nodes that lead nowhere end paths, they need no round
    inner = written(arcs.join(degree.select(*by, F.col("v").alias("w")), [*by, "w"], "left_semi"), "inner")
    begin = start.join(degree.select(*by, F.col("v").alias("src")), [*by, "src"], "left_semi")
    far = distances(begin, inner, by).withColumnRenamed("node", "v")
    met = written(far.join(degree, [*by, "v"]).groupBy(*by, "src").agg(F.sum("k").alias("k")), "met")
    size = met.agg(F.max("k").alias("most"), F.sum("k").alias("all")).first()
    if (size["most"] or 0) > ARCS:
        return None
    all_ = size["all"] or 0
    groups = max(1, -(-all_ // GROUP), min(TASKS, all_ // FEW))
    # sources in order, so that those that meet the same arcs are together where their numbers tell
    dealt = running_places(met, [*by, "src"], "k").select(*by, "src", F.floor(F.col("before") * groups / (all_ + 1)).cast("int").alias("_group"))
    rows = written(far.join(dealt, [*by, "src"]).select("_group", *by, F.col("src").cast(kind).alias("src"), "v", "d"), "dealt")
    piece = F.pmod(F.xxhash64("w"), F.ceil(F.col("k") / LIST))
    near = arcs.join(degree, [*by, "v"]).groupBy(*by, "v", piece.alias("piece")).agg(F.collect_list(F.struct(F.col("w").cast(kind).alias("w"), "len")).alias("on"))
    near = written(near, "near")
    release(far, met)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in arcs.select(*by, F.col("v").alias("orig"), F.col("v").alias("dest")).schema]
    used: list[DataFrame] = []
    for first in range(0, groups, TASKS):  # some groups at a time, whose shuffles are gone before the next
        some = rows.where(F.col("_group").between(first, first + TASKS - 1))
        lists = some.select("_group", *by, "v").distinct().join(near, [*by, "v"]).select(*[F.col(c).alias(c) for c in ("_group", *by, "v", "on")])
        sums = lists.groupBy("_group").cogroup(some.groupBy("_group")).applyInArrow(_counter(by), ", ".join([*fields, "_b double"]))
        used.append(written(sums.groupBy(*by, "orig", "dest").agg(F.sum("_b").alias("_b")), "used"))
    release(rows, near, inner)
    all_used = used[0]
    for df in used[1:]:
        all_used = all_used.unionByName(df)
    return all_used if len(used) == 1 else all_used.groupBy(*by, "orig", "dest").agg(F.sum("_b").alias("_b"))


def _counter(by: list[str]):
    """A function of the arcs that some sources meet, each once, in lists (by, v, on), and of these sources' distances (by, src, v, d): betweenness of the arcs."""

    def run(near: pa.Table, far: pa.Table) -> pa.Table:
        near, far = near.combine_chunks(), far.combine_chunks()
        column = lambda t, c: pa.concat_arrays(t[c].chunks) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        numbers = lambda a: pc.dictionary_encode(a).indices.to_numpy(zero_copy_only=False).astype("int64")
        on, n, m = column(near, "on"), near.num_rows, far.num_rows
        row = np.repeat(np.arange(n), np.diff(on.offsets.to_numpy()))  # of each arc the list that it is in
        to = on.flatten().field("w")
        graph = np.zeros(n + m, "int64")
        for c in by:
            code = numbers(pa.concat_arrays([column(near, c), column(far, c)]))
            graph = np.unique(graph * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
        nodes = numbers(pa.concat_arrays([column(near, "v"), to, column(far, "src"), column(far, "v")]))
        many = int(nodes.max(initial=0)) + 1
        k = len(to)
        whole = np.concatenate([graph[:n], graph[:n][row], graph[n:], graph[n:]]) * many + nodes
        place = np.unique(whole, return_inverse=True)[1].astype("int64")  # of nodes in their graphs
        tail, head, src, at = place[:n][row], place[n : n + k], place[n + k : n + k + m], place[n + k + m :]
        count = int(place.max(initial=-1)) + 1
        arc = np.argsort(tail, kind="stable")  # arcs by the node that they begin in
        degree = np.bincount(tail, minlength=count)
        begin = np.cumsum(degree) - degree
        length, head = on.flatten().field("len").to_numpy()[arc], head[arc]
        order = np.argsort(src, kind="stable")
        src, at, away = src[order], at[order], far["d"].to_numpy()[order]
        done = np.concatenate([[0], np.cumsum(degree[at])])  # arcs met before each row
        first = np.append(np.flatnonzero(np.diff(src, prepend=-1)), m)  # rows where a source begins
        total = np.zeros(k)
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(done[first], done[first[i]] + SLICE, side="right")) - 1)
            lo, hi = first[i], first[j]
            each = degree[at[lo:hi]]
            met_row = np.repeat(np.arange(lo, hi), each)
            met = np.arange(done[hi] - done[lo]) + np.repeat(begin[at[lo:hi]] - (done[lo:hi] - done[lo]), each)
            total += np.bincount(met, _counted(src[lo:hi], at[lo:hi], away[met_row] + length[met], met_row - lo, head[met], count), k)
            i = j
        hit = np.flatnonzero(total)
        rows = pa.array(row[arc][hit])
        return pa.table([*(column(near, c).take(rows) for c in by), column(near, "v").take(rows), to.take(pa.array(arc[hit])), pa.array(total[hit])], names=[*by, "orig", "dest", "_b"])

    return run


def _counted(src: np.ndarray, at: np.ndarray, d: np.ndarray, row: np.ndarray, head: np.ndarray, count: int) -> np.ndarray:
    """Betweenness of each arc that sources ``src`` meet at nodes ``at``: it ends in ``head``, ``d`` away from its source, and begins at ``at[row]``."""
    n = len(at)
    place, where = np.unique(np.concatenate([src * count + at, src[row] * count + head]), return_inverse=True)  # places of (source, node)
    size, at_v, at_w = len(place), where[:n], where[n:]
    origin = np.zeros(size, bool)
    origin[at_v[src == at]] = True
    least = np.where(origin, 0.0, np.inf)
    np.minimum.at(least, at_w, d)
    short = np.flatnonzero(d == least[at_w])  # arcs on shortest paths
    a, b = at_v[row[short]], at_w[short]
    paths = front = origin.astype("float64")
    while (on := front[a] > 0).any():
        front = np.bincount(b[on], front[a[on]], size)
        paths = paths + front
    rest = front = np.where(origin | (paths == 0), 0.0, 1 / np.where(paths == 0, 1.0, paths))
    inner = ~origin[a]
    while (on := inner & (front[b] > 0)).any():
        front = np.bincount(a[on], front[b[on]], size)
        rest = rest + front
    out = np.zeros(len(d))
    out[short] = paths[a] * rest[b]
    return out


def edge_betweenness(nodes: DataFrame, edges: DataFrame, weighted: bool = True, normalised: bool = True, by: Sequence[str] = (), sources: DataFrame | None = None) -> DataFrame:
    """(by, orig, dest, edge_betweenness): of each directed edge the share of shortest paths that use it, summed over pairs of nodes.

    Path lengths are 1 / weight. ``by``: columns of nodes and edges that tell graphs apart. ``sources`` (by, coord_id): paths from
    these nodes only; all otherwise. Normalised by n (n - 1) of each graph's nodes. An edge has one row. With s(v) paths to v, an
    arc (v, w) is on s(v) · x(w) of a source's, where x(w) = 1 / s(w) + the sum of x over the shortest arcs from w (Brandes 2001).
    """
    by = list(by)
    arcs = written(arcs_of(edges, weighted, by), "arcs")
    start = written((nodes if sources is None else sources).select(*by, F.col("coord_id").alias("src")).distinct(), "sources")
    total = _in_groups(start, arcs, by)
    if total is None:
        total = _in_rounds(start, arcs, by)
    size = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = edges.select(*by, "orig", "dest").distinct().join(total, [*by, "orig", "dest"], "left")
    out = out.join(size, by, "left") if by else out.join(F.broadcast(size), F.lit(True))
    scale = F.when(F.col("_n") > 1, F.col("_n") * (F.col("_n") - 1)).otherwise(F.lit(1)) if normalised else F.lit(1)
    return out.select(*by, "orig", "dest", (F.coalesce("_b", F.lit(0.0)) / scale).alias("edge_betweenness"))
