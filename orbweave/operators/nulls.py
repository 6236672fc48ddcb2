"""Null models: lattices, random walks and rewired networks.

A realization is a value of a column, so an ensemble is one plan. Random choices are MD5 sums of (seed, realization,
track, step), so they don't depend on how rows are dealt over tasks, and any engine draws the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.running import running_places
from ..sources.scratch import written
from .icosphere import IcosaGrid
from .network import axis_cells

DRAWS = 1 << 52
CHUNK = 256  #: steps of a walk in its own task between two written tables
FEW = 4  #: those by joins
LINKS = 20_000  #: links of a lattice that go to every task


def rect_lattice(spark, res: float) -> DataFrame:
    """(orig, dest, weight 1) between each cell of the rectangular grid and its up to eight neighbours, round the date line; the doubled
    column at +180 is left out."""
    cells = axis_cells(spark, res).where(F.col("lon") < 180)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    steps = cells.select("lat", "lon", F.explode(around).alias("d")).select("lat", "lon", (F.col("lat") + F.col("d.a") * res).alias("lat2"), S.wrap(F.col("lon") + F.col("d.b") * res).alias("lon2"))
    inside = steps.where((F.col("lat2") >= -90) & (F.col("lat2") <= 90))
    return inside.select(S.cell_id(F.col("lat"), F.col("lon")).alias("orig"), S.cell_id(F.col("lat2"), F.col("lon2")).alias("dest"), F.lit(1.0).alias("weight")).distinct()


def sphere_lattice(grid: IcosaGrid, spark, res: int) -> DataFrame:
    """(orig, dest, weight 1) between each cell of the spherical grid and its neighbours, over the poles and the date line alike."""
    return grid.sides(grid.all_cells(spark, res), "coord_id").select(F.col("coord_id").alias("orig"), F.col("neighbour").alias("dest"), F.lit(1.0).alias("weight"))


def draw(seed: int, *parts: Column) -> Column:
    """A whole number in 0 .. DRAWS - 1 drawn for these values: the first 13 hex digits of the MD5 sum of them, joined by colons."""
    return _drawn(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _drawn(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def numbered_cells(lattice: DataFrame) -> DataFrame:
    """(cell, at): the lattice's cells in order, from 0."""
    cells = lattice.select(F.col("orig").alias("cell")).unionByName(lattice.select(F.col("dest").alias("cell"))).distinct().withColumn("one", F.lit(1))
    return running_places(cells, ["cell"], "one").select("cell", F.col("before").cast("long").alias("at"))


def ways_on(lattice: DataFrame, ways: Sequence[int] = (1,)) -> DataFrame:
    """(way, cell, on, total): the neighbours of each cell with their weights' running sums, in order; way -1 goes against the links."""
    link = {1: lattice.select(F.lit(1).alias("way"), F.col("orig").alias("cell"), F.col("dest").alias("to"), "weight"), -1: lattice.select(F.lit(-1).alias("way"), F.col("dest").alias("cell"), F.col("orig").alias("to"), "weight")}
    rows = link[ways[0]]
    for w in ways[1:]:
        rows = rows.unionByName(link[w])
    # a cell's neighbours, not a frame: the window is as long as a cell has links
    upto = Window.partitionBy("way", "cell").orderBy("to").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("weight > 0").withColumn("sum", F.sum(F.col("weight").cast("double")).over(upto))
    near = rows.groupBy("way", "cell").agg(F.sort_array(F.collect_list(F.struct("sum", "to"))).alias("on"), F.max("sum").alias("total"))
    return written(near, "ways")


def walk(walkers: DataFrame, near: DataFrame, key: Sequence[str], seed: int = 0, links: int = LINKS) -> DataFrame:
    """(key, step, cells): the walks of the walkers (key, n, way, cell), n cells each, the first its own, in pieces; a piece begins at
    ``step`` with the last cell of the one before. A walk ends where no way leads on.

    Ways (see ``ways_on``) of at most ``links`` links go to all tasks, and a walker takes CHUNK steps in its own task; with
    more each step is a join of all walkers with them, and a table is written every FEW steps.
    """
    key = list(key)
    own = [*key, "n", "way"]
    many = near.agg(F.sum(F.size("on"))).first()[0] or 0
    ahead = _within(near, key, seed) if many <= links else _joined(near, key, seed)
    at = walkers.where("n > 0 AND cell IS NOT NULL").select(*own, F.lit(1).cast("long").alias("step"), "cell")
    out = None
    while True:
        done = written(ahead(at), "walk")
        pieces = done.select(*key, "step", "cells")
        out = pieces if out is None else out.unionByName(pieces)
        step = F.col("step") + F.size("cells") - 1
        on = F.size("cells") > (CHUNK if many <= links else FEW)  # a shorter piece ended
        at = done.where((F.col("n") > step) & on).select(*own, step.cast("long").alias("step"), F.element_at("cells", -1).alias("cell"))
        if at.isEmpty():
            return out


def _taken(on: Column, mark: Column) -> Column:
    """The neighbour that a mark falls to."""
    return F.coalesce(F.try_element_at(F.filter(on, lambda e: e["sum"] > mark), F.lit(1)), F.element_at(on, -1))


def _within(near: DataFrame, key: list[str], seed: int):
    """CHUNK steps of each walker without a shuffle: tasks hold the ways, at most LINKS links of them, and walk a batch of walkers at a time."""
    table = near.orderBy("way", "cell").toArrow().combine_chunks()
    steps = _walker(table, CHUNK)

    def ahead(at: DataFrame) -> DataFrame:
        # walkers are small rows of much work: dealt by number, as their bytes would make a task or two
        dealt = at.repartition(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *key)
        text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.lit(""))
        kind = at.schema["cell"].dataType.simpleString()
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in at.select(*key, "n", "way", "step").schema]
        return dealt.select(*key, "n", "way", "step", "cell", text.alias("_text")).mapInArrow(steps, ", ".join([*fields, f"cells array<{kind}>"]))

    return ahead


def _walker(near: pa.Table, chunk: int):
    """A function of batches of walkers: up to ``chunk`` steps of each on the ways, with all walkers of a batch taking a step together."""

    def run(batches):
        on, way = near["on"].chunk(0) if near.num_rows else None, near["way"].to_numpy()
        first = on.offsets.to_numpy() if near.num_rows else np.zeros(1, "int32")  # a cell's links are first[i] .. first[i + 1] - 1
        links = on.values if near.num_rows else None
        sums, total = links.field("sum").to_numpy() if near.num_rows else None, near["total"].to_numpy()
        place = {w: np.flatnonzero(way == w) for w in np.unique(way).tolist()}
        for batch in batches:
            cell = batch.column("cell")
            rows, n, step, ways = batch.num_rows, *(batch.column(c).to_numpy() for c in ("n", "step", "way"))
            names = pa.concat_arrays([links.field("to").cast(cell.type), cell]) if links else cell
            found = lambda cells, w: _index(cells, near["cell"].take(place[w]).cast(cell.type), place[w])  # noqa: B023, E731
            at, onto = np.full(rows, -1), {}
            for w in place:
                at = np.where(ways == w, found(cell, w), at)
                onto[w] = found(links.field("to"), w)  # of each link the place of the cell that it leads to
            texts = np.array(batch.column("_text").to_pylist(), object)
            left = np.minimum(n - step, chunk)
            path, taken = np.empty((rows, max(0, int(left.max(initial=0))) + 1), "int64"), np.zeros(rows, "int64")
            path[:, 0] = len(names) - rows + np.arange(rows)
            for t in range(path.shape[1] - 1):
                go = np.flatnonzero((left > t) & (at >= 0))
                if not len(go):
                    break
                digest = b"".join([hashlib.md5(f"{x}{i}".encode()).digest() for x, i in zip(texts[go], (step[go] + t).tolist(), strict=True)])
                u = (np.frombuffer(digest, ">u8")[::2] >> np.uint64(12)).astype("float64") / DRAWS  # the first 13 hex digits
                here = at[go]
                link = _first_above(sums, first[here], first[here + 1] - 1, u * total[here])
                path[go, t + 1] = link
                taken[go] += 1
                for w in place:
                    mine = ways[go] == w
                    at[go[mine]] = onto[w][link[mine]]
            inside = np.arange(path.shape[1]) <= taken[:, None]
            ends = np.concatenate([[0], np.cumsum(taken + 1)]).astype("int32")
            cells = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(path[inside])))
            kept = [c for c in batch.schema.names if c not in ("cell", "_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), cells], [*kept, "cells"])

    return run


def _index(cells: pa.Array, known: pa.ChunkedArray, place: np.ndarray) -> np.ndarray:
    """The place of each cell, -1 of unknown ones."""
    i = pc.fill_null(pc.index_in(cells.cast(known.type), value_set=known), -1).to_numpy(zero_copy_only=False)
    return np.where(i < 0, -1, place[i]) if len(place) else np.full(len(cells), -1)


def _first_above(sums: np.ndarray, low: np.ndarray, high: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The first link from low on whose running sum is above the mark, or else the link high; by halving."""
    while (low < high).any():
        middle = (low + high) // 2
        above = sums[middle] > mark
        low, high = np.where(above | (low == high), low, middle + 1), np.where(above, middle, high)
    return high


def _joined(near: DataFrame, key: list[str], seed: int):
    """FEW steps of all walkers, each a join with the ways, which Spark shuffles when they are large."""

    def ahead(at: DataFrame) -> DataFrame:
        own = [*key, "n", "way", "begun"]
        rows = at.select(*key, "n", "way", F.col("step").alias("begun"), "step", "cell", F.array("cell").alias("cells"))
        for _ in range(FEW):
            rows = rows.join(near, ["way", "cell"], "left")
            # a column of its own: inside a lambda a name that the select also makes would mean the new one
            rows = rows.withColumn("mark", draw(seed, *[F.col(k) for k in key], F.col("step")) / F.lit(float(DRAWS)) * F.col("total"))
            took = F.when(F.col("n") > F.col("step"), _taken(F.col("on"), F.col("mark"))["to"])
            rows = rows.select(*own, (F.col("step") + 1).alias("step"), took.alias("cell"), "cells")
            rows = rows.withColumn("cells", F.when(F.col("cell").isNull(), F.col("cells")).otherwise(F.concat("cells", F.array("cell"))))
        return rows.select(*key, "n", "way", F.col("begun").alias("step"), "cells")

    return ahead


def steps_of(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, a, b): the steps of walks in pieces, in the order in which they were taken."""
    both = F.transform(F.slice("cells", F.lit(1), F.size("cells") - 1), lambda a, i: F.struct(a.alias("a"), F.element_at("cells", i + 2).alias("b")))
    return pieces.select(*key, F.explode(both).alias("s")).select(*key, "s.a", "s.b")


def random_walks(tracks: DataFrame, lattice: DataFrame, realizations: int, start: str | None = "first", end: str | None = None, seed: int = 0) -> DataFrame:
    """(realization, trackid, seq, coord_idx): walks on the lattice as long as the tracks (trackid, n, first, last).

    start='first' begins at the track's first cell, end='last' walks back from its last one; neither: from a random cell.
    A track whose fixed cell is missing or not on the lattice has no walk; at a cell without a way on the walk ends, shorter
    than its track; a track without rows has no walk.
    """
    # a walk that is fixed at its end goes against the lattice's directions, and is turned round
    way = -1 if end else 1
    key = ["realization", "trackid"]
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(realizations - 1).cast("long"))).alias("realization")
    pieces = walk(anchored(tracks.select("*", runs), lattice, key, "last" if end else "first" if start else None, way, seed), ways_on(lattice, [way]), key, seed)
    # a piece begins with a cell that the one before has
    fresh = (F.col("step") == 1) | (F.col("i") > 0)
    if not end:
        return pieces.select(*key, "step", F.posexplode("cells").alias("i", "coord_idx")).where(fresh).select(*key, (F.col("step") + F.col("i")).alias("seq"), "coord_idx")
    last = pieces.groupBy(*key).agg(F.max(F.col("step") + F.size("cells") - 1).alias("_last"))
    rows = pieces.join(last, key).select(*key, "step", "_last", F.posexplode("cells").alias("i", "coord_idx"))
    return rows.where(fresh).select(*key, (F.col("_last") + 1 - F.col("step") - F.col("i")).alias("seq"), "coord_idx")


def anchored(tracks: DataFrame, lattice: DataFrame, key: Sequence[str], anchor: str | None, way: int, seed: int = 0) -> DataFrame:
    """(key, n, way, cell): where each walker begins, its ``anchor`` column if that is on the lattice, or else a cell drawn."""
    cells = numbered_cells(lattice)
    if anchor:
        return tracks.join(cells.select(F.col("cell").alias(anchor)), anchor).select(*key, "n", F.lit(way).alias("way"), F.col(anchor).alias("cell"))
    many = cells.count()
    pick = F.pmod(draw(seed, *[F.col(k) for k in key], F.lit(0)), F.lit(max(1, many)))
    return tracks.withColumn("at", pick).join(cells, "at").select(*key, "n", F.lit(way).alias("way"), "cell")


def rewire(edges: DataFrame, lattice: DataFrame, realizations: int, maxdist: int = 3, seed: int = 0) -> DataFrame:
    """(realization, orig, dest, weight): each edge gets a destination among the other cells within ``maxdist`` lattice steps of
    its origin, drawn; weights stay and edges that fall together add up. An edge whose origin has no such cell keeps
    its destination."""
    ring = lattice.select("orig", "dest").distinct()
    reach = ring
    for _ in range(maxdist - 1):
        reach = reach.unionByName(reach.select("orig", F.col("dest").alias("m")).join(ring.select(F.col("orig").alias("m"), "dest"), "m").select("orig", "dest")).where("orig <> dest").distinct()
    near = reach.groupBy("orig").agg(F.sort_array(F.collect_list("dest")).alias("near"))
    many = edges.select("orig", "dest", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(realizations - 1).cast("long"))).alias("realization")).join(near, "orig", "left")
    pick = F.pmod(draw(seed, F.col("realization"), F.col("orig"), F.col("dest")), F.size("near").cast("long"))
    return many.select("realization", "orig", F.coalesce(F.element_at("near", (pick + 1).cast("int")), F.col("dest")).alias("dest"), "weight").groupBy("realization", "orig", "dest").agg(F.sum("weight").alias("weight"))
