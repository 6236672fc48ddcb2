"""A grid of hexagons and twelve pentagons on the sphere, and the outlines of regions made of its cells.

The twelve vertices of an icosahedron (two at the poles) span twenty faces. At resolution r each side is cut into
``base`` · 2^r parts; the points of the triangular lattice so made are the cells' centres, 10·n² + 2 of them. A cell is
named by what its centre weighs on the vertices of its face, such as ``1:0x3-4x4-5x1``: vertices of no weight are left
out, so a cell on a side or vertex of faces has one name, and poles and the date line are nothing special. A corner of
cells is the middle of three centres, that is a point of the lattice three times as fine, named in the same way; that two
cells share a corner or a side is thus a matter of names, not of comparing places.

Points reach their face by the nearest face's middle, and the lattice there by the gnomonic (central) projection. Areas of
hexagons differ by a factor of less than two (large in the middle of a face, small at its vertices); pentagons have five sixths of that.
Defined cases: a null or NaN latitude or longitude has no cell; longitudes may be of any turn.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

TURN = 11.0  #: longitude of the first northern vertex: no side of a face lies on the date line


def _vertex(v: int) -> tuple[float, float, float]:
    """0 and 11 are the poles, 1-5 and 6-10 rings at latitudes of ±atan(1/2)."""
    if v in (0, 11):
        return 0.0, 0.0, 1.0 if v == 0 else -1.0
    lat = math.atan(0.5) * (1 if v < 6 else -1)
    lon = math.radians(TURN + (72 * (v - 1) if v < 6 else 72 * (v - 6) + 36))
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def _dot(a, b) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True))


def _cross(a, b) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


VERTICES = [_vertex(v) for v in range(12)]
FACES = [f for f in combinations(range(12), 3) if all(_dot(VERTICES[a], VERTICES[b]) > 0.4 for a, b in combinations(f, 2))]
SUPPORTS = sorted({s for f in FACES for k in (1, 2, 3) for s in combinations(f, k)})


def _face_row(face: tuple[int, int, int]) -> list[float]:
    """Middle of the face, the three rows that give a point's weights on its vertices, and their numbers."""
    a, b, c = (VERTICES[v] for v in face)
    det = _dot(a, _cross(b, c))
    duals = [[x / det for x in _cross(p, q)] for p, q in ((b, c), (c, a), (a, b))]
    return [sum(x) for x in zip(a, b, c, strict=True)] + [x for row in duals for x in row] + [float(v) for v in face]


def _sides() -> list[tuple[str, int, list[int], list[int], list[int]]]:
    """For every set of vertices that a cell's centre can rest on, its sides anticlockwise seen from outside: (support, place,
    step to the neighbour, corner where the side starts, corner where it ends). Steps are in units of the cells' lattice, corners in
    thirds, both as weights on the twelve vertices."""

    def step(**by: int) -> list[int]:
        out = [0] * 12
        for v, n in by.items():
            out[int(v[1:])] += n
        return out

    def point(cell: list[int], third: list[int]) -> tuple[float, float, float]:
        w = [3 * a + b for a, b in zip(cell, third, strict=True)]
        return tuple(_dot(w, [x[i] for x in VERTICES]) for i in range(3))

    rows = []
    for s in SUPPORTS:
        cell = [4 if v in s else 0 for v in range(12)]
        found = {}
        for d in s:
            for r in range(12):
                faces = [f for f in FACES if set(s) | {d, r} <= set(f)]
                if r == d or not faces:
                    continue
                others = sorted({t for f in faces for t in f} - {d, r} if len(s) < 3 else set(s) - {d, r})
                corners = [step(**{f"v{r}": 1, f"v{t}": 1, f"v{d}": -2}) for t in others] + [step(**{f"v{r}": 2, f"v{d}": -1, f"v{t}": -1}) for t in others if t in s]
                one, two = corners
                if _dot(point(cell, [0] * 12), _cross(point(cell, one), point(cell, two))) < 0:
                    one, two = two, one
                found[tuple(one)] = (step(**{f"v{r}": 1, f"v{d}": -1}), one, two)
        at = min(found)
        for place in range(len(found)):
            to, one, two = found[at]
            rows.append(("-".join(map(str, s)), place, to, one, two))
            at = tuple(two)
    return rows


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def weights(name: Column) -> Column:
    """What a cell's (or corner's) name weighs on each of the twelve vertices."""
    return _let(F.str_to_map(F.element_at(F.split(name, ":"), 2), F.lit("-"), F.lit("x")), lambda m: F.array(*[F.coalesce(F.try_element_at(m, F.lit(str(v))).cast("int"), F.lit(0)) for v in range(12)]))


def _name(res: Column, w: Column, mark: str = "") -> Column:
    return F.concat(F.lit(mark), res.cast("string"), F.lit(":"), F.array_join(F.transform(w, lambda n, v: F.when(n > 0, F.concat(v.cast("string"), F.lit("x"), n.cast("string")))), "-"))


def vector(name: Column) -> Column:
    """Unit vector (x, y, z) of a cell's centre, or of a corner."""

    def along(w: Column, i: int) -> Column:
        return sum((F.get(w, F.lit(v)) * F.lit(VERTICES[v][i]) for v in range(12)), F.lit(0.0))

    def unit(p: Column) -> Column:
        far = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
        return F.struct((p["x"] / far).alias("x"), (p["y"] / far).alias("y"), (p["z"] / far).alias("z"))

    return _let(_let(weights(name), lambda w: F.struct(along(w, 0).alias("x"), along(w, 1).alias("y"), along(w, 2).alias("z"))), unit)


def excess(a: Column, b: Column) -> Column:
    """Signed area (steradians) of the spherical triangle of the north pole and two unit vectors; summed along a ring and taken
    modulo the sphere's 4π it is the area to the left of it."""
    return 2 * F.atan2(a["x"] * b["y"] - a["y"] * b["x"], 1 + a["z"] + b["z"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])


class IcosaGrid:
    """All but ``sides`` are column expressions without Python; ``sides`` joins a table of 360 rows."""

    def __init__(self, base: int = 4):
        if base < 3:
            raise ValueError("base of 3 parts or more")
        self.base = base

    def frequency(self, res: int) -> int:
        return self.base << res

    def encode(self, lat: Column, lon: Column, res: int) -> Column:
        n = self.frequency(res)
        a, o = F.radians(lat), F.radians(lon)
        where = F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))
        table = F.array(*[_numbers(_face_row(f)) for f in FACES])

        def face(p: Column) -> Column:
            along = lambda f, i: f[i] * p["x"] + f[i + 1] * p["y"] + f[i + 2] * p["z"]
            nearest = F.array_max(F.transform(table, lambda f: F.struct(along(f, 0).alias("near"), f.alias("f"))))["f"]
            return _let(nearest, lambda f: F.struct(along(f, 3).alias("a"), along(f, 6).alias("b"), along(f, 9).alias("c"), F.slice(f, 13, 3).alias("v")))

        def place(q: Column) -> Column:
            total = (q["a"] + q["b"] + q["c"]) / n
            return F.struct((q["a"] / total).alias("a"), (q["b"] / total).alias("b"), (q["c"] / total).alias("c"), q["v"].alias("v"))

        def nearest(q: Column) -> Column:  # the coordinate of largest rounding error follows from the others
            ra, rb, rc = F.rint(q["a"]), F.rint(q["b"]), F.rint(q["c"])
            da, db, dc = F.abs(ra - q["a"]), F.abs(rb - q["b"]), F.abs(rc - q["c"])
            return F.array(
                F.when((da > db) & (da > dc), n - rb - rc).otherwise(ra),
                F.when(((da <= db) | (da <= dc)) & (db > dc), n - ra - rc).otherwise(rb),
                F.when(((da <= db) | (da <= dc)) & (db <= dc), n - ra - rb).otherwise(rc),
            )

        def name(q: Column) -> Column:
            parts = F.zip_with(q["v"], nearest(q), lambda v, w: F.when(w > 0, F.concat(v.cast("int").cast("string"), F.lit("x"), w.cast("int").cast("string"))))
            return F.concat(F.lit(f"{res}:"), F.array_join(parts, "-"))

        known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat.cast("double")) & ~F.isnan(lon.cast("double"))
        return F.when(known, _let(_let(_let(where, face), place), name))

    def center(self, cell: Column) -> tuple[Column, Column]:
        """Latitude and longitude; of a corner too."""
        p = vector(cell)
        return F.degrees(F.asin(p["z"])), F.degrees(F.atan2(p["y"], p["x"]))

    def parent(self, cell: Column) -> Column:
        """The cell of the next coarser resolution: the same point of the lattice, or for one half way between two points that
        nearer to the vertex of lower number. Null at resolution 0."""
        res = F.element_at(F.split(cell, ":"), 1).cast("int")

        def halved(w: Column) -> Column:
            odd = F.array_position(F.transform(w, lambda n: n % 2), 1)
            return F.transform(w, lambda n, v: F.floor(n / 2).cast("int") + F.when(v + 1 == odd, 1).otherwise(0))

        return F.when(res > 0, _let(_let(weights(cell), halved), lambda w: _name(res - 1, w)))

    def all_cells(self, spark, res: int) -> DataFrame:
        """(coord_id, lat, lon) of every cell: the lattice's points inside each vertex, side and face, so none comes twice."""
        n = self.frequency(res)
        rows = [(len(s), *s, *[-1] * (3 - len(s))) for s in SUPPORTS]
        s = spark.createDataFrame(rows, "k int, a int, b int, c int")
        first = s.withColumn("i", F.explode(F.when(F.col("k") == 1, F.array(F.lit(n))).otherwise(F.sequence(F.lit(1), F.lit(n + 1) - F.col("k")))))
        both = first.withColumn("j", F.explode(F.when(F.col("k") < 3, F.array(n - F.col("i"))).otherwise(F.sequence(F.lit(1), n - 1 - F.col("i")))))
        part = lambda v, w: F.when((F.col(v) >= 0) & (w > 0), F.concat(F.col(v).cast("string"), F.lit("x"), w.cast("string")))
        cells = both.select(F.concat(F.lit(f"{res}:"), F.concat_ws("-", part("a", F.col("i")), part("b", F.col("j")), part("c", n - F.col("i") - F.col("j")))).alias("coord_id"))
        lat, lon = self.center(F.col("coord_id"))
        return cells.select("coord_id", lat.alias("lat"), lon.alias("lon"))

    def sides(self, cells: DataFrame, cell: str = "cell") -> DataFrame:
        """Each row of ``cells`` with each side of its cell, anticlockwise: ``place`` from 0, ``neighbour`` and the corners ``start``
        and ``end``. Rows without a cell have none."""
        table = cells.sparkSession.createDataFrame(_sides(), "_support string, place int, _to array<int>, _one array<int>, _two array<int>")
        known = cells.where(F.col(cell).isNotNull()).withColumn("_w", weights(F.col(cell)))
        rest = F.array_join(F.transform("_w", lambda n, v: F.when(n > 0, v.cast("string"))), "-")
        res = F.element_at(F.split(F.col(cell), ":"), 1)
        thirds = lambda d: _name(res, F.zip_with("_w", d, lambda n, m: 3 * n + m), "c")
        got = known.withColumn("_support", rest).join(F.broadcast(table), "_support")
        return got.select(*cells.columns, "place", _name(res, F.zip_with("_w", "_to", lambda n, m: n + m)).alias("neighbour"), thirds("_one").alias("start"), thirds("_two").alias("end"))


def outlines(grid: IcosaGrid, cells: DataFrame, cell: str = "cell", community: str = "community") -> DataFrame:
    """Rings round the regions of (cell, community): one row for each corner with ``ring`` (its least corner), ``place`` along it
    from that corner on, the region on the left, ``corner``, ``end`` (the next one), ``lat`` and ``lon``.

    Sides that two cells of a community share cancel: they are counted, not joined. As three cells meet at a corner, a community has
    none or one side that starts there, so the rest are rings as they stand. Each corner learns its ring's least corner and how far it is by pointer
    doubling: as many rounds of one join as the longest ring has binary digits, each written as a table.

    Rows without a cell or community count for nothing, repeated rows once; a cell of two communities is in both; a
    community of the whole sphere has no ring.
    """
    known = cells.select(F.col(cell).alias("cell"), F.col(community).alias("community")).where("cell IS NOT NULL AND community IS NOT NULL").distinct()
    half = grid.sides(known).groupBy("community", F.least("start", "end").alias("_a"), F.greatest("start", "end").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("start").alias("corner"), F.min("end").alias("end"))
    state = written(half.where("_n = 1").select("community", "corner", "end", F.col("end").alias("next"), F.col("corner").alias("ring"), F.lit(0).cast("long").alias("ahead")), "outline")
    reach = 1
    while True:
        other = state.select("community", F.col("corner").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        state = written(
            state.drop("less").join(other, ["community", "next"]).select("community", "corner", "end", F.col("_next").alias("next"), F.when(less, F.col("_ring")).otherwise(F.col("ring")).alias("ring"), F.when(less, F.col("_ahead") + reach).otherwise(F.col("ahead")).alias("ahead"), less.alias("less")),
            "outline",
        )
        reach *= 2
        if state.where("less").isEmpty():
            break
    length = state.groupBy("community", "ring").agg((F.max("ahead") + 1).alias("_length"))
    lat, lon = grid.center(F.col("corner"))
    return state.join(length, ["community", "ring"]).select("community", "ring", F.when(F.col("ahead") == 0, 0).otherwise(F.col("_length") - F.col("ahead")).alias("place"), "corner", "end", lat.alias("lat"), lon.alias("lon"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """(community, ring, n_corners, area, hole) of ``outlines``: the area in steradians is that to the left. A ring with more than half of
    the sphere to its left is a hole: what it cuts out is the smaller part."""
    edges = rings.select("community", "ring", excess(vector(F.col("corner")), vector(F.col("end"))).alias("e"))
    return edges.groupBy("community", "ring").agg(F.count(F.lit(1)).alias("n_corners"), F.pmod(F.sum("e"), F.lit(4 * math.pi)).alias("area")).withColumn("hole", F.col("area") > 2 * math.pi)
