"""A pluggable hexagonal grid.

``HexGrid`` is the protocol; ``AxialHexGrid`` is a plain hexagonal tiling of the longitude-latitude plane with
readable ids 'r:q:s' (resolution, axial coordinates). Catalogs that already carry ids of another grid need none of it.
"""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HexGrid(Protocol):
    def encode(self, lat: Column, lon: Column, res: int) -> Column: ...
    def center(self, cell: Column) -> tuple[Column, Column]: ...
    def boundary(self, cell: Column) -> Column: ...
    def all_cells(self, spark, res: int) -> DataFrame: ...


class AxialHexGrid:
    """Pointy-top hexagons; at resolution r a hexagon's radius is ``base`` / √7^r degrees. All expressions stay in the JVM."""

    def __init__(self, base: float = 12.0):
        self.base = base

    def radius(self, res: int) -> float:
        return self.base / math.sqrt(7) ** res

    def _round(self, q: Column, s: Column) -> tuple[Column, Column]:
        """Nearest cell of fractional axial coordinates: the coordinate of largest rounding error follows from the others."""
        t = -q - s
        rq, rs, rt = F.bround(q), F.bround(s), F.bround(t)
        dq, ds, dt = F.abs(rq - q), F.abs(rs - s), F.abs(rt - t)
        return F.when((dq > ds) & (dq > dt), -rs - rt).otherwise(rq), F.when((ds >= dq) & (ds > dt), -rq - rt).otherwise(rs)

    def encode(self, lat: Column, lon: Column, res: int) -> Column:
        a = self.radius(res)
        lon = F.pmod(lon + 180, F.lit(360.0)) - 180
        axial = F.struct(((math.sqrt(3) / 3 * lon - lat / 3) / a).alias("q"), ((lat * 2 / 3) / a).alias("s"))

        def name(p: Column) -> Column:  # inside a lambda, so that the coordinates' expressions are not repeated
            q, s = self._round(p["q"], p["s"])
            return F.when(q.isNotNull() & s.isNotNull(), F.format_string("%d:%d:%d", F.lit(res), q.cast("int"), s.cast("int")))

        return F.element_at(F.transform(F.array(axial), name), 1)

    def _parts(self, cell: Column) -> tuple[Column, Column, Column]:
        p = F.split(cell, ":")
        return p[0].cast("int"), p[1].cast("double"), p[2].cast("double")

    def center(self, cell: Column) -> tuple[Column, Column]:
        r, q, s = self._parts(cell)
        a = F.lit(self.base) / F.pow(F.lit(math.sqrt(7)), r)
        return a * 1.5 * s, a * math.sqrt(3) * (q + s / 2)

    def boundary(self, cell: Column) -> Column:
        r, _, _ = self._parts(cell)
        a = F.lit(self.base) / F.pow(F.lit(math.sqrt(7)), r)
        lat, lon = self.center(cell)
        return F.array(*[F.struct((lon + a * math.cos(math.radians(60 * i - 30))).alias("lon"), (lat + a * math.sin(math.radians(60 * i - 30))).alias("lat")) for i in [*range(6), 0]])

    def neighbours(self, cells: DataFrame) -> DataFrame:
        """(cell, neighbour): the six around each cell."""
        r, q, s = self._parts(F.col("cell"))
        around = F.array(*[F.format_string("%d:%d:%d", r, (q + a).cast("int"), (s + b).cast("int")) for a, b in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))])
        return cells.select("cell", F.explode(around).alias("neighbour"))

    def all_cells(self, spark, res: int) -> DataFrame:
        """Every cell that holds a point of a fine lattice over the globe: (coord_id, lat, lon)."""
        step = self.radius(res) / 2
        n_lon, n_lat = math.ceil(360 / step), math.ceil(180 / step) + 1
        points = spark.range(n_lon * n_lat).select((F.lit(-90.0) + step * F.floor(F.col("id") / n_lon)).alias("a"), (F.lit(-180.0) + step * (F.col("id") % n_lon)).alias("o"))
        cells = points.where("a <= 90").select(self.encode(F.col("a"), F.col("o"), res).alias("coord_id")).distinct()
        lat, lon = self.center(F.col("coord_id"))
        return cells.select("coord_id", lat.alias("lat"), lon.alias("lon"))
