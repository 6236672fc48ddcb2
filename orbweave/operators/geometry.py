"""Cells as polygons, edge directions and the tables that drawings are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.running import quantiles
from .network import edge_places


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def rect_boundary(lon: Column, lat: Column, res: float) -> Column:
    """Corners of a rectangular cell, from the lower left one counter-clockwise, closed."""
    h = res / 2
    corners = [(-h, -h), (h, -h), (h, h), (-h, h), (-h, -h)]
    return F.array(*[_point(lon + a, lat + b) for a, b in corners])


def edge_bearings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bearing``: initial bearing in degrees from orig to dest."""
    return edge_places(edges, nodes).withColumn("bearing", S.initial_bearing(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))


def direction_bins(bearings: DataFrame, n: int = 8) -> DataFrame:
    """``dir`` in [0, 1] and ``bin``: which of n points evenly spaced between the extremes is reached last."""
    df = bearings.withColumn("dir", F.col("bearing") / 360)
    ends = df.agg(F.min("dir").alias("_a"), F.max("dir").alias("_b"))
    step = (F.col("_b") - F.col("_a")) / (n - 1)
    at = F.when(F.col("_b") > F.col("_a"), F.floor((F.col("dir") - F.col("_a")) / step + 1e-9)).otherwise(0)
    return df.join(F.broadcast(ends), F.lit(True)).withColumn("bin", at.cast("long")).drop("_a", "_b")


def split_at_meridian(edges: DataFrame) -> DataFrame:
    """Edges (lon1, lat1, lon2, lat2) as segments: one that crosses the date line becomes two that end at ±180, each at
    its own end's latitude. Longitudes are wrapped to [-180, 180) first; where an end lies on the cut, the cut moves 0.5 inwards.
    """
    df = edges.withColumns({"_a": S.wrap(F.col("lon1")), "_b": S.wrap(F.col("lon2"))})
    seg = lambda a, y, b, z: F.struct(a.alias("x1"), y.alias("y1"), b.alias("x2"), z.alias("y2"))
    west = lambda x: F.when(F.col(x) == -180, -179.5).otherwise(-180.0)
    east = F.col("_a") > F.col("_b")
    cut = F.array(seg(F.col("_a"), F.col("lat1"), F.when(east, 180.0).otherwise(west("_a")), F.col("lat1")), seg(F.when(east, west("_b")).otherwise(180.0), F.col("lat2"), F.col("_b"), F.col("lat2")))
    whole = F.array(seg(F.col("_a"), F.col("lat1"), F.col("_b"), F.col("lat2")))
    df = df.withColumn("_s", F.when(F.abs(F.col("_a") - F.col("_b")) > 180, cut).otherwise(whole))
    return df.select(*edges.columns, F.posexplode("_s").alias("segment", "s")).select(*edges.columns, "segment", "s.x1", "s.y1", "s.x2", "s.y2")


def discard_long(segments: DataFrame, most: float) -> DataFrame:
    """Without segments longer than ``most`` degrees of longitude."""
    return segments.where(F.abs(F.col("x1") - F.col("x2")) <= most)


def split_polygons(cells: DataFrame, column: str = "boundary") -> DataFrame:
    """Polygons over the date line (a vertex beyond 170 and one beyond -170) as two: eastern ones end at 180, western ones at -180."""
    v = F.col(column)
    over = F.exists(v, lambda p: p["lon"] > 170) & F.exists(v, lambda p: p["lon"] < -170)
    east = F.transform(v, lambda p: F.struct(F.when(p["lon"] < 0, 180.0).otherwise(p["lon"]).alias("lon"), p["lat"].alias("lat")))
    west = F.transform(v, lambda p: F.struct(F.when(p["lon"] > 0, -180.0).otherwise(p["lon"]).alias("lon"), p["lat"].alias("lat")))
    parts = F.when(over, F.array(east, west)).otherwise(F.array(F.transform(v, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))))
    rest = [c for c in cells.columns if c != column]
    return cells.select(*rest, F.posexplode(parts).alias("part", column))


def unwrap(steps: DataFrame, lon: str) -> DataFrame:
    """``lon`` along each track without jumps over the date line (it may leave [-180, 180])."""
    w = Window.partitionBy("trackid").orderBy("seq")
    d = F.col(lon) - F.lag(lon).over(w)
    jump = F.when(d > 180, -F.ceil((d - 180) / 360)).when(d < -180, F.ceil((-d - 180) / 360)).otherwise(0)
    df = steps.withColumn("_j", F.coalesce(jump, F.lit(0)))
    return df.withColumn(lon, F.col(lon) + 360 * F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def curve_control(edges: DataFrame, curvature: float = 0.2) -> DataFrame:
    """``cx``, ``cy``: control point of a curved edge, the midpoint moved up by curvature times its extent in x."""
    return edges.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2 + curvature * (F.col("x2") - F.col("x1"))})


def equal_earth(lon: Column, lat: Column, radius: float = 1.0, center: float = 0.0) -> tuple[Column, Column]:
    """x and y of the Equal Earth projection of a sphere (Šavrič, Patterson and Jenny 2018), ``center`` being the longitude in the middle.

    Longitudes are taken as they are: segments are split at the edge of the map first (``split_at_meridian``).
    """
    a1, a2, a3, a4 = 1.340264, -0.081106, 0.000893, 0.003796  # the projection's fixed values
    t = F.asin(math.sqrt(3) / 2 * F.sin(F.radians(lat)))
    t2 = t * t
    t6 = t2 * t2 * t2
    x = radius * 2 * math.sqrt(3) * F.radians(lon - F.lit(center)) * F.cos(t) / (3 * (9 * a4 * t6 * t2 + 7 * a3 * t6 + 3 * a2 * t2 + a1))
    return x, radius * t * (a4 * t6 * t2 + a3 * t6 + a2 * t2 + a1)


def projected_arcs(segments: DataFrame, curvature: float = 0.2, parts: int = 10, project=equal_earth) -> DataFrame:
    """Each segment (x1, y1, x2, y2 in degrees) as ``parts`` + 1 points of a quadratic Bezier arc, bent in projected coordinates:
    ``step`` from 0, ``px``, ``py``, and ``heading``, the direction of the arc there in radians (for arrows). The control point is the projected
    midpoint, moved up by curvature times the arc's projected extent in x. A segment without a place has points without places."""
    (ax, ay), (bx, by) = project(F.col("x1"), F.col("y1")), project(F.col("x2"), F.col("y2"))
    df = segments.withColumn("_e", F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")))
    df = df.withColumn("_c", F.struct(((F.col("_e.ax") + F.col("_e.bx")) / 2).alias("x"), ((F.col("_e.ay") + F.col("_e.by")) / 2 + curvature * (F.col("_e.bx") - F.col("_e.ax"))).alias("y")))
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(parts))))
    t = F.col("step") / parts
    at = lambda k: (1 - t) * (1 - t) * F.col(f"_e.a{k}") + 2 * t * (1 - t) * F.col(f"_c.{k}") + t * t * F.col(f"_e.b{k}")
    slope = lambda k: (1 - t) * (F.col(f"_c.{k}") - F.col(f"_e.a{k}")) + t * (F.col(f"_e.b{k}") - F.col(f"_c.{k}"))
    return df.withColumns({"px": at("x"), "py": at("y"), "heading": F.atan2(slope("y"), slope("x"))}).drop("_e", "_c")


def point_in_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point columns, polygon id) of points (lon, lat) inside polygons (poly, boundary), by ray casting in array functions.

    Candidates are joined by 10-degree tiles, so neither side is crossed with all of the other.
    """
    tile = lambda x: F.floor(x / 10).cast("int")
    xs, ys = F.transform("boundary", lambda p: p["lon"]), F.transform("boundary", lambda p: p["lat"])
    spread = polygons.select("poly", "boundary", F.explode(F.sequence(tile(F.array_min(xs)), tile(F.array_max(xs)))).alias("_tx"), ys.alias("_ys"))
    spread = spread.select("poly", "boundary", "_tx", F.explode(F.sequence(tile(F.array_min("_ys")), tile(F.array_max("_ys")))).alias("_ty"))
    both = points.withColumns({"_tx": tile(F.col("lon")), "_ty": tile(F.col("lat"))}).join(spread, ["_tx", "_ty"])
    pairs = F.zip_with(F.slice("boundary", F.lit(1), F.size("boundary") - 1), F.slice("boundary", F.lit(2), F.size("boundary") - 1), lambda a, b: ((a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))) & (F.col("lon") < (b["lon"] - a["lon"]) * (F.col("lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]))
    crossings = F.size(F.filter(pairs, lambda x: F.coalesce(x, F.lit(False))))
    return both.where(crossings % 2 == 1).select(*points.columns, "poly").distinct()


def plot_table(edges: DataFrame, nodes: DataFrame, n_bins: int = 7, discard: float = 180.0) -> DataFrame:
    """A row for each drawn segment: places, width bin of the weight (between the rounded least and the rounded 0.999 quantile), bearing."""
    df = edge_bearings(edges, nodes)
    ends = df.agg(F.bround(F.min("weight")).alias("_a")).join(F.broadcast(quantiles(df, "weight", [0.999]).select(F.bround(F.col("q")[0]).alias("_b"))), F.lit(True))
    w = F.least(F.greatest(F.col("weight"), F.col("_a")), F.col("_b"))
    bin_ = F.when(F.col("_b") > F.col("_a"), F.floor((w - F.col("_a")) * (n_bins - 1) / (F.col("_b") - F.col("_a")))).otherwise(0)
    df = df.join(F.broadcast(ends), F.lit(True)).withColumn("bin", bin_.cast("long")).drop("_a", "_b")
    return discard_long(split_at_meridian(df), discard).select("orig", "dest", "segment", "x1", "y1", "x2", "y2", "weight", "bin", "bearing")


def node_table(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """Nodes with their opacity: 0.6 with any degree, 0.1 without."""
    return nodes.join(degree, "coord_id", "left").withColumn("alpha", F.when(F.coalesce("degree", F.lit(0.0)) > 0, 0.6).otherwise(0.1))


def change_table(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(coord_id, change): b minus a where both are known."""
    both = a.select("coord_id", S.no_nan(F.col(column).cast("double")).alias("_a")).join(b.select("coord_id", S.no_nan(F.col(column).cast("double")).alias("_b")), "coord_id")
    return both.where("_a IS NOT NULL AND _b IS NOT NULL").select("coord_id", (F.col("_b") - F.col("_a")).alias("change"))


def sentinel_difference(a: DataFrame, b: DataFrame, column: str, sentinel: float = 9999.0) -> DataFrame:
    """(coord_id, diff): b minus a; -9999 where a lacks the cell, 9999 where b does."""
    both = a.select("coord_id", F.col(column).cast("double").alias("_a")).join(b.select("coord_id", F.col(column).cast("double").alias("_b")), "coord_id", "full_outer")
    return both.select("coord_id", F.when(F.col("_a").isNull(), -sentinel).when(F.col("_b").isNull(), sentinel).otherwise(F.col("_b") - F.col("_a")).alias("diff"))


def combined(a: DataFrame, b: DataFrame, column: str, fill: float = 0.0) -> DataFrame:
    """(coord_id, a, b, first): both catalogs' values, ``fill`` where one lacks the cell; ``first`` is a's if known, else b's."""
    both = a.select("coord_id", F.col(column).alias("a")).join(b.select("coord_id", F.col(column).alias("b")), "coord_id", "full_outer")
    return both.select("coord_id", F.coalesce("a", F.lit(fill)).alias("a"), F.coalesce("b", F.lit(fill)).alias("b"), F.coalesce("a", "b").alias("first"))
