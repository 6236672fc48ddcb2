"""Catalogs of tracked objects: filters, classes and trajectory operators.

A catalog has a row for each track and step; ``seq`` is the step's place in its track and is made once,
at ingest. Classes are a column, never a list of frames. Filters on whole tracks are semi-joins with an
aggregate of the track's rows, so only flags are shuffled.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.running import quantiles, running_places
from ..schema import locator, require

SEA = "Sea"
FEATURES = ("IVT_mean", "area", "length", "width", "perimeter", "LW_ratio", "cent_vel", "ocean", "land")
LIFECYCLES = ("birth-death", "birth-landfall", "landfall-death")


def with_seq(catalog: DataFrame, *order: str, track: str = "trackid") -> DataFrame:
    """``seq`` from 1 in the given order within each track; the order should end in a tie-break."""
    return catalog.withColumn("seq", F.row_number().over(Window.partitionBy(track).orderBy(*order)).cast("long"))


def graft(catalog: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """A column of another catalog by (trackid, seq)."""
    return catalog.drop(column).join(other.select("trackid", "seq", column), ["trackid", "seq"], "left")


def prune(catalog: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Without the named columns and those that begin with a prefix."""
    return catalog.drop(*[c for c in catalog.columns if c in names or c.startswith(tuple(prefixes))])


# filters


def time_window(catalog: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """Rows strictly after January 1 of the first year and strictly before December 31 of the last (both at 0:00)."""
    if years is None:
        return catalog
    a, b = F.to_timestamp(F.lit(f"{years[0]:04d}-01-01")), F.to_timestamp(F.lit(f"{years[-1]:04d}-12-31"))
    return catalog.where((F.col("time") > a) & (F.col("time") < b))


def drop_end_tracks(catalog: DataFrame) -> DataFrame:
    """Without the tracks of smallest and largest id (they may be cut by the window)."""
    ends = catalog.agg(F.min("trackid").alias("_a"), F.max("trackid").alias("_b"))
    return catalog.join(F.broadcast(ends), (F.col("trackid") > F.col("_a")) & (F.col("trackid") < F.col("_b"))).drop("_a", "_b")


def _tracks_where(catalog: DataFrame, keep: Column) -> DataFrame:
    return catalog.join(catalog.groupBy("trackid").agg(keep.alias("_keep")).where("_keep").select("trackid"), "trackid", "left_semi")


def in_continent(catalog: DataFrame, name: str, fully_contained: bool = True) -> DataFrame:
    """Tracks that touch the continent; fully contained ones are elsewhere only at sea."""
    require(catalog, "continent")
    here = F.coalesce(F.col("continent") == name, F.lit(False))
    keep = F.bool_or(here)
    if fully_contained:
        keep = keep & F.bool_and(here | F.coalesce(F.col("continent") == SEA, F.lit(False)))
    return _tracks_where(catalog, keep)


def in_box(catalog: DataFrame, box: Sequence[float], lon: Column, lat: Column) -> DataFrame:
    """Tracks whose every row lies strictly inside [latmin, latmax, lonmin, lonmax]; a missing position is outside."""
    a, b, c, d = box
    lon, lat = S.no_nan(lon), S.no_nan(lat)
    return _tracks_where(catalog, F.bool_and(F.coalesce((lat > a) & (lat < b) & (lon > c) & (lon < d), F.lit(False))))


def constrain(catalog: DataFrame, years=None, region=None, lon: Column | None = None, lat: Column | None = None, fully_contained: bool = True) -> DataFrame:
    """Time first (with the end tracks dropped), then space: None or 'global', a continent's name, or a box."""
    out = catalog if years is None else drop_end_tracks(time_window(catalog, years))
    if region is None or region == "global":
        return out
    return in_continent(out, region, fully_contained) if isinstance(region, str) else in_box(out, region, lon, lat)


def long_tracks(catalog: DataFrame, least: int, by: Sequence[str] = ("trackid",)) -> DataFrame:
    """Rows of tracks with ``least`` rows or more."""
    return catalog.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def hemisphere(catalog: DataFrame, lat: str, north: bool = True, edge: float = 15.0) -> DataFrame:
    """Tracks of mean latitude >= edge (north) or < -edge (south)."""
    mean = F.avg(lat)
    return _tracks_where(catalog, F.coalesce(mean >= edge if north else mean < -edge, F.lit(False)))


# classes


def _edges(values: DataFrame, column: str, k: int, exact: bool) -> DataFrame:
    at = [i / k for i in range(k + 1)]
    if exact:
        return quantiles(values, column, at).withColumnRenamed("q", "edges")
    return values.agg(F.percentile_approx(column, F.array(*[F.lit(x) for x in at])).alias("edges"))


def feature_classes(catalog: DataFrame, feature: str, average: bool, bins: int | Sequence[float] = 5, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``class`` 1..k by a feature (the track's mean of it with ``average``), and the bin edges.

    An integer makes row-weighted quantile bins (right-closed, lowest edge included; equal edges are an error);
    a list gives the edges (lowest excluded). Rows outside go. ``exact=False`` takes approximate quantiles.
    """
    value = S.no_nan(F.col(feature).cast("double"))
    # summed in order of size: the same rows give the same mean in whatever order they come, so tracks of equal values stay equal
    mean = F.avg("_v").over(Window.partitionBy("trackid").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = catalog.withColumn("_v", value)
    df = df.withColumn("_v", mean) if average else df
    if isinstance(bins, int):
        edges = _edges(df, "_v", bins, exact)
        row = edges.withColumn("_same", F.size(F.array_distinct("edges")) < bins + 1)
        checked = row.select(F.when(F.col("_same"), F.raise_error(F.lit("bin edges must be unique"))).otherwise(F.col("edges")).alias("edges"))
        label = S.quantile_label(F.col("_v"), [F.col("edges")[i] for i in range(bins + 1)])
        df = df.join(F.broadcast(checked), F.lit(True))
    else:
        edges = catalog.sparkSession.createDataFrame([([float(b) for b in bins],)], "edges array<double>")
        label = S.cut_label(F.col("_v"), bins)
    out = df.withColumn("class", (label + 1).cast("long")).where("class IS NOT NULL").drop("_v", "edges")
    return out, edges.select(F.posexplode("edges").alias("i", "edge"))


def day_night_tracks(catalog: DataFrame) -> DataFrame:
    """Tracks cut into runs of day and of night (ids trackid_1, trackid_2, ...), runs of one row dropped; class day or night."""
    require(catalog, "local_time")
    w = Window.partitionBy("trackid").orderBy("seq")
    df = catalog.withColumn("class", S.day_night(F.col("local_time")))
    change = F.when(F.col("class").eqNullSafe(F.lag("class").over(w)), 0).otherwise(1)
    df = df.withColumn("_island", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(change)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("trackid", F.concat_ws("_", F.col("trackid").cast("string"), F.col("_island").cast("string"))).drop("_island")
    return long_tracks(df, 2).where("class IS NOT NULL")


def lifetime_classes(catalog: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``class`` 0..k-1 of equal row counts by the track's lifetime (time span), and the edges: k quantiles of the rows' lifetimes.

    Rows count in order of (lifetime, trackid, seq); the remainder goes to the last class, and with fewer rows than
    classes each row has one of its own. Places are summed over tracks dealt by ranges of (lifetime, trackid), so a
    lifetime that most tracks have is spread over tasks, and over each track, so no sort is global.
    """
    tracks = catalog.groupBy("trackid").agg((F.max("time").cast("timestamp").cast("double") - F.min("time").cast("timestamp").cast("double")).alias("life"), F.count(F.lit(1)).alias("n"))
    tracks = running_places(tracks, ["life", "trackid"], "n")
    edges = quantiles(tracks.select("life", "n"), "life", [i / k for i in range(k + 1)], "n").withColumnRenamed("q", "edges")
    total = tracks.agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("trackid").orderBy("seq")) - 1
    df = catalog.withColumn("_r", place).join(tracks.select("trackid", F.col("before").alias("start")), "trackid").join(F.broadcast(total), F.lit(True))
    label = F.least(F.floor((F.col("start") + F.col("_r")) / F.greatest(F.lit(1), F.floor(F.col("total") / k))), F.lit(k - 1))
    return df.withColumn("class", label.cast("long")).drop("_r", "start", "total"), edges.select(F.posexplode("edges").alias("i", "edge"))


def condition(catalog: DataFrame, cond: str | None, bins: int | Sequence[float] = 5) -> tuple[DataFrame, DataFrame | None]:
    """``class`` by a condition, rows without a class dropped, and the bin edges where there are any."""
    if cond is None:
        return catalog.withColumn("class", F.lit(0)), None
    if cond == "season":
        return catalog.withColumn("class", S.season(F.col("time"))).where("class IS NOT NULL"), None
    if cond == "daytime":
        return day_night_tracks(catalog), None
    if cond in ("IP", "teleconnection"):
        column = "inland_pen" if cond == "IP" else cond
        require(catalog, column)
        return catalog.withColumn("class", F.col(column)).where("class IS NOT NULL"), None
    if cond in FEATURES or cond == "lifecycle":
        require(catalog, cond)
        return feature_classes(catalog, cond, cond != "lifecycle", bins)
    if cond == "lifetime":
        return lifetime_classes(catalog, bins if isinstance(bins, int) else len(bins))
    warnings.warn(f"unknown condition {cond!r}: a single class", stacklevel=2)
    return catalog.withColumn("class", F.lit(0)), None


# trajectories


def _track(df: DataFrame) -> list[str]:
    return ["class", "trackid"] if "class" in df.columns else ["trackid"]


def pairs(catalog: DataFrame, lifecycle: str | None = None) -> DataFrame:
    """Origin-destination pairs of each track: consecutive known cells (unknown ones are bridged), or its ends.

    lifecycle: 'birth-death' first and last row; 'birth-landfall' first row and first with landfall;
    'landfall-death' first with landfall and last. Pairs of a cell with itself stay.
    """
    by = _track(catalog)
    df = catalog.where("coord_idx IS NOT NULL")
    if lifecycle is None:
        w = Window.partitionBy(*by).orderBy("seq")
        out = df.select(*by, "seq", F.col("coord_idx").alias("orig"), F.lead("coord_idx").over(w).alias("dest"), F.col("mean_ivt").alias("orig_ivt"), F.lead("mean_ivt").over(w).alias("dest_ivt"))
        return out.where("dest IS NOT NULL")
    if lifecycle not in LIFECYCLES:
        raise ValueError(f"lifecycle {lifecycle!r}: one of {', '.join(LIFECYCLES)}")
    place = F.struct("seq", "coord_idx", "mean_ivt")
    first, last = F.min(place), F.max(place)
    landed = F.min(F.when(S.no_nan(F.col("lf_lon")).isNotNull(), place)) if "lf_lon" in df.columns else F.lit(None).cast("struct<seq:long,coord_idx:long,mean_ivt:double>")
    a, b = {"birth-death": (first, last), "birth-landfall": (first, landed), "landfall-death": (landed, last)}[lifecycle]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), a.alias("a"), b.alias("b")).where("n > 1 AND a IS NOT NULL AND b IS NOT NULL")
    return out.select(*by, F.col("a.seq").alias("seq"), F.col("a.coord_idx").alias("orig"), F.col("b.coord_idx").alias("dest"), F.col("a.mean_ivt").alias("orig_ivt"), F.col("b.mean_ivt").alias("dest_ivt"))


def to_entry_region(catalog: DataFrame, region: DataFrame, after_entry: bool = True, node: str = "coord_idx") -> DataFrame:
    """Tracks up to where they enter a region (a frame of cells), entry included; with ``after_entry`` up to where they leave it again.

    Tracks that never enter go. An unknown cell is outside.
    """
    cells = region.select(F.col(region.columns[0]).alias(node)).distinct().withColumn("_in", F.lit(True))
    df = catalog.join(cells, node, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    w = Window.partitionBy(*_track(catalog))
    df = df.withColumn("_en", F.min(F.when(F.col("_in"), F.col("seq"))).over(w))
    df = df.withColumn("_ex", F.min(F.when(~F.col("_in") & (F.col("seq") > F.col("_en")), F.col("seq"))).over(w))
    inside = (F.col("_ex").isNull() | (F.col("seq") < F.col("_ex"))) if after_entry else F.col("seq") <= F.col("_en")
    return df.where(F.col("_en").isNotNull() & inside).select(*catalog.columns)


def region_of(communities: DataFrame, community: int | None = None) -> DataFrame:
    """Cells (hex_id, community) of one community, or of every one >= 0."""
    return communities.where(F.col("community") == community if community is not None else F.col("community") >= 0).select("hex_id").distinct()


def run_dedup(steps: DataFrame, node: str = "coord_idx") -> DataFrame:
    """Without steps in the same cell as the step before."""
    w = Window.partitionBy(*_track(steps)).orderBy("seq")
    return steps.withColumn("_p", F.lag(node).over(w)).where(f"_p IS NULL OR _p <> {node}").drop("_p")


def paths(steps: DataFrame, node: str = "coord_idx") -> DataFrame:
    """One row for each track: its cells in order."""
    return steps.groupBy(*_track(steps)).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col(node).alias("c")))), lambda x: x["c"]).alias("path"))


def track_ends(catalog: DataFrame, node: str = "coord_idx") -> DataFrame:
    """Rows, first and last known cell of each track."""
    known = F.when(F.col(node).isNotNull(), F.struct("seq", F.col(node).alias("c")))
    return catalog.groupBy(*_track(catalog)).agg(F.count(F.lit(1)).alias("n"), F.min(known)["c"].alias("first"), F.max(known)["c"].alias("last"))


def track_means(catalog: DataFrame, *columns: str) -> DataFrame:
    """Means over each track, and its duration in days at four rows a day."""
    return catalog.groupBy(*_track(catalog)).agg(*[F.avg(S.no_nan(F.col(c).cast("double"))).alias(c) for c in columns], (F.count(F.lit(1)) / 4).alias("days"))


def sample_tracks(catalog: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows of n tracks, those of smallest MD5 sum of seed and id: the same for the same seed, in any engine."""
    ids = catalog.select("trackid").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trackid").cast("string")).cast("binary")), "trackid").limit(n)
    return catalog.join(F.broadcast(ids), "trackid", "left_semi")


def classify_tracks(catalog: DataFrame, edges: DataFrame, attribute: str = "edge_betweenness", least: int = 4, low: float = 0.33, high: float = 0.66, scale: str = "log") -> DataFrame:
    """conformist, straddler or stray by how central the edges of each track are (one minus the median step score).

    Paths are taken without repeated cells; those shorter than ``least`` are unclassified (NULL). Steps on no edge
    don't count. Thresholds are quantiles of the scores of all tracks.
    """
    if scale not in ("log", "linear"):
        raise ValueError("scale: log or linear")
    e = F.col(attribute).cast("double")
    value = F.ln(e + 1e-12) if scale == "log" else e
    scored = edges.select("orig", "dest", value.alias("_v"))
    ends = scored.agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    score = (F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-12) if scale == "log" else F.col("_v") / (F.col("_b") + 1e-12)
    scored = scored.join(F.broadcast(ends), F.lit(True)).select("orig", "dest", score.alias("s"))
    short = run_dedup(catalog.where("coord_idx IS NOT NULL"))
    size = short.groupBy("trackid").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("trackid").orderBy("seq")
    steps = short.select("trackid", F.col("coord_idx").alias("orig"), F.lead("coord_idx").over(w).alias("dest")).where("dest IS NOT NULL")
    median = steps.join(scored, ["orig", "dest"], "left").groupBy("trackid").agg((1 - F.percentile("s", F.lit(0.5))).alias("stray"))
    tracks = size.join(median, "trackid", "left").select("trackid", F.when(F.col("n") >= least, F.col("stray")).alias("stray"))
    edge = quantiles(tracks, "stray", [low, high]).withColumnRenamed("q", "_q")
    kind = F.when(F.col("stray") <= F.col("_q")[0], "conformist").when(F.col("stray") >= F.col("_q")[1], "stray").when(F.col("stray").isNotNull(), "straddler")
    return tracks.join(F.broadcast(edge), F.lit(True)).select("trackid", "stray", kind.alias("kind"))


def preprocess(catalog: DataFrame, years=None, loc: str = "centroid", grid: str = "rectangular", region="global", res: float = 2, cond: str | None = None, lifecycle: str | None = None, fully_contained: bool = True, bins: int | Sequence[float] = 5) -> DataFrame:
    """A catalog ready for pairing: cells, constraints, classes; columns class, time, trackid, seq, coord_idx, mean_ivt[, lf_lon]."""
    lon, lat = locator(loc, grid)
    if grid == "rectangular":
        df = catalog.withColumns({"_lon": S.cell_lon(lon, res), "_lat": S.cell_lat(lat, res)})
        df = df.withColumn("coord_idx", S.cell_id(F.col("_lat"), F.col("_lon")))
        lon, lat = F.col("_lon"), F.col("_lat")
    else:
        require(catalog, f"hex_idx_{loc}_res{res:g}")
        df = catalog.withColumn("coord_idx", F.col(f"hex_idx_{loc}_res{res:g}"))
    df = constrain(df, years, region, lon, lat, fully_contained)
    df, _ = condition(df, cond, bins)
    keep = ["class", "time", "trackid", "seq", "coord_idx", "mean_ivt"] + (["lf_lon"] if lifecycle else [])
    return df.select(*keep)
