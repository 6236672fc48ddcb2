"""Data model: catalogs (a row for each track and step) and networks (nodes and edges)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

LOCATORS = ("core", "centroid", "head", "tail", "li")
UNASSIGNED = -999  #: how a missing community is written at the API's edge

CATALOG = StructType(
    [StructField("trackid", StringType()), StructField("time", TimestampType())]
    + [StructField(f"{loc}_{axis}", DoubleType()) for loc in LOCATORS for axis in ("lon", "lat")]
    + [StructField(n, DoubleType()) for n in ("mean_ivt", "lf_lon", "IVT_mean", "area", "length", "width", "perimeter", "LW_ratio", "cent_vel", "ocean", "land", "lifecycle")]
    + [StructField("continent", StringType()), StructField("inland_pen", IntegerType()), StructField("teleconnection", IntegerType())]
)


def locator(loc: str, grid: str = "rectangular") -> tuple[Column, Column]:
    """Longitude and latitude columns of a locator; on the hexagonal grid those of its cell."""
    if loc not in LOCATORS:
        raise ValueError(f"locator {loc!r}: one of {', '.join(LOCATORS)}")
    if grid not in ("rectangular", "hexagonal"):
        raise ValueError(f"grid {grid!r}: rectangular or hexagonal")
    prefix = "hex_" if grid == "hexagonal" else ""
    return F.col(f"{prefix}{loc}_lon"), F.col(f"{prefix}{loc}_lat")


def require(df: DataFrame, *columns: str) -> None:
    """Fail at once where a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


@dataclass(frozen=True)
class Network:
    """``nodes``: coord_id, lat, lon and attributes. ``edges``: orig, dest, weight and attributes; both may have class columns."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True

    def with_nodes(self, nodes: DataFrame) -> Network:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Network:
        return replace(self, edges=edges)
