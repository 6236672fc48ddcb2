"""Column expressions: time classes, grid cells, longitudes, class labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def no_nan(x: Column) -> Column:
    """NULL for NaN; aggregates then skip it."""
    return F.when(~F.isnan(x), x)


def season(time: Column) -> Column:
    """DJF, MAM, JJA or SON of a timestamp's month."""
    m = F.month(time)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isin(9, 10, 11), "SON")


def day_night(local: Column) -> Column:
    """'day' from 6:00 to 17:59, else 'night'; NULL stays NULL."""
    h = F.hour(local)
    return F.when((h >= 6) & (h < 18), "day").when(h.isNotNull(), "night")


def local_time(time: Column, tz: Column) -> Column:
    """Wall clock of a UTC time in a zone ('UTC+3', 'Europe/Paris'); NULL without a zone."""
    return F.from_utc_timestamp(time, tz)


def utc_zone(lon: Column) -> Column:
    """The zone of whole hours nearest to a longitude: GMT+h, ties to the even hour."""
    h = F.bround(lon / 15).cast("int")
    return F.concat(F.lit("GMT"), F.when(h < 0, "-").otherwise("+"), F.lpad(F.abs(h).cast("string"), 2, "0"), F.lit(":00"))


def floor_day(time: Column) -> Column:
    return F.date_trunc("DAY", time)


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def round2(x: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(x, 2)


def wrap(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def nearest_cell(x: Column, low: float, high: float, res: float, nan_to_first: bool = False) -> Column:
    """Centre of the nearest cell of the axis low, low + res, ... that reaches ``high`` (it may overshoot); ties go down.

    Beyond the ends the end cells are taken. NULL or NaN gives NULL, or the first cell with ``nan_to_first``.
    """
    n = math.ceil((high - low + res) / res - 1e-12)
    x = no_nan(x)
    cell = F.lit(low) + F.lit(float(res)) * F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil((x - low) / res - 0.5)))
    cell = F.when(x.isNotNull(), cell)
    return F.coalesce(cell, F.lit(float(low))) if nan_to_first else cell


def cell_lon(lon: Column, res: float, nan_to_first: bool = False) -> Column:
    return nearest_cell(lon, -180.0, 180.0, res, nan_to_first)


def cell_lat(lat: Column, res: float, nan_to_first: bool = False) -> Column:
    return nearest_cell(lat, -90.0, 90.0, res, nan_to_first)


def cell_id(lat: Column, lon: Column) -> Column:
    """Decimal string of the first 8 bytes of SHA-256 over 'lat_lon' with six decimals (it doesn't fit a signed long)."""
    return F.conv(F.substring(F.sha2(F.format_string("%.6f_%.6f", lat.cast("double"), lon.cast("double")), 256), 1, 16), 16, 10)


def digitize(x: Column, edges: Sequence[Column], offset: int = 0, nan: str = "null") -> Column:
    """How many of the ascending edges x reaches, plus offset. NaN: 'null', or 'last' (above all edges)."""
    n = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(offset))
    return F.when(x.isNotNull() & ~F.isnan(x), n) if nan == "null" else F.when(x.isNotNull(), n).otherwise(F.lit(offset + len(edges)))


def quantile_label(x: Column, edges: Sequence[Column]) -> Column:
    """Right-closed class 0..k-1 between k + 1 quantile edges, the lowest edge included."""
    return F.when(x.isNotNull(), sum((F.when(x > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)))


def cut_label(x: Column, edges: Sequence[float]) -> Column:
    """Right-closed class 0..k-1 between fixed edges, the lowest edge excluded; NULL outside."""
    n = sum((F.when(x > F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((x > F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1]))), n)


def initial_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Forward azimuth in degrees from point 1 to point 2, in [0, 360)."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def share_or_null(part: Column, total: Column) -> Column:
    """part / total, NULL where total is 0."""
    return F.when(total != 0, part / total)
