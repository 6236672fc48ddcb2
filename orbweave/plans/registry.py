"""Where queries and their DuckDB oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers and flags as bigint, fractions as double rounded to six places: the same on both engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("long")
        elif kind == "boolean":
            c = c.cast("int").cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # no -0.0
        out.append(c.alias(name))
    return df.select(*out)


def register(name: str, build: Callable[[Fixtures], DataFrame], sql: str | None = None, as_is: bool = False) -> None:
    """``sql`` may use the fixture views; without it only the rows of the query are checked. ``as_is``: no rounding."""
    QUERIES[name] = lambda spark, sf_dir: (lambda df: df if as_is else tidy(df))(build(Fixtures(spark, sf_dir)))
    if sql:
        ORACLES[name] = with_views(sql.strip())
