"""Monthly climate indices and their phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def melt_months(wide: DataFrame) -> DataFrame:
    """(year, month, idx) of rows (year, m1..m12)."""
    return wide.unpivot("year", [f"m{i}" for i in range(1, 13)], "name", "idx").select(F.col("year").cast("int"), F.substring("name", 2, 2).cast("int").alias("month"), F.col("idx").cast("double"))


def monthly_series(index: DataFrame) -> DataFrame:
    """(month_start, idx) in time order of (year, month, idx)."""
    return index.select(F.make_date("year", "month", F.lit(1)).alias("month_start"), "idx")


def smoothed(series: DataFrame) -> DataFrame:
    """``avg3``: mean of a month and the two before it, NULL unless all three are known.

    A climate index is one short series (rows are months), so its windows have one partition.
    """
    w = Window.orderBy("month_start").rowsBetween(-2, 0)
    return series.withColumn("avg3", F.when(F.count("idx").over(w) == 3, F.avg("idx").over(w)))


def sustained_phases(series: DataFrame, column: str, threshold: float = 0.5, least: int = 5, zscore: bool = True) -> DataFrame:
    """``phase``: 1 (-1) from the ``least``-th month on of a run above (below) the threshold, else 0; unknown months are 0."""
    every = Window.partitionBy()
    order = Window.orderBy("month_start")
    x = F.col(column)
    z = (x - F.avg(x).over(every)) / F.stddev_pop(x).over(every) if zscore else x
    df = series.withColumn("_z", z)
    total = F.lit(0)
    for sign, cond in ((1, F.col("_z") > threshold), (-1, F.col("_z") < -threshold)):
        c, g = f"_c{sign}", f"_g{sign}"
        df = df.withColumn(c, F.coalesce(cond.cast("int"), F.lit(0)))
        change = F.when(F.col(c) == F.coalesce(F.lag(c).over(order), F.col(c)), 0).otherwise(1)
        df = df.withColumn(f"_x{sign}", change)
        df = df.withColumn(g, F.sum(f"_x{sign}").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        run = F.sum(c).over(Window.partitionBy(g).orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(f"_r{sign}", run)
        total = total + F.when((F.col(c) == 1) & (F.col(f"_r{sign}") >= least), sign).otherwise(0)
    return df.withColumn("phase", total.cast("int")).select(*series.columns, "phase")


def daily(series: DataFrame, *columns: str) -> DataFrame:
    """One row a day from the first month's start to the last one's; each day has its month's values, missing months carried forward."""
    ends = series.agg(F.min("month_start").alias("a"), F.max("month_start").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    joined = days.join(series.withColumnRenamed("month_start", "day"), "day", "left")
    return joined.select("day", *[F.last(c, True).over(w).alias(c) for c in columns])


def with_index(catalog: DataFrame, days: DataFrame, column: str, name: str = "teleconnection") -> DataFrame:
    """The day's value of an index on each row of a catalog (a century has under 40,000 days, so they are broadcast)."""
    return catalog.withColumn("day", F.to_date("time")).join(F.broadcast(days.select("day", F.col(column).alias(name))), "day", "left").drop("day")
