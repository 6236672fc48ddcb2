"""Running sums, places and exact quantiles of a whole frame without ordering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def with_group(df: DataFrame, keys: Sequence[str], **of: Column) -> DataFrame:
    """``df`` with aggregates of each row's group, NULL being a key like others.

    Summed before the exchange and joined back, where a large group can be split; a window would hold it in one task.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    group = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[c.alias(n) for n, c in of.items()])
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    return df.join(group, same).drop(*names)


def running_sums(df: DataFrame, x: str, columns: Sequence[str], bins: int = 128) -> DataFrame:
    """``df`` (one row for each value of x) with ``next`` (the next larger x) and ``cum_<column>`` (its sum up to and with x).

    Values are cut at approximate quantiles into bins; sums run within each bin, and the at most ``bins`` totals are
    the only rows that one task orders.
    """
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = df.agg(F.percentile_approx(x, at, F.lit(10_000)).alias("_cuts"))
    d = df.join(F.broadcast(cuts), F.lit(True)).withColumn("_bin", F.size(F.filter("_cuts", lambda e: e < F.col(x)))).drop("_cuts")
    totals = d.groupBy("_bin").agg(F.min(x).alias("_first"), *[F.sum(c).alias(f"_t_{c}") for c in columns])
    order = Window.orderBy("_bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bin", F.lead("_first").over(order).alias("_after"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inner = Window.partitionBy("_bin").orderBy(x)
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", F.lead(x).over(inner).alias("_next"), *[F.sum(c).over(run).alias(f"_c_{c}") for c in columns]).join(F.broadcast(totals), "_bin")
    return d.select(*df.columns, F.coalesce("_next", "_after").alias("next"), *[(F.col(f"_b_{c}") + F.col(f"_c_{c}")).alias(f"cum_{c}") for c in columns])


def running_places(df: DataFrame, order: Sequence[str], count: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``count`` over all rows that come before in ``order``, which no two rows share.

    Rows are dealt by ranges of the whole order, so equal first columns are spread too; the ranges' totals are all that one task sees.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(count).alias("_t")).select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy("_part").orderBy(*order)
    rows = dealt.withColumn("_c", F.sum(count).over(inner) - F.col(count)).join(F.broadcast(totals), "_part")
    return rows.select(*df.columns, (F.col("_b") + F.col("_c")).alias("before"))


def quantiles(df: DataFrame, x: str, at: Sequence[float], count: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, q): of each group the quantiles ``at`` of x, interpolated between neighbours; NULL and NaN don't count, an array of NULLs
    without values. Without ``by`` one row. ``count`` weighs each row.

    Exact in bounded memory, in two light passes: counts of distinct values are written once, dealt by ranges of (by, x); the ranges'
    totals tell in which of them a quantile's place lies, and only these ranges' values are ordered and summed.
    """
    by = list(by)
    n = F.sum(count) if count else F.count(F.lit(1))
    known = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    values = df.where(known).select(*by, (F.col(x).cast("double") + F.lit(0.0)).alias("_x"), *([F.col(count).alias("_k")] if count else []))
    counts = values.groupBy(*by, "_x").agg((F.sum("_k") if count else n).cast("long").alias("_n")).where("_n > 0")
    dealt = written(counts.repartitionByRange(*by, "_x").withColumn("_part", F.spark_partition_id()), "values")
    inner = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_t"))  # no more rows than ranges and groups
    parts = parts.select(*by, "_part", "_t", F.coalesce(F.sum("_t").over(inner), F.lit(0)).alias("_b"), F.sum("_t").over(Window.partitionBy(*by)).alias("_all"))
    place = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("r")) for i, q in enumerate(at)])
    ends = lambda a: F.array(F.struct(a["i"].alias("i"), (a["r"] - F.floor(a["r"])).alias("f"), F.lit(0).alias("up"), F.floor(a["r"]).alias("k")), F.struct(a["i"].alias("i"), (a["r"] - F.floor(a["r"])).alias("f"), F.lit(1).alias("up"), F.ceil(a["r"]).alias("k")))
    mine = F.filter(F.flatten(F.transform(place, ends)), lambda a: (a["k"] >= F.col("_b")) & (a["k"] < F.col("_b") + F.col("_t")))
    asked = parts.withColumn("_asked", mine).where(F.size("_asked") > 0).select(*by, "_part", "_b", "_asked")
    run = Window.partitionBy(*by, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    other = asked.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)], F.col("_part").alias("_p"), "_b", "_asked")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"_g{i}"))
    rows = dealt.join(other, same).withColumn("_c", F.col("_b") + F.sum("_n").over(run))
    hits = rows.select(*by, "_x", F.explode(F.filter("_asked", lambda a: (a["k"] < F.col("_c")) & (a["k"] >= F.col("_c") - F.col("_n")))).alias("a"))
    value = hits.groupBy(*by, F.col("a.i").alias("i")).agg(F.max(F.when(F.col("a.up") == 0, F.col("_x"))).alias("lo"), F.max(F.when(F.col("a.up") == 1, F.col("_x"))).alias("hi"), F.max("a.f").alias("f"))
    q = F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))
    found = value.select(*by, "i", q.alias("q"))
    if by:  # groups without values too
        found = found.unionByName(df.select(*by, F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("q")).distinct())
    got = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "q")))).alias("s"))
    return got.select(*by, F.array(*[F.try_element_at("s", F.lit(i)) for i in range(len(at))]).alias("q"))
