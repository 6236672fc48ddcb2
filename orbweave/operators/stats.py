"""Significance against null ensembles, distributions and two-sample statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.running import quantiles, running_sums


def p_values(real: DataFrame, null: DataFrame, metric: str, two_sided: bool = False, key: str = "cell") -> DataFrame:
    """(cell, model, p) of real (cell, metric) against null (model, realization, cell, metric).

    One-sided (count of null >= real, plus 1) / (n + 1); two-sided by distances from the null mean.
    """
    both = real.select(key, F.col(metric).alias("_r")).join(null.select("model", key, S.no_nan(F.col(metric)).alias("_n")), key).where("_n IS NOT NULL AND _r IS NOT NULL")
    if two_sided:
        mean = null.groupBy("model", key).agg(F.avg(S.no_nan(F.col(metric))).alias("_m"))
        both = both.join(mean, ["model", key]).withColumns({"_r": F.abs(F.col("_r") - F.col("_m")), "_n": F.abs(F.col("_n") - F.col("_m"))})
    # a hair's breadth of tolerance makes equal values equal whatever the order of summing
    p = (F.sum(F.when(F.col("_n") >= F.col("_r") - 1e-12, 1).otherwise(0)) + 1) / (F.count(F.lit(1)) + 1)
    return both.groupBy(key, "model").agg(p.alias("p"))


def benjamini_hochberg(p: DataFrame, key: str = "cell", test: str = "model") -> DataFrame:
    """``p_adj``: p-values adjusted over the known tests of each cell."""
    w = Window.partitionBy(key).orderBy("p", test)
    known = p.where("p IS NOT NULL")
    raw = known.withColumn("_a", F.col("p") * F.count(F.lit(1)).over(Window.partitionBy(key)) / F.row_number().over(w))
    down = Window.partitionBy(key).orderBy(F.desc("p"), F.desc(test)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adj", F.least(F.lit(1.0), F.min("_a").over(down))).drop("_a")


def significant(p: DataFrame, column: str = "p_adj", alpha: float = 0.1) -> DataFrame:
    return p.withColumn("significant", F.coalesce(F.col(column) < alpha, F.lit(False)))


def populations(flags: DataFrame) -> DataFrame:
    """Nested populations from flags s1..s4 of a cell: pop1 s1; pop2 s1, s4; pop3 s1, s4, s2; pop4 all; pop0 none of these."""
    s1, s2, s3, s4 = (F.coalesce(F.col(f"s{i}"), F.lit(False)) for i in range(1, 5))
    pop = {"pop1": s1, "pop2": s1 & s4, "pop3": s1 & s4 & s2, "pop4": s1 & s2 & s3 & s4}
    return flags.withColumns({**pop, "pop0": ~s1})


def wide_flags(p: DataFrame, column: str = "significant", key: str = "cell") -> DataFrame:
    """s1..s4: the flag of each model."""
    return p.groupBy(key).agg(*[F.bool_or(F.when(F.col("model") == i, F.col(column))).alias(f"s{i}") for i in range(1, 5)])


def kde(values: DataFrame, column: str, low: float, high: float, n: int = 100) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on n points from low to high.

    One sum for each point in a single aggregate: a task sends on one row, however many values it has.
    """
    x = S.no_nan(F.col(column).cast("double"))
    v = values.select(x.alias("x")).where("x IS NOT NULL")
    h = v.agg((F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"), F.count(F.lit(1)).alias("n"))
    step = (high - low) / (n - 1)
    sums = v.join(F.broadcast(h), F.lit(True)).agg(F.max("h").alias("h"), F.max("n").alias("n"), *[F.sum(F.exp(-F.pow((F.lit(low + i * step) - F.col("x")) / F.col("h"), 2) / 2)).alias(f"_{i}") for i in range(n)])
    points = sums.where("n IS NOT NULL").select("h", "n", F.posexplode(F.array(*[f"_{i}" for i in range(n)])).alias("i", "k"))
    return points.select(F.col("i").cast("long").alias("i"), (F.lit(low) + F.col("i") * step).alias("x"), (F.col("k") / (F.col("h") * F.col("n") * math.sqrt(2 * math.pi))).alias("density"))


def histogram(values: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, low, n): equal-width bins between the extremes, the last one closed; empty bins are left out."""
    x = S.no_nan(F.col(column).cast("double"))
    v = values.select(x.alias("x")).where("x IS NOT NULL")
    ends = v.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) * bins / (F.col("b") - F.col("a"))))
    at = F.when(F.col("b") > F.col("a"), at).otherwise(F.lit(bins // 2))
    return v.join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("long").alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins).alias("low"), "n")


def _ecdf(values: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """Distinct values with both groups' cumulative shares; one row a distinct value."""
    x = S.no_nan(F.col(column).cast("double"))
    v = values.where(F.col(group).isin(a, b)).select(x.alias("x"), (F.col(group) == a).cast("int").alias("g")).where("x IS NOT NULL")
    each = v.groupBy("x").agg(F.sum("g").alias("na"), F.sum(1 - F.col("g")).alias("nb"))
    total = each.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    run = running_sums(each, "x", ["na", "nb"]).join(F.broadcast(total), F.lit(True))
    return run.select("x", "next", "na", "nb", F.col("cum_na").alias("ca"), F.col("cum_nb").alias("cb"), "ta", "tb")


def wasserstein(values: DataFrame, column: str, group: str, a, b, pooled: bool = True) -> DataFrame:
    """First Wasserstein distance of two groups; relative to the pooled standard deviation with ``pooled``."""
    e = _ecdf(values, column, group, a, b)
    dist = e.agg(F.sum(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")) * (F.col("next") - F.col("x"))).alias("w"))
    if not pooled:
        return dist.select(F.col("w").alias("distance"))
    x = S.no_nan(F.col(column).cast("double"))
    var = values.agg(F.var_pop(F.when(F.col(group) == a, x)).alias("va"), F.var_pop(F.when(F.col(group) == b, x)).alias("vb"))
    return dist.join(var).select((F.col("w") / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("distance"))


def _ks_p(d: Column, na: Column, nb: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic, by a hundred terms of its alternating series; NULL without values on both sides."""
    t = F.sqrt(F.try_divide(na * nb, na + nb)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * t * t))
    return F.when((na > 0) & (nb > 0) & d.isNotNull(), F.when(t > 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))).otherwise(1.0))


def normal_tails(z: Column, n: int = 1000) -> Column:
    """Two-sided p of a standard normal deviate z >= 0: Simpson's rule over n intervals from 0 to z (0 beyond 12)."""
    h = z / n
    weight = lambda i: F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda s, i: s + weight(i) * F.exp(-(i * h) * (i * h) / 2)) * h / 3
    return F.when(z > 12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 2 * area / math.sqrt(2 * math.pi))))


def kolmogorov_smirnov(values: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """(statistic, p): largest difference of the two cumulative shares; asymptotic p. NULL if a group has no value."""
    e = _ecdf(values, column, group, a, b)
    top = e.agg(F.max(F.abs(F.try_divide("ca", "ta") - F.try_divide("cb", "tb"))).alias("statistic"), F.max("ta").alias("na"), F.max("tb").alias("nb"))
    return top.select("statistic", _ks_p(F.col("statistic"), F.col("na").cast("double"), F.col("nb").cast("double")).alias("p"))


def mann_whitney(values: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """(u, z, p) of group a: ties get their mean rank; two-sided normal p with tie and continuity correction."""
    e = _ecdf(values, column, group, a, b).withColumn("n", F.col("na") + F.col("nb"))
    rank = F.col("ca") + F.col("cb") - F.col("n") + (F.col("n") + 1) / 2
    s = e.agg(F.sum(rank * F.col("na")).alias("r"), F.max("ta").cast("double").alias("na"), F.max("tb").cast("double").alias("nb"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("t"))
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2
    n = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (n + 1 - F.try_divide(F.col("t"), n * (n - 1))))
    top = F.greatest(u, F.col("na") * F.col("nb") - u)
    z = F.try_divide(top - F.col("na") * F.col("nb") / 2 - 0.5, sd)
    # below 0 (the continuity correction of equal ranks) both tails are all there is
    return s.select(u.alias("u"), z.alias("z")).select("u", "z", F.when(F.col("z").isNotNull(), normal_tails(F.greatest("z", F.lit(0.0)))).alias("p"))


def group_median(values: DataFrame, column: str, *by: str) -> DataFrame:
    return quantiles(values, column, [0.5], by=by).select(*by, F.col("q")[0].alias("median"))


def group_percentile(values: DataFrame, column: str, q: float, *by: str) -> DataFrame:
    """The q quantile (linear) of the known values of each group."""
    return quantiles(values, column, [q], by=by).select(*by, F.col("q")[0].alias("q"))


def summary(values: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean, population variance, quartiles and their distance."""
    x = S.no_nan(F.col(column))
    moments = values.groupBy(*by).agg(F.avg(x).alias("mean"), F.var_pop(x).alias("var"))
    q = quantiles(values, column, [0.25, 0.75], by=by).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return moments.join(q, same).drop(*[f"_{k}" for k in by]).withColumn("iqr", F.col("q75") - F.col("q25"))
