"""Metrics, calibration and significance over a long result table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The quantile of 95 per cent.
Z = 1.959964


def bin_of(p: Column) -> Column:
    """Ten equal bins of a probability; 1 belongs to the last."""
    return F.least(F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 10), F.lit(9)).cast("int")


def reliability(df: DataFrame, p: str, hit: str, group: list[str] | None = None) -> DataFrame:
    """(bin, n, mean_p, rate) of each bin that has rows."""
    g = [F.col(c) for c in group or []]
    return df.groupBy(*g, bin_of(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("rate"))


def ece_brier(df: DataFrame, p: str, hit: str) -> DataFrame:
    """Expected calibration error and Brier score; one pass and a fold of ten bins."""
    y = F.col(hit).cast("double")
    bins = df.groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - y) ** 2).alias("sq"))
    return bins.agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def isotonic(bins: DataFrame, value: str, weight: str, group: list[str] | None = None, size: int = 10) -> DataFrame:
    """(bin, p) for all bins: values pooled to rise with the bin (min-max form of
    the pool-adjacent-violators fit); an empty bin takes the next filled one's
    value, at the end the last filled one's.  Works on at most ``size`` rows a
    group, whatever the data."""
    group = group or []
    b = bins.select(*group, "bin", F.col(value).alias("v"), F.col(weight).alias("w"))
    lo, mid, hi = b.alias("lo"), b.alias("mid"), b.alias("hi")
    same = [F.col(f"lo.{g}") == F.col(f"mid.{g}") for g in group]
    # weighted means of all ranges of bins
    test = F.col("lo.bin") <= F.col("mid.bin")
    for s in same:
        test = test & s
    spans = lo.join(mid, test).select(*[F.col(f"lo.{g}").alias(g) for g in group], F.col("lo.bin").alias("a"), F.col("mid.bin").alias("m"), F.col("mid.v").alias("v"), F.col("mid.w").alias("w"))
    ends = hi.select(*[F.col(g) for g in group], F.col("bin").alias("b"))
    test = F.col("s.m") <= F.col("e.b")
    for g in group:
        test = test & (F.col(f"s.{g}") == F.col(f"e.{g}"))
    means = (spans.alias("s").join(ends.alias("e"), test).groupBy(*[F.col(f"s.{g}").alias(g) for g in group], "a", "b")
             .agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean")).where("a <= b"))
    points = b.select(*group, F.col("bin").alias("i"))
    test = (F.col("x.a") <= F.col("y.i")) & (F.col("x.b") >= F.col("y.i"))
    for g in group:
        test = test & (F.col(f"x.{g}") == F.col(f"y.{g}"))
    low = (means.alias("x").join(points.alias("y"), test).groupBy(*[F.col(f"y.{g}").alias(g) for g in group], "i", "a").agg(F.min("mean").alias("low")))
    fit = low.groupBy(*group, F.col("i").alias("bin")).agg(F.max("low").alias("p"))
    every = fit.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("m"), F.max("bin").alias("last")) if group else fit.agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("m"), F.max("bin").alias("last"))
    rows = every.select(*group, "m", "last", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("bin"))
    after = F.array_min(F.filter(F.map_keys("m"), lambda k: k >= F.col("bin")))
    return rows.select(*group, "bin", F.col("m")[F.coalesce(after, F.col("last"))].alias("p"))


def wilson_lower(k: Column, n: Column) -> Column:
    """Lower end of the 95 % Wilson interval, kept within [0.005, 0.995]."""
    p = k / n
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return F.least(F.greatest(low, F.lit(0.005)), F.lit(0.995))


def operating_points(df: DataFrame, p: str, hit: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, precision, recall): conditional sums of one pass."""
    y = F.col(hit).cast("long")
    at = F.struct
    sums = [at(F.lit(t).alias("threshold"), F.count_if(F.col(p) >= t).alias("n"), F.sum(F.when(F.col(p) >= t, y).otherwise(0)).alias("tp"), F.sum(y).alias("all")).alias("x") for t in thresholds]
    rows = df.agg(F.array(*sums).alias("all_points")).select(F.explode("all_points").alias("x"))
    return rows.select("x.threshold", "x.n", (F.col("x.tp") / F.col("x.n")).alias("precision"), (F.col("x.tp") / F.col("x.all")).alias("recall"))


def log_gamma(x: Column) -> Column:
    """ln Γ(x) of x > 0 by Stirling's series, ten steps up."""
    y = x.cast("double") + 10
    low = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, i: a + F.ln(x.cast("double") + i))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - low


def sign_test(fixed: Column, broke: Column) -> Column:
    """Exact two-sided sign test, summed in logarithms.  Terms more than some 40
    deviations from the middle, less than 1e-300 of it, are left out, so that the
    sum has of the order of sqrt(n) terms."""
    n, m = (fixed + broke).cast("long"), F.least(fixed, broke).cast("long")
    first = F.least(m, F.greatest(F.lit(0), F.floor(n / 2 - 20 * F.sqrt(n) - 20))).cast("long")
    log = log_gamma(n + 1) - log_gamma(first + 1) - log_gamma(n - first + 1) - n * math.log(2.0)
    start = F.struct(log.alias("log"), F.exp(log).alias("sum"))
    step = lambda a, k: F.struct((a["log"] + F.ln(n - k) - F.ln(k + 1)).alias("log"), (a["sum"] + F.exp(a["log"] + F.ln(n - k) - F.ln(k + 1))).alias("sum"))
    rest = F.when(m > first, F.sequence(first, m - 1)).otherwise(F.array().cast("array<long>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * F.aggregate(rest, start, step)["sum"], F.lit(1.0)))


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates overall and by each label, in one grouping-sets pass."""
    sets = [["config"], *(["config", b] for b in by)]
    return df.groupingSets(sets, "config", *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact").cast("int")).alias("exact"), F.sum(F.col("normalized").cast("int")).alias("normalized"), F.round(F.avg("edit"), 6).alias("mean_edit"))


def bootstrap(df: DataFrame, hit: str, resamples: int = 1000, low: int = 25, high: int = 974, seed: int = 1) -> DataFrame:
    """(low, high): the rates of the stated ranks (from 0) of so many resamples.

    A resample of n rows, k of them hits, has a binomial count of hits; it is drawn
    by inverting the distribution at a hashed number.  The distribution is
    tabulated within 20 deviations of its mean, so work does not grow with
    rows times resamples."""
    c = df.agg(F.count_if(F.col(hit)).alias("k"), F.count(F.lit(1)).alias("n")).first()
    spark, k, n = df.sparkSession, c["k"], c["n"]
    if not n or k in (0, n):
        rate = k / n if n else 0.0
        return spark.range(1).select(F.lit(round(rate, 6)).alias("low"), F.lit(round(rate, 6)).alias("high"))
    wide = 20 * math.ceil(math.sqrt(k * (n - k) / n)) + 20
    begin, end = max(0, k - wide), min(n, k + wide)
    # logarithm of a count's weight over that of k: sums of ratios of neighbours, outwards from k
    step = F.ln((F.lit(n) - F.col("id") + 1).cast("double")) - F.ln(F.col("id").cast("double")) + math.log(k / (n - k))
    ratios = spark.range(begin + 1, end + 1).select("id", step.alias("r")).unionByName(spark.createDataFrame([(begin, 0.0)], "id long, r double"))
    order = W.orderBy("id")  # one row a count near the mean, not a row of the data
    logs = ratios.withColumn("log", F.sum("r").over(order.rowsBetween(W.unboundedPreceding, 0)))
    logs = logs.withColumn("w", F.exp(F.col("log") - F.max("log").over(W.partitionBy())))
    table = logs.withColumn("p", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(W.partitionBy())).select("id", "p")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    # each number takes the first count whose probability reaches it: in one order, the next count behind it
    mixed = table.select("p", "id", F.lit(1).alias("is_count")).unionByName(spark.range(resamples).select(u.alias("p"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("is_count")))
    drawn = mixed.withColumn("next", F.first("id", ignorenulls=True).over(W.orderBy("p", "is_count").rowsBetween(0, W.unboundedFollowing))).where("is_count = 0")
    ranked = drawn.select(F.round(F.coalesce("next", F.lit(end)) / F.lit(n), 6).alias("rate")).withColumn("rank", F.row_number().over(W.orderBy("rate")) - 1)
    return ranked.agg(F.max(F.when(F.col("rank") == low, F.col("rate"))).alias("low"), F.max(F.when(F.col("rank") == high, F.col("rate"))).alias("high"))
