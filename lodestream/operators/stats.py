"""Magnitude, noise and coverage statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG10_E = math.log10(math.e)


def mad(df: DataFrame, value: str, keys: list[str], name: str = "mad") -> DataFrame:
    """The median absolute deviation per key, in two aggregations."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return df.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias(name))


def rms(x: Column) -> Column:
    """A29"""
    return F.sqrt(F.avg(x * x))


def snr_db(value: str, signal: Column, noise: Column) -> Column:
    """20 log10 of the ratio of the two windows' RMS."""
    v = F.col(value)
    ratio = F.sqrt(F.avg(F.when(signal, v * v))) / F.nullif(F.sqrt(F.avg(F.when(noise, v * v))), F.lit(0.0))
    return 20 * F.log10(ratio)


def snr_peak(value: str, signal: Column, noise: Column, least: int = 5) -> Column:
    """The signal window's peak over the noise window's RMS; null with fewer than `least` samples in either."""
    v = F.col(value)
    enough = (F.count(F.when(signal, v)) >= least) & (F.count(F.when(noise, v)) >= least)
    return F.when(enough, F.max(F.abs(F.when(signal, v))) / F.nullif(F.sqrt(F.avg(F.when(noise, v * v))), F.lit(0.0)))


def noise(df: DataFrame, value: str, channel: str, method: str = "madjdabadi") -> DataFrame:
    """A noise level: mean of 3 population deviations per channel, or the mean of the 10th and 90th percentiles
    ('krietsch'), or mean and MAD of every channel ('by_channel')."""
    if method == "madjdabadi":
        return df.groupBy(channel).agg((3 * F.stddev_pop(value)).alias("n")).agg(F.avg("n").alias("noise"))
    if method == "krietsch":
        p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
        return df.groupBy(channel).agg(((p[0] + p[1]) / 2).alias("n")).agg(F.avg("n").alias("noise"))
    if method == "by_channel":
        return df.groupBy(channel).agg(F.avg(value).alias("noise")).join(mad(df, value, [channel]), channel)
    raise ValueError(f"unknown method {method}")


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int, keys: list[str] = ()) -> DataFrame:
    """Counts of equal bins; the last bin includes its upper edge, values outside are left out."""
    place = F.floor((F.col(value) - low) / width)
    place = F.when(F.col(value) == low + width * bins, F.lit(bins - 1)).otherwise(place).cast("int")
    rows = df.withColumn("bin", place).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def dense_histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """A19 with a row for every bin."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(histogram(df, value, low, width, bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def max_curvature(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """The bin after which the histogram bends most (largest second difference); the lowest of equals.

    The window runs over the bins, whose number is fixed.
    """
    w = Window.orderBy("bin")
    bend = F.lead("n", 2).over(w) - 2 * F.lead("n", 1).over(w) + F.col("n")
    rows = dense_histogram(df, value, low, width, bins).withColumn("bend", F.abs(bend)).where("bend is not null")
    return rows.agg(F.max(F.struct("bend", (-F.col("bin")).alias("b"))).alias("x")).select((-F.col("x.b")).alias("bin"), (low + width * -F.col("x.b")).alias("mc"))


def b_value_lsq(df: DataFrame, value: str, low: float, width: float, bins: int, least: int = 5) -> DataFrame:
    """Slope and intercept of log10 of how many values reach each bin; null with fewer than `least` bins."""
    w = Window.orderBy(F.desc("bin"))
    rows = dense_histogram(df, value, low, width, bins).withColumn("total", F.sum("n").over(w)).where("total > 0")
    x, y = low + width * F.col("bin"), F.log10("total")
    enough = F.count("*") >= max(2, least)
    return rows.agg(F.when(enough, -F.regr_slope(y, x)).alias("b"), F.when(enough, F.regr_intercept(y, x)).alias("a"))


def b_value_mle(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The maximum-likelihood b-value and its standard error per key."""
    m = F.col(value)
    b = LOG10_E / F.nullif(F.avg(m) - F.min(m), F.lit(0.0))
    spread = F.var_pop(m) / F.nullif(F.count(m) - 1, F.lit(0))
    return df.groupBy(*keys).agg(b.alias("b"), (2.30 * F.sqrt(spread) * b * b).alias("error"))


def b_value_by_cutoff(df: DataFrame, value: str, cutoffs: list[float]) -> DataFrame:
    """The maximum-likelihood b-value above every cut-off, in one aggregation."""
    parts = []
    for c in cutoffs:
        m = F.when(F.col(value) >= c, F.col(value))
        parts.append(F.struct(F.lit(float(c)).alias("cutoff"), F.count(m).alias("n"), (LOG10_E / F.nullif(F.avg(m) - c, F.lit(0.0))).alias("b")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def utsu_probability(n1: Column, n2: Column, b1: Column, b2: Column) -> Column:
    """The probability that two b-values are equal."""
    n = n1 + n2
    da = -2 * n * F.log(n) + 2 * n1 * F.log(n1 + n2 * b1 / b2) + 2 * n2 * F.log(n1 * b2 / b1 + n2) - 2
    return F.exp(-da / 2 - 2)


def quartile_weights(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median, spread from the quartiles, and the share of values beyond three spreads, per key."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = df.groupBy(*keys).agg(p.alias("p")).select(*keys, F.col("p")[1].alias("middle"), ((F.col("p")[2] - F.col("p")[0]) / 1.349).alias("spread"))
    far = F.avg(F.when(F.abs(F.col(value) - F.col("middle")) > 3 * F.col("spread"), 1.0).otherwise(0.0))
    return df.join(q, keys).groupBy(*keys, "middle", "spread").agg(far.alias("outliers"))


def nearest_node(x: Column, first: float, step: float, nodes: int) -> Column:
    """The index of the nearest of evenly spaced nodes; ties go to the lower one."""
    place = F.ceil((x - first) / step - 0.5)
    return F.least(F.greatest(place, F.lit(0)), F.lit(nodes - 1)).cast("int")


def ecdf_rank(df: DataFrame, value: str, order: list, keys: list[str]) -> DataFrame:
    """How many rows of the key come after each in ascending order, ties by `order`."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    return df.withColumn("above", F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(w))


def coverage(df: DataFrame, keys: list[str], event: str, kind: str) -> DataFrame:
    """Rows, distinct events, their share of all events, and the sorted kinds, per key."""
    total = df.agg(F.count_distinct(event).alias("_t"))
    per = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(event).alias("n_events"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"))
    return per.join(F.broadcast(total)).withColumn("share", F.col("n_events") / F.col("_t")).drop("_t")


def overlapping_density(df: DataFrame, value: str, first: float, last: float, step: float, half: float, keys: list[str]) -> DataFrame:
    """How many values lie in [a - half, a + half) around every step a from first to last, zeros left out.

    Every value finds the few steps whose window holds it, so nothing is compared with all steps.
    """
    low = F.greatest(F.floor((F.col(value) - half - first) / step) + 1, F.lit(0))
    high = F.least(F.floor((F.col(value) + half - first) / step), F.floor(F.lit((last - first) / step)))
    rows = df.withColumn("_s", F.when(low <= high, F.sequence(low, high))).select(*keys, F.explode("_s").alias("_k"))
    return rows.groupBy(*keys, (first + step * F.col("_k")).alias("place")).agg(F.count("*").alias("n"))
