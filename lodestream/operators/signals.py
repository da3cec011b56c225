"""Operators on array columns: waveforms are rows, and groups of them stations or clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(df: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """Element-wise mean and sum of the arrays of a key, by position, so that partial sums meet."""
    x = df.select(*keys, F.posexplode(samples).alias("i", "v"))
    per = x.groupBy(*keys, "i").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"), F.count("v").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "mean", "total")))
    return per.groupBy(*keys).agg(ordered.alias("a"), F.max("n").alias("traces")).select(
        *keys, "traces", F.col("a.mean").alias("mean"), F.col("a.total").alias("total")
    )


def taper(samples: str | Column, share: float) -> Column:
    """Samples under a cosine window, in column operations."""
    a = F.col(samples) if isinstance(samples, str) else samples
    n = F.size(a)
    k = F.floor(F.lit(share) * n / 2)

    def weight(i):
        edge = F.least(i, n - 1 - i)
        return F.when(edge < k, 0.5 * (1 - F.cos(np.pi * edge / k))).otherwise(1.0)

    return F.transform(a, lambda x, i: x.cast("double") * weight(i))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def correlation(a: Column, b: Column) -> Column:
    """Zero-lag Pearson correlation of two arrays of one length."""
    n = F.size(a)
    one = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    sa, sb = one(a), one(b)
    spread = F.sqrt((dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n))
    return (dot(a, b) - sa * sb / n) / F.nullif(spread, F.lit(0.0))


def amplitude_ratio(a: Column, b: Column) -> Column:
    """Relative amplitude of two aligned traces from their 2 x 2 product matrix."""
    xx, yy, xy = dot(a, a), dot(b, b), dot(a, b)
    top = (xx + yy + F.sqrt(F.pow(xx - yy, 2) + 4 * xy * xy)) / 2
    return (top - xx) / F.nullif(xy, F.lit(0.0))


def sign_weights(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The signed agreement of two weights per key: sum(ab) / sum(|ab|)."""
    product = F.col(a) * F.col(b)
    return df.groupBy(*keys).agg((F.sum(product) / F.nullif(F.sum(F.abs(product)), F.lit(0.0))).alias("resolved"))
