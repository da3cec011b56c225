"""Geometry, projection, magnitude and stress formulas, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def euclid(a: list[Column], b: list[Column]) -> Column:
    """F31"""
    return F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(a, b)), F.lit(0.0)))


def flat_distance_km(lat1: Column, lon1: Column, z1: Column, lat2: Column, lon2: Column, z2: Column, radius: float = 6371.009) -> Column:
    """F32: equirectangular distance with depth."""
    mean = F.radians((lat1 + lat2) / 2)
    x, y = F.radians(lon1 - lon2) * F.cos(mean) * radius, F.radians(lat1 - lat2) * radius
    return F.sqrt(x * x + y * y + F.pow(z1 - z2, 2))


_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series of the transverse Mercator projection in powers of the third flattening, to the third order.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """easting and northing in metres, by the series, to better than a centimetre within a zone."""
    p, d = F.radians(lat), F.radians(lon - (6 * zone - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(p)) - c * F.atanh(c * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    return 500_000 + _K0 * _RECT * x, (10_000_000 if south else 0) + _K0 * _RECT * y


def from_utm(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """latitude and longitude in degrees."""
    xi, eta = (north - (10_000_000 if south else 0)) / (_K0 * _RECT), (east - 500_000) / (_K0 * _RECT)
    x = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BACK, 1))
    y = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BACK, 1))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_LATITUDE, 1))
    return F.degrees(lat), 6 * zone - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def plane_normal(strike: Column, dip: Column) -> list[Column]:
    """the upward unit normal (east, north, up) of a plane by strike and dip, in degrees."""
    s, d = F.radians(strike), F.radians(dip)
    return [F.sin(d) * F.cos(s), -F.sin(d) * F.sin(s), F.cos(d)]


def moment(mw: Column) -> Column:
    """10^(1.5 (M + 9))"""
    return F.pow(F.lit(10.0), 1.5 * (mw + 9))


def magnitude(m0: Column) -> Column:
    """F36, inverse"""
    return F.log10(m0) / 1.5 - 9


def linear_magnitude(x: Column, slope: float, offset: float, inverse: bool = False) -> Column:
    """F37"""
    return (x - offset) / slope if inverse else x * slope + offset


def moment_from_local(ml: Column, form: str = "majer") -> Column:
    """the two published relations; they differ from F36 by constants (trap T-11)."""
    if form == "majer":
        return F.pow(F.lit(10.0), 17.27 + 0.77 * ml) * 1e-7
    return F.pow(F.lit(10.0), 1.5 * ((ml - 0.73) / 0.88) + 9)


def back_azimuth(east: Column, north: Column) -> Column:
    """degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def incidence(horizontal: Column, depth: Column) -> Column:
    """F54"""
    return F.degrees(F.atan2(horizontal, depth))


def rotate(vector: list[Column], azimuth: Column, plunge: Column) -> list[Column]:
    """A vector turned about the vertical by azimuth, then about its new first axis by plunge, in degrees."""
    a, p = F.radians(azimuth), F.radians(plunge)
    x, y, z = vector
    u, v = x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)
    return [u, v * F.cos(p) - z * F.sin(p), v * F.sin(p) + z * F.cos(p)]


def resolved_stress(normal: list[Column], principal: tuple[float, float, float], pore: float) -> tuple[Column, Column]:
    """Effective normal and shear stress on a plane, principal stresses along east, north and up."""
    push = [n * s for n, s in zip(normal, principal)]
    across = sum((t * n for t, n in zip(push, normal)), F.lit(0.0))
    square = sum((t * t for t in push), F.lit(0.0))
    return across - pore, F.sqrt(F.greatest(square - across * across, F.lit(0.0)))


def interpolate_clamped(points: DataFrame, survey: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """F41, F43b, X-style survey lookup: values at `at`, linear between survey rows, held at the ends."""
    s = survey.select(*keys, at, *values, F.lit(None).cast("long").alias("_id"))
    p = points.withColumn("_id", F.monotonically_increasing_id())
    rows = s.unionByName(p.select(*keys, at, *[F.lit(None).cast("double").alias(v) for v in values], "_id"))
    w = Window.partitionBy(*keys).orderBy(at, F.col("_id").isNotNull())
    known = F.when(F.col("_id").isNull(), F.struct(at, *values))
    lo = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*keys).orderBy(F.desc(at), F.col("_id").isNull())
    hi = F.last(known, True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_lo", lo).withColumn("_hi", hi).where("_id is not null")
    share = (F.col(at) - F.col(f"_lo.{at}")) / F.nullif(F.col(f"_hi.{at}") - F.col(f"_lo.{at}"), F.lit(0.0))

    def value(v):
        a, b = F.col(f"_lo.{v}"), F.col(f"_hi.{v}")
        return F.when(F.col("_lo").isNull(), b).when(F.col("_hi").isNull(), a).otherwise(a + (b - a) * F.coalesce(share, F.lit(0.0)))

    return rows.select(*keys, at, *[value(v).alias(v) for v in values])


def minimum_curvature(survey: DataFrame, keys: list[str], md: str, inc: str, azi: str) -> DataFrame:
    """East, north and vertical depth along a well by the minimum-curvature method, angles in degrees."""
    w = Window.partitionBy(*keys).orderBy(md)
    i1, i2 = F.radians(F.lag(inc).over(w)), F.radians(inc)
    a1, a2 = F.radians(F.lag(azi).over(w)), F.radians(azi)
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(i2 - i1) - F.sin(i1) * F.sin(i2) * (1 - F.cos(a2 - a1)))))
    ratio = F.when(F.abs(bend) < 1e-9, 1.0).otherwise(2 / bend * F.tan(bend / 2))
    half = (F.col(md) - F.lag(md).over(w)) / 2 * ratio
    steps = {"east": half * (F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2)), "north": half * (F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2)), "tvd": half * (F.cos(i1) + F.cos(i2))}
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    staged = survey.select("*", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in steps.items()])
    return staged.select(*survey.columns, *[F.sum(n).over(upto).alias(n) for n in steps])
