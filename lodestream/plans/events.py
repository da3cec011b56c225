"""Catalog and inversion queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import events as E
from lodestream.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its own name with its DuckDB counterpart, if SQL has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query("""
SELECT c_custkey AS k, arg_min(o_orderkey, (abs(o_totalprice - c_acctbal * 20), o_orderkey)) FILTER (WHERE abs(o_totalprice - c_acctbal * 20) < 50000) AS matched
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def self_detections(spark, sf):
    """J24"""
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 20).alias("m"))
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("m"), "o_orderkey")
    return E.match_self_detections(t, d, "k", "m", 50_000.0, "o_orderkey")


@query("""
WITH s AS (SELECT s_nationkey AS well, s_suppkey AS depth, s_acctbal / 100 AS x, s_suppkey * 3.0::DOUBLE AS y, -s_suppkey * 1.0::DOUBLE AS z FROM supplier),
e AS (SELECT well, arg_min(x, depth) AS ax, arg_min(y, depth) AS ay, arg_min(z, depth) AS az, arg_max(x, depth) AS bx, arg_max(y, depth) AS by_, arg_max(z, depth) AS bz FROM s GROUP BY 1),
t AS (SELECT *, (0.1 * (5 - ax) + 0.3 * (20 - ay) + 0.9 * (-10 - az)) / nullif(CASE WHEN abs(0.1 * (bx - ax) + 0.3 * (by_ - ay) + 0.9 * (bz - az)) > 1e-6 THEN 0.1 * (bx - ax) + 0.3 * (by_ - ay) + 0.9 * (bz - az) END, 0) AS t FROM e),
h AS (SELECT well, ax + t * (bx - ax) AS hx, ay + t * (by_ - ay) AS hy, az + t * (bz - az) AS hz FROM t WHERE t IS NOT NULL)
SELECT well, round(hx, 3) AS hit_x, round(hy, 3) AS hit_y, round(hz, 3) AS hit_z, arg_min(depth, (sqrt(pow(x - hx, 2) + pow(y - hy, 2) + pow(z - hz, 2)), depth)) AS depth FROM s JOIN h USING (well) GROUP BY well, hx, hy, hz""")
def borehole_plane(spark, sf):
    """J18"""
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("well"), F.col("s_suppkey").alias("depth"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") * 3.0).alias("y"), (F.col("s_suppkey") * -1.0).alias("z")
    )
    out = E.borehole_plane(s, ["well"], "depth", ["x", "y", "z"], [5.0, 20.0, -10.0], [0.1, 0.3, 0.9])
    return out.select("well", *[F.round(f"hit_{c}", 3).alias(f"hit_{c}") for c in "xyz"], "depth")


@query("""
WITH d AS (SELECT p_partkey, 10 - p_size AS x, 50 - p_retailprice / 20 AS y, -5.0::DOUBLE AS z FROM part)
SELECT p_partkey, round(sqrt(x * x + y * y + z * z), 5) AS distance, round(CASE WHEN degrees(atan2(x, y)) < 0 THEN degrees(atan2(x, y)) + 360 ELSE degrees(atan2(x, y)) END, 5) AS azimuth, round(degrees(atan2(-z, sqrt(x * x + y * y))), 5) AS plunge FROM d""")
def excavation_front(spark, sf):
    """F43"""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"), F.lit(0.0).alias("z"))
    out = E.front_geometry(p, [10.0, 50.0, -5.0], ["x", "y", "z"])
    return out.select("p_partkey", *[F.round(c, 5).alias(c) for c in ("distance", "azimuth", "plunge")])


@query("""
WITH s AS (SELECT n_nationkey AS station, n_nationkey * 2.0::DOUBLE AS slat, n_nationkey * 3.0::DOUBLE AS slon FROM nation),
g AS (SELECT a.range::DOUBLE AS lat, b.range::DOUBLE AS lon, c.range * 5.0::DOUBLE AS depth FROM range(0, 41, 10) a, range(0, 61, 20) b, range(0, 4) c)
SELECT station, lat, lon, depth, round(sqrt(pow(2 * 6371 * asin(sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))), 2) + depth * depth) / 6, 4) AS time_s FROM s, g""")
def travel_time_grid(spark, sf):
    """Straight rays stand for the travel-time model"""
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("station"), (F.col("n_nationkey") * 2.0).alias("lat"), (F.col("n_nationkey") * 3.0).alias("lon"))
    return E.travel_time_grid(s, (0, 40, 10), (0, 60, 20), (0, 15, 5), 6.0).withColumn("time_s", F.round("time_s", 4))


@query("""
WITH t AS (SELECT event_type AS channel, (epoch_us(ts) // 60000000) AS minute, sum(value) AS v FROM events GROUP BY ALL),
l AS (SELECT event_type AS channel, n.range AS node, n.range * length(event_type) AS lag FROM (SELECT DISTINCT event_type FROM events), range(4) n)
SELECT node, minute - lag AS minute, round(sum(v), 4) AS brightness FROM t JOIN l USING (channel) GROUP BY ALL""")
def brightness_stack(spark, sf):
    """G06"""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("channel"), minute.alias("minute")).agg(F.sum("value").alias("v"))
    l = table(spark, sf, "events").select(F.col("event_type").alias("channel")).distinct().crossJoin(spark.range(4).withColumnRenamed("id", "node")).withColumn("lag", F.col("node") * F.length("channel"))
    return E.brightness(t, l, "channel", "minute", "v").withColumn("brightness", F.round("brightness", 4))


@query()
def damped_inversion(spark, sf):
    """Per return flag, prices from quantities of parts by station"""
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = l.groupBy("l_returnflag", "l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    total = F.sum("p").over(Window.partitionBy("l_returnflag", "l_orderkey"))
    return E.least_squares(rows.withColumn("d", total), ["l_returnflag"], "l_orderkey", "l_suppkey", "q", "d", 1.0)


@query("""
SELECT event_id, round(2 + 3 * exp(-0.05 * value), 6) AS pressure, round(3e10 * value, 0) AS linear, round(log10(0.4 * 1.5e9 * pow(value, 1.5)), 6) AS power FROM events WHERE value > 0""")
def curve_formulas(spark, sf):
    """F45, F46"""
    v = F.col("value")
    a, b = E.moment_bounds(v)
    return table(spark, sf, "events").where(v > 0).select("event_id", F.round(E.pressure_curve(v, 2, 3, 0.05), 6).alias("pressure"), F.round(a, 0).alias("linear"), F.round(F.log10(b), 6).alias("power"))
