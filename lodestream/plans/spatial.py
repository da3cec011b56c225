"""Range, nearest, radius and clustering queries. customer and supplier stand for wells and templates:
the balance is a depth, the nation a place."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import clustering as C
from lodestream.operators import ranges as R
from lodestream.operators import timeseries as T
from lodestream.operators.components import components
from lodestream.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Register a query under its own name with its DuckDB counterpart, if SQL has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal AS a, s_acctbal + 150 AS b FROM supplier)
SELECT c_custkey, s_suppkey FROM customer JOIN s ON c_acctbal >= a AND c_acctbal < b""")
def interval_join(spark, sf):
    """Channel depths in well segments"""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_acctbal") + 150).alias("b"))
    return R.interval_join(table(spark, sf, "customer"), s, "c_acctbal", "a", "b", 200.0).select("c_custkey", "s_suppkey")


@query("""
SELECT p.event_id AS pick, count(*) AS n, round(max(e.value), 6) AS peak FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts - INTERVAL 10 MINUTE AND e.ts < p.ts + INTERVAL 20 MINUTE
WHERE p.event_type = 'purchase' OR p.event_type = 'error' GROUP BY 1""")
def window_join(spark, sf):
    """Samples in a window around each pick"""
    e = table(spark, sf, "events").select("user_id", "value", (T.micros("ts") / 1e6).alias("t"))
    p = table(spark, sf, "events").where("event_type in ('purchase', 'error')").withColumn("s", T.micros("ts") / 1e6)
    spans = p.select("user_id", F.col("event_id").alias("pick"), (F.col("s") - 600).alias("a"), (F.col("s") + 1200).alias("b"))
    return R.interval_join(e, spans, "t", "a", "b", 1800.0, ["user_id"]).groupBy("pick").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("peak"))


@query("""
WITH r AS (SELECT user_id, value, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'view')
SELECT l.event_id, arg_min(r.event_id, (abs(l.t - r.t), r.t, r.event_id)) AS partner FROM l LEFT JOIN r USING (user_id) GROUP BY 1""")
def nearest_asof(spark, sf):
    """The nearest in time, before or after"""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", T.micros("ts").alias("t"))
    l, r = e.where("event_type <> 'view'").drop("event_type"), e.where("event_type = 'view'").select("event_id", "user_id", "t")
    return R.nearest(l, r, "t", ["user_id"], ["event_id"]).select("event_id", F.col("nearest.event_id").alias("partner"))


@query("""
SELECT c_custkey, arg_min(s_suppkey, (abs(c_acctbal - s_acctbal), s_acctbal, s_suppkey)) AS snapped FROM customer JOIN supplier ON s_nationkey % 5 = c_nationkey % 5 GROUP BY 1""")
def nearest_snap(spark, sf):
    """Stations to well samples"""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("well"), F.col("c_acctbal").alias("depth"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("well"), F.col("s_acctbal").alias("depth"))
    return R.nearest(c, s, "depth", ["well"], ["s_suppkey"]).where("nearest is not null").select("c_custkey", F.col("nearest.s_suppkey").alias("snapped"))


@query("""
SELECT r.radius, count(*) AS n FROM customer a, supplier b, (SELECT unnest([50.0::DOUBLE, 100.0, 200.0]) AS radius) r
WHERE sqrt(pow(c_acctbal - s_acctbal, 2) + pow((c_nationkey - s_nationkey) * 20, 2)) <= r.radius GROUP BY 1""")
def radius_join(spark, sf):
    """Several radii at once, on cells of places with the number of their rows"""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 20).cast("double").alias("y"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 20).cast("double").alias("y"))
    c, s = (t.groupBy("x", "y").agg(F.count("*").alias("rows")) for t in (c, s))
    return R.radius_counts(c, s, ["x", "y"], [50.0, 100.0, 200.0])


@query("""
WITH d AS (SELECT a.c_custkey AS id, b.c_custkey AS other, sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow((a.c_nationkey - b.c_nationkey) * 20, 2)) AS distance FROM customer a, customer b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank FROM d)
SELECT id, rank, other, round(distance, 6) AS distance FROM r WHERE rank <= 4""")
def k_nearest(spark, sf):
    """Four nearest, the row itself included"""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 20).cast("double").alias("y"))
    return R.k_nearest(c, "id", ["x", "y"], 4, 60.0).withColumn("distance", F.round("distance", 6))


@query("""
SELECT event_id FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 120000000
  AND pow(a.value - b.value, 2) + pow(a.user_id - b.user_id, 2) <= 100)""")
def space_time_semi(spark, sf):
    """J14"""
    e = table(spark, sf, "events")
    return R.space_time_semi(e, "event_id", T.micros("ts") / 1e6, ["value", "user_id"], 120.0, 10.0).select("event_id")


@query("""
WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 120),
c AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 3),
e AS (SELECT p.a, p.b FROM p JOIN c x ON x.a = p.a JOIN c y ON y.a = p.b),
o AS (SELECT a AS id, s_acctbal AS v FROM c JOIN supplier ON s_suppkey = a),
k AS (SELECT id, min(id) OVER (PARTITION BY g) AS cluster FROM (SELECT id, v, sum(f) OVER (ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT id, v, CASE WHEN v - lag(v) OVER (ORDER BY v, id) <= 120 THEN 0 ELSE 1 END AS f FROM o)))
SELECT s_suppkey, arg_min(cluster, (p.a <> p.b, p.b)) AS cluster, s_suppkey IN (SELECT a FROM c) AS core
FROM supplier LEFT JOIN (p JOIN k ON k.id = p.b) ON p.a = s_suppkey GROUP BY s_suppkey""")
def dbscan(spark, sf):
    """In one dimension, where runs of core rows are the clusters"""
    return C.dbscan(table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], 120.0, 3)


@query("""
WITH RECURSIVE g AS (SELECT c_custkey AS id, (c_custkey * 7919) % 18001 / 100.0::DOUBLE - 90 AS lat, (c_custkey * 104729) % 36000 / 100.0::DOUBLE - 180 AS lon FROM customer),
p AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON abs(a.lat - b.lat) <= 4 AND 2 * 6371 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2
  + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 400),
c AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 3),
e AS (SELECT p.a, p.b FROM p JOIN c x ON x.a = p.a JOIN c y ON y.a = p.b),
r AS (SELECT a AS id, a AS seen FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT id, min(seen) AS cluster FROM r GROUP BY id)
SELECT g.id AS c_custkey, arg_min(cluster, (p.a <> p.b, p.b)) AS cluster, g.id IN (SELECT a FROM c) AS core
FROM g LEFT JOIN (p JOIN k ON k.id = p.b) ON p.a = g.id GROUP BY g.id""")
def dbscan_on_the_globe(spark, sf):
    """Clusters of places all over the globe, the poles and the date line among them"""
    key = F.col("c_custkey")
    places = table(spark, sf, "customer").select("c_custkey", ((key * 7919) % 18001 / 100 - 90).alias("lat"), ((key * 104729) % 36000 / 100 - 180).alias("lon"))
    return C.dbscan_geodesic(places, "c_custkey", "lat", "lon", 400.0, 3)


@query("""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.e, b.e) AS d FROM n a JOIN n b ON a.vec_id < b.vec_id)
SELECT a, b, round(d, 4) AS d FROM p WHERE isfinite(d)""")
def pairwise_cosine(spark, sf):
    """Cosine distances of all pairs, by blocks"""
    pairs = C.cosine_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return pairs.withColumn("d", F.floor(F.col("d") * 10_000 + 0.5) / 10_000)  # to four digits; F.round makes a decimal of every value


@query("""
WITH RECURSIVE n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.e, b.e) <= 0.7),
r AS (SELECT a AS node, a AS seen FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen)
SELECT node, min(seen) AS root FROM r GROUP BY node""")
def single_linkage(spark, sf):
    """Over all vectors, from a spanning forest of the near pairs of every two blocks"""
    return components(C.cosine_links(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.7))


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list({'c': l_linenumber, 'd': round_even(l_discount, 2)})) AS shape FROM lineitem GROUP BY 1)
SELECT min(l_orderkey) AS l_orderkey, count(*) AS members, len(shape) AS channels FROM s GROUP BY shape""")
def delay_groups(spark, sf):
    """C07"""
    return C.group_by_delays(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_discount")


@query("""
WITH m AS (SELECT l_returnflag, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_quantity, l_discount * 100) AS xy, covar_pop(l_discount * 100, l_discount * 100) AS yy,
  covar_pop(l_quantity, l_extendedprice / 1000) AS xz, covar_pop(l_discount * 100, l_extendedprice / 1000) AS yz, avg(l_quantity) AS mx, avg(l_discount * 100) AS my, avg(l_extendedprice / 1000) AS mz FROM lineitem GROUP BY 1),
p AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m)
SELECT l_returnflag, round(a, 5) AS a, round(b, 5) AS b, round(mz - a * mx - b * my, 3) AS c, round(degrees(atan(sqrt(a * a + b * b))), 3) AS dip FROM p""")
def plane_fit(spark, sf):
    """C09"""
    l = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))
    p = C.plane(l, ["l_returnflag"], "x", "y", "z")
    return p.select("l_returnflag", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), F.round("c", 3).alias("c"), F.round("dip", 3).alias("dip"))


@query(None)
def kmeans(spark, sf):
    """C05"""
    return C.kmeans(table(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], 4)
