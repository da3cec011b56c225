"""Scalar queries over pages, documents, events and the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import geo as G
from lodestream.functions import text as X
from lodestream.functions import times as D
from lodestream.operators import ranges as R
from lodestream.operators import timeseries as T
from lodestream.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its own name with its DuckDB counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


@query("""
SELECT p_partkey, nullif(trim(p_name), '') AS name, try_cast(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INT) AS stage, split_part(replace(p_type, ' ', '-'), '-', 1) AS field,
  nullif(regexp_extract(p_brand, '^([a-zA-Z]+)', 1), '') AS letters FROM part""")
def text_parts(spark, sf):
    """F01, F02, F05, F07, F14"""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", X.clean_text(F.col("p_name")).alias("name"), X.first_integer(F.col("p_brand")).alias("stage"),
        X.prefix(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("field"), X.capture(F.col("p_brand"), "^([a-zA-Z]+)").alias("letters"),
    )


@query("""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS canonical,
  regexp_extract(url, '[^/]*$') AS tail, nullif(regexp_extract(url, '//(?:www\\.|m\\.)?([a-z]+)', 1), '') AS host FROM pages""")
def canonical_names(spark, sf):
    """F03, F04, F06, F08, F09, F10"""
    u = F.col("url")
    steps = [("^https?://", ""), ("[?#].*$", ""), ("/+$", "")]
    return table(spark, sf, "pages").select("page_id", X.replace_chain(u, steps).alias("canonical"), X.tail(u).alias("tail"), X.capture(u, r"//(?:www\.|m\.)?([a-z]+)").alias("host"))


@query("""
SELECT c_custkey, 'NW.' || c_mktsegment || '.' || coalesce(CASE WHEN c_nationkey > 12 THEN c_nationkey::VARCHAR END, '') || '.' || c_name AS seed,
  CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'B' WHEN 'automobile' THEN 'A' WHEN 'machinery' THEN 'M' WHEN 'household' THEN 'H' WHEN 'furniture' THEN 'F' END AS code FROM customer""")
def identifiers(spark, sf):
    """F11, F12, F49"""
    names = {"building": "B", "automobile": "A", "machinery": "M", "household": "H", "furniture": "F"}
    location = F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("string"))
    seed = X.seed_id(F.lit("NW"), F.col("c_mktsegment"), location, F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", seed.alias("seed"), X.lookup(F.col("c_mktsegment"), names).alias("code"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, 'v' || json_extract_string(props, '$.k') AS tag FROM events")
def json_fields(spark, sf):
    """F13, F50"""
    k = F.from_json("props", "k INT")["k"]
    tag = X.key_values(F.concat(F.lit("k: v"), k.cast("string"), F.lit("; x: y: z")))["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), tag.alias("tag"))


@query("""
SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, (isodow(o_orderdate) - 1)::INT AS dow, strftime(o_orderdate, '%Y-%m') AS ym,
  round(epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 719529, 6) AS datenum, o_orderdate + INTERVAL 0 DAY AS back, o_orderdate::DATE - (SELECT min(o_orderdate)::DATE FROM orders) AS elapsed FROM orders""")
def time_parts(spark, sf):
    """F21, F25, F29"""
    t = F.col("o_orderdate")
    o = table(spark, sf, "orders")
    first = o.agg(F.min(T.micros("o_orderdate")).alias("f"))
    return o.join(F.broadcast(first)).select(
        "o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.weekday(t).alias("dow"), F.date_format(t, "yyyy-MM").alias("ym"),
        F.round(D.to_datenum(t), 6).alias("datenum"), D.from_datenum(D.to_datenum(t)).alias("back"),
        F.floor((T.micros("o_orderdate") - F.col("f")) / 86_400_000_000).alias("elapsed"),
    )


@query("""
SELECT o_orderkey, coalesce(try_strptime(s, '%d.%m.%Y %H:%M'), try_strptime(s, '%Y/%m/%d')) AS ts,
  CASE WHEN strptime(e, '%Y-%m-%d') < strptime(b, '%Y-%m-%d') THEN strptime(e, '%Y-%m-%d') + INTERVAL 1 DAY ELSE strptime(e, '%Y-%m-%d') END AS ended FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y %H:%M') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'bad' END AS s,
    strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate - INTERVAL (o_orderkey % 2) DAY, '%Y-%m-%d') AS e FROM orders)""")
def time_parsing(spark, sf):
    """F20, F24"""
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format(t, "dd.MM.yyyy HH:mm")).when(k == 1, F.date_format(t, "yyyy/MM/dd")).otherwise("bad")
    day = F.date_trunc("day", t).cast("timestamp_ntz")
    end = F.when(F.col("o_orderkey") % 2 == 1, day - F.expr("INTERVAL 1 DAY")).otherwise(day)
    return table(spark, sf, "orders").select("o_orderkey", D.parse_first(s, ["dd.MM.yyyy HH:mm", "yyyy/MM/dd"]).alias("ts"), D.roll_overnight(day, end).alias("ended"))


@query("""
SELECT event_id, make_timestamp(floor(y)::BIGINT, 1, 1, 0, 0, 0) + to_microseconds((round((y - floor(y)) * 365 * 86400))::BIGINT * 1000000) AS frac,
  (ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS utc, strptime(strftime(ts, '%Y%m%d%H%M'), '%Y%m%d%H%M') AS label FROM (SELECT event_id, ts, 2000 + (event_id % 1000) / 250.0::DOUBLE AS y FROM events)""")
def odd_calendars(spark, sf):
    """F23, F26, F27"""
    e = table(spark, sf, "events").withColumn("y", 2000 + (F.col("event_id") % 1000) / 250.0)
    label = F.concat(F.lit("epoch_"), F.date_format("ts", "yyyyMMddHHmm"), F.lit(".dat"))
    return e.select("event_id", D.fractional_year(F.col("y")).alias("frac"), D.local_to_utc(F.col("ts"), "Europe/Berlin").alias("utc"), D.epoch_label(label).alias("label"))


@query("""
SELECT event_type, unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events GROUP BY 1""")
def day_spine(spark, sf):
    """F28, X10"""
    ends = table(spark, sf, "events").groupBy("event_type").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return ends.select("event_type", D.days(F.col("a"), F.col("b")).alias("day"))


@query("""
WITH p AS (SELECT c_custkey, c_nationkey * 2.0::DOUBLE AS lat, c_acctbal / 100 AS lon FROM customer)
SELECT c_custkey, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - 20) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * pow(sin(radians(lon - 10) / 2), 2))), 4) AS km,
  round(sqrt(pow(radians(lon - 10) * cos(radians((lat + 20) / 2)) * 6371.009, 2) + pow(radians(lat - 20) * 6371.009, 2) + 25), 4) AS flat,
  round(CASE WHEN degrees(atan2(lon - 10, lat - 20)) < 0 THEN degrees(atan2(lon - 10, lat - 20)) + 360 ELSE degrees(atan2(lon - 10, lat - 20)) END, 4) AS azimuth,
  round(sqrt(pow(lat - 20, 2) + pow(lon - 10, 2)), 6) AS euclid FROM p""")
def distances(spark, sf):
    """F30, F31, F32, F54"""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") * 2.0).alias("lat"), (F.col("c_acctbal") / 100).alias("lon"))
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(10.0)
    return c.select(
        "c_custkey", F.round(R.haversine_km(a, b, lat, lon), 4).alias("km"), F.round(G.flat_distance_km(lat, lon, F.lit(5.0), a, b, F.lit(0.0)), 4).alias("flat"),
        F.round(G.back_azimuth(lon - b, lat - a), 4).alias("azimuth"), F.round(G.euclid([lat, lon], [a, b]), 6).alias("euclid"),
    )


@query("SELECT c_custkey, round(40 + c_nationkey / 10.0::DOUBLE, 6) AS lat, round(8 + c_acctbal / 5000, 6) AS lon FROM customer")
def utm_round_trip(spark, sf):
    """to the projected plane and back"""
    c = table(spark, sf, "customer")
    east, north = G.to_utm(40 + F.col("c_nationkey") / 10, 8 + F.col("c_acctbal") / 5000, 32)
    lat, lon = G.from_utm(F.col("e"), F.col("n"), 32)
    return c.withColumn("e", east).withColumn("n", north).select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("""
SELECT p_partkey, round(log10(pow(10, 1.5 * (m + 9))), 6) AS m0, round(m, 6) AS back, round(m * 0.88 + 0.73, 6) AS ml, round(log10(pow(10, 17.27 + 0.77 * m) * 1e-7), 6) AS majer,
  round(1.5 * ((m - 0.73) / 0.88) + 9, 6) AS local, round(m * 0.3048, 6) AS metres FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS m FROM part)""")
def magnitudes(spark, sf):
    """F36, F37, F38, F39, F45, F46, F52"""
    m = F.col("p_size") / 10.0
    return table(spark, sf, "part").select(
        "p_partkey", F.round(F.log10(G.moment(m)), 6).alias("m0"), F.round(G.magnitude(G.moment(m)), 6).alias("back"), F.round(G.linear_magnitude(m, 0.88, 0.73), 6).alias("ml"),
        F.round(F.log10(G.moment_from_local(m)), 6).alias("majer"), F.round(F.log10(G.moment_from_local(m, "linear")), 6).alias("local"), F.round(m * 0.3048, 6).alias("metres"),
    )


@query("""
WITH a AS (SELECT p_partkey, radians(p_size * 7) AS s, radians(p_size * 1.5) AS d FROM part),
n AS (SELECT *, sin(d) * cos(s) AS e, -sin(d) * sin(s) AS n, cos(d) AS u FROM a),
t AS (SELECT *, e * e * 30 + n * n * 20 + u * u * 25 AS across, pow(e * 30, 2) + pow(n * 20, 2) + pow(u * 25, 2) AS square FROM n)
SELECT p_partkey, round(e, 6) AS e, round(n, 6) AS n, round(u, 6) AS u, round(across - 5, 6) AS normal, round(sqrt(greatest(square - across * across, 0)), 4) AS shear FROM t""")
def fault_stress(spark, sf):
    """F35, F44b, C11"""
    v = G.plane_normal(F.col("p_size") * 7, F.col("p_size") * 1.5)
    across, shear = G.resolved_stress(v, (30.0, 20.0, 25.0), 5.0)
    return table(spark, sf, "part").select("p_partkey", *[F.round(c, 6).alias(x) for c, x in zip(v, "enu")], F.round(across, 6).alias("normal"), F.round(shear, 4).alias("shear"))


@query("""
WITH a AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y, 3.0::DOUBLE AS z, radians(p_size * 5) AS a, radians(p_size) AS p FROM part),
b AS (SELECT *, x * cos(a) - y * sin(a) AS u, x * sin(a) + y * cos(a) AS v FROM a)
SELECT p_partkey, round(u, 5) AS u, round(v * cos(p) - z * sin(p), 5) AS v, round(v * sin(p) + z * cos(p), 5) AS w FROM b""")
def rotate_vectors(spark, sf):
    """F44, G38"""
    s = F.col("p_size").cast("double")
    r = G.rotate([s, F.col("p_retailprice") / 100, F.lit(3.0)], s * 5, s)
    return table(spark, sf, "part").select("p_partkey", *[F.round(c, 5).alias(n) for c, n in zip(r, "uvw")])


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * 30.0::DOUBLE AS md FROM orders),
s AS (SELECT *, radians(o_orderkey % 60) AS i, radians((o_orderkey * 7) % 360) AS a FROM w),
l AS (SELECT *, lag(i) OVER k AS i1, lag(a) OVER k AS a1, md - lag(md) OVER k AS d FROM s WINDOW k AS (PARTITION BY o_custkey ORDER BY md)),
b AS (SELECT *, acos(greatest(-1, least(1, cos(i - i1) - sin(i1) * sin(i) * (1 - cos(a - a1))))) AS bend FROM l),
r AS (SELECT *, d / 2 * CASE WHEN abs(bend) < 1e-9 THEN 1 ELSE 2 / bend * tan(bend / 2) END AS h FROM b)
SELECT o_custkey, md, round(sum(coalesce(h * (sin(i1) * sin(a1) + sin(i) * sin(a)), 0)) OVER k, 4) AS east, round(sum(coalesce(h * (cos(i1) + cos(i)), 0)) OVER k, 4) AS tvd
FROM r WINDOW k AS (PARTITION BY o_custkey ORDER BY md ROWS UNBOUNDED PRECEDING)""")
def minimum_curvature(spark, sf):
    """F42"""
    from pyspark.sql import Window

    md = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) * F.lit(30.0)
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select("o_custkey", md.alias("md"), (k % 60).alias("inc"), ((k * 7) % 360).alias("azi"))
    return G.minimum_curvature(s, ["o_custkey"], "md", "inc", "azi").select("o_custkey", "md", F.round("east", 4).alias("east"), F.round("tvd", 4).alias("tvd"))


@query("""
WITH s AS (SELECT s_nationkey % 5 AS well, s_acctbal AS depth, avg(s_suppkey)::DOUBLE AS x FROM supplier GROUP BY ALL),
c AS (SELECT c_custkey, c_nationkey % 5 AS well, c_acctbal AS depth FROM customer),
j AS (SELECT c.*, max_by((s.depth, s.x), s.depth) FILTER (WHERE s.depth <= c.depth) AS lo, min_by((s.depth, s.x), s.depth) FILTER (WHERE s.depth >= c.depth) AS hi
  FROM c JOIN s USING (well) GROUP BY ALL)
SELECT well, depth, round(CASE WHEN lo IS NULL THEN hi[2] WHEN hi IS NULL OR hi[1] = lo[1] THEN lo[2] ELSE lo[2] + (hi[2] - lo[2]) * (depth - lo[1]) / (hi[1] - lo[1]) END, 4) AS x FROM j""")
def clamped_interpolation(spark, sf):
    """F41, F43b, F40"""
    s = table(spark, sf, "supplier").groupBy((F.col("s_nationkey") % 5).alias("well"), F.col("s_acctbal").alias("depth")).agg(F.avg("s_suppkey").alias("x"))
    c = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("well"), F.col("c_acctbal").alias("depth"))
    wells = s.select("well").distinct()
    return G.interpolate_clamped(c.join(wells, "well", "left_semi"), s, ["well"], "depth", ["x"]).withColumn("x", F.round("x", 4))


@query("""
SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 5) AS head, round(embedding[-1]::DOUBLE, 6) AS last,
  round(greatest(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 6) AS most, list_position(list_transform(embedding, lambda x: abs(x - 0.1::FLOAT)), list_min(list_transform(embedding, lambda x: abs(x - 0.1::FLOAT))))::BIGINT AS nearest FROM embeddings""")
def array_parts(spark, sf):
    """F47, F48, F51, S22"""
    e = F.col("embedding")
    head = F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double"))
    off = F.transform(e, lambda x: F.abs(x - F.lit(0.1).cast("float")))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.round(head, 5).alias("head"), F.round(F.reverse(e)[0].cast("double"), 6).alias("last"),
        F.round(F.greatest(e[0], e[1]).cast("double"), 6).alias("most"), F.array_position(off, F.array_min(off)).alias("nearest"),
    )


@query("SELECT i::INT AS i, round(pow(10, -2 + i * 0.25), 8) AS edge FROM range(13) r(i)")
def log_edges(spark, sf):
    """F53"""
    return spark.range(13).select(F.col("id").cast("int").alias("i"), F.round(F.pow(F.lit(10.0), -2 + F.col("id") * 0.25), 8).alias("edge"))
