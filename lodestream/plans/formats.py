"""Queries of further formats, streams and array operators: driver tables are written in a format and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestream.functions import times
from lodestream.operators import arrays as A
from lodestream.session import table
from lodestream.sources import binary as B
from lodestream.sources import readers, writers
from lodestream.streaming import ingest

from .io import _path

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its own name with its DuckDB counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _documents(lines, key, path: str) -> None:
    """A document with one root per value of `key`, a file each, of the elements in column `value`; keys hold what one file should."""
    grouped = lines.groupBy(key.alias("part")).agg(F.collect_list("value").alias("v"))
    grouped.select("part", F.concat(F.lit("<all>"), F.array_join("v", ""), F.lit("</all>")).alias("value")).write.partitionBy("part").text(path)


def _text(*columns) -> F.Column:
    return F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in columns])


@query("SELECT s_suppkey AS id, s_acctbal AS pressure, NULL::DOUBLE AS flow FROM supplier")
def csv_with_units(spark, sf):
    """A byte-order mark, two rows of units, trailing commas, a column that isn't there"""
    path = _path(spark, "units")
    head = spark.createDataFrame([("﻿id, pressure,",), ("-,psi,",), ("count,gauge,",)], "value string").coalesce(1)
    body = table(spark, sf, "supplier").select(_text(F.col("s_suppkey").cast("string"), ", ", F.col("s_acctbal").cast("string"), ",").alias("value"))
    head.union(body).coalesce(1).write.text(path)
    return readers.csv_with_units(spark, path, {"id": "long", "pressure": "double", "flow": "double"})


@query("SELECT event_id, ts + INTERVAL 7 HOUR AS ts, value * 6894.757 AS pascal FROM events")
def local_time_scan(spark, sf):
    """Wall times seven hours west of UTC, blank-separated, units converted, files of two folders"""
    paths = [_path(spark, "wall") for _ in range(2)]
    e = table(spark, sf, "events").select(F.col("event_id").alias("Event"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Wall Time"), F.col("value").alias("PSI"), F.lit("x").alias("unused"))
    for i, path in enumerate(paths):
        e.where(F.col("Event") % 2 == i).write.option("header", True).option("sep", "\t").csv(path)
    rows = readers.csv(spark, paths, {"event_id": ("event",), "ts": ("wall time",), "value": ("psi",)}, {"event_id": "long", "ts": "timestamp_ntz", "value": "double"}, ("event_id",), "\t")
    return rows.select("event_id", times.local_to_utc(F.col("ts"), "Etc/GMT+7").alias("ts"), readers.scaled(rows, "value", 6894.757).alias("pascal"))


@query("""
WITH e AS (SELECT event_id, TIMESTAMP '2024-05-01' + to_microseconds((event_id % 86400) * 1000000) AS ts FROM events)
SELECT kind, count(*) AS n, min(event_id) AS low, max(ts) AS top FROM (SELECT 'text' AS kind, * FROM e UNION ALL SELECT 'fraction', * FROM e UNION ALL SELECT 'serial', * FROM e) GROUP BY kind""")
def voted_times(spark, sf):
    """One column as month/day/year text, day fractions or spreadsheet days, told apart by a vote"""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 86400).alias("s"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-05-01 00:00:00")) + F.col("s"))
    found = None
    for kind, text in (("text", F.date_format(at, "M/d/yy H:m:s")), ("fraction", (F.col("s") / 86400).cast("string")), ("serial", (45413 + F.col("s") / 86400).cast("string"))):
        part = times.parse_injection_times(e.select(F.lit(kind).alias("kind"), "event_id", text.alias("t")), "t", "2024-05-01")
        part = part.withColumn("ts", F.timestamp_seconds(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).cast("timestamp_ntz"))
        found = part if found is None else found.union(part)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("ts").alias("top"))


@query("""
WITH w AS (SELECT user_id, max(date_trunc('second', ts)) AS ts, list({'i': event_id, 'v': value} ORDER BY event_id) AS l FROM events GROUP BY 1)
SELECT ts, 20.5::DOUBLE AS reference, user_id::DOUBLE AS probe1, u.r AS row, round(l[u.r + 1].i::DOUBLE, 1) AS depth, round(l[u.r + 1].v, 4) AS temperature
FROM w, (SELECT unnest(range(10000))::INT AS r) u WHERE u.r < len(l)""")
def xml_frame_scan(spark, sf):
    """Log frames with reference and probe temperatures and a line of numbers for every depth"""
    path = _path(spark, "frames")
    e = table(spark, sf, "events")
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    data = F.array_join(F.transform("l", lambda r: F.concat(F.lit("<data>"), r["event_id"].cast("string"), F.lit(", "), r["value"].cast("string"), F.lit("</data>"))), "")
    w = e.groupBy("user_id").agg(F.date_format(F.date_trunc("second", F.max("ts")), "yyyy-MM-dd'T'HH:mm:ss").alias("t"), rows.alias("l"))
    frames = w.select("user_id", _text("<log><endDateTimeIndex>", F.col("t"), "</endDateTimeIndex><logData>", data, "</logData><customData><referenceTemperature>20.5</referenceTemperature><probe1Temperature>", F.col("user_id").cast("string"), "</probe1Temperature></customData></log>").alias("value"))
    _documents(frames, F.expr("user_id div 40"), path)
    f = readers.xml_frames(spark, path, 2)
    return f.select("ts", "reference", "probe1", "row", F.round("v0", 1).alias("depth"), F.round("v1", 4).alias("temperature"))


@query("""
SELECT date_trunc('second', min(ts) OVER (PARTITION BY user_id % 8)) + INTERVAL 30 SECOND AS ts, event_id::DOUBLE AS distance, round(value, 4) AS value, round(value / 2, 4) AS width
FROM events WHERE user_id % 8 BETWEEN 2 AND 5""")
def json_frame_scan(spark, sf):
    """Fiber frames of the files between two stamps, both excluded, at the middle of each measurement"""
    path = _path(spark, "fiber")
    e = table(spark, sf, "events").withColumn("part", F.col("user_id") % 8)
    point = F.struct(F.col("event_id").cast("double").alias("distance"), F.struct(F.col("value").alias("value"), (F.col("value") / 2).alias("width"), F.lit(1.0).alias("gain")).alias("peak1"))
    begins = e.groupBy("part").agg(F.date_trunc("second", F.min("ts")).alias("t"))
    w = e.groupBy("part", F.expr("event_id div 2000").alias("file")).agg(F.collect_list(point).alias("points")).join(begins, "part")  # a bounded file
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    info = F.struct(stamp(F.col("t")).alias("meas_start_time"), stamp(F.col("t") + F.expr("INTERVAL 1 MINUTE")).alias("meas_end_time"))
    w.select(F.format_string("2024010%d", "part").alias("stamp"), F.to_json(F.struct(info.alias("info"), "points")).alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("stamp").text(path)
    chosen = readers.files_between([f"{path}/stamp=2024010{i}" for i in range(8)], r"stamp=(\d+)", "20240101", "20240106")
    f = readers.json_frames(spark, chosen)
    return f.select("ts", "distance", F.round("value", 4).alias("value"), F.round("width", 4).alias("width"))


@query("""
SELECT l_orderkey::DOUBLE AS id, l_quantity AS x, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_extendedprice END AS y,
  CASE WHEN l_linenumber = 4 THEN 0.2 ELSE l_linenumber END::DOUBLE AS mag, CASE WHEN l_linenumber = 3 THEN NULL ELSE 7.0::DOUBLE END AS rcc, NULL::DOUBLE AS cid
FROM lineitem WHERE l_linenumber <> 5""")
def relocation_scan(spark, sf):
    """Event rows of 17 tokens or more; stars and -9 are null, a magnitude of 0 counts as 0.2"""
    path = _path(spark, "reloc")
    n = F.col("l_linenumber")
    y = F.when(n == 2, F.lit("*****")).otherwise(F.col("l_extendedprice").cast("string"))
    mag, rcc = F.when(n == 4, F.lit("0.0")).otherwise(n.cast("string")), F.when(n == 3, F.lit("-9")).otherwise(F.lit("7"))
    line = F.concat_ws("  ", F.col("l_orderkey"), F.col("l_quantity"), y, mag, rcc, F.when(n != 5, F.lit("1 " * 12)))
    table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    return readers.relocation_table(spark, path, ["id", "x", "y", "mag", "rcc", *[f"f{i}" for i in range(12)], "cid"]).select("id", "x", "y", "mag", "rcc", "cid")


@query("""
SELECT c_custkey, g AS "group", CASE WHEN g = 1 THEN c_acctbal ELSE c_acctbal * 2 END AS Tp, CASE WHEN g = 1 THEN c_nationkey::DOUBLE END AS dp
FROM customer, (VALUES (1), (2)) v(g)""")
def group_column_scan(spark, sf):
    """Columns named by group and field as rows"""
    path = _path(spark, "groups")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("Group 1 Tp"), F.col("c_nationkey").alias("Group 1 dp"), (F.col("c_acctbal") * 2).alias("Group 2 Tp"))
    writers.csv(c, path, ["c_custkey"])
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(F.col("c_custkey").cast("long").alias("c_custkey"), *[F.col(f"`{n}`").cast("double").alias(n) for n in raw.columns[1:]])
    return readers.group_columns(raw, r"Group (\d+) (\w+)", ["c_custkey"])


@query("SELECT p_partkey AS id, round(p_retailprice * 0.001, 6) AS metres, p_size::DOUBLE AS gauge FROM part")
def extensometer_scan(spark, sf):
    """Blank-separated numbers under a header line, scaled"""
    path = _path(spark, "dat")
    p = table(spark, sf, "part")
    p.select(F.concat_ws(" ", "p_partkey", "p_retailprice", "p_size").alias("value")).union(spark.createDataFrame([("TOA5 station",)], "value string")).write.text(path)
    v = readers.ascii_matrix(spark, path, 1, flip=False)
    return v.select(F.col("values")[0].cast("long").alias("id"), F.round(F.col("values")[1] * 0.001, 6).alias("metres"), F.col("values")[2].alias("gauge"))


@query("""
SELECT o_orderkey::VARCHAR AS event_id, o_orderdate::TIMESTAMP AS ts, -103.5::DOUBLE AS longitude, o_totalprice AS depth,
  CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / 100000, 3) END AS magnitude, (o_orderkey % 2)::INT AS n_picks, CASE WHEN o_orderkey % 2 = 1 THEN 'S1' END AS station FROM orders""")
def catalog_scan(spark, sf):
    """Catalog documents with a preferred origin, magnitudes that may lack and picks"""
    path = _path(spark, "catalog")
    o = table(spark, sf, "orders")
    t = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    key = F.col("o_orderkey").cast("string")
    mag = F.when(F.col("o_orderkey") % 3 != 0, _text("<magnitude><mag><value>", F.round(F.col("o_totalprice") / 100000, 3).cast("string"), "</value></mag></magnitude>")).otherwise("")
    pick = F.when(F.col("o_orderkey") % 2 == 1, _text("<pick><time><value>", t, '</value></time><waveformID stationCode="S1" channelCode="Z"/><phaseHint>P</phaseHint></pick>')).otherwise("")
    line = _text(
        '<event publicID="smi:a/', key, '"><preferredOriginID>b</preferredOriginID><origin publicID="a"><depth><value>-1</value></depth></origin><origin publicID="b"><time><value>', t,
        "</value></time><longitude><value>-103.5</value></longitude><depth><value>", F.col("o_totalprice").cast("string"), "</value></depth></origin>", mag, pick, "</event>",
    )
    _documents(o.select("o_orderkey", line.alias("value")), F.expr("o_orderkey div 4000"), path)
    e = B.catalog_events(spark, path)
    return e.select("event_id", "ts", "longitude", "depth", F.round("magnitude", 3).alias("magnitude"), F.size("picks").alias("n_picks"), F.get("picks", F.lit(0))["station"].alias("station"))


@query("""
SELECT TIMESTAMP '2024-01-02 03:04:00' + to_seconds(s_suppkey % 60) AS ts, s_acctbal AS depth, 0.01::DOUBLE AS rms, (s_suppkey % 90)::INT AS n_phases, s_name[-4:] AS station, 0.5::DOUBLE AS residual FROM supplier""")
def location_scan(spark, sf):
    """Location output documents, files of many events: origin, quality and phases"""
    path = _path(spark, "hyp")
    s = table(spark, sf, "supplier")
    head = F.format_string("GEOGRAPHIC  OT 2024 01 02  03 04 %d.0  Lat 44.1 Long -103.7 Depth %s\nQUALITY  Pmax 1 RMS 0.01 Nphs %d Gap 120.5\n", F.col("s_suppkey") % 60, F.col("s_acctbal").cast("string"), F.col("s_suppkey") % 90)
    phase = F.concat(F.substring("s_name", -4, 4), F.lit("   ?    ?    ? P      ? 20240102 0304    5.6 GAU  1  2  3  4  >  0.105  0.5\n"))
    s.select(_text("NLLOC \n", head, phase, "END_NLLOC").alias("value")).write.text(path)
    r = B.location_outputs(spark, path)
    return r.select("ts", "depth", "rms", "n_phases", F.get("phases", F.lit(0))["station"].alias("station"), F.get("phases", F.lit(0))["residual"].alias("residual"))


@query("SELECT TIMESTAMP '2024-03-01 10:00:00' + to_hours(r_regionkey) AS ts, 5 - r_regionkey AS place FROM region")
def header_time_scan(spark, sf):
    """The times of a header line, last first; cells that are no time are left out"""
    path = _path(spark, "times")
    hours = table(spark, sf, "region").agg(F.array_sort(F.collect_list("r_regionkey")).alias("h"))
    cells = F.array_join(F.transform("h", lambda h: F.format_string("2024-03-01 %d:00:00", h + 10)), "\t")
    hours.select(F.concat(F.lit("units\ndepth\t"), cells).alias("value")).write.text(path)
    found = B.header_times(spark, path, 1, "yyyy-MM-dd H:mm:ss")
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(found)], "ts timestamp_ntz, place long")


@query("SELECT user_id % 7 AS station, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events ORDER BY 1 LIMIT 2) AND user_id % 7 IN (1, 3) GROUP BY 1")
def archive_days(spark, sf):
    """An archive by day and station, two days and two stations of it"""
    path = _path(spark, "days")
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("day"), (F.col("user_id") % 7).cast("string").alias("station"), "value")
    writers.by_key(e, path, ["day", "station"])
    days = [r[0] for r in e.select("day").distinct().orderBy("day").limit(2).collect()]
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        g = B.day_partitions(spark, path, days, ["1", "3"]).groupBy(F.col("station").cast("long").alias("station"))
    finally:
        spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT s.s_suppkey AS well, count(*) AS n, round(sum((p_retailprice - 10 * s_suppkey) * 1.5), 3) AS along
FROM part JOIN supplier s ON p_retailprice >= 10 * s_suppkey AND p_retailprice < 10 * s_suppkey + 8 GROUP BY 1""")
def fiber_segments(spark, sf):
    """Channel depths on the well segments that hold them, stretched along the well"""
    frames = table(spark, sf, "part").select(F.col("p_retailprice").alias("depth"))
    segments = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("well"), (10.0 * F.col("s_suppkey")).alias("start"), (10.0 * F.col("s_suppkey") + 8).alias("stop"), F.lit(1.5).alias("stretch"))
    found = B.fiber_by_well(frames, segments)
    return found.groupBy("well").agg(F.count("*").alias("n"), F.round(F.sum("along"), 3).alias("along"))


@query("SELECT vec_id, s AS start, s - greatest(s - 2, 0) AS before, round(list_sum(list_transform(embedding[greatest(s - 2, 0) + 1 : least(s + 18, len(embedding))], lambda x: x::DOUBLE)), 4) AS total FROM embeddings, (SELECT unnest(range(0, 4096, 8))::INT AS s) WHERE s + 16 <= len(embedding)")
def overlapping_windows(spark, sf):
    """Windows of 16 samples, 8 apart, with two samples of their neighbours on either side"""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    w = A.overlapping_windows(e, "x", 16, 8, 2)
    return w.select("vec_id", "start", "before", F.round(F.aggregate("window", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("SELECT c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN round(avg(c_acctbal), 4) END AS mean, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ValueError: no data' END AS error FROM customer GROUP BY 1")
def work_per_key(spark, sf):
    """A function per key; the key that fails is reported and the others go on"""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        if part["c_mktsegment"].iloc[0] == "BUILDING":
            raise ValueError("no data")
        return pd.DataFrame({"c_mktsegment": part["c_mktsegment"].head(1), "mean": part["c_acctbal"].mean(), "error": None})

    out = A.per_item(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], work, "c_mktsegment string, mean double, error string", "error")
    return out.withColumn("mean", F.round("mean", 4))


@query("""
WITH g AS (SELECT DISTINCT (5 * (p_size // 5))::DOUBLE AS x, 1000.0::DOUBLE AS y FROM part),
p AS (SELECT p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y, p_partkey::DOUBLE AS v FROM part),
d AS (SELECT g.x, g.y, v, sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2) AS d FROM g JOIN p ON (g.x - p.x) ** 2 + (g.y - p.y) ** 2 <= 400)
SELECT x, y, round(sum(v / greatest(d, 1e-9) ** 2) / sum(1 / greatest(d, 1e-9) ** 2), 3) AS v, count(*) AS n FROM d GROUP BY x, y""")
def scattered_to_grid(spark, sf):
    """Inverse-distance means of scattered points at grid nodes"""
    p = table(spark, sf, "part")
    grid = p.select((5 * F.floor(F.col("p_size") / 5)).cast("double").alias("x")).distinct().withColumn("y", F.lit(1000.0))
    points = p.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), F.col("p_partkey").cast("double").alias("v"))
    return A.interpolate_scattered(points, grid, ["x", "y"], "v", 20.0).select("x", "y", F.round("v", 3).alias("v"), "n")


@query("""
WITH c AS (SELECT c_custkey, least(floor((c_acctbal + 1000) / 11000 * 8), 7)::INT AS i, least(floor(c_nationkey / 25 * 8), 7)::INT AS j, c_acctbal BETWEEN -1000 AND 10000 AS inside FROM customer)
SELECT c_custkey, CASE WHEN inside THEN (i // 4 + 2 * (j // 4))::VARCHAR || (i // 2 % 2 + 2 * (j // 2 % 2))::VARCHAR || (i % 2 + 2 * (j % 2))::VARCHAR END AS cell FROM c""")
def quadtree(spark, sf):
    """The cell path of places in a box"""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", A.quadtree_cells(F.col("c_acctbal"), F.col("c_nationkey"), (-1000, 0, 10000, 25), 3).alias("cell"))


@query("SELECT false AS same, true AS other_size, true AS fewer, count(*) AS files FROM supplier")
def manifest_changes(spark, sf):
    """A listing against the manifest of the last run: the same, a file of another size, a file less"""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.col("s_suppkey").alias("size"))
    other = s.withColumn("size", F.when(F.col("size") == 1, 0).otherwise(F.col("size")))
    found = (ingest.changed(s, s), ingest.changed(other, s), ingest.changed(s.where("size > 1"), s), s.count())
    return spark.createDataFrame([found], "same boolean, other_size boolean, fewer boolean, files long")


@query("SELECT count(*) AS n, round(sum(value), 3) AS total, 1::BIGINT AS failed, true AS named FROM events WHERE user_id % 4 <> 2")
def stream_goes_on(spark, sf):
    """Batches are checked and appended; the one that fails is logged and the loop goes on"""
    source, out, check, log = (_path(spark, n) for n in ("arrivals", "appended", "progress", "failed"))
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("part"), "value")
    for part in range(4):
        e.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.file_stream(spark, source, e.schema, pattern="*.parquet", files_at_once=1)
    ingest.each_batch(stream, check, lambda b: b.where("part = 2").isEmpty(), lambda b, n: b.write.mode("append").parquet(out), log)
    failed = spark.read.parquet(log).agg(F.count("*").alias("failed"), F.bool_and(F.contains("error", F.lit("failed its check"))).alias("named"))
    kept = spark.read.parquet(out).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return kept.withColumn("k", F.lit(1)).join(failed.withColumn("k", F.lit(1)), "k").drop("k")
