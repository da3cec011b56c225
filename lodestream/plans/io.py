"""Reader, sink and stream queries: driver tables are written in a monitoring format and read back, or streamed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestream.operators import relational as R
from lodestream.session import table
from lodestream.sources import readers, writers
from lodestream.storage import checkpoint_folder
from lodestream.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its own name with its DuckDB counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _path(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey AS id, s_name AS well, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS depth, NULL::TIMESTAMP AS ts FROM supplier WHERE s_nationkey <> 3")
def csv_aliases(spark, sf):
    """Odd headers, bad numbers, missing columns, rows without a key"""
    path = _path(spark, "csv")
    s = table(spark, sf, "supplier")
    key = F.when(F.col("s_nationkey") != 3, F.col("s_suppkey").cast("string")).otherwise("none")
    depth = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal").cast("string")).otherwise("n/a")
    writers.csv(s.select(key.alias(" Event ID "), F.col("s_name").alias("WELLNAME"), depth.alias("DEPTHM")), path)
    kinds = {"id": "long", "well": "string", "depth": "double", "ts": "timestamp_ntz"}
    read = lambda p: readers.csv(spark, p, {"id": ("event id",), "well": ("wellname",), "depth": ("depthm",)}, kinds, ("id",))
    return readers.csv_by_flavour(spark, path, {"compiled": ({"wellname", "depthm"}, read)})


@query("""
SELECT event_id, event_type AS template, value, CASE WHEN user_id % 5 <> 0 THEN user_id END AS no_chans, round(value / 8, 6) AS mad FROM events""")
def key_value_scan(spark, sf):
    """S14 (trap T-20: the divisor is stated here), K10"""
    path = _path(spark, "parties")
    e = table(spark, sf, "events")
    chans = F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).otherwise("?")
    line = F.concat_ws("; ", F.concat(F.lit("template: "), "event_type"), F.concat(F.lit("event_id: "), F.col("event_id")), F.concat(F.lit("value: "), F.col("value")), F.concat(F.lit("no_chans: "), chans))
    e.select(line.alias("value")).write.text(path)
    rows = readers.key_value_lines(spark, path, {"event_id": "long", "template": "string", "value": "double", "no_chans": "long"})
    return rows.withColumn("mad", F.round(F.col("value") / 8, 6))


@query("SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 4) AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 2) AS total FROM embeddings")
def ascii_scan(spark, sf):
    """Number lines, flipped left to right"""
    path = _path(spark, "ascii")
    e = table(spark, sf, "embeddings")
    numbers = F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>"))
    e.select(F.array_join(numbers.cast("array<string>"), " ").alias("value")).write.text(path)
    rows = readers.ascii_matrix(spark, path, 1).select(F.reverse("values").alias("v"))
    body = F.slice("v", 2, F.size("v"))
    return rows.select(F.col("v")[0].cast("long").alias("vec_id"), F.size(body).alias("n"), F.round(body[0], 4).alias("last"), F.round(F.aggregate(body, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("SELECT user_id % 4 AS part, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id % 4 < 2 GROUP BY 1")
def partitioned_archive(spark, sf):
    """Written by key, read with the partition filter"""
    path = _path(spark, "archive")
    writers.by_key(table(spark, sf, "events").withColumn("part", F.col("user_id") % 4), path, ["part"])
    g = spark.read.parquet(path).where("part < 2").groupBy(F.col("part").cast("long").alias("part"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_custkey, printf('%-12s %8.2f', c_mktsegment, c_acctbal) AS line FROM customer")
def fixed_width_lines(spark, sf):
    """K10, K11, K12"""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", writers.fixed_width(c, [("c_mktsegment", "%-12s"), ("c_acctbal", "%8.2f")]).alias("line"))


@query("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey % 2 = 0")
def published_latest(spark, sf):
    """The second of two published versions"""
    folder = _path(spark, "published")
    o = table(spark, sf, "orders")
    writers.publish(o, folder, "2024-01-01")
    writers.publish(o.where("o_orderkey % 2 = 0"), folder, "2024-01-02")
    return writers.latest(spark, folder).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("SELECT event_id, ts, user_id, value FROM events")
def stream_append(spark, sf):
    """A stream with every event twice, deduplicated and appended in several batches"""
    source, out, check = (_path(spark, n) for n in ("arrivals", "appended", "progress"))
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    e.union(e).repartition(4, "event_id").write.parquet(source)
    stream = ingest.distinct_events(ingest.file_stream(spark, source, e.schema, pattern="*.parquet", files_at_once=2), ["event_id"], "ts", "365 days")
    ingest.append(stream, out, check)
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1, 2)
SELECT bucket, event_type, mean, n FROM w WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_windows(spark, sf):
    """A01, R06 as a stream: the windows that the watermark has closed"""
    source, out, check = (_path(spark, n) for n in ("arrivals", "windows", "progress"))
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.write.parquet(source)
    ingest.append(ingest.windowed_means(ingest.file_stream(spark, source, e.schema), "ts", "1 hour", ["event_type"], "value", "10 minutes"), out, check)
    w = spark.read.parquet(out)
    return w.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", F.round("mean", 4).alias("mean"), "n")


@query("SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE day(o_orderdate) % 3 <> 0 GROUP BY 1")
def resume_by_day(spark, sf):
    """Days that the ledger lacks"""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    ledger = o.where(F.dayofmonth("day") % 3 == 0).distinct()
    return R.exclude(o, ledger, ["day"]).groupBy("day").agg(F.count("*").alias("n"))
