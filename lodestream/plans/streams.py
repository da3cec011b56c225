"""Stateful streams over tables that arrive in parts, each part taken by a new start on the same checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestream.session import table
from lodestream.storage import checkpoint_folder
from lodestream.streaming import ingest, triggers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its own name with its DuckDB counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


#: Lengths of the averages in samples, ratios that open and end a trigger, and seconds of the longest trigger and of silence.
SHORT, LONG, ON, OFF, LONGEST, IDLE = 3, 20, 2.2, 1.2, 20000.0, 864000.0
LEAST = 3


@query(f"""
WITH RECURSIVE s AS (
  SELECT event_type AS network, user_id % 6 AS station, epoch_us(ts) AS t, value,
    row_number() OVER (PARTITION BY event_type, user_id % 6 ORDER BY ts, event_id) AS i
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL
), r AS (
  SELECT network, station, 0::BIGINT AS i, 0::BIGINT AS t, 0.0::DOUBLE AS sta, 0.0::DOUBLE AS lta, false AS opened, 0::BIGINT AS on_us, 0.0::DOUBLE AS peak,
    false AS closed, 0::BIGINT AS was_on, 0::BIGINT AS was_off, 0.0::DOUBLE AS was_peak
  FROM (SELECT DISTINCT network, station FROM s)
  UNION ALL
  SELECT network, station, i, t, sta, lta, opened, CASE WHEN opened THEN CASE WHEN goes_on THEN on_us ELSE t END END, CASE WHEN opened THEN CASE WHEN goes_on THEN greatest(peak, ratio) ELSE ratio END END,
    was_open AND NOT goes_on, on_us, t0, peak
  FROM (
    SELECT *, was_open AND ratio >= {OFF} AND t <= on_us + {int(LONGEST * 1e6)} AS goes_on, (was_open AND ratio >= {OFF} AND t <= on_us + {int(LONGEST * 1e6)}) OR ratio >= {ON} AS opened
    FROM (
      SELECT *, CASE WHEN i >= {LONG} AND lta > 0 THEN sta / lta ELSE 0 END AS ratio
      FROM (SELECT r.network, r.station, s.i, s.t, r.t AS t0, r.sta + (s.value ** 2 - r.sta) / {SHORT} AS sta, r.lta + (s.value ** 2 - r.lta) / {LONG} AS lta,
        r.opened AS was_open, r.on_us, r.peak FROM r JOIN s ON s.network = r.network AND s.station = r.station AND s.i = r.i + 1)))
), g AS (
  SELECT network, station, was_on AS a, was_off AS b, was_peak AS peak FROM r WHERE closed
  UNION ALL SELECT network, station, on_us, t, peak FROM r WHERE opened AND i = (SELECT max(i) FROM s WHERE s.network = r.network AND s.station = r.station)
), m AS (
  SELECT *, sum(new) OVER (PARTITION BY network ORDER BY a, b, station ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY network ORDER BY a, b, station ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM g)
)
SELECT network, min(a) AS start_us, max(b) AS end_us, count(DISTINCT station) AS n_stations, count(*) AS n_triggers, round(max(peak), 6) AS peak
FROM m GROUP BY network, island HAVING count(DISTINCT station) >= {LEAST}""")
def stream_coincidences(spark, sf):
    """Recursive averages per channel over three parts, triggers appended, then their coincidences by network over two parts"""
    path = f"{checkpoint_folder(spark)}/triggers-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    samples = e.select(F.col("event_type").alias("network"), (F.col("user_id") % 6).cast("string").alias("station"), F.lit("Z").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    low, high = (F.unix_micros(f("ts").cast("timestamp")) for f in (F.min, F.max))
    first, last = e.agg(low, high).first()
    if first is None:
        return spark.createDataFrame([], triggers.COINCIDENCES)
    part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - first) * 3 / F.lit(max(1, last - first))))
    end = spark.range(1).select(*[F.lit("~").alias(c) for c in ("network", "station", "channel")], F.timestamp_micros(F.lit(last + int(3e6 * IDLE))).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("value"))
    for k in range(4):  # the last part ends the record: whoever is silent by then is given up
        (end if k == 3 else samples.where(part == k)).write.mode("append").parquet(f"{path}/samples")
        stream = ingest.file_stream(spark, f"{path}/samples", samples.schema)
        ingest.append(triggers.channel_triggers(stream, "0 seconds", SHORT, LONG, ON, OFF, LONGEST, IDLE), f"{path}/found", f"{path}/first")
    found = spark.read.schema(triggers.TRIGGERS).parquet(f"{path}/found")
    done = spark.range(1).select(*[F.lit("~").alias(c) for c in ("network", "station", "channel")], *[F.lit(last + int(4e6 * IDLE)).alias(c) for c in ("on_us", "off_us", "known_us")], F.lit(0.0).alias("peak"), F.lit(0).cast("long").alias("n_samples"))
    half = first + (last - first) // 2
    for rows in (found.where(F.col("known_us") <= half), found.where(F.col("known_us") > half).unionByName(done)):
        rows.write.mode("append").parquet(f"{path}/triggers")
        stream = ingest.file_stream(spark, f"{path}/triggers", found.schema)
        ingest.append(triggers.network_coincidences(stream, "0 seconds", LEAST, LONGEST), f"{path}/joined", f"{path}/second")
    return spark.read.schema(triggers.COINCIDENCES).parquet(f"{path}/joined").withColumn("peak", F.round("peak", 6))
