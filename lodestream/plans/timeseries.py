"""Time-series queries over `events`: event_type stands for template or channel, user_id for station."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

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
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, event_type, round(avg(value), 6) AS mean_value, count(*) AS n
FROM events GROUP BY 1, 2""")
def resample_mean_10min(spark, sf):
    """Ten-minute means per event type."""
    e = table(spark, sf, "events")
    w = e.groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "mean_value", "n")


@query("SELECT time_bucket(INTERVAL 30 SECOND, ts) AS bucket, round(avg(value), 6) AS value FROM events GROUP BY 1")
def resample_30s(spark, sf):
    """A01, A02, S07"""
    return T.resample_mean(table(spark, sf, "events"), "ts", "30 seconds", ["value"])


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY event_type)
SELECT event_type, hour, coalesce(n, 0) AS n FROM s LEFT JOIN h USING (event_type, hour)""")
def grid_fill_hourly(spark, sf):
    """A03"""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    h = table(spark, sf, "events").groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"))
    return T.densify(h, "hour", "1 HOUR", ["event_type"]).select("event_type", "hour", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE value > 30 GROUP BY 1),
d AS (SELECT isodow(ts) - 1 AS day, count(*) AS n FROM events WHERE value > 30 GROUP BY 1)
SELECT 'hour' AS kind, s.range::INT AS bin, coalesce(n, 0) AS n FROM range(24) s LEFT JOIN h ON h.hour = s.range
UNION ALL SELECT 'weekday', s.range::INT, coalesce(n, 0) FROM range(7) s LEFT JOIN d ON d.day = s.range""")
def daily_patterns(spark, sf):
    """Counts over the whole domain of hours and weekdays (0 is Monday)"""
    e = table(spark, sf, "events").where("value > 30")
    out = None
    for kind, size, part in (("hour", 24, F.hour("ts")), ("weekday", 7, F.weekday("ts"))):
        n = e.groupBy(part.alias("bin")).agg(F.count("*").alias("n"))
        spine = spark.range(size).select(F.col("id").cast("int").alias("bin"))
        rows = spine.join(n, "bin", "left").select(F.lit(kind).alias("kind"), "bin", F.coalesce("n", F.lit(0)).alias("n"))
        out = rows if out is None else out.union(rows)
    return out


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT month, o_orderstatus, n, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY month)::BIGINT AS total FROM m""")
def cumulative_monthly(spark, sf):
    """A15, A44, W04"""
    m = table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))
    return m.withColumn("total", F.sum("n").over(Window.partitionBy("o_orderstatus").orderBy("month")))


@query("""
SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1000000 AS seconds FROM events""")
def interevent_time(spark, sf):
    """W03, W27"""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", ((T.micros("ts") - F.lag(T.micros("ts")).over(w)) / 1e6).alias("seconds"))


@query("""
SELECT event_type, ts, sum(count(*)) OVER (PARTITION BY event_type ORDER BY ts)::BIGINT AS total FROM events GROUP BY event_type, ts""")
def cumulative_detections(spark, sf):
    """Ties fall into one point"""
    n = table(spark, sf, "events").groupBy("event_type", "ts").agg(F.count("*").alias("n"))
    return n.select("event_type", "ts", F.sum("n").over(Window.partitionBy("event_type").orderBy("ts")).alias("total"))


@query("""
SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(median(value) OVER w, 6) AS med, round(stddev_samp(value) OVER w, 4) AS sd FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '7199.999999 seconds' PRECEDING AND CURRENT ROW)""")
def rolling_2h(spark, sf):
    """Mean, median and deviation over (t - 2 h, t], six hours of a type in a task"""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    r = T.rolling_statistics(e, ["event_type"], "ts", 7200, 21_600, "value")
    return r.select("event_id", F.round("mean", 6).alias("mean"), F.round("med", 6).alias("med"), F.round("sd", 4).alias("sd"))


@query("""
WITH w AS (SELECT event_id, count(*) OVER w AS n, avg(value) OVER w AS m, min(value) OVER w AS low FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING))
SELECT event_id, CASE WHEN n >= 100 THEN round(log10(exp(1)) / nullif(m - low, 0), 6) END AS b FROM w""")
def rolling_b_value(spark, sf):
    """W07, X01"""
    e = T.rolling_b_value(table(spark, sf, "events"), "value", ["event_type"], ["ts", "event_id"], 100)
    return e.select("event_id", F.round("b", 6).alias("b"))


@query("""
WITH w AS (SELECT event_id, median(value) OVER w AS x, median(user_id) OVER w AS y FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 24 PRECEDING))
SELECT event_id, round(x, 6) AS x, round(y, 6) AS y, round(degrees(atan2(y - 20, x - 20)), 4) AS trend FROM w""")
def rolling_centroid(spark, sf):
    """W08"""
    w = T.rolling_rows(["event_type"], ["ts", "event_id"], 24)
    x, y = T.percentile("value").over(w), T.percentile("user_id").over(w)
    return table(spark, sf, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).withColumn("trend", F.round(F.degrees(F.atan2(F.col("y") - 20, F.col("x") - 20)), 4))


@query("""
SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS highest,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS ordinal FROM events""")
def running_max_and_ordinal(spark, sf):
    """W11, W12"""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.max("value").over(w).alias("highest"), F.row_number().over(w).alias("ordinal"))


@query("""
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY user_id),
j AS (SELECT user_id, hour, v, row_number() OVER (PARTITION BY user_id ORDER BY hour) AS n FROM s LEFT JOIN h USING (user_id, hour)),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS lv, first_value(v IGNORE NULLS) OVER a AS rv,
  max(CASE WHEN v IS NOT NULL THEN n END) OVER b AS ln, min(CASE WHEN v IS NOT NULL THEN n END) OVER a AS rn FROM j
  WINDOW b AS (PARTITION BY user_id ORDER BY hour ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, hour, round(CASE WHEN v IS NOT NULL THEN v WHEN rv IS NULL THEN lv ELSE lv + (rv - lv) * (n - ln)::DOUBLE / nullif(rn - ln, 0) END, 6) AS v FROM k""")
def interpolate_gaps(spark, sf):
    """W13, J07, A03"""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    h = table(spark, sf, "events").groupBy("user_id", hour.alias("hour")).agg(F.avg("value").alias("v"))
    filled = T.interpolate(T.densify(h, "hour", "1 HOUR", ["user_id"]), "v", ["user_id"], "hour")
    return filled.select("user_id", "hour", F.round("v", 6).alias("v"))


@query("""
WITH e AS (SELECT user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY user_id, i""")
def islands(spark, sf):
    """Scan windows that touch become one"""
    return T.islands(table(spark, sf, "events"), ["user_id"], F.col("ts"), F.col("ts") + F.expr("INTERVAL 30 MINUTE"), chunk_seconds=86_400)


@query("""
SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events""")
def delta_first(spark, sf):
    """W15"""
    return table(spark, sf, "events").select("event_id", F.round(T.delta_first("value", ["user_id"], ["ts", "event_id"]), 6).alias("delta"))


@query("""
WITH m AS (SELECT event_id, event_type, value, median(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM events),
d AS (SELECT *, abs(value - m) AS d FROM m), s AS (SELECT event_type, mad(d) AS s FROM d GROUP BY event_type)
SELECT event_id, round(CASE WHEN d > 3 * s THEN m ELSE value END, 6) AS clean FROM d JOIN s USING (event_type)""")
def despike3(spark, sf):
    """W16"""
    return T.despike(table(spark, sf, "events"), "value", ["event_type"], ["ts", "event_id"], 3.0).select("event_id", F.round("clean", 6).alias("clean"))


@query("""
WITH j AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events)
SELECT event_id, round(value - sum(CASE WHEN abs(j) > 25 THEN j ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS corrected FROM j""")
def gain_correction(spark, sf):
    """W18"""
    e = T.gain_steps(table(spark, sf, "events"), "value", ["user_id"], ["ts", "event_id"], 25.0)
    return e.select("event_id", F.round("corrected", 4).alias("corrected"))


@query("""
WITH c AS (SELECT *, value > 20 AS v FROM events),
d AS (SELECT *, CASE WHEN v <> lag(v) OVER (PARTITION BY event_type ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM c),
r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM d)
SELECT event_id, v AND r > 0 AND r < max(r) OVER (PARTITION BY event_type) AND count(*) OVER (PARTITION BY event_type, r) <= 2 AS short FROM r""")
def short_run_mask(spark, sf):
    """The evident intent (trap T-01)"""
    return T.short_runs(table(spark, sf, "events"), F.col("value") > 20, ["event_type"], ["ts", "event_id"], 2).select("event_id", "short")


@query("""
WITH d AS (SELECT event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap FROM events)
SELECT event_id FROM d WHERE gap < 60""")
def duplicates_in_time(spark, sf):
    """The evident intent (trap T-02)"""
    return T.near_duplicates_in_time(table(spark, sf, "events"), ["event_type"], "ts", ["event_id"], 60).select("event_id")


@query("""
SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING), 6) AS causal,
  round(value - median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS above FROM events""")
def rolling_median_rows(spark, sf):
    """W21, W26"""
    order = ["ts", "event_id"]
    causal = T.percentile("value").over(T.rolling_rows(["user_id"], order, 6))
    centred = T.percentile("value").over(T.rolling_rows(["user_id"], order, 5, 5))
    return table(spark, sf, "events").select("event_id", F.round(causal, 6).alias("causal"), F.round(F.col("value") - centred, 6).alias("above"))


@query("""
WITH n AS (SELECT event_id, value, abs(value - lag(value) OVER w) AS a, abs(value - lead(value) OVER w) AS b,
  lag(value) OVER w AS p, lead(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN coalesce(a, 1e9) <= coalesce(b, 1e9) THEN coalesce(p, value) ELSE q END AS aligned FROM n""")
def neighbour_realign(spark, sf):
    """W22"""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p, q, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    a, b = F.coalesce(F.abs(v - p), F.lit(1e9)), F.coalesce(F.abs(v - q), F.lit(1e9))
    return table(spark, sf, "events").select("event_id", F.when(a <= b, F.coalesce(p, v)).otherwise(q).alias("aligned"))


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER w AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a.user_id, a.i::INT AS place, round(a.value - b.value, 6) AS deviation FROM n a JOIN n b ON a.user_id = b.user_id AND a.i = b.j WHERE a.i < a.j""")
def leg_difference(spark, sf):
    """A channel against the one equally far from the other end"""
    up, down = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    n = table(spark, sf, "events").select("user_id", "value", F.row_number().over(up).alias("i"), F.row_number().over(down).alias("j"))
    other = n.select("user_id", F.col("value").alias("back"), F.col("j").alias("i"))
    return n.where("i < j").join(other, ["user_id", "i"]).select("user_id", F.col("i").alias("place"), F.round(F.col("value") - F.col("back"), 6).alias("deviation"))


@query("""
WITH d AS (SELECT user_id, ts, event_id, sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id - lag(event_id) OVER w, 2) + pow(epoch(ts) / 60 - epoch(lag(ts) OVER w) / 60, 2)) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(sum(coalesce(d, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS along FROM d""")
def arc_length(spark, sf):
    """W24"""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = lambda c: F.pow(c - F.lag(c).over(w), 2)
    e = table(spark, sf, "events").withColumn("m", T.micros("ts") / 6e7)
    d = e.withColumn("d", F.coalesce(F.sqrt(step(F.col("value")) + step(F.col("event_id")) + step(F.col("m"))), F.lit(0.0)))
    return d.select("event_id", F.round(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("along"))


@query("""
WITH n AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE AS i FROM events),
l AS (SELECT event_type, regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM n GROUP BY event_type)
SELECT event_id, round(value - (a * i + b), 4) AS residual FROM n JOIN l USING (event_type)""")
def detrend(spark, sf):
    """W25"""
    return T.detrend(table(spark, sf, "events"), "value", ["event_type"], ["ts", "event_id"]).select("event_id", F.round("residual", 4).alias("residual"))


@query("""
WITH p AS (SELECT user_id, (epoch(lead(ts) OVER w) - epoch(ts)) * (lead(value) OVER w + value) / 2 AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sum(p), 2) AS integral FROM p GROUP BY user_id""")
def trapz_integral(spark, sf):
    """A32, A33"""
    t = T.trapezoid(table(spark, sf, "events"), T.micros("ts") / 1e6, "value", ["user_id"], ["event_id"])
    return t.select("user_id", F.round("integral", 2).alias("integral"))


@query("""
WITH p AS (SELECT event_id, user_id, ts, coalesce((lag(v) OVER w + v) / 2 * (epoch(ts) - epoch(lag(ts) OVER w)), 0) AS p
  FROM (SELECT *, coalesce(nullif(value, 10), 0) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(sum(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS volume FROM p""")
def cumulative_volume(spark, sf):
    """Trapezoids over an irregular rate (traps T-04 and T-16: intent)"""
    e = table(spark, sf, "events").withColumn("rate", F.nullif("value", F.lit(10.0))).withColumn("s", T.micros("ts") / 1e6)
    step, upto = T.cumulative_rate("rate", F.col("s"), ["user_id"], ["ts", "event_id"])
    return e.withColumn("p", step).select("event_id", F.round(F.sum("p").over(upto), 2).alias("volume"))


@query("""
SELECT event_id, event_type, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)""")
def retention_window(spark, sf):
    """R10"""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last")))).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 12 HOURS")).drop("last")


def decluster(spark, sf):
    """Greedy suppression, tested against brute force"""
    return T.decluster(table(spark, sf, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", "value", 600.0)


QUERIES["decluster"] = decluster
