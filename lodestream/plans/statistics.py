"""Aggregation queries. lineitem stands for picks (event l_orderkey, station l_suppkey, phase l_returnflag)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import stats as S
from lodestream.operators.timeseries import running_total
from lodestream.session import table
from lodestream.storage import small

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
SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_events,
  round(count(DISTINCT l_orderkey)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS share,
  string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY l_suppkey""")
def coverage_stats(spark, sf):
    """A06, A09, A37"""
    c = S.coverage(table(spark, sf, "lineitem"), ["l_suppkey"], "l_orderkey", "l_returnflag")
    return c.withColumn("share", F.round("share", 6))


@query("""
SELECT l_suppkey, l_returnflag, round(median(l_extendedprice), 4) AS med, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last,
  min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 AS middle FROM lineitem GROUP BY ALL""")
def group_summaries(spark, sf):
    """A05, A07, A08, A12"""
    x = F.col("l_extendedprice")
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.median(x), 4).alias("med"), F.round(F.avg(x), 4).alias("mean"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    )
    return g.withColumn("middle", (F.col("first") + (F.col("last") - F.col("first")) / 2).cast("timestamp_ntz"))


@query("""
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_min(nullif(value, 10), (ts, event_id)) FILTER (WHERE nullif(value, 10) IS NOT NULL) AS first_value
FROM events GROUP BY user_id""")
def first_non_null(spark, sf):
    """First values in time order"""
    from lodestream.operators.relational import first_non_null as first

    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("first_type"), F.nullif("value", F.lit(10.0)).alias("first_value"))
    return first(e, ["user_id"], ["ts", "event_id"])


@query("""
SELECT ts::DATE AS day, event_type, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY ALL""")
def daily_quantiles(spark, sf):
    """A10, X02"""
    shares = [10, 25, 50, 75, 90]
    p = F.percentile("value", F.array(*[F.lit(x / 100) for x in shares]))
    g = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(p.alias("p"))
    return g.select("day", "event_type", *[F.round(F.col("p")[i], 4).alias(f"p{x}") for i, x in enumerate(shares)])


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE year(o_orderdate) % 4 = 0) AS y0, count(*) FILTER (WHERE year(o_orderdate) % 4 = 1) AS y1,
  count(*) FILTER (WHERE year(o_orderdate) % 4 = 2) AS y2, count(*) FILTER (WHERE year(o_orderdate) % 4 = 3) AS y3, count(*) AS total FROM orders GROUP BY 1""")
def pivot_year(spark, sf):
    """A13"""
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate") % 4)
    p = o.groupBy("o_orderpriority").pivot("y", [0, 1, 2, 3]).count().na.fill(0)
    p = p.select("o_orderpriority", *[F.col(str(i)).alias(f"y{i}") for i in range(4)])
    return p.withColumn("total", F.col("y0") + F.col("y1") + F.col("y2") + F.col("y3"))


@query("""
SELECT date_trunc('month', l_shipdate)::DATE AS month, l_returnflag, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 6) AS depth, round(sum(l_quantity), 2) AS volume
FROM lineitem GROUP BY ALL""")
def weighted_depth(spark, sf):
    """A16, A17"""
    q, d = F.col("l_quantity"), F.col("l_discount")
    g = table(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), "l_returnflag")
    return g.agg(F.round(F.sum(q * d) / F.nullif(F.sum(q), F.lit(0.0)), 6).alias("depth"), F.round(F.sum(q), 2).alias("volume"))


@query("""
SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last, round(median(value), 4) AS med, count(*) FILTER (WHERE value > 30) AS strong FROM events""")
def global_summary(spark, sf):
    """A18, A49, K13"""
    v = F.col("value")
    return table(spark, sf, "events").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.round(F.median(v), 4).alias("med"), F.count_if(v > 30).alias("strong"),
    )


@query("""
WITH b AS (SELECT CASE WHEN value = 50 THEN 24 ELSE floor(value / 2)::INT END AS bin, count(*) AS n FROM events GROUP BY 1)
SELECT r.range::INT AS bin, coalesce(n, 0) AS n FROM range(25) r LEFT JOIN b ON b.bin = r.range""")
def histogram(spark, sf):
    """A19, F53"""
    return S.dense_histogram(table(spark, sf, "events"), "value", 0.0, 2.0, 25)


@query("""
WITH b AS (SELECT CASE WHEN value = 50 THEN 24 ELSE floor(value / 2)::INT END AS bin, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT r.range::INT AS bin, coalesce(n, 0) AS n FROM range(25) r LEFT JOIN b ON b.bin = r.range),
c AS (SELECT bin, abs(lead(n, 2) OVER (ORDER BY bin) - 2 * lead(n) OVER (ORDER BY bin) + n) AS bend FROM d)
SELECT bin, (bin * 2)::DOUBLE AS mc FROM c WHERE bend IS NOT NULL ORDER BY bend DESC, bin LIMIT 1""")
def freq_magnitude_mc(spark, sf):
    """A20 (trap T-14: bins start below the least value)"""
    return S.max_curvature(table(spark, sf, "events"), "value", 0.0, 2.0, 25)


@query("""
WITH b AS (SELECT CASE WHEN value = 50 THEN 24 ELSE floor(value / 2)::INT END AS bin, count(*) AS n FROM events WHERE value <= 50 GROUP BY 1),
t AS (SELECT bin * 2 AS m, log10(sum(n) OVER (ORDER BY bin DESC)) AS y, n FROM (SELECT r.range::INT AS bin, coalesce(n, 0) AS n FROM range(25) r LEFT JOIN b ON b.bin = r.range)
  QUALIFY sum(n) OVER (ORDER BY bin DESC) > 0)
SELECT round(-regr_slope(y, m), 6) AS b, round(regr_intercept(y, m), 6) AS a FROM t HAVING count(*) >= 5""")
def bvalue_lsq(spark, sf):
    """A21, A22"""
    return S.b_value_lsq(table(spark, sf, "events"), "value", 0.0, 2.0, 25).select(F.round("b", 6).alias("b"), F.round("a", 6).alias("a"))


@query("""
SELECT event_type, round(log10(exp(1)) / nullif(avg(value) - min(value), 0), 6) AS b,
  round(2.3 * sqrt(var_pop(value) / nullif(count(*) - 1, 0)) * pow(log10(exp(1)) / nullif(avg(value) - min(value), 0), 2), 6) AS error FROM events GROUP BY 1""")
def bvalue_mle(spark, sf):
    """A23"""
    return S.b_value_mle(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", F.round("b", 6).alias("b"), F.round("error", 6).alias("error"))


@query("""
SELECT c::DOUBLE AS cutoff, count(*) AS n, round(log10(exp(1)) / nullif(avg(value) - c, 0), 6) AS b FROM (SELECT unnest([5, 10, 15, 20, 25]) AS c), events WHERE value >= c GROUP BY c""")
def mc_stability(spark, sf):
    """A24"""
    return S.b_value_by_cutoff(table(spark, sf, "events"), "value", [5, 10, 15, 20, 25]).withColumn("b", F.round("b", 6))


@query("""
WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, 1 / (avg(value) - min(value)) AS b FROM events GROUP BY 1)
SELECT x.event_type AS left_type, y.event_type AS right_type,
  round(exp(-(-2 * (x.n + y.n) * ln(x.n + y.n) + 2 * x.n * ln(x.n + y.n * x.b / y.b) + 2 * y.n * ln(x.n * y.b / x.b + y.n) - 2) / 2 - 2), 6) AS p
FROM g x JOIN g y ON x.event_type < y.event_type""")
def bvalue_equality(spark, sf):
    """Pairs of event types, of which there are few"""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), (1 / (F.avg("value") - F.min("value"))).alias("b"))
    x, y = g.alias("x"), small(g).alias("y")
    p = S.utsu_probability(F.col("x.n"), F.col("y.n"), F.col("x.b"), F.col("y.b"))
    return x.join(y, F.col("x.event_type") < F.col("y.event_type")).select(F.col("x.event_type").alias("left_type"), F.col("y.event_type").alias("right_type"), F.round(p, 6).alias("p"))


@query("""
SELECT event_id, round(log10(sum(pow(10, 1.5 * value / 10 + 9.05)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 6) AS log_moment FROM events""")
def cumulative_moment(spark, sf):
    """A26, in chunks of a day"""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    moment = F.pow(F.lit(10.0), 1.5 * F.col("value") / 10 + 9.05)
    t = running_total(e, ["event_type"], "ts", ["event_id"], moment, 86_400)
    return t.select("event_id", F.round(F.log10("total"), 6).alias("log_moment"))


@query("SELECT round(avg(n), 6) AS noise FROM (SELECT 3 * stddev_pop(value) AS n FROM events GROUP BY user_id)")
def noise_sigma(spark, sf):
    """A27 (trap T-07)"""
    return S.noise(table(spark, sf, "events"), "value", "user_id").select(F.round("noise", 6).alias("noise"))


@query("SELECT round(avg(n), 6) AS noise FROM (SELECT (quantile_cont(value, 0.1) + quantile_cont(value, 0.9)) / 2 AS n FROM events GROUP BY user_id)")
def noise_percentiles(spark, sf):
    """A27"""
    return S.noise(table(spark, sf, "events"), "value", "user_id", "krietsch").select(F.round("noise", 6).alias("noise"))


@query("SELECT user_id, round(avg(value), 6) AS noise, round(mad(value), 6) AS mad FROM events GROUP BY user_id")
def mad_noise(spark, sf):
    """A27, A28"""
    n = S.noise(table(spark, sf, "events"), "value", "user_id", "by_channel")
    return n.select("user_id", F.round("noise", 6).alias("noise"), F.round("mad", 6).alias("mad"))


@query("""
SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms,
  round(20 * log10(sqrt(avg(value * value) FILTER (WHERE event_type = 'click')) / sqrt(avg(value * value) FILTER (WHERE event_type = 'view'))), 4) AS db,
  CASE WHEN count(*) FILTER (WHERE event_type = 'click') >= 5 AND count(*) FILTER (WHERE event_type = 'view') >= 5 THEN
    round(max(abs(value)) FILTER (WHERE event_type = 'click') / sqrt(avg(value * value) FILTER (WHERE event_type = 'view')), 4) END AS peak
FROM events GROUP BY user_id""")
def snr_db(spark, sf):
    """A29, A30, A31"""
    signal, noise = F.col("event_type") == "click", F.col("event_type") == "view"
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.round(S.rms(F.col("value")), 6).alias("rms"), F.round(S.snr_db("value", signal, noise), 4).alias("db"), F.round(S.snr_peak("value", signal, noise), 4).alias("peak")
    )


@query("""
SELECT l_orderkey, make_timestamp((floor(avg(epoch_us(l_shipdate) / 1000000)))::BIGINT * 1000000) AS mean_time, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n
FROM lineitem GROUP BY 1 HAVING count(*) >= 5""")
def cluster_times(spark, sf):
    """A35"""
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.timestamp_micros(F.floor(F.avg(us / 1_000_000)) * 1_000_000).cast("timestamp_ntz").alias("mean_time"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count("*").alias("n"))
    return g.where("n >= 5")


@query("""
SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(l_discount)), ',') AS residuals FROM lineitem GROUP BY ALL""")
def residual_lists(spark, sf):
    """A36, A48"""
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.array_join(F.sort_array(F.collect_list("l_discount")).cast("array<string>"), ",").alias("residuals"))


@query("""
SELECT l_orderkey, len(list_distinct(list(l_suppkey)))::INT AS n_stations FROM lineitem GROUP BY 1""")
def station_count(spark, sf):
    """Distinct stations in an array of channels"""
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_partkey")).alias("chans"))
    return c.select("l_orderkey", F.size(F.array_distinct(F.transform("chans", lambda x: x["l_suppkey"]))).alias("n_stations"))


@query("""
WITH q AS (SELECT l_suppkey, quantile_cont(l_discount, 0.5) AS middle, (quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25)) / 1.349 AS spread FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(middle, 6) AS middle, round(spread, 6) AS spread, round(avg(CASE WHEN abs(l_discount - middle) > 3 * spread THEN 1.0::DOUBLE ELSE 0 END), 6) AS outliers
FROM lineitem JOIN q USING (l_suppkey) GROUP BY l_suppkey, middle, spread""")
def quartile_weights(spark, sf):
    """A39 (trap T-10: intent)"""
    q = S.quartile_weights(table(spark, sf, "lineitem"), "l_discount", ["l_suppkey"])
    return q.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("middle", "spread", "outliers")])


@query("""
WITH g AS (SELECT least(greatest(ceil((value - 0) / 5.0 - 0.5), 0), 9)::INT AS x, least(greatest(ceil((user_id - 0) / 8.0 - 0.5), 0), 5)::INT AS y, value FROM events)
SELECT x, y, count(*) AS n, round(avg(value), 6) AS mean FROM g GROUP BY x, y HAVING count(*) >= 20""")
def grid_nodes(spark, sf):
    """A40, F55"""
    e = table(spark, sf, "events").select(S.nearest_node(F.col("value"), 0, 5.0, 10).alias("x"), S.nearest_node(F.col("user_id"), 0, 8.0, 6).alias("y"), "value")
    return e.groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).where("n >= 20")


@query("""
SELECT event_id, ts::DATE AS day FROM events WHERE ts::DATE IN (SELECT ts::DATE FROM events GROUP BY 1 HAVING count(*) > 150)""")
def swarm_days(spark, sf):
    """A41"""
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return e.join(e.groupBy("day").count().where("count > 150").select("day"), "day", "left_semi")


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, arg_max(l_linenumber, (n, -l_linenumber)) AS mode FROM c GROUP BY 1""")
def mode_per_group(spark, sf):
    """The least of equally frequent values"""
    c = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("mode"))


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, max(o_totalprice) AS top FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH))::DATE AS month)
SELECT month, top FROM s LEFT JOIN m USING (month) QUALIFY row_number() OVER (ORDER BY month DESC) > 2""")
def monthly_maximum(spark, sf):
    """A row for every month but the last two; the window runs over months, of which there are few"""
    m = table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.max("o_totalprice").alias("top"))
    ends = m.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    s = ends.select(F.explode(F.sequence("a", F.add_months("b", -2), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return s.join(m, "month", "left")


@query("""
WITH s AS (SELECT unnest(generate_series(0, 100)) * 0.5::DOUBLE AS place)
SELECT event_type, place, count(*) AS n FROM s JOIN events ON value >= place - 1 AND value < place + 1 GROUP BY ALL""")
def overlapping_density(spark, sf):
    """A45"""
    return S.overlapping_density(table(spark, sf, "events"), "value", 0.0, 50.0, 0.5, 1.0, ["event_type"])


@query("""
WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, i::INT AS i, round(median(v), 6) AS med FROM x GROUP BY ALL""")
def spectral_medians(spark, sf):
    """Medians of array elements over many arrays"""
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return x.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.median(F.col("v").cast("double")), 6).alias("med"))


@query("""
WITH b AS (SELECT floor(c_acctbal / 500)::BIGINT AS bin, c_acctbal FROM customer)
SELECT bin, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd, count(*) AS n FROM b WHERE bin < (SELECT max(bin) FROM b) GROUP BY bin""")
def distance_bins(spark, sf):
    """The last, partial bin is left out"""
    b = table(spark, sf, "customer").select(F.floor(F.col("c_acctbal") / 500).alias("bin"), "c_acctbal")
    last = b.agg(F.max("bin").alias("last"))
    g = b.join(F.broadcast(last)).where("bin < last").groupBy("bin")
    return g.agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 4).alias("sd"), F.count("*").alias("n"))


@query("""
SELECT floor(c_acctbal / 100)::BIGINT AS bin, arg_min(c_custkey, (abs(c_acctbal - (floor(c_acctbal / 100) * 100 + 50)), c_custkey)) AS nearest FROM customer GROUP BY 1""")
def thin_channels(spark, sf):
    """The channel nearest each bin's centre"""
    bin_ = F.floor(F.col("c_acctbal") / 100)
    off = F.abs(F.col("c_acctbal") - (bin_ * 100 + 50))
    return table(spark, sf, "customer").groupBy(bin_.alias("bin")).agg(F.min_by("c_custkey", F.struct(off, "c_custkey")).alias("nearest"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS above FROM events""")
def ecdf_rank(spark, sf):
    """W02"""
    return S.ecdf_rank(table(spark, sf, "events"), "value", ["event_id"], ["event_type"]).select("event_id", "above")
