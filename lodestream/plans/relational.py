"""Projection, filter, join, set and ordering queries. orders and lineitem stand for events and picks,
supplier, part and nation for stations and their groups, `events` for detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators import relational as R
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


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS depth, s_acctbal, NULL::VARCHAR AS phase FROM supplier")
def ensure_schema(spark, sf):
    """P01"""
    schema = T.StructType.fromDDL("s_suppkey BIGINT, s_name STRING, depth DOUBLE, s_acctbal DOUBLE, phase STRING")
    return R.ensure_columns(table(spark, sf, "supplier"), schema)


@query("SELECT event_id AS id, event_type AS kind, round(value * 2, 4) AS doubled FROM events")
def rename_derive(spark, sf):
    """P02"""
    e = table(spark, sf, "events").withColumnsRenamed({"event_id": "id", "event_type": "kind"})
    return e.withColumn("doubled", F.round(F.col("value") * 2, 4)).drop("ts", "user_id", "value", "props")


@query("SELECT event_id, round(abs(value) / nullif(user_id % 7, 0), 6) AS per_channel FROM events")
def guarded_ratio(spark, sf):
    """P03"""
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(R.safe_ratio(F.col("value"), F.col("user_id") % 7), 6).alias("per_channel"))


@query("""
SELECT p_partkey, p_size, p_retailprice FROM part
WHERE coalesce(nullif(p_size, 7), 0) >= 5 AND coalesce(nullif(p_retailprice, 0), 9999) <= 1500""")
def threshold_defaults(spark, sf):
    """P04"""
    p = table(spark, sf, "part")
    marked = p.select("p_partkey", "p_size", "p_retailprice", F.nullif("p_size", F.lit(7)).alias("s"), F.nullif("p_retailprice", F.lit(0.0)).alias("r"))
    return R.at_least(marked, {"s": 5}, {"r": 1500}).drop("s", "r")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'click')")
def exclude_list(spark, sf):
    """P05"""
    return table(spark, sf, "events").select("event_id", "event_type").where(~F.col("event_type").isin("error", "click"))


@query("""
SELECT event_id, event_type, ts::DATE AS day FROM events
WHERE (event_type, ts::DATE) NOT IN (
  SELECT (event_type, ts::DATE) FROM events GROUP BY event_type, ts::DATE HAVING count(*) > 40)""")
def exclude_spike_days(spark, sf):
    """Detections of a template on its spike days go"""
    e = table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    spikes = e.groupBy("event_type", "day").count().where("count > 40")
    return R.exclude(e, spikes, ["event_type", "day"])


@query("""
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-03' + INTERVAL 1 DAY""")
def day_range(spark, sf):
    """P08, P07"""
    return R.day_range(table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-01-02", "2024-01-03")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 12")
def bounding_box(spark, sf):
    """P09"""
    return R.bounding_box(table(spark, sf, "customer"), {"c_acctbal": (0, 5000), "c_nationkey": (3, 12)}).select("c_custkey")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 1000 AND c_nationkey < 8 THEN 'south' WHEN c_acctbal > 6000 AND c_nationkey > 15 THEN 'north' ELSE 'middle' END AS region
FROM customer""")
def region_labels(spark, sf):
    """P10"""
    bal, n = F.col("c_acctbal"), F.col("c_nationkey")
    label = F.when((bal < 1000) & (n < 8), "south").when((bal > 6000) & (n > 15), "north").otherwise("middle")
    return table(spark, sf, "customer").select("c_custkey", label.alias("region"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def clamp_negative(spark, sf):
    """P11"""
    return table(spark, sf, "customer").select("c_custkey", R.clamp_negative(F.col("c_acctbal")).alias("balance"))


@query("""
SELECT c_custkey, CASE WHEN o IS NULL THEN 'absent' ELSE 'present' END AS status,
  concat_ws(', ', CASE WHEN o IS NULL THEN 'no orders' END, CASE WHEN c_acctbal < 0 THEN 'negative balance' END) AS gaps
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey""")
def presence_and_gaps(spark, sf):
    """P12, P24"""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("o")).distinct()
    c = table(spark, sf, "customer").join(o, F.col("o") == F.col("c_custkey"), "left")
    status = F.when(F.col("o").isNull(), "absent").otherwise("present").alias("status")
    gaps = R.missing_reason({"no orders": F.col("o").isNull(), "negative balance": F.col("c_acctbal") < 0})
    return c.select("c_custkey", status, gaps.alias("gaps"))


@query("""
SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) <= 2 * s""")
def sigma_clip(spark, sf):
    """P13"""
    return R.sigma_clip(table(spark, sf, "events").select("event_id", "value"), "value", 2.0)


@query("""
WITH g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT user_id, count(*) AS n FROM events, g GROUP BY user_id, m, s HAVING abs(avg(value) - m) <= 0.2 * s OR bool_or(value > m + 4 * s)""")
def filter_by_group_residual(spark, sf):
    """P14"""
    e = table(spark, sf, "events")
    g = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    per = e.join(F.broadcast(g)).groupBy("user_id", "m", "s").agg(F.count("*").alias("n"), F.avg("value").alias("a"), F.bool_or(F.col("value") > F.col("m") + 4 * F.col("s")).alias("out"))
    return per.where((F.abs(F.col("a") - F.col("m")) <= 0.2 * F.col("s")) | F.col("out")).select("user_id", "n")


@query("SELECT event_id FROM events WHERE abs(value) >= 12.0 / 8.0 * 10 AND user_id >= 3 AND abs(value - 20) <= 15")
def rethreshold(spark, sf):
    """P15, P18"""
    v = F.col("value")
    return table(spark, sf, "events").where((F.abs(v) >= 12.0 / 8.0 * 10) & (F.col("user_id") >= 3) & (F.abs(v - 20) <= 15)).select("event_id")


@query("""
WITH p AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount >= 0.05) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n FROM p WHERE n >= 2""")
def nested_pick_filter(spark, sf):
    """Picks as an array of structs inside their event"""
    picks = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_discount", "l_suppkey")).alias("picks"))
    return R.filter_nested(picks, "picks", "l_discount", 0.05, 2).select("l_orderkey", F.size("picks").cast("long").alias("n"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^(?i)[A-Z0-9?*#]{1,8}$') AS valid FROM part")
def valid_code(spark, sf):
    """P19"""
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").rlike("(?i)^[A-Z0-9?*#]{1,8}$").alias("valid"))


@query("""
SELECT s_suppkey, n_nationkey FROM supplier, nation
WHERE s_nationkey <> n_nationkey AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def pair_table(spark, sf):
    """Source and receiver pairs without bad channels and pairs of one group"""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    active = R.exclude(s, s.where("s_acctbal < 0"), ["s_suppkey"])
    return active.crossJoin(small(n)).where("s_nationkey <> n_nationkey").select("s_suppkey", "n_nationkey")


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '^[A-B]') THEN 'source' ELSE 'receiver' END AS side FROM customer")
def split_by_pattern(spark, sf):
    """P22"""
    side = F.when(F.col("c_mktsegment").rlike("^[A-B]"), "source").otherwise("receiver")
    return table(spark, sf, "customer").select("c_custkey", side.alias("side"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_keep(spark, sf):
    """P23, J08"""
    named = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.keep(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), named, ["o_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_mismatch(spark, sf):
    """J09"""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.exclude(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@query("""
WITH a AS (SELECT nullif(s_nationkey, 3) AS k, min(s_acctbal) AS low, min(s_name) AS name FROM supplier GROUP BY 1),
b AS (SELECT nullif(c_nationkey, 4) AS k, max(c_acctbal) AS high, min(c_name) AS name FROM customer WHERE c_nationkey > 2 GROUP BY 1),
c AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 12),
ab AS (SELECT coalesce(a.k, b.k) AS k, low, high, coalesce(a.name, b.name) AS name FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k)
SELECT coalesce(ab.k, c.k) AS k, low, high, name, n_name FROM ab FULL JOIN c ON ab.k IS NOT DISTINCT FROM c.k""")
def stage_full_outer(spark, sf):
    """Null keys meet, duplicate columns coalesce from the left"""
    a = table(spark, sf, "supplier").groupBy(F.nullif("s_nationkey", F.lit(3)).alias("k")).agg(F.min("s_acctbal").alias("low"), F.min("s_name").alias("name"))
    b = table(spark, sf, "customer").where("c_nationkey > 2").groupBy(F.nullif("c_nationkey", F.lit(4)).alias("k")).agg(F.max("c_acctbal").alias("high"), F.min("c_name").alias("name"))
    c = table(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("k"), "n_name")
    return R.merge_full([a, b, c], ["k"])


@query("""
SELECT s_suppkey, s_name, med, mean, low, n FROM supplier LEFT JOIN (
  SELECT l_suppkey, round(median(l_extendedprice), 4) AS med, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS low, count(*) AS n
  FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey""")
def summary_left_joins(spark, sf):
    """J02, A07, A08"""
    x = F.col("l_extendedprice")
    picks = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.median(x), 4).alias("med"), F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("low"), F.count("*").alias("n"))
    s = table(spark, sf, "supplier")
    return s.join(picks, s.s_suppkey == picks.l_suppkey, "left").select("s_suppkey", "s_name", "med", "mean", "low", "n")


@query("""
SELECT o_orderkey, l_suppkey, round(sum(l_quantity), 4) AS qty, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def chained_joins(spark, sf):
    """One set-based join in place of a loop over events"""
    o, l, s = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    o, l = R.dealt(o.where("o_orderstatus = 'F'").select("o_orderkey"), l.select("l_orderkey", "l_suppkey", "l_quantity"), "o_orderkey", "l_orderkey")
    sums = o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("_sum"))
    names = small(s.groupBy("s_suppkey", "s_name").agg(F.count("*").alias("_n")))
    named = sums.join(names, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return named.select("o_orderkey", "l_suppkey", "s_name", F.round(F.col("_sum") * F.coalesce("_n", F.lit(1)), 4).alias("qty"))


@query("""
WITH a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, round(avg(value), 6) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, round(avg(value), 6) AS views FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT h, clicks, views FROM a FULL JOIN b USING (h)""")
def outer_join_on_time(spark, sf):
    """The evident intent, a join on time (not stacked rows)"""
    e = table(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    a = e.where("event_type = 'click'").groupBy("h").agg(F.round(F.avg("value"), 6).alias("clicks"))
    b = e.where("event_type = 'view'").groupBy("h").agg(F.round(F.avg("value"), 6).alias("views"))
    return a.join(b, "h", "full")


@query("""
SELECT l_orderkey, arg_max(l_suppkey, (l_extendedprice, l_suppkey)) AS best, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey""")
def best_per_group(spark, sf):
    """W01, J19, L04"""
    l = table(spark, sf, "lineitem")
    top = l.groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", "l_suppkey")).alias("t"))
    return top.select("l_orderkey", F.col("t.l_suppkey").alias("best"), F.col("t.l_extendedprice").alias("price"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC NULLS LAST, l_extendedprice, l_suppkey, l_partkey) AS r FROM lineitem)
SELECT l_orderkey, l_returnflag, l_quantity, l_extendedprice, l_suppkey FROM r WHERE r = 1""")
def highest_confidence_first(spark, sf):
    """W10, W09, U10"""
    order = [F.desc_nulls_last("l_quantity"), "l_extendedprice", "l_suppkey", "l_partkey"]
    top = R.top_one(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], *order)
    return top.select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_suppkey")


@query("""
SELECT c_custkey, c_acctbal, 'old' AS origin FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
UNION ALL SELECT c_custkey, c_acctbal + 1, 'new' FROM customer WHERE c_custkey % 5 = 0""")
def replace_by_key(spark, sf):
    """Reviewed rows replace, rejected ones go"""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("old").alias("origin"))
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("new").alias("origin"))
    return R.update_by_key(c, changes, c.where("c_custkey % 7 = 0"), "c_custkey")


@query("""
WITH k AS (SELECT p_partkey, unnest([p_brand, lower(p_brand), 'brand#' || p_size]) AS name, generate_subscripts([1, 2, 3], 1) AS rank FROM part),
m AS (SELECT DISTINCT lower(p_brand) AS name, dense_rank() OVER (ORDER BY lower(p_brand)) AS channel FROM part)
SELECT p_partkey, arg_max(channel, rank) AS channel FROM k JOIN m USING (name) GROUP BY p_partkey""")
def candidate_key_join(spark, sf):
    """Several candidate keys, the later match wins"""
    p = table(spark, sf, "part")
    names = F.array("p_brand", F.lower("p_brand"), F.concat(F.lit("brand#"), F.col("p_size").cast("string")))
    keys = p.select("p_partkey", F.posexplode(names).alias("rank", "name"))
    m = p.select(F.lower("p_brand").alias("name")).distinct()
    m = R.number_rows(m, [F.col("name")], "channel")
    return keys.join(m, "name").groupBy("p_partkey").agg(F.max_by("channel", "rank").alias("channel"))


@query("""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer)
SELECT position, o_orderkey, c_custkey FROM a JOIN b USING (position)""")
def zip_by_position(spark, sf):
    """J22"""
    o, c = table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    z = R.zip_rows(o, c, [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("c_acctbal"), F.col("c_custkey")])
    return z.select("position", "o_orderkey", "c_custkey")


@query("""
WITH p AS (SELECT user_id, event_type, sign(sum(value) - 100) AS pol FROM events GROUP BY ALL),
q AS (SELECT user_id, event_type, sign(max(value) - 40) AS pol, count(*) AS n FROM events GROUP BY ALL HAVING count(*) < 60)
SELECT user_id, event_type, p.pol::DOUBLE AS relative, q.pol::DOUBLE AS catalog, p.pol = q.pol AS agrees FROM p JOIN q USING (user_id, event_type)""")
def polarity_match(spark, sf):
    """J25"""
    e = table(spark, sf, "events")
    p = e.groupBy("user_id", "event_type").agg(F.signum(F.sum("value") - 100).alias("relative"))
    q = e.groupBy("user_id", "event_type").agg(F.signum(F.max("value") - 40).alias("catalog"), F.count("*").alias("n")).where("n < 60").drop("n")
    return p.join(q, ["user_id", "event_type"]).withColumn("agrees", F.col("relative") == F.col("catalog"))


@query("""
SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 'kept' WHEN l.k IS NOT NULL THEN 'excluded' ELSE 'missing' END AS membership
FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) l FULL JOIN (SELECT p_partkey + 20 AS k FROM part) r ON l.k = r.k""")
def four_way_compare(spark, sf):
    """U06"""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    r = table(spark, sf, "part").select((F.col("p_partkey") + 20).alias("k"))
    return R.compare_membership(l, r, "k", ("kept", "excluded", "missing"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, round_even(o_totalprice / 100000, 1), o_orderpriority IS NULL ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE r = 1""")
def rounded_dedup(spark, sf):
    """U09"""
    o = table(spark, sf, "orders").withColumn("x", F.col("o_totalprice") / 100000)
    return R.rounded_dedup(o, ["o_custkey"], {"x": 1}, F.col("o_orderpriority").isNull(), "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("""
SELECT 'customer' AS origin, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, sf):
    """U01, U02, U11, S12"""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""
SELECT l_suppkey AS k, 'all' AS side FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O')
UNION ALL SELECT l_partkey, 'only' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def set_operations(spark, sf):
    """U03, U04, U05, U07"""
    l = table(spark, sf, "lineitem")
    s = [l.where(w).select("l_suppkey") for w in ("l_returnflag = 'A'", "l_returnflag = 'R'", "l_linestatus = 'O'")]
    both = s[0].intersect(s[1]).intersect(s[2]).select(F.col("l_suppkey").alias("k"), F.lit("all").alias("side"))
    only = l.where("l_returnflag = 'A'").select("l_partkey").subtract(l.where("l_returnflag = 'R'").select("l_partkey"))
    return both.union(only.select("l_partkey", F.lit("only")))


@query("""
WITH r AS (SELECT url, page_id, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY (url NOT LIKE '%?%') DESC, page_id) AS r FROM pages)
SELECT page_id, url FROM r WHERE r = 1""")
def preferred_path(spark, sf):
    """U08"""
    p = table(spark, sf, "pages").select("page_id", "url")
    key = F.regexp_replace("url", "[?#].*$", "")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(~F.col("url").contains("?")), "page_id"))
    return p.withColumn("r", rank).where("r = 1").drop("r")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def multiset_duplicates(spark, sf):
    """A46"""
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("""
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 25""")
def ranked_head(spark, sf):
    """A top-k report"""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return c.orderBy(F.desc_nulls_last("c_mktsegment"), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 5")
def top_frequency(spark, sf):
    """L03, L08, A11, A18"""
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(5)


@query("""
WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_type, event_id, value, r::INT AS r FROM r WHERE r <= 3""")
def top_per_class(spark, sf):
    """L06, W29"""
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf, "events").select("event_type", "event_id", "value").withColumn("r", rank).where("r <= 3")


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey""")
def newest_with_partner(spark, sf):
    """L07"""
    o = R.keep(table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem, (SELECT avg(l_quantity) + 1.5 * stddev_pop(l_quantity) AS t FROM lineitem) WHERE l_quantity >= t""")
def largest_events(spark, sf):
    """L09"""
    l = table(spark, sf, "lineitem")
    t = l.agg((F.avg("l_quantity") + 1.5 * F.stddev_pop("l_quantity")).alias("t"))
    return l.join(F.broadcast(t)).where("l_quantity >= t").select("l_orderkey", "l_linenumber", "l_quantity")
