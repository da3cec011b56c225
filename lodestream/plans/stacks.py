"""Stacks, coherences and polarity matrices: `embeddings` are traces, `label` a channel, and vec_id the order of epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import arrays as A
from lodestream.operators import magnitudes as M
from lodestream.operators import polarity, stacks
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


def _traces(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


_E = "SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"
_CC = "(list_inner_product({a}, {b}) - list_sum({a}) * list_sum({b}) / {n}) / sqrt((list_inner_product({a}, {a}) - list_sum({a}) ** 2 / {n}) * (list_inner_product({b}, {b}) - list_sum({b}) ** 2 / {n}))"


@query(f"""
WITH e AS ({_E}), u AS (SELECT vec_id, label, x, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x) / len(x))) AS y FROM e),
s AS (SELECT label, list(v ORDER BY i) AS s FROM (SELECT label, i, sum(y[i]) AS v FROM u, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1),
f AS (SELECT u.*, {_CC.format(a="x", b="s", n=64)} AS first_cc FROM u JOIN s USING (label)),
t AS (SELECT label, list(v ORDER BY i) AS s FROM (SELECT label, i, sum(y[i]) AS v FROM f, range(1, 65) r(i) WHERE first_cc > 0.15 GROUP BY ALL) GROUP BY 1)
SELECT label, vec_id, round(first_cc, 6) AS first_cc, round({_CC.format(a="x", b="s", n=64)}, 6) AS cc, coalesce({_CC.format(a="x", b="s", n=64)} > 0.2, false) AS member
FROM f LEFT JOIN t USING (label)""")
def two_pass_stack(spark, sf):
    """Members of a channel's stack, and of the stack of those"""
    found = stacks.two_pass_members(_traces(spark, sf), ["label"], "vec_id", "x", least=0.2, first=0.15)
    return found.withColumn("first_cc", F.round("first_cc", 6)).withColumn("cc", F.round("cc", 6))


@query(f"""
WITH e AS ({_E}), u AS (
  SELECT label, x, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x) / 64)) AS y,
    list_transform(range(0, 64), lambda n: list_sum(list_transform(range(0, 64), lambda m: CASE WHEN (n - m) % 2 = 0 THEN 0 ELSE x[m + 1] * 2 / 64 / tan(pi() * (n - m) / 64) END))) AS h
  FROM e
), p AS (
  SELECT label, i, sum(y[i]) AS linear, count(*) AS n, sum(x[i] / sqrt(x[i] ** 2 + h[i] ** 2)) AS re, sum(h[i] / sqrt(x[i] ** 2 + h[i] ** 2)) AS im
  FROM u, range(1, 65) r(i) GROUP BY ALL
)
SELECT label, i - 1 AS i, n, round(linear, 6) AS linear, round(sqrt(re * re + im * im) / n, 6) AS coherence, round(linear * (re * re + im * im) / (n * n), 6) AS stacked FROM p""")
def phase_stack(spark, sf):
    """Linear and phase-weighted stacks of the channels, sample by sample"""
    found = stacks.phase_weighted_stack(_traces(spark, sf), ["label"], "x", 2.0)
    each = found.select("label", "n", F.posexplode(F.arrays_zip("linear", "coherence", "stacked")).alias("i", "v"))
    return each.select("label", F.col("i").cast("long").alias("i"), "n", *[F.round(f"v.{c}", 6).alias(c) for c in ("linear", "coherence", "stacked")])


#: Nodes of a grid with the lags of the stations in samples.
NODES = {"a": {}, "b": {"0": 3, "1": 1, "3": 5}, "c": {"0": 64, "1": 10, "2": -2}}


@query(f"""
WITH s AS (SELECT vec_id % 4 AS station, vec_id // 4 * 64 + i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i) WHERE vec_id % 37 <> 5),
l AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {s}, {per.get(str(s), 0)})" for n, per in NODES.items() for s in range(4))}) l(node, station, lag)),
a AS (SELECT node, station, i - lag AS u, v FROM s JOIN l USING (station)),
w AS (SELECT node, station, (u // 16 - k) * 16 AS start, u, v FROM a, range(0, 2) r(k) WHERE u >= 0 OR u % 16 = 0),
q AS (SELECT x.node, x.start, x.station AS p, y.station AS q, count(*) AS n, corr(x.v, y.v) AS r FROM w x JOIN w y ON x.node = y.node AND x.start = y.start AND x.u = y.u AND x.station < y.station GROUP BY ALL),
g AS (SELECT node, start, abs(r) AS r FROM q WHERE n = 32)
SELECT node, start, round(avg(r), 6) AS coherence, count(*) AS pairs FROM g WHERE start >= 0 GROUP BY ALL HAVING avg(r) >= 0.15""")
def coherence_grid(spark, sf):
    """Windows of a record of four stations whose coherence at a grid's node passes a threshold"""
    samples = _traces(spark, sf).where("vec_id % 37 <> 5").select((F.col("vec_id") % 4).alias("station"), (F.floor(F.col("vec_id") / 4) * 64).alias("first"), F.posexplode("x").alias("k", "v"))
    rows = samples.select("station", (F.col("first") + F.col("k")).alias("i"), "v")
    found = stacks.window_coherence(rows, "station", "i", "v", NODES, length=32, step=16, chunk=4096, least=0.15)
    return found.where("start >= 0").withColumn("coherence", F.round("coherence", 6))


@query(f"""
WITH e AS ({_E}), t AS (SELECT vec_id AS template, label, vec_id % 2 AS phase, x[13:52] AS a FROM e WHERE vec_id % 5 = 0),
d AS (SELECT vec_id AS detection, label, vec_id % 2 AS phase, x FROM e WHERE vec_id % 5 <> 0),
k AS (SELECT template, detection, label, phase, k, a, x[k + 1:k + 40] AS b FROM t JOIN d USING (label, phase), range(0, 25) r(k)),
c AS (SELECT template, detection, label, phase, list({_CC.format(a="a", b="b", n=40)} ORDER BY k) AS c FROM k GROUP BY ALL),
m AS (SELECT *, list_transform(c, lambda v: abs(v)) AS a FROM c),
n AS (SELECT *, list_position(a, list_max(a)) AS top,
  list_filter(range(1, 26), lambda i: a[i] > a[least(i + 1, 25)] AND a[i] > a[least(i + 2, 25)] AND a[i] > a[greatest(i - 1, 1)] AND a[i] > a[greatest(i - 2, 1)]) AS peaks FROM m),
v AS (SELECT *, sign(c[top]) * (a[top] - greatest(coalesce(a[list_max(list_filter(peaks, lambda i: i < top))], -1), coalesce(a[list_min(list_filter(peaks, lambda i: i > top))], -1))) AS polarity
  FROM n WHERE top > 1 AND top < 25 AND a[top] >= 0.2 AND list_contains(peaks, top) AND len(peaks) > 1)
SELECT label, phase, template, detection, round(polarity, 6) AS polarity FROM v WHERE abs(polarity) > 0.05""")
def polarity_pairs(spark, sf):
    """All templates and detections of a phase and channel"""
    e = _traces(spark, sf).withColumn("phase", F.col("vec_id") % 2)
    templates = e.where("vec_id % 5 = 0").withColumn("x", F.slice("x", 13, 40))
    found = polarity.polarity_matrix(templates, e.where("vec_id % 5 <> 0"), ["label", "phase"], "vec_id", "x", least_cc=0.2, level=0.05)
    return found.withColumn("polarity", F.round("polarity", 6))


@query(f"""
WITH e AS (SELECT vec_id, label, vec_id // 4 AS event, vec_id % 4 AS channel, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE vec_id % 9 <> 4),
p AS (SELECT a.event AS a, b.event AS b, {_CC.format(a="a.x", b="b.x", n=64)} AS cc FROM e a JOIN e b ON a.channel = b.channel AND a.event < b.event)
SELECT a, b, round(avg(cc), 6) AS coherence, count(*) AS channels FROM p GROUP BY ALL HAVING count(*) >= 3 AND avg(cc) >= 0.12""")
def event_coherence(spark, sf):
    """All pairs of events by the mean correlation over the channels that they share"""
    e = _traces(spark, sf).where("vec_id % 9 <> 4").select(F.lit("all").alias("k"), F.expr("vec_id div 4").alias("event"), (F.col("vec_id") % 4).alias("channel"), "x")
    found = polarity.event_coherences(e, ["k"], "event", "channel", "x", 0.12, 3)
    return found.select("a", "b", F.round("coherence", 6).alias("coherence"), "channels")


@query()
def subspace_basis(spark, sf):
    """Vectors that hold nine tenths of a channel's energy"""
    return stacks.subspace_design(_traces(spark, sf), ["label"], "x", 0.9)


@query(f"""
WITH e AS ({_E}), f AS (SELECT label, vec_id % 3 AS channel, vec_id // 30 AS detection, arg_min(x, vec_id) AS x, min(vec_id) AS v FROM e GROUP BY ALL),
t AS (SELECT label, channel, arg_min(x, v)[13:52] AS x, arg_min(x, v)[1:8] AS z, min(v) % 5 + 0.5 AS m FROM f GROUP BY ALL),
k AS (SELECT f.label, f.channel, detection, t.x AS a, z, m, k, f.x[k + 1:k + 40] AS b FROM f JOIN t USING (label, channel), range(0, 25) r(k)),
c AS (SELECT *, {_CC.format(a="a", b="b", n=40)} AS cc FROM k),
g AS (SELECT label, channel, detection, any_value(a) AS a, any_value(z) AS z, any_value(m) AS m, max(cc) AS cc, arg_max(b, cc) AS b FROM c GROUP BY ALL HAVING max(cc) >= 0.2),
s AS (SELECT *, list_inner_product(a, a) AS xx, list_inner_product(b, b) AS yy, list_inner_product(a, b) AS xy, list_stddev_pop(a) AS sa, list_stddev_pop(b) AS sb, list_stddev_pop(z) AS sz FROM g),
p AS (SELECT label, detection, m, ((xx + yy + sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2 - xx) / xy AS ratio, log10(sb / sa) AS raw, log10(cc * sb / sa * (1 + (sz / sa) ** 2)) AS corrected FROM s),
o AS (SELECT label, detection, count(*) AS channels, median(ratio) AS r, median(raw) AS raw, median(corrected) AS corrected, min(m) AS m FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT label, detection, channels, round(r, 5) AS relative_amplitude, round(raw, 5) AS delta_raw, round(corrected, 5) AS delta, round(CASE WHEN r > 0 THEN 0.9 * m + 0.1 + log10(CASE WHEN r > 0 THEN r END) * 2 / 3 END, 5) AS magnitude FROM o""")
def relative_magnitudes(spark, sf):
    """A channel's first trace is the template of the others, in blocks of 30 epochs"""
    e = _traces(spark, sf).withColumn("channel", F.col("vec_id") % 3).withColumn("detection", F.floor(F.col("vec_id") / 30))
    first = F.min_by(F.struct("x", "vec_id"), "vec_id")
    d = e.groupBy("label", "channel", "detection").agg(first.alias("f")).select("label", "channel", "detection", "f.x", "f.vec_id")
    t = e.groupBy("label", "channel").agg(first.alias("f")).select("label", "channel", F.slice("f.x", 13, 40).alias("x"), F.slice("f.x", 1, 8).alias("noise"), (F.col("f.vec_id") % 5 + 0.5).alias("m"))
    found = M.party_magnitudes(t, d, ["label"], "channel", "detection", "x", "noise", "m", least_cc=0.2, least_channels=2, slope=0.9, offset=0.1)
    return found.select("label", "detection", "channels", *[F.round(c, 5).alias(c) for c in ("relative_amplitude", "delta_raw", "delta", "magnitude")])


@query(f"""
WITH e AS ({_E}), p AS (SELECT vec_id, label, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM e),
k AS (SELECT vec_id, k, x, y[k + 1:k + 40] AS a, x[13:52] AS b FROM p, range(0, 25) r(k) WHERE y IS NOT NULL),
c AS (SELECT vec_id, k, {_CC.format(a="a", b="b", n=40)} AS cc FROM k)
SELECT vec_id, arg_max(k, cc)::INT - 12 AS shift, round(max(cc), 6) AS cc FROM c GROUP BY vec_id""")
def fiber_shift(spark, sf):
    """Where the middle of a trace lies in the one before it of its channel"""
    from pyspark.sql import Window

    e = _traces(spark, sf).withColumn("y", F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))).where("y is not null")
    pairs = e.select("vec_id", F.slice("x", 13, 40).alias("x"), "y", F.array(F.lit(0.0)).alias("z"))
    return M.channel_amplitudes(pairs, ["vec_id"], "x", "y", "z").select("vec_id", (F.col("shift") - 12).alias("shift"), F.round("cc", 6).alias("cc"))


@query("""
WITH b AS (SELECT o_custkey % 7 AS cloud, count(*) AS n, min(o_totalprice) AS x0, max(o_totalprice) AS x1 FROM orders GROUP BY 1)
SELECT cloud, round((x1 - x0) * 10 * 20, 2) AS volume FROM b""")
def hull_volume(spark, sf):
    """Hulls of clouds of points inside boxes whose corners are among the points"""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("cloud"), F.col("o_totalprice").alias("x"), "o_orderkey")
    ends = o.groupBy("cloud").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    side = [F.explode(F.array(*[F.lit(float(v)) for v in (0, n)])) for n in (10, 20)]
    corners = ends.select("cloud", F.explode(F.array("a", "b")).alias("x")).withColumn("y", side[0]).withColumn("z", side[1])
    inside = o.select("cloud", "x", (F.col("o_orderkey") % 101 / 10.1).alias("y"), (F.col("o_orderkey") % 211 / 10.55).alias("z"))
    return A.hull_volumes(inside.unionByName(corners), ["cloud"], ["x", "y", "z"]).withColumn("volume", F.round("volume", 2))
