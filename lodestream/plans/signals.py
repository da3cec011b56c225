"""Waveform queries: `embeddings` are traces, `label` a station, and vec_id the order of epochs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import detect
from lodestream.operators import kernels as K
from lodestream.operators import picks as P
from lodestream.operators import signals as S
from lodestream.operators import stacks
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


def _pairs(spark, sf):
    """Every trace with the one before it of its station."""
    before = F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))
    return _traces(spark, sf).withColumn("y", before).where("y is not null")


@query("""
WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m, sum(v) AS s FROM x GROUP BY ALL), n AS (SELECT label, count(*) AS traces FROM embeddings GROUP BY 1)
SELECT label, traces, round(arg_max(m, (abs(m), -i)), 5) AS peak, round(sum(s), 3) AS total FROM m JOIN n USING (label) GROUP BY label, traces""")
def channel_stack(spark, sf):
    """G03, G20, G31"""
    s = S.stack(_traces(spark, sf), ["label"], "x")
    top = F.aggregate("mean", F.lit(0.0), lambda a, v: F.when(F.abs(v) > F.abs(a), v).otherwise(a))
    return s.select("label", "traces", F.round(top, 5).alias("peak"), F.round(F.aggregate("total", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("""
WITH x AS (SELECT vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
w AS (SELECT vec_id, v * CASE WHEN least(i, n - 1 - i) < floor(0.2 * n / 2) THEN 0.5 * (1 - cos(pi() * least(i, n - 1 - i) / floor(0.2 * n / 2))) ELSE 1 END AS v FROM x)
SELECT vec_id, round(sum(v * v), 5) AS energy FROM w GROUP BY 1""")
def tapered_energy(spark, sf):
    """G16, G17, A29"""
    t = S.taper("x", 0.2)
    return _traces(spark, sf).withColumn("t", t).select("vec_id", F.round(S.dot(F.col("t"), F.col("t")), 5).alias("energy"))


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, lag(list_transform(embedding, lambda v: v::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings),
d AS (SELECT vec_id, list_inner_product(x, x) AS xx, list_inner_product(y, y) AS yy, list_inner_product(x, y) AS xy, list_sum(x) AS sx, list_sum(y) AS sy, len(x) AS n FROM p WHERE y IS NOT NULL)
SELECT vec_id, round((xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)), 5) AS cc, round(log10(abs(((xx + yy + sqrt(pow(xx - yy, 2) + 4 * xy * xy)) / 2 - yy) / xy)), 3) AS magnitude_step FROM d""")
def array_corr(spark, sf):
    """Correlation with the trace before, and log relative amplitude"""
    cc, ratio = S.correlation(F.col("x"), F.col("y")), S.amplitude_ratio(F.col("y"), F.col("x"))
    return _pairs(spark, sf).select("vec_id", F.round(cc, 5).alias("cc"), F.round(F.log10(F.abs(ratio)), 3).alias("magnitude_step"))


@query("""
WITH x AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)
SELECT label, round(sum(a * b) / sum(abs(a * b)), 6) AS resolved FROM x GROUP BY 1""")
def polarity_resolution(spark, sf):
    """G29"""
    x = _traces(spark, sf).select("label", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    return S.sign_weights(x, ["label"], "a", "b").withColumn("resolved", F.round("resolved", 6))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE ** 2) AS q, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS a FROM embeddings),
k AS (SELECT vec_id, q, a, k, k * log10(list_sum(q[1:k]) / (k - 1)) + (63 - k) * log10(list_sum(q[k + 1:64]) / (63 - k)) AS aic FROM e, range(5, 59) r(k)),
p AS (SELECT vec_id, any_value(q) AS q, any_value(a) AS a, arg_min(k, aic) AS k FROM k GROUP BY vec_id)
SELECT vec_id, k::INT AS pick, CASE WHEN k > 5 THEN round(0.707 * list_max(a[k + 1:59]) / sqrt(list_sum(q[6:k]) / (k - 5)), 5) END AS snr FROM p""")
def aic_pick(spark, sf):
    """G12; the ratio counts where there is noise before the pick"""
    found = P.on_matrices(lambda x: P.aic_picks(x, 5), "pick int, snr double", "x")
    p = _traces(spark, sf).select("vec_id", found.alias("f"))
    return p.select("vec_id", "f.pick", F.when(F.col("f.pick") > 5, F.round("f.snr", 5)).alias("snr"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), q AS (SELECT vec_id, x, list_transform(x, lambda v: v ** 2) AS q FROM e),
i AS (SELECT vec_id, i - 1 AS i, (list_sum(q[greatest(i - 2, 1):i]) / least(i, 3)) / (list_sum(q[greatest(i - 11, 1):i]) / least(i, 12)) AS r, CASE WHEN i = 1 THEN 0 ELSE abs(x[i] - x[i - 1]) END AS step FROM q, range(1, 65) r(i))
SELECT vec_id, coalesce(min(i) FILTER (r >= 2.5), arg_max(i, r))::INT AS pick, arg_max(i, step)::INT AS steepest FROM i GROUP BY vec_id""")
def sta_lta_pick(spark, sf):
    """G13, G14"""
    both = P.on_matrices(lambda x: (*P.sta_lta_picks(x, 3, 12, 2.5), *P.gradient_picks(x)), "pick int, steepest int", "x")
    return _traces(spark, sf).select("vec_id", both.alias("f")).select("vec_id", "f.*")


_LAGS = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
p AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM e),
k AS (SELECT vec_id, k, list_inner_product(x[greatest(1, 1 + k):least(64, 64 + k)], y[greatest(1, 1 - k):least(64, 64 - k)]) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)) AS c FROM p, range(-9, 10) r(k) WHERE y IS NOT NULL),
t AS (SELECT vec_id, arg_max(k, c) AS k FROM k WHERE abs(k) <= 8 GROUP BY vec_id),
n AS (SELECT vec_id, t.k, max(c) FILTER (k.k = t.k) AS c1, max(c) FILTER (k.k = t.k - 1) AS c0, max(c) FILTER (k.k = t.k + 1) AS c2 FROM t JOIN k USING (vec_id) GROUP BY ALL),
l AS (SELECT vec_id, k + greatest(-0.5, least(0.5, (c2 - c0) / (2 * (2 * c1 - c0 - c2)))) AS lag, c1 AS cc, abs(k) >= 7 AS edge FROM n)"""


@query(f"{_LAGS} SELECT vec_id, round(lag, 5) AS lag, round(cc, 6) AS cc, edge FROM l")
def xcorr_lag(spark, sf):
    """Every epoch against the one before of its station"""
    found = P.on_matrices(lambda a, b: P.correlation_lags(a, b, 8), "lag double, cc double, edge boolean", "y", "x")
    return _pairs(spark, sf).select("vec_id", found.alias("f")).select("vec_id", F.round("f.lag", 5).alias("lag"), F.round("f.cc", 6).alias("cc"), "f.edge")


@query(f"""{_LAGS},
f AS (SELECT vec_id, x, k, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(2 * pi() * k * i / 64))) ** 2 + list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(2 * pi() * k * i / 64))) ** 2 AS w
  FROM e, range(0, 33) r(k)),
c AS (SELECT vec_id, sqrt(list_inner_product(any_value(x), any_value(x)) / 64) AS rms, sum(w * k * 750) / sum(w) AS centroid FROM f GROUP BY vec_id)
SELECT vec_id, round(rms, 6) AS rms, round(centroid, 3) AS centroid, round(lag / 48000 * 1e6, 3) AS dt_us, round(cc, 6) AS cc, edge OR cc < 0.2 AS rejected FROM l JOIN c USING (vec_id)""")
def metric_battery(spark, sf):
    """Every epoch against the one before"""
    found = P.on_matrices(lambda a, b: P.metric_batteries(a, b, 48_000.0, 8, 0.2), "rms double, centroid double, dt_us double, cc double, rejected boolean", "y", "x")
    f = _pairs(spark, sf).select("vec_id", found.alias("f"))
    return f.select("vec_id", F.round("f.rms", 6).alias("rms"), F.round("f.centroid", 3).alias("centroid"), F.round("f.dt_us", 3).alias("dt_us"), F.round("f.cc", 6).alias("cc"), "f.rejected")


@query()
def warping(spark, sf):
    """G10, G11"""
    found = K.on_arrays(lambda a, b: K.warping_lag(a, b, 6), "lag double, misfit double", "y", "x")
    coarse = K.on_arrays(lambda a, b: K.envelope_lag(a, b, 6), "lag double, cc double, edge boolean", "y", "x")
    return _pairs(spark, sf).select("vec_id", found.alias("f"), coarse.alias("e")).select("vec_id", "f.lag", "f.misfit", F.col("e.lag").alias("coarse"))


@query()
def peaks_nms(spark, sf):
    """G05, G23"""
    return _traces(spark, sf).select("vec_id", K.on_arrays(lambda x: K.runs_of_peaks(x, 0.2, 4), "array<int>", "x").alias("peaks"))


@query("""
WITH s AS (SELECT vec_id % 3 AS channel, vec_id // 3 * 64 + i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i) WHERE vec_id % 41 <> 7),
t AS (SELECT vec_id // 3 AS template, vec_id % 3 AS channel, vec_id % 3 * 5 - 3 AS delay, k - 1 AS k, embedding[k + 16]::DOUBLE AS w FROM embeddings, range(1, 33) r(k) WHERE vec_id // 3 % 40 = 3),
c AS (SELECT template, channel, i - delay - k AS start, corr(v, w) AS cc FROM s JOIN t USING (channel) GROUP BY ALL HAVING count(*) = 32),
g AS (SELECT template, start, floor(start / 2048)::BIGINT AS period, sum(cc) AS stack, count(*) AS channels FROM c GROUP BY ALL),
h AS (SELECT *, 4.5 * median(abs(stack)) OVER (PARTITION BY template, period) AS threshold FROM g),
o AS (SELECT *, start - row_number() OVER (PARTITION BY template, period ORDER BY start) AS run FROM h WHERE abs(stack) >= threshold)
SELECT template::VARCHAR AS template, arg_max(start, abs(stack)) AS start, period, round(arg_max(stack, abs(stack)), 6) AS stack, arg_max(channels, abs(stack)) AS channels, round(any_value(threshold), 6) AS threshold
FROM o GROUP BY template, period, run""")
def matched_filter(spark, sf):
    """A record of three channels, in periods of 2048 samples, with templates that are delayed by channel"""
    e = _traces(spark, sf).withColumn("channel", F.col("vec_id") % 3).withColumn("place", F.expr("vec_id div 3"))
    samples = e.where("vec_id % 41 <> 7").select("channel", "place", F.posexplode("x").alias("k", "v"))
    record = samples.select("channel", (F.col("place") * 64 + F.col("k")).alias("i"), "v")
    templates = e.where("place % 40 = 3").select(F.col("place").alias("template"), "channel", (F.col("channel") * 5 - 3).alias("delay"), F.slice("x", 17, 32).alias("x"))
    found = detect.matched_filter(record, templates, "channel", "i", "v", "template", "delay", "x", "mad", 4.5, 2048)
    return found.withColumn("stack", F.round("stack", 6)).withColumn("threshold", F.round("threshold", 6))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
h AS (SELECT vec_id, label, list_transform(range(0, 64), lambda n: sqrt(x[n + 1] ** 2 + list_sum(list_transform(range(0, 64), lambda m: CASE WHEN (n - m) % 2 = 0 THEN 0 ELSE x[m + 1] * 2 / 64 / tan(pi() * (n - m) / 64) END)) ** 2)) AS v FROM e),
s AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: list_sum(v[greatest(1, i - 2):least(64, i + 2)]) / 5) AS x FROM h),
p AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM s),
k AS (SELECT vec_id, k, list_inner_product(x[greatest(1, 1 + k):least(64, 64 + k)], y[greatest(1, 1 - k):least(64, 64 - k)]) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)) AS c FROM p, range(-7, 8) r(k) WHERE y IS NOT NULL),
t AS (SELECT vec_id, arg_max(k, c) AS k FROM k WHERE abs(k) <= 6 GROUP BY vec_id),
n AS (SELECT vec_id, t.k, max(c) FILTER (k.k = t.k) AS c1, max(c) FILTER (k.k = t.k - 1) AS c0, max(c) FILTER (k.k = t.k + 1) AS c2 FROM t JOIN k USING (vec_id) GROUP BY ALL)
SELECT vec_id, round(k + greatest(-0.5, least(0.5, (c2 - c0) / (2 * (2 * c1 - c0 - c2)))), 4) AS coarse, round(c1, 6) AS cc FROM n""")
def envelope_lag(spark, sf):
    """Every epoch against the one before of its station"""
    found = P.on_matrices(lambda a, b: P.envelope_lags(a, b, 6), "lag double, cc double", "y", "x")
    return _pairs(spark, sf).select("vec_id", found.alias("f")).select("vec_id", F.round("f.lag", 4).alias("coarse"), F.round("f.cc", 6).alias("cc"))


@query("""
WITH e AS (SELECT vec_id, s, list_transform(embedding[s + 1:s + 32], lambda v: v::DOUBLE) AS x FROM embeddings, (SELECT unnest([0, 16, 32]) AS s)),
w AS (SELECT vec_id, s, list_transform(range(0, 32), lambda j: (x[j + 1] - list_sum(x) / 32) * (0.5 - 0.5 * cos(2 * pi() * j / 32))) AS x FROM e),
p AS (SELECT vec_id, k, avg((list_sum(list_transform(range(0, 32), lambda j: x[j + 1] * cos(2 * pi() * k * j / 32))) ** 2 + list_sum(list_transform(range(0, 32), lambda j: x[j + 1] * sin(2 * pi() * k * j / 32))) ** 2) / 1200) AS v FROM w, range(0, 17) r(k) GROUP BY ALL)
SELECT vec_id, k AS bin, round(v * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END, 8) AS power FROM p""")
def welch_power(spark, sf):
    """Power densities of windows of 32 samples at 100 a second"""
    found = P.on_matrices(lambda x: P.welch_powers(x, 100.0, 32), "power array<double>", "x")
    each = _traces(spark, sf).select("vec_id", F.posexplode(found["power"]).alias("bin", "power"))
    return each.select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("power", 8).alias("power"))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
f AS (SELECT vec_id, label, k, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(2 * pi() * k * i / 64))) ** 2 + list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(2 * pi() * k * i / 64))) ** 2 AS w FROM e, range(2, 27) r(k)),
p AS (SELECT vec_id, k, w, lag(w) OVER (PARTITION BY label, k ORDER BY vec_id) AS v FROM f)
SELECT vec_id, round(regr_slope(ln(w / v) / 2, k * 0.75), 6) AS slope FROM p WHERE v IS NOT NULL GROUP BY vec_id""")
def spectral_slope(spark, sf):
    """Per kHz, from 1 to 20 kHz"""
    found = P.on_matrices(lambda a, b: P.spectral_slopes(a, b, 48.0, 1.0, 20.0), "slope double", "y", "x")
    return _pairs(spark, sf).select("vec_id", F.round(found["slope"], 6).alias("slope"))


@query()
def spectra(spark, sf):
    """G15, G21"""
    centroid = K.on_arrays(lambda x: K.centroid_frequency(x, 48_000.0), "double", "x")
    filtered = K.on_arrays(lambda x: float((K.bandpass(x, 3000, 12_000, 48_000.0) ** 2).mean()), "double", "x")
    slope = K.on_arrays(lambda a, b: K.spectral_slope(a, b, 48_000.0, 1000, 20_000), "double", "y", "x")
    return _pairs(spark, sf).select("vec_id", centroid.alias("centroid"), filtered.alias("band_power"), slope.alias("slope"))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
p AS (SELECT vec_id, x, (lag(x) OVER (PARTITION BY label ORDER BY vec_id))[13:52] AS a FROM e),
k AS (SELECT vec_id, k, a, x[k + 1:k + 40] AS b FROM p, range(0, 25) r(k) WHERE a IS NOT NULL),
c AS (SELECT vec_id, list((list_inner_product(a, b) - list_sum(a) * list_sum(b) / 40) / sqrt((list_inner_product(a, a) - list_sum(a) ** 2 / 40) * (list_inner_product(b, b) - list_sum(b) ** 2 / 40)) ORDER BY k) AS c FROM k GROUP BY vec_id),
m AS (SELECT *, list_transform(c, lambda v: abs(v)) AS a FROM c),
n AS (SELECT *, list_position(a, list_max(a)) AS top,
  list_filter(range(1, 26), lambda i: a[i] > a[least(i + 1, 25)] AND a[i] > a[least(i + 2, 25)] AND a[i] > a[greatest(i - 1, 1)] AND a[i] > a[greatest(i - 2, 1)]) AS peaks FROM m)
SELECT vec_id, round(CASE WHEN top > 1 AND top < 25 AND a[top] >= 0.2 AND list_contains(peaks, top) AND len(peaks) > 1 THEN sign(c[top]) * (a[top] - greatest(
  coalesce(a[list_max(list_filter(peaks, lambda i: i < top))], -1), coalesce(a[list_min(list_filter(peaks, lambda i: i > top))], -1))) ELSE 0 END, 6) AS polarity FROM n""")
def relative_polarity(spark, sf):
    """The middle of the trace before against every trace"""
    pairs = _pairs(spark, sf).withColumn("y", F.slice("y", 13, 40))
    found = P.on_matrices(lambda a, b: P.pair_polarities(a, b, 0.2), "polarity double", "y", "x")
    return pairs.select("vec_id", F.round(found["polarity"], 6).alias("polarity"))


@query()
def svd_weights(spark, sf):
    """From the clusters' sums of products; no cluster goes to one task whole"""
    return stacks.first_weights(_traces(spark, sf).withColumn("cluster", F.floor(F.col("vec_id") / 25)), ["label", "cluster"], "vec_id", "x")


@query("""
WITH e AS (SELECT vec_id // 25 AS block, 500 * cos(radians(vec_id % 25 * 14.4)) AS east, 500 * sin(radians(vec_id % 25 * 14.4)) AS north, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
w AS (SELECT block, east, north, w, list_transform(range(0, 32), lambda j: x[16 * w + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 32))) AS x FROM e, range(0, 3) r(w)),
z AS (SELECT block, east, north, w, list_sum(list_transform(range(0, 32), lambda j: x[j + 1] * cos(2 * pi() * j / 32))) AS re, -list_sum(list_transform(range(0, 32), lambda j: x[j + 1] * sin(2 * pi() * j / 32))) AS im FROM w),
g AS (SELECT block, w, re, im, a * 30 AS azimuth, s, 2 * pi() * 2 * s * (east * sin(radians(a * 30)) + north * cos(radians(a * 30))) AS p FROM z, range(0, 12) r(a), (SELECT unnest([0.0005, 0.001]) AS s)),
t AS (SELECT block, azimuth, s, w, sum(re * cos(p) + im * sin(p)) AS re, sum(im * cos(p) - re * sin(p)) AS im, sum(cos(p)) AS c, sum(sin(p)) AS d, count(*) AS n FROM g GROUP BY ALL)
SELECT block, azimuth::DOUBLE AS azimuth, s::DOUBLE AS slowness, round(avg((re * re + im * im) / (n * n)), 8) AS power, round(avg((c * c + d * d) / (n * n)), 6) AS response FROM t GROUP BY ALL""")
def beam_power(spark, sf):
    """Every block of 25 traces as an array of stations on a ring"""
    e = _traces(spark, sf).withColumn("block", F.expr("vec_id div 25")).withColumn("a", F.radians((F.col("vec_id") % 25) * 14.4))
    placed = e.select("block", "x", (500 * F.cos("a")).alias("east"), (500 * F.sin("a")).alias("north"))
    found = stacks.beam_powers(placed, ["block"], "x", "east", "north", [float(z) for z in range(0, 360, 30)], [5e-4, 1e-3], 2.0, 100.0, 32)
    return found.select("block", "azimuth", "slowness", F.round("power", 8).alias("power"), F.round("response", 6).alias("response"))
