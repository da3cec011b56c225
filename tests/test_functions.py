import math

import pytest

from lodestream.functions import geo as G
from lodestream.functions import text as X
from lodestream.functions import times as D
from lodestream.operators import relational as R
from lodestream.operators import stats as S
from pyspark.sql import functions as F


def test_utm_known_place(spark):
    # the projection's defining values on the central meridian, and a published point (45 N, 10 E in zone 32)
    row = spark.range(1).select(*G.to_utm(F.lit(0.0), F.lit(9.0), 32), *G.to_utm(F.lit(45.0), F.lit(10.0), 32)).first()
    assert row[0] == pytest.approx(500_000, abs=1e-6) and row[1] == pytest.approx(0, abs=1e-6)
    assert row[2] == pytest.approx(578_815.30, abs=0.02) and row[3] == pytest.approx(4_983_436.77, abs=0.02)


def test_lookup_raises_on_unknown_and_keeps_null(spark):
    df = spark.createDataFrame([(" Lat ",), (None,)], "x string")
    assert [r[0] for r in df.select(X.lookup(F.col("x"), {"lat": "latitude"})).collect()] == ["latitude", None]
    with pytest.raises(Exception, match="unknown field depth"):
        spark.createDataFrame([("depth",)], "x string").select(X.lookup(F.col("x"), {"lat": "latitude"})).collect()


def test_key_values_first_wins(spark):
    got = spark.createDataFrame([("a: 1; b: x: y; a: 2; junk",)], "x string").select(X.key_values(F.col("x"))).first()[0]
    assert got == {"a": "1", "b": "x: y"}


def test_local_zones(spark):
    df = spark.createDataFrame([("2024-07-01 12:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    row = df.select(D.local_to_utc(F.col("t"), "CET"), D.local_to_utc(F.col("t"), "Etc/GMT+2")).first()
    assert (row[0].hour, row[1].hour) == (10, 14)


def test_magnitude_relations(spark):
    row = spark.range(1).select(G.magnitude(G.moment(F.lit(2.5))), G.moment(F.lit(0.0)), G.moment_from_local(F.lit(0.73), "linear")).first()
    assert row[0] == pytest.approx(2.5) and row[1] == pytest.approx(10**13.5) and row[2] == pytest.approx(1e9)


def test_empty_inputs_and_null_keys(spark):
    a = spark.createDataFrame([(None, 1, "x"), (2, None, "y")], "k int, v int, w string")
    b = spark.createDataFrame([(None, 5, 7.0), (3, 6, 8.0)], "k int, v int, z double")
    got = sorted(map(str, map(tuple, R.merge_full([a, b], ["k"]).collect())))
    assert got == sorted(map(str, [(None, 1, "x", 7.0), (2, None, "y", None), (3, 6, None, 8.0)]))
    assert R.sigma_clip(a.limit(0), "v", 2).count() == 0
    assert R.zip_rows(a, b, [F.col("w")], [F.col("z")]).select("position", "w", "z").count() == 2
    assert S.b_value_lsq(a.limit(0), "v", 0, 1, 5).first().b is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.999,), (4.0,), (5.0,), (5.1,), (None,)], "v double")
    assert [r.n for r in S.dense_histogram(df, "v", 0.0, 1.0, 5).orderBy("bin").collect()] == [2, 0, 0, 0, 2]


def test_equal_b_values_are_likely(spark):
    p = spark.range(1).select(S.utsu_probability(F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(1.0)), S.utsu_probability(F.lit(500.0), F.lit(500.0), F.lit(1.0), F.lit(2.0))).first()
    assert p[0] == pytest.approx(math.exp(-1)) and p[1] < 1e-6
