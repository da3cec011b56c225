from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestream.streaming import ingest as I


def rows(start, n, channel="a"):
    return [(channel, datetime(2024, 1, 1) + timedelta(seconds=start + i), float(i % 7)) for i in range(n)]


SCHEMA = "channel string, ts timestamp, value double"


def test_append_drops_duplicates_and_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = spark.createDataFrame(rows(0, 20) + rows(0, 5), SCHEMA)
    first.write.parquet(src)
    for _ in range(2):
        stream = I.file_stream(spark, src, first.schema, pattern="*.parquet")
        I.append(I.distinct_events(stream, ["channel", "ts"], "ts", "1 hour"), out, check)
        assert spark.read.parquet(out).count() == 20
    spark.createDataFrame(rows(15, 10), SCHEMA).write.mode("append").parquet(src)
    I.append(I.distinct_events(I.file_stream(spark, src, first.schema), ["channel", "ts"], "ts", "1 hour"), out, check)
    assert spark.read.parquet(out).count() == 25


def test_windows_batches_and_checks(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows(0, 100), SCHEMA)
    df.write.parquet(src)
    seen = []
    stream = I.file_stream(spark, src, df.schema)
    I.each_batch(stream, str(tmp_path / "c1"), lambda b: b.count() > 0, lambda b, n: seen.append(b.count()))
    assert seen == [100]
    with pytest.raises(Exception, match="failed its check"):
        I.each_batch(I.file_stream(spark, src, df.schema), str(tmp_path / "c2"), lambda b: False, lambda b, n: None)
    out = str(tmp_path / "w")
    I.append(I.windowed_means(I.file_stream(spark, src, df.schema), "ts", "10 seconds", ["channel"], "value", "5 seconds"), out, str(tmp_path / "c3"))
    got = {r.bucket.second: r.n for r in spark.read.parquet(out).collect() if r.bucket.minute == 0}
    assert got[0] == 10 and got[50] == 10


def test_triggers_keep_their_state(spark, tmp_path):
    quiet = np.random.default_rng(0).normal(0, 0.1, 60)
    data = [(c, datetime(2024, 1, 1) + timedelta(seconds=i), float(v if i < 40 or c == "c" else v + 5)) for c in "abc" for i, v in enumerate(quiet)]
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    early, late = [r for r in data if r[1] < datetime(2024, 1, 1, 0, 0, 30)], [r for r in data if r[1] >= datetime(2024, 1, 1, 0, 0, 30)]
    for part in (early, late):
        df = spark.createDataFrame(part, SCHEMA)
        df.write.mode("append").parquet(src)
        I.append(I.trigger_states(I.file_stream(spark, src, df.schema), "channel", "ts", "value", 2, 20, 5.0), out, check)
    found = spark.read.parquet(out)
    starts = {r.channel: r.first for r in found.groupBy("channel").agg({"ts": "min"}).withColumnRenamed("min(ts)", "first").collect()}
    assert set(starts) == {"a", "b"} and all(t.second == 40 for t in starts.values())
    assert I.coincidences(found, "channel", "ts", "10 seconds", 2).count() == 1


def test_manifest(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, size long")
    assert not I.changed(a, a) and I.changed(a, a.limit(1)) and I.changed(a, a.selectExpr("path", "size + 1 as size"))
