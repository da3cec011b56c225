import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.functions import times as D
from lodestream.operators import ranges as R
from lodestream.operators import timeseries as T
from pyspark.sql import functions as F


def greedy(times, strength, apart):
    taken = []
    for i in sorted(range(len(times)), key=lambda i: (-strength[i], times[i])):
        if all(abs(times[i] - times[j]) >= apart for j in taken):
            taken.append(i)
    return sorted(taken)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5)), max_size=25), st.integers(1, 9))
def test_strongest_first(points, apart):
    t, s = (np.array([p[i] for p in points], float) for i in (0, 1))
    kept = T.strongest_first(t, s, apart).tolist()
    assert sorted(t[kept].tolist()) == sorted(t[greedy(t, s, apart)].tolist())


def test_decluster_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(4000)), float(rng.randrange(50)) + i / 1000, i) for i, k in enumerate("ab" * 150)]
    got = {r.id for r in T.decluster(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, id int"), ["k"], "ts", "v", 30).collect()}
    want = set()
    for k in "ab":
        part = [r for r in rows if r[0] == k]
        want |= {part[i][3] for i in greedy([(r[1] - datetime(2024, 1, 1)).total_seconds() for r in part], [r[2] for r in part], 30)}
    assert got == want


def test_interpolation_ends(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [("b", 0, None)], "k string, t int, v double")
    got = [r.v for r in T.interpolate(df, "v", ["k"], "t").orderBy("k", "t").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0, None]


def test_nearest_ties_and_no_partner(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 0), (3, "k", 9), (4, "none", 1), (5, "k", 4)], "id int, k string, t long")
    right = spark.createDataFrame([(10, "k", 4), (11, "k", 6), (12, "k", 4)], "rid int, k string, t long")
    got = {r.id: r.nearest.rid if r.nearest else None for r in R.nearest(left, right, "t", ["k"], ["rid"]).collect()}
    assert got == {1: 10, 2: 10, 3: 11, 4: None, 5: 10}


@pytest.mark.parametrize("text, want", [(["1/2/24 3:4:5"] * 5, "2024-01-02 03:04:05"), (["0.25"] * 5, "2024-03-01 06:00:00"), (["45292.5"] * 5, "2024-01-01 12:00:00"), (["2024-05-06 01:02:03"] * 4 + ["x"], "2024-05-06 01:02:03")])
def test_injection_times_by_vote(spark, text, want):
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert str(D.parse_injection_times(df, "t", "2024-03-01").first().ts) == want


def test_voted_format(spark):
    df = spark.createDataFrame([("2024/01/02",), ("03.04.2024",)], "t string")
    got = [r.ts for r in D.parse_voted(df, "t", ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy"]).collect()]
    assert got == [datetime(2024, 1, 2), None]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert T.decluster(df, ["k"], "ts", "v", 1).count() == 0
    assert T.islands(df, ["k"], F.col("ts"), F.col("ts")).count() == 0


def test_windows_over_hot_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_A_WINDOW", 7)
    rng = np.random.default_rng(12)
    keys = rng.choice(["hot", "cold", None], 400, p=[0.8, 0.15, 0.05])
    rows = [(i, None if k is None else str(k), int(t), float(v)) for i, (k, t, v) in enumerate(zip(keys, rng.permutation(4000)[:400], rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "id int, k string, t int, v double").repartition(9)
    by = {}
    for r in sorted(rows, key=lambda r: r[2]):
        by.setdefault(r[1], []).append(r)

    got = {r.id: r["_i"] for r in T.number_within(df, ["k"], ["t"]).collect()}
    assert got == {r[0]: n for part in by.values() for n, r in enumerate(part, 1)}

    got = {r.id: r.short for r in T.short_runs(df, F.col("v") > -0.3, ["k"], ["t"], 3).collect()}
    want = {}
    for part in by.values():
        runs = [list(g) for _, g in itertools.groupby(part, key=lambda r: r[3] > -0.3)]
        for n, run in enumerate(runs):
            for r in run:
                want[r[0]] = r[3] > -0.3 and 0 < n < len(runs) - 1 and len(run) <= 3
    assert got == want and any(want.values())

    got = {r.id: r.clean for r in T.despike(df.where("k is not null"), "v", ["k"], ["t"], 3.0).collect()}
    for k in ("hot", "cold"):
        v = np.array([r[3] for r in by[k]])
        m = np.array([np.median(v[max(0, i - 1) : i + 2]) for i in range(len(v))])
        d = np.abs(v - m)
        s = np.median(np.abs(d - np.median(d)))
        assert np.allclose([got[r[0]] for r in by[k]], np.where(d > 3 * s, m, v))

    left = spark.createDataFrame(rows[:150] + [(900, "hot", None, 0.0), (901, "none", 5, 0.0)], df.schema).repartition(5)
    right = spark.createDataFrame(rows[150:] + [(902, "hot", None, 0.0)], df.schema).repartition(6)
    got = {r.id: None if r.nearest is None else r.nearest.id for r in R.nearest(left, right, "t", ["k"], ["id"]).collect()}
    want = {900: None, 901: None}
    for r in rows[:150]:
        others = [(abs(x[2] - r[2]), x[2], x[0]) for x in rows[150:] if x[1] == r[1]]
        want[r[0]] = min(others)[2] if others else None
    assert got == want


def test_rolling_statistics_in_long_frames(spark):
    draw = random.Random(5)
    odd = [None, float("nan"), float("inf"), 1e13]
    values = [draw.choice(odd) if i % 97 == 5 else round(draw.gauss(50, 20), 2) if i < 500 else 7.25 for i in range(700)]
    seconds = sorted(draw.randrange(0, 30_000) for _ in values)
    rows = [(i, "a" if i % 5 else None, None if i % 50 == 9 else s, v) for i, (s, v) in enumerate(zip(seconds, values))]
    df = spark.createDataFrame(rows, "id long, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r.id: r for r in T.rolling_statistics(df, ["k"], "ts", 3600, 5400, "v").collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, k, s, _ in rows:
        frame = np.array([v for _, o, t, v in rows if o == k and v is not None and ((s is None and t is None) or (None not in (s, t) and s - 3600 < t <= s))])
        with np.errstate(all="ignore"):
            if not len(frame):
                assert (got[i].mean, got[i].med, got[i].sd) == (None, None, None)
                continue
            middle = np.sort(frame)[[(len(frame) - 1) // 2, len(frame) // 2]]
            want = [frame.mean(), middle[0] if middle[0] == middle[1] else middle.mean(), frame.std(ddof=1) if len(frame) > 1 else np.nan]
        assert (got[i].sd is None) == (len(frame) == 1)
        assert [got[i].mean, got[i].med, np.nan if got[i].sd is None else got[i].sd] == pytest.approx(want, rel=1e-6, abs=1e-9, nan_ok=True)


def test_a_step_of_a_rolling_median_costs_what_enters_and_leaves():
    t = np.arange(200_000)
    v = (t * 7919 % 100_003).astype(float)
    _, med, _ = T.frame_statistics(t, v, t, 50_000)
    assert med[-1] == np.median(v[-50_000:]) and med[60_000] == np.median(v[10_001:60_001])
