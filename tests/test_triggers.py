from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestream.streaming import ingest
from lodestream.streaming import triggers as T

START = datetime(2024, 1, 1)
SCHEMA = "network string, station string, channel string, ts timestamp, seq long, value double"


def test_recursive_mean_in_blocks():
    x = np.random.default_rng(0).normal(size=1000) ** 2
    for n in (0, 1, 127, 128, 129, 1000):
        y, want = 0.7, []
        for v in x[:n]:
            y += (v - y) / 13
            want.append(y)
        assert np.allclose(T.recursive_mean(x[:n], 0.7, 13), want)


def walk(ratio, t, on, off, longest, opened):
    """Triggers sample by sample: (first or None, end or None)."""
    out, since, first = [], opened, None
    for k in range(len(t)):
        if since is not None and (ratio[k] < off or t[k] > since + longest):
            out.append((first, k))
            since = first = None
        if since is None and ratio[k] >= on:
            since, first = t[k], k
    if since is not None:
        out.append((first, None))
    return out


def test_onsets_equal_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        ratio, t = rng.uniform(0, 4, n), np.cumsum(rng.integers(0, 3, n))
        for opened in (None, int(t[0]) - 3):
            assert list(T.onsets(ratio, t, 3.0, 1.0, 6, opened)) == walk(ratio, t, 3.0, 1.0, 6, opened)


def averages(samples, short, long, on, off, longest, end):
    """(on, off) in seconds of a channel's triggers; `samples` is (second, value)."""
    sta = lta = 0.0
    ratio, t = [], []
    for k, (s, v) in enumerate(samples):
        sta, lta = sta + (v * v - sta) / short, lta + (v * v - lta) / long
        ratio.append(sta / lta if k + 1 >= long and lta > 0 else 0.0)
        t.append(s)
    return [(t[a], t[b - 1] if b is not None else end) for a, b in walk(ratio, t, on, off, longest, None)]


def record(seed, bursts, n=200):
    x = np.random.default_rng(seed).normal(size=n) * 0.1
    for a, b in bursts:
        x[a:b] += 5
    return [(i, float(v)) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Triggers of four channels that arrive in three parts, the third long after the others."""
    path = tmp_path_factory.mktemp("triggers")
    channels = {"a": record(1, [(50, 60), (120, 150)]), "b": record(2, [(52, 58), (125, 140)]), "c": record(3, [(54, 70)]), "d": record(4, [(190, 200)])}
    rows = [("n", s, "Z", START + timedelta(seconds=i), i, v) for s, x in channels.items() for i, v in x]
    rows += [("n", None, "Z", START, 0, 1.0), ("n", "a", "Z", None, 0, 1.0), ("n", "a", "Z", START, 0, None)]
    parts = [[r for r in rows if r[3] is None or r[3] < START + timedelta(seconds=55)], [r for r in rows if r[3] is not None and r[3] >= START + timedelta(seconds=55)]]
    parts.append([("n", "e", "Z", START + timedelta(hours=1), 0, 0.0)])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = ingest.file_stream(spark, f"{path}/in", spark.createDataFrame([], SCHEMA).schema)
        ingest.append(T.channel_triggers(stream, "0 seconds", 2, 20, 3.0, 1.0, 25.0, 60.0), f"{path}/out", f"{path}/check")
    return path, channels, spark.read.schema(T.TRIGGERS).parquet(f"{path}/out")


def test_triggers_go_on_over_parts_and_end_with_silence(found):
    _, channels, out = found
    base = int((START - datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.station, r.on_us / 1e6 - base, r.off_us / 1e6 - base) for r in out.collect())
    want = sorted((s, a, b) for s, x in channels.items() for a, b in averages(x, 2, 20, 3.0, 1.0, 25, 199))
    assert got == want
    last = max((r for r in out.collect() if r.station == "d"), key=lambda r: r.off_us)
    assert last.known_us / 1e6 - base == pytest.approx(199 + 60, abs=0.01)  # its channel fell silent with the trigger open


def test_coincidences_are_final_once(spark, found):
    path, _, out = found
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 10**6
    far = ("x", "x", "Z", base + 10**12, base + 10**12, base + 10**12, 0.0, 1)
    rows = sorted((tuple(r) for r in out.collect()), key=lambda r: r[5])
    for part in (rows[:2], rows[2:], [far]):
        spark.createDataFrame(part, T.TRIGGERS).coalesce(1).write.mode("append").parquet(f"{path}/in2")
        stream = ingest.file_stream(spark, f"{path}/in2", out.schema)
        ingest.append(T.network_coincidences(stream, "30 seconds", 2, 25.0), f"{path}/out2", f"{path}/check2")
    got = sorted(tuple(r) for r in spark.read.schema(T.COINCIDENCES).parquet(f"{path}/out2").collect())
    groups, end = [], None
    for r in sorted(rows, key=lambda r: r[3:5]):
        if end is None or r[3] > end:
            groups.append([])
            end = r[4]
        groups[-1].append(r)
        end = max(end, r[4])
    want = [("n", g[0][3], max(r[4] for r in g), len({r[1] for r in g}), len(g), max(r[6] for r in g)) for g in groups if len({r[1] for r in g}) >= 2]
    assert got == want and len(want) >= 2
