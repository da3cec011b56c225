import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import polarity, ranges, stacks
from lodestream.operators import clustering as C


def frame(spark, rows, extra="id int"):
    return spark.createDataFrame(rows, f"k string, {extra}, x array<double>")


def test_two_passes_drop_outliers(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=50)
    good = [base + rng.normal(size=50) * 0.1 for _ in range(12)]
    half = [base + rng.normal(size=50) * 1.0 for _ in range(3)]
    odd = [rng.normal(size=50) for _ in range(4)]
    rows = [("a", i, x.tolist()) for i, x in enumerate(good + half + odd)]
    rows += [("a", 90, [1.0] * 50), ("a", 91, [1.0, 2.0]), ("a", 92, None), (None, 93, [1.0]), ("b", 1, rng.normal(size=50).tolist())]
    got = {(r.k, r.id): r for r in stacks.two_pass_members(frame(spark, rows), ["k"], "id", "x", least=0.9).collect()}
    assert {i for (k, i), r in got.items() if k == "a" and r.member} == set(range(12))
    assert got["a", 90].cc is None and got["a", 91].cc is None and ("a", 92) not in got
    assert got["b", 1].member and got["b", 1].cc == pytest.approx(1)

    def unit(x):
        return x / np.sqrt((x * x).mean())

    same = [x for x in good + half + odd] + [np.ones(50)]
    one = sum(map(unit, same))
    one[:2] += unit(np.array([1.0, 2.0]))
    want = np.corrcoef(half[0], one)[0, 1]
    assert got["a", 12].first_cc == pytest.approx(want)


def test_phase_weighted_stack_on_known_phases(spark):
    t = np.arange(40) / 40
    shifts = [0, 0.2, 0.4, 0.1]
    waves = [np.cos(2 * np.pi * (4 * t) + p) * (i + 1) for i, p in enumerate(shifts)]
    rows = [("a", i, w.tolist()) for i, w in enumerate(waves)] + [("b", 0, [1.0, -1.0, 2.0]), ("c", 0, [0.0, 0.0])]
    got = {r.k: r for r in stacks.phase_weighted_stack(frame(spark, rows), ["k"], "x", 3.0).collect()}
    mean = abs(np.exp(1j * np.array(shifts)).mean())
    linear = sum(np.sqrt(2) * np.cos(2 * np.pi * 4 * t + p) for p in shifts)
    assert got["a"].n == 4 and np.allclose(got["a"].coherence, mean) and np.allclose(got["a"].linear, linear)
    assert np.allclose(got["a"].stacked, linear * mean**3)
    assert np.allclose(got["b"].coherence, 1) and got["c"].stacked == [0, 0]
    odd = np.random.default_rng(1).normal(size=(3, 7))
    z = stacks.analytic(odd)
    assert np.allclose(z.real, odd) and np.allclose(np.fft.fft(z, axis=1)[:, 4:], 0)


def test_principal_vectors_equal_the_decomposition(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 16)) + rng.normal(size=(200, 16)) * 0.01
    rows = [("a", i, x.tolist()) for i, x in enumerate(a)] + [("a", 900, [1.0, 2.0]), ("z", 1, [0.0, 0.0]), ("n", 1, None)]
    df = frame(spark, rows).repartition(9)
    got = stacks.principal_vectors(df, ["k"], "x", 5).where("n = 16").orderBy("rank").collect()
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose([r.sigma for r in got], s[:5]) and got[2].share == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
    for r, w in zip(got, v):
        assert abs(np.dot(r.vector, w)) == pytest.approx(1) and max(r.vector, key=abs) > 0
    weights = {r.id: r.weight for r in stacks.first_weights(df, ["k"], "id", "x").where("k = 'a' and id < 900").collect()}
    w = np.array([weights[i] for i in range(200)])
    assert abs(w @ u[:, 0]) == pytest.approx(1)
    basis = stacks.subspace_design(df, ["k"], "x", 0.999).where("k = 'a' and n = 16").count()
    assert basis == int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.999) + 1) == 3
    assert stacks.principal_vectors(df, ["k"], "x", 5).where("k in ('z', 'n')").count() == 0


def test_principal_vectors_of_many_keys_hold_few_matrices(spark, monkeypatch):
    monkeypatch.setattr(stacks, "_FEW", 60)  # 3 traces of 16 samples, and 5 of 12
    monkeypatch.setattr(stacks, "_HELD", 600)  # two matrices of 16 samples
    rng = np.random.default_rng(12)
    traces = {f"k{k}": rng.normal(size=(1 + k % 7, 16 if k % 2 else 12)) for k in range(40)}
    df = frame(spark, [(k, i, x.tolist()) for k, m in traces.items() for i, x in enumerate(m)]).repartition(5)
    got = {(r.k, r["rank"]): r for r in stacks.principal_vectors(df, ["k"], "x", 3).collect()}
    assert len(got) == sum(min(len(m), 3) for m in traces.values())
    for k, m in traces.items():
        _, s, v = np.linalg.svd(m, full_matrices=False)
        for i in range(min(len(m), 3)):
            assert got[k, i + 1].n == m.shape[1] and got[k, i + 1].sigma == pytest.approx(s[i]) and abs(np.dot(got[k, i + 1].vector, v[i])) == pytest.approx(1)
    few = stacks._gram(df.where("k = 'k1'").select("k", "x"), ["k"]).count()
    assert few == 16 * 17 // 2


def test_coherence_of_shifted_stations(spark):
    rng = np.random.default_rng(3)
    wave = rng.normal(size=400)
    shift = {"a": 0, "b": 7, "c": -4}
    record = {s: np.roll(wave, k) + rng.normal(size=400) * 0.05 for s, k in shift.items()}
    rows = [(s, i, float(v)) for s, x in record.items() for i, v in enumerate(x)]
    rows = [r for r in rows if r[:2] != ("c", 200)] + [("a", 3, None), (None, 1, 1.0), ("d", 5, 1.0)]
    df = spark.createDataFrame(rows, "station string, at long, value double").repartition(5)
    nodes = {"right": shift, "wrong": {"b": 30}}
    want = {}
    for node, lags in nodes.items():
        for start in range(-40, 440, 10):
            parts = []
            for s in "abc":
                at = np.arange(start + lags.get(s, 0), start + lags.get(s, 0) + 30)
                if at[0] >= 0 and at[-1] < 400 and not (s == "c" and (at == 200).any()):
                    parts.append(record[s][at])
            r = [abs(np.corrcoef(x, y)[0, 1]) for i, x in enumerate(parts) for y in parts[i + 1 :]]
            if r:
                want[node, start] = (np.mean(r), len(r))
    for chunk in (40, 1000):
        got = {(r.node, r.start): (r.coherence, r.pairs) for r in stacks.window_coherence(df, "station", "at", "value", nodes, 30, 10, chunk).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    high = stacks.window_coherence(df, "station", "at", "value", nodes, 30, 10, 100, least=0.9)
    assert {r.node for r in high.collect()} == {"right"}


def polarity_of(a, b, least):
    """One pair, sample by sample."""
    cc = np.array([np.corrcoef(a, b[k : k + len(a)])[0, 1] for k in range(len(b) - len(a) + 1)])
    m = np.abs(cc)
    n, top = len(m), int(m.argmax())
    peaks = [i for i in range(1, n - 1) if all(m[i] > m[min(max(i + s, 0), n - 1)] for s in (-2, -1, 1, 2))]
    if top in (0, n - 1) or m[top] < least or top not in peaks or len(peaks) < 2:
        return 0.0
    at = peaks.index(top)
    return float(np.sign(cc[top]) * (m[top] - max(m[p] for p in peaks[max(0, at - 1) : at] + peaks[at + 1 : at + 2])))


def test_polarity_matrix_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(polarity, "BLOCK", 8)
    monkeypatch.setattr(polarity, "_AT_ONCE", 3000)
    rng = np.random.default_rng(4)
    base = rng.normal(size=30)
    templates, detections = [], []
    for i in range(40):
        k = "hot" if i % 4 else "cold"
        templates.append((k, i, (rng.choice([-1, 1]) * base[5:20] + rng.normal(size=15) * 0.4).tolist()))
        detections.append((k, i, (rng.choice([-1, 1]) * base + rng.normal(size=30) * 0.4).tolist()))
    detections += [("hot", 100, [0.0] * 30), ("hot", 101, None), (None, 102, [1.0] * 30), ("hot", 103, [1.0, 2.0]), ("alone", 104, [1.0] * 30), ("hot", 105, rng.normal(size=22).tolist())]
    d = frame(spark, detections)
    got = polarity.polarity_matrix(frame(spark, templates), d, ["k"], "id", "x", 0.3)
    assert got.columns == ["k", "template", "detection", "polarity"]
    found = {(r.k, r.template, r.detection): r.polarity for r in got.collect()}
    want = {(k, i, j): polarity_of(np.array(a), np.array(b), 0.3) for k, i, a in templates for k2, j, b in detections if k == k2 and b and len(b) >= 15 and any(b)}
    want = {k: v for k, v in want.items() if v}
    assert found.keys() == want.keys() and len(want) > 50
    assert all(found[k] == pytest.approx(want[k]) for k in want)
    high = polarity.polarity_matrix(frame(spark, templates), d, ["k"], "id", "x", 0.3, level=0.4).count()
    assert high == sum(abs(v) > 0.4 for v in want.values())


@pytest.mark.parametrize("km", [5.0, 300.0, 2500.0, 9000.0])
def test_geodesic_pairs_equal_brute_force(spark, km):
    rng = np.random.default_rng(5)
    lat = np.concatenate([rng.uniform(-90, 90, 150), [90, -90, 90, 89.99, -89.99, 89.98, 0, 0, 0.001, 45, 45]])
    lon = np.concatenate([rng.uniform(-180, 180, 150), [0, 10, 170, 180, -20, 0, 180, -180, 179.999, 359.99, -0.01]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    df = spark.createDataFrame(rows + [(900, None, 1.0), (901, 91.0, 1.0), (902, float("nan"), 0.0)], "id int, lat double, lon double")
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1))) <= km
    got = [(r.id, r.id_r) for r in ranges.geodesic_join(df, df, "lat", "lon", km).select("id", "id_r").collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(near)))


def clusters(near, least):
    """DBSCAN with the least core id as a cluster's name."""
    n = len(near)
    core = near.sum(1) >= least
    name = np.where(core, np.arange(n), n)
    while True:
        new = np.array([min([name[j] for j in range(n) if core[j] and near[i, j]], default=n) if core[i] else n for i in range(n)])
        if (new == name).all():
            break
        name = new
    out = []
    for i in range(n):
        own = [i] if core[i] else [j for j in range(n) if core[j] and near[i, j]]
        out.append((i, int(name[own[0]]) if own else None, bool(core[i])))
    return out


@pytest.mark.parametrize("least", [1, 3, 6])
def test_density_clusters_in_space_and_on_the_sphere(spark, least):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 3)) + rng.integers(0, 3, (60, 1)) * 4, rng.uniform(-5, 15, (40, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, x double, y double, z double")
    near = np.sqrt(((x[:, None] - x) ** 2).sum(-1)) <= 1.5
    assert sorted(tuple(r) for r in C.dbscan(df, "id", ["x", "y", "z"], 1.5, least).collect()) == clusters(near, least)
    lat, lon = np.concatenate([rng.uniform(85, 90, 40), rng.uniform(-2, 2, 40)]), np.concatenate([rng.uniform(-180, 180, 40), 180 + rng.uniform(-2, 2, 40)])
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 90
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "id int, lat double, lon double")
    assert sorted(tuple(r) for r in C.dbscan_geodesic(df, "id", "lat", "lon", 90.0, least).collect()) == clusters(near, least)


def test_event_coherences_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(polarity, "BLOCK", 5)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3, 20))
    traces = {("hot" if e < 25 else "cold", e, c): base[c] * (e % 2) + rng.normal(size=20) for e in range(32) for c in range(3) if (e + c) % 7}
    traces["hot", 3, 1] = np.ones(20)
    rows = [(k, e, c, x.tolist()) for (k, e, c), x in traces.items()] + [("hot", 90, 0, None), ("hot", None, 0, [1.0]), ("hot", 91, 0, [1.0, 2.0]), (None, 92, 0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k string, e int, c int, x array<double>").repartition(6)
    want = {}
    for k in ("hot", "cold"):
        events = sorted({e for k2, e, _ in traces if k2 == k})
        for a in events:
            for b in events:
                cc = [np.corrcoef(traces[k, a, c], traces[k, b, c])[0, 1] for c in range(3) if (k, a, c) in traces and (k, b, c) in traces and np.ptp(traces[k, a, c]) > 0 and np.ptp(traces[k, b, c]) > 0] if a < b else []
                if len(cc) >= 2 and np.mean(cc) >= 0.2:
                    want[k, a, b] = (np.mean(cc), len(cc))
    got = {(r.k, r.a, r.b): (r.coherence, r.channels) for r in polarity.event_coherences(df, ["k"], "e", "c", "x", 0.2, 2).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("exact", [True, False])
def test_event_coherences_of_few_large_blocks(spark, monkeypatch, exact):
    for name, value in (("BLOCK", 2), ("_BLOCKS", 3), ("_LARGE", 20), ("_AT_ONCE", 40)):
        monkeypatch.setattr(polarity, name, value)
    rng = np.random.default_rng(10)
    base = rng.normal(size=(3, 20))
    traces = {(e, c): base[c] * (e % 2) + rng.normal(size=20) for e in range(40) for c in range(3) if (e + c) % 7}
    if exact:
        traces = {k: x.astype(np.float32).astype(float) for k, x in traces.items()}
    df = spark.createDataFrame([("hot", e, c, x.tolist()) for (e, c), x in traces.items()], "k string, e int, c int, x array<double>").repartition(6)
    found = polarity.event_coherences(df, ["k"], "e", "c", "x", 0.2, 2)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert ("array<float>" in plan) == exact
    got = {(r.a, r.b): (r.coherence, r.channels) for r in found.collect()}
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            cc = [np.corrcoef(traces[a, c], traces[b, c])[0, 1] for c in range(3) if (a, c) in traces and (b, c) in traces]
            if len(cc) >= 2 and np.mean(cc) >= 0.2:
                want[a, b] = (np.mean(cc), len(cc))
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k] == pytest.approx(want[k]) for k in want)
