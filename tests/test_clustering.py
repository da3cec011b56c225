import random

import numpy as np

from lodestream.operators import clustering as C
from lodestream.operators.components import components


def test_components_as_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000), (None, 3), (2000, 1)]
    group = {}
    for a, b in edges:
        if a is not None:
            group.setdefault(a, a), group.setdefault(b, b)
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    found = components(spark.createDataFrame(edges, "a long, b long"))
    rows = found.collect()
    assert {r.node: r.root for r in rows} == {k: min(j for j in group if group[j] == g) for k, g in group.items()} and len(rows) == len(group)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_cosine_pairs_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 5 else 3).tolist()) for i in range(60)]
    rows += [(100, [0.0] * 4), (101, None), (102, [1.0, None, 1.0, 1.0]), (103, []), (None, [1.0] * 4), (104, rows[1][1])]
    want = set()
    for i, v in rows[:60] + rows[-1:]:
        for j, w in rows[:60] + rows[-1:]:
            if i < j and len(v) == len(w) and 1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) <= 0.4:
                want.add((i, j))
    found = C.cosine_pairs(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", 0.4).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_density_clusters_of_dense_places_store_no_pairs(spark, monkeypatch):
    """30,000 rows in two dense strips, of which all pairs would be 450 million, with copies, a bridge and noise."""
    from lodestream.operators import clustering as C

    written = []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df: written.append(cut(df)) or written[-1])
    strip = "case when id < 15000 then (id % 5000) / 5000 else 3.5 + (id % 5000) / 5000 end as x"
    odd = [(30_000, 1.75), (30_001, 2.625), (30_002, 9.0), (30_003, None), (30_004, float("nan")), (30_005, 9.5), (30_006, 5.25)]
    df = spark.range(30_000).selectExpr("id", strip).union(spark.createDataFrame(odd, "id long, x double"))
    got = {r.id: (r.cluster, r.core) for r in C.dbscan(df, "id", ["x"], 1.0, 3).collect()}
    assert len(got) == 30_007
    assert {got[i] for i in range(30_000)} == {(0, True)} and got[30_000] == (0, True) == got[30_001] == got[30_006]
    assert all(got[i] == (None, False) for i in (30_002, 30_003, 30_004, 30_005))
    assert sum(t.count() for t in written) < 100_000


def test_cosine_links_connect_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 40)
    x = np.random.default_rng(8).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>")
    pairs, links = C.cosine_pairs(df, "id", "e", 0.01), C.cosine_links(df, "id", "e", 0.01)
    assert sorted(map(tuple, components(pairs).collect())) == sorted(map(tuple, components(links).collect()))
    full = C.cosine_links(df, "id", "e", 2.0).count()  # every vector is near every other: 44,850 pairs
    assert 299 <= full <= 36 * 80


def test_pairwise_cosine_is_of_all_pairs(spark, tmp_path, monkeypatch):
    from lodestream.plans import spatial

    monkeypatch.setattr(C, "BLOCK", 30)
    monkeypatch.setattr(C, "PAIRS", 200, raising=False)
    x = np.random.default_rng(9).normal(size=(100, 8)).astype(np.float32)
    x[1], x[2] = -x[0], x[0]  # as far from each other as can be, and copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    found = {(r.a, r.b): r.d for r in spatial.pairwise_cosine(spark, str(tmp_path)).collect()}
    assert set(found) == {(i, j) for j in range(100) for i in range(j)} and found[0, 1] == 2.0 and found[0, 2] == 0.0
    assert all(abs(d - far[p]) < 1e-4 for p, d in found.items())


def test_cosine_distance_of_large_and_small_parts(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [0.0, 1e-200])]
    found = {(r.a, r.b): r.d for r in C.cosine_pairs(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", 3.0).collect()}
    assert set(found) == {(0, 1), (0, 2), (1, 2)}
    assert np.allclose([found[0, 1], found[0, 2], found[1, 2]], [1 - 0.5**0.5, 1.0, 1 - 0.5**0.5])
