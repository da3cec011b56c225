import numpy as np
import pytest

from lodestream.operators import ranges as R


@pytest.mark.parametrize("k", [1, 4, 400])
def test_k_nearest_with_copies_dense_places_and_rows_without_a_place(spark, k):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((60, 2)), rng.normal(size=(120, 2)) / 1000, rng.uniform(-500, 500, (30, 2))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None, 1.0), (901, float("nan"), 0.0), (902, 0.0, float("inf"))], "id long, x double, y double")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    want = sorted((i, r + 1, int(j), far[i, j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), far[i]))[:k]))
    got = sorted(tuple(r) for r in R.k_nearest(df, "id", ["x", "y"], k, 60.0).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_k_nearest_broadcasts_no_places(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 100, (300, 2)), [[900.0, 900.0], [5000.0, 0.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    want = sorted((i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), far[i]))[:4]))
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    monkeypatch.setattr("lodestream.storage.SMALL", -1)
    for few in (-1, 20):  # in the second run the two far places are sent
        monkeypatch.setattr(R, "FEW", few, raising=False)
        found = R.k_nearest(df, "id", ["x", "y"], 4, 60.0)
        assert sorted((r.id, r.rank, r.other) for r in found.collect()) == want
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert any("BroadcastExchange" in p for p in plans) == (few > 0)


def test_interval_join_deals_a_full_bucket_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "COMPARISONS", 5_000)
    points = spark.range(3000).selectExpr("id", "cast(id % 2 as int) as k", "double(id % 50) as x")
    spans = spark.range(40).selectExpr("id as s", "cast(id % 2 as int) as k", "double(id) as a", "double(id) + 3.5 as b")
    found = R.interval_join(points, spans, "x", "a", "b", 100.0, ["k"])
    want = sorted((p, s) for p in range(3000) for s in range(40) if p % 2 == s % 2 and s <= p % 50 < s + 3.5)
    assert sorted(map(tuple, found.select("id", "s").collect())) == want
    tasks = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(1 for n in tasks if n) > 10


def test_radius_join_of_copies_is_of_places(spark, tmp_path, monkeypatch):
    from lodestream.plans import spatial

    spark.range(3000).selectExpr("id as c_custkey", "1.5D as c_acctbal", "2 as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(2000).selectExpr("id as s_suppkey", "double(id % 2) * 60 as s_acctbal", "2 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs, join = [], R.radius_join
    monkeypatch.setattr(R, "radius_join", lambda *a: pairs.append(join(*a)) or pairs[-1])
    assert sorted(map(tuple, spatial.radius_join(spark, str(tmp_path)).collect())) == [(50.0, 3_000_000), (100.0, 6_000_000), (200.0, 6_000_000)]
    assert pairs[0].count() == 2


def test_radius_join_of_many_places_counts_pairs_without_making_them(spark, tmp_path, monkeypatch):
    from lodestream.plans import spatial

    rng = np.random.default_rng(6)
    x, y, u, v = rng.integers(0, 60_000, 900) / 100, rng.integers(0, 25, 900), rng.integers(0, 60_000, 400) / 100, rng.integers(0, 25, 400)
    x[:50], u[:50] = np.arange(50) * 10 + 0.1, np.arange(50) * 10 + 0.1  # many at exactly one of the radii
    x[50] = u[50] = 5000.0  # a cell of few places
    y[50] = v[50] = 7
    spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(u, v))], "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    far = np.sqrt((x[:, None] - u) ** 2 + ((y[:, None] - v) * 20.0) ** 2)
    pairs, join = [], R.radius_join
    monkeypatch.setattr(R, "radius_join", lambda *a: pairs.append(join(*a)) or pairs[-1])
    for name, n in (("PAIRED", 5_000), ("STEPS", 500), ("LEFT", 20), ("RIGHT", 60)):
        monkeypatch.setattr(R, name, n, raising=False)
    assert sorted(map(tuple, spatial.radius_join(spark, str(tmp_path)).collect())) == [(r, int((far <= r).sum())) for r in (50.0, 100.0, 200.0)]
    assert 0 < pairs[0].count() < 1_000 and (far <= 200).sum() > 100_000


@pytest.mark.parametrize("d", [1, 2, 3])
def test_count_within_as_all_pairs(d):
    rng = np.random.default_rng(d)
    x, y = ([np.round(rng.uniform(0, 8, k), 1) if i == 0 else rng.integers(0, 5, k) / 2 for i in range(d)] for k in (200, 150))
    n, m = rng.integers(1, 4, 200), rng.integers(1, 4, 150)
    far = np.sqrt(sum((a[:, None] - b) ** 2 for a, b in zip(x, y)))
    radii = [0.0, 0.5, 1.0, 2.5, 100.0]
    assert R.count_within(x, n, y, m, radii) == [int(((far <= r) * n[:, None] * m).sum()) for r in radii]
