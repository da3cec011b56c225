import numpy as np

from lodestream.operators import events as E


def test_large_systems_are_solved_by_blocks(spark, monkeypatch):
    """Systems over the size of one matrix give its solution, beside a small key, an odd one and repeated entries."""
    monkeypatch.setattr(E, "DENSE_COLUMNS", 20)
    rng = np.random.default_rng(4)
    rows = [(k, int(r), int(c) * 3, float(rng.integers(1, 50)), float(r % 17)) for k, n, m in (("a", 900, 300), ("b", 60, 12)) for r in range(n) for c in rng.integers(0, m, 3)]
    rows += [("c", r, c, float("nan") if r == 5 else 1.0, 1.0) for r in range(40) for c in range(30)]
    got = {(r.k, r.c): r.solution for r in E.least_squares(spark.createDataFrame(rows, "k string, r long, c long, v double, d double"), ["k"], "r", "c", "v", "d", 1.0).collect()}
    for k in "ab":
        names = sorted({c for q, _, c, _, _ in rows if q == k})
        a, d = np.zeros((len(names), len(names))), np.zeros(len(names))
        by: dict = {}
        for q, r, c, v, t in rows:
            if q == k:
                by.setdefault(r, []).append((names.index(c), v, t))
        for line in by.values():
            for i, v, t in line:
                d[i] += v * t
                for j, w, _ in line:
                    a[i, j] += v * w
        assert np.allclose([got[k, c] for c in names], np.linalg.solve(a + np.eye(len(names)), d), rtol=1e-9, atol=1e-11)
    assert all(got["c", c] is None for c in range(30)) and len({k for k, _ in got}) == 3
