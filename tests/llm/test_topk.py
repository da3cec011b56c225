import math
import random

import numpy as np
import pytest

from lodestream.llm import topk


def brute(rows, k, every):
    rows = [(i, v) for i, v in rows if not (i is None or v is None or any(x is None or not math.isfinite(x) for x in v))]
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for n, (i, e) in enumerate(q):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(e, f)), j) for m, (j, f) in enumerate(q) if m != n and len(f) == len(e))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, at_once", [(5, 2048), (3, 4), (60, 2048)])
def test_top_k_as_brute_force(spark, monkeypatch, k, at_once):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", at_once)
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 260)]  # ties
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(500, []), (501, []), (550, [3.0, 2.0]), (600, [1e6, -1e6, 0.0, 0.0, 0.0, 0.0]), rows[3], rows[10], (601, [7e4, 1e6, 1 / 3, 0.0, 0.0, 1e7]), (610, [3.3e6, 1e6, 5e6, -7.7, 1e-9, 1e6]), (0, [9.0] * 6), (-50, [0.1] * 6)]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = topk.top_k(df, k=k, every=10)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows, k, 10)


def test_scores_are_exact_or_raise():
    rng = random.Random(2)
    for size in (1.0, 1e7, 1e8, 2e8):
        a, b = ([[float(math.floor(rng.gauss(0, size) if rng.random() < 0.3 else rng.gauss(0, 9))) for _ in range(5)] for _ in range(8)] for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(q, v)) for v in b] for q in a]
        assert topk._scores(np.array(b), np.array(a)).tolist() == want
    with pytest.raises(OverflowError):
        topk._scores(np.array([[1e15, 0.0]]), np.array([[1e15, 1.0]]))


def test_empty_and_without_queries(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).collect() == []
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(df).collect() == []


def test_scores_that_just_fit_a_long(spark):
    rows = [(i, [x]) for i, x in enumerate([1.18e7, -1.18e7, 1.17e7, 1.0, 0.0, -1.0, 1.18e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, k=3, every=1).collect()))
    assert got == brute(rows, 3, 1) and max(abs(r[3]) for r in got) > 2**62
