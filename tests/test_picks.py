import numpy as np
import pytest

from lodestream.operators import picks as P


def lag_of(b, e, max_lag, guard=1):
    """One pair, lag by lag."""
    n = min(len(b), len(e))
    b, e = np.array(b[:n], float), np.array(e[:n], float)
    size = np.sqrt((b * b).sum() * (e * e).sum())
    if size == 0:
        return 0.0, 0.0, True
    cc = {k: sum(e[t + k] * b[t] for t in range(n) if 0 <= t + k < n) / size for k in range(-n + 1, n)}
    lags = [k for k in range(-max_lag, max_lag + 1) if k in cc]
    top = max(lags, key=lambda k: (cc[k], -k))
    sub = 0.0
    if top - 1 in cc and top + 1 in cc and abs(2 * cc[top] - cc[top - 1] - cc[top + 1]) > 1e-12:
        sub = np.clip((cc[top + 1] - cc[top - 1]) / (2 * (2 * cc[top] - cc[top - 1] - cc[top + 1])), -0.5, 0.5)
    at = lags.index(top)
    return top + sub, cc[top], at <= guard or at >= len(lags) - 1 - guard


def test_lags_equal_a_loop_and_nulls_stay(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=n).tolist(), rng.normal(size=m).tolist()) for i, (n, m) in enumerate([(20, 20)] * 15 + [(5, 9), (1, 1), (2, 3), (3, 3)])]
    rows += [(90, [0.0] * 4, [1.0] * 4), (91, None, [1.0]), (92, [1.0, None], [1.0, 2.0]), (93, [float("nan")], [1.0])]
    wave = rng.normal(size=60)
    rows.append((94, wave.tolist(), np.roll(wave, 4).tolist()))
    df = spark.createDataFrame(rows, "id int, b array<double>, e array<double>").repartition(3)
    f = P.on_matrices(lambda b, e: P.correlation_lags(b, e, 6), "lag double, cc double, edge boolean", "b", "e")
    got = {r.id: tuple(r)[1:] for r in df.select("id", f.alias("f")).select("id", "f.*").collect()}
    assert all(got[i] == (None, None, None) for i in (91, 92, 93))
    for i, b, e in rows:
        if i not in (91, 92, 93):
            assert got[i] == pytest.approx(lag_of(b, e, 6)), i
    assert abs(got[94][0] - 4) < 0.5 and not got[94][2]


def test_picks_find_onsets_and_edge_cases():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 200)) * 0.1
    x[:, 120:] += np.sin(np.arange(80)) * 3
    at, snr = P.aic_picks(x, 10)
    assert (abs(at - 120) <= 3).all() and (snr > 10).all()
    assert P.aic_picks(x, 10, least_snr=1e6)[0].tolist() == [0] * 5
    assert [v.tolist() for v in P.aic_picks(np.zeros((2, 50)))] == [[0, 0], [0, 0]]
    assert P.aic_picks(x[:, :10])[0].tolist() == [0] * 5
    first = P.sta_lta_picks(x, 5, 50, 5.0)[0]
    assert (abs(first - 121) <= 2).all()
    assert P.sta_lta_picks(np.zeros((2, 0)), 2, 4, 3.0)[0].tolist() == [0, 0]
    steps = np.array([[0.0, 1.0, 5.0, 5.5], [0.0, 0.0, 0.0, 0.0]])
    assert P.gradient_picks(steps)[0].tolist() == [2, 0]
    assert P.pair_polarities(np.ones((1, 5)), np.ones((1, 3)), 0.1)[0].tolist() == [0.0]
