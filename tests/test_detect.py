import numpy as np
import pytest

from lodestream.operators import detect as D


def brute_force(record, templates, kind, level, period):
    """record: {channel: {i: v}}; templates: {name: [(channel, delay, samples)]}."""
    out = []
    for name, parts in templates.items():
        stack = {}
        for c, d, x in parts:
            own = record.get(c, {})
            for s in {i - d - k for i in own for k in range(len(x))}:
                window = [own.get(s + d + k) for k in range(len(x))]
                if None not in window:
                    flat = np.ptp(window) == 0 or np.ptp(x) == 0
                    v, n = stack.get(s, (0.0, 0))
                    stack[s] = (v + (0.0 if flat else np.corrcoef(window, x)[0, 1]), n + 1)
        for p in {s // period for s in stack}:
            starts = sorted(s for s in stack if s // period == p)
            size = np.abs([stack[s][0] for s in starts])
            threshold = {"mad": level * np.median(size), "absolute": level * len(parts), "average": level * size.mean()}[kind]
            run = []
            for s in [*starts, None]:
                if s is not None and abs(stack[s][0]) >= threshold and (not run or s == run[-1] + 1):
                    run.append(s)
                    continue
                if run:
                    top = max(run, key=lambda r: (abs(stack[r][0]), -r))
                    out.append((name, top, p, stack[top][0], stack[top][1], threshold))
                run = [s] if s is not None and abs(stack[s][0]) >= threshold else []
    return sorted(out)


@pytest.mark.parametrize("kind, level", [("mad", 4.0), ("absolute", 0.5), ("average", 3.0)])
def test_detections_equal_brute_force(spark, monkeypatch, kind, level):
    monkeypatch.setattr(D, "BLOCK", 2)
    rng = np.random.default_rng(3)
    record = {c: {i: float(v) for i, v in zip(range(-40, 260), rng.normal(size=300))} for c in "abc"}
    templates = {}
    for t in range(5):
        parts = [(c, int(rng.integers(-6, 9)), rng.normal(size=12)) for c in "abc"[: 2 + t % 2]] + ([("lacking", 0, rng.normal(size=12))] if t == 4 else [])
        templates[f"t{t}"] = parts
        for c, d, x in parts[:3]:
            for k, v in enumerate(x):
                record.get(c, {})[5 + 40 * t + d + k] = float(3 * v + rng.normal() * 0.1)
    for i in (100, 101):
        del record["b"][i]
    rows = [(c, i, v) for c, own in record.items() for i, v in own.items()] + [("a", None, 1.0), (None, 5, 1.0), ("a", 5000, None)]
    t_rows = [(n, c, d, x.tolist()) for n, parts in templates.items() for c, d, x in parts] + [("bad", "a", None, [1.0, 2.0]), ("bad", "a", 0, None)]
    r = spark.createDataFrame(rows, "c string, i long, v double").repartition(4)
    t = spark.createDataFrame(t_rows, "t string, c string, d int, x array<double>")
    got = sorted(tuple(x) for x in D.matched_filter(r, t, "c", "i", "v", "t", "d", "x", kind, level, 100).collect())
    want = brute_force(record, templates, kind, level, 100)
    assert [g[:3] + g[4:5] for g in got] == [w[:3] + w[4:5] for w in want]
    assert np.allclose([[g[3], g[5]] for g in got], [[w[3], w[5]] for w in want])
    assert {(f"t{k}", 5 + 40 * k) for k in (0, 1, 3)} <= {g[:2] for g in got}


def test_without_templates_or_record(spark):
    r = spark.createDataFrame([("a", 1, 1.0)], "c string, i long, v double")
    t = spark.createDataFrame([("t", "a", 0, [1.0, 2.0])], "t string, c string, d int, x array<double>")
    assert D.matched_filter(r, t.limit(0), "c", "i", "v", "t", "d", "x", "mad", 3.0, 10).collect() == []
    assert D.matched_filter(r.limit(0), t, "c", "i", "v", "t", "d", "x", "mad", 3.0, 10).collect() == []
    with pytest.raises(ValueError):
        D.matched_filter(r, t, "c", "i", "v", "t", "d", "x", "other", 3.0, 10)


def test_correlations_of_many_templates_at_once():
    rng = np.random.default_rng(4)
    templates, windows = rng.normal(size=(5, 12)), rng.normal(size=(30, 12))
    templates[2], windows[7], windows[8, 3] = 1.5, -2.0, np.nan
    whole = np.arange(30) != 9
    got = D.sliding_correlations(templates, windows, whole)
    want = [[0.0 if i == 2 or j in (7, 8, 9) else np.corrcoef(t, w)[0, 1] for j, w in enumerate(windows)] for i, t in enumerate(templates)]
    assert np.allclose(got, want)
    stack = np.array([[1.0, -3, 3, 0, 2, 1], [2, 0, 0, 0, 0, 2], [0, 0, 0, 0, 0, 0]])
    row, place = D.peaks_of_runs(stack, np.array([1.0, 2.0, 1.0]))
    assert list(zip(row.tolist(), place.tolist())) == [(0, 1), (0, 4), (1, 0), (1, 5)]
    assert np.allclose(D.medians(stack), np.median(stack, axis=1)) and np.allclose(D.medians(stack[:, :5]), np.median(stack[:, :5], axis=1))


def test_delays_beyond_a_period_and_spans_of_periods(spark, monkeypatch):
    for name, value in (("_SPAN", 120), ("_PACK", 16), ("_WINDOWS", 24), ("_AT_ONCE", 120)):
        monkeypatch.setattr(D, name, value)
    rng = np.random.default_rng(8)
    record = {c: {i: float(v) for i, v in zip(range(-300, 500), rng.normal(size=800))} for c in "ab"}
    templates = {f"t{t}": [(c, d, rng.normal(size=10)) for c, d in zip("abb", (int(rng.integers(-150, 150)), 7, 7))][: 1 + t % 3] for t in range(7)}
    rows = [(c, i, v) for c, own in record.items() for i, v in own.items() if i not in (50, 51)]
    for own in record.values():
        del own[50], own[51]
    r = spark.createDataFrame(rows, "c string, i long, v double").repartition(4)
    t = spark.createDataFrame([(n, c, d, x.tolist()) for n, parts in templates.items() for c, d, x in parts], "t string, c string, d int, x array<double>")
    got = sorted(tuple(x) for x in D.matched_filter(r, t, "c", "i", "v", "t", "d", "x", "mad", 3.0, 60).collect())
    want = brute_force(record, templates, "mad", 3.0, 60)
    assert [g[:3] + g[4:5] for g in got] == [w[:3] + w[4:5] for w in want] and len(want) > 30
    assert np.allclose([[g[3], g[5]] for g in got], [[w[3], w[5]] for w in want])
