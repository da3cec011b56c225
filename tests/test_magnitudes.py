import numpy as np
import pytest

from lodestream.operators import magnitudes as M


def test_party_magnitudes_equal_the_formulas(spark):
    rng = np.random.default_rng(0)
    templates, detections, want = [], [], {}
    for k in range(2):
        for c in range(4):
            x = rng.normal(size=40)
            templates.append((k, c, x.tolist(), (rng.normal(size=20) * (0.1 if c else 0)).tolist(), 1.5 + k))
    for d in range(6):
        scale = 10.0 ** rng.uniform(-2, 1)
        for k, c, x, *_ in templates:
            if c == 3 and d % 2:
                continue  # a channel that the detection lacks
            y = rng.normal(size=52) * 0.02 * scale
            at = int(rng.integers(0, 13))
            y[at : at + 40] += scale * np.array(x) * (-1 if c == 2 and d == 0 else 1)
            detections.append((k, c, d, y.tolist()))
    for k in range(2):
        for d in range(6):
            values = []
            for k2, c, d2, y in detections:
                if (k2, d2) != (k, d):
                    continue
                _, _, x, z, _ = templates[4 * k + c]
                cc = [np.corrcoef(x, y[p : p + 40])[0, 1] for p in range(13)]
                b = np.array(y[int(np.argmax(cc)) :][:40])
                if max(cc) < 0.7:
                    continue
                v = np.linalg.svd(np.stack([x, b], 1), full_matrices=False)[2]
                noise, spread = np.std(z), np.std(x)
                fixed = np.log10(max(cc) * b.std() / spread * (1 + (noise / spread) ** 2)) if noise > 1e-12 else np.nan
                values.append((v[0, 1] / v[0, 0], np.log10(b.std() / spread), fixed))
            if len(values) >= 3:
                ratio, raw, fixed = np.array(values).T
                want[k, d] = (len(values), np.median(ratio), np.median(raw), np.nanmedian(fixed), 0.9 * (1.5 + k) + 0.1 + np.log10(np.median(ratio)) * 2 / 3)
    detections += [(0, 0, 50, [1.0] * 52), (0, 1, 50, [1.0]), (0, 2, 50, None), (9, 1, 50, [1.0] * 52)]
    t = spark.createDataFrame(templates, "k int, c int, x array<double>, z array<double>, m double")
    d = spark.createDataFrame(detections, "k int, c int, d int, x array<double>")
    got = M.party_magnitudes(t, d, ["k"], "c", "d", "x", "z", "m", 0.7, 3, 0.9, 0.1)
    assert got.columns == ["k", "d", "channels", "relative_amplitude", "delta_raw", "delta", "magnitude"]
    found = {(r.k, r.d): tuple(r)[2:] for r in got.collect()}
    assert found.keys() == want.keys() and len(want) >= 10
    for key, row in want.items():
        assert found[key] == pytest.approx(row)
