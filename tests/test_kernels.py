import numpy as np
import pytest

from lodestream.operators import kernels as K

RATE = 48_000.0


def wavelet(n=400, at=200.0, f=3000.0, width=25.0):
    t = np.arange(n) - at
    return np.exp(-((t / width) ** 2)) * np.cos(2 * np.pi * f * t / RATE)


@pytest.mark.parametrize("shift", [-6, -2.4, 0, 3, 7.7])
def test_lags_of_known_shifts(shift):
    a, b = wavelet(), wavelet(at=200 + shift)
    lag, cc, edge = K.correlation_lag(a, b, 12)
    assert abs(lag - shift) < 0.1 and cc > 0.98 and not edge
    assert abs(K.envelope_lag(a, b, 12)[0] - shift) < 1.5
    lag, misfit = K.warping_lag(a, b, 12)
    assert abs(lag - shift) < 1.5 and misfit < 0.3


def test_edges_and_flat_traces():
    assert K.correlation_lag(wavelet(), wavelet(at=209), 4)[2]
    assert K.correlation_lag(np.zeros(50), np.zeros(50), 5) == (0.0, 0.0, True)


def test_template_is_found():
    rng = np.random.default_rng(1)
    image, template = rng.normal(0, 0.01, 2000), wavelet(120, 60)
    image[700:820] += template
    cc = K.normalised_correlation(template, image)
    want = [np.corrcoef(template, image[i : i + 120])[0, 1] for i in (0, 699, 700, 1500)]
    assert np.allclose(cc[[0, 699, 700, 1500]], want, atol=1e-9) and cc.argmax() == 700
    assert K.detections(cc, "mad", 12, 1, 50) == [700] and K.detections(cc, "absolute", 0.9, 1, 50) == [700]
    assert not len(K.normalised_correlation(template, image[:50]))


def test_pickers():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.05, 300), rng.normal(0, 1, 200)]
    assert abs(K.aic_pick(x) - 300) <= 3 and abs(K.sta_lta_pick(x, 8, 80, 4) - 300) <= 6
    assert K.aic_pick(x[:10]) is None and K.aic_pick(x, least_snr=100) is None
    assert K.pick(np.array([0, 0, 0, 5.0, 5.0]), "gradient") == 3


def test_filters():
    t = np.arange(4800) / RATE
    low, mid, high = (np.sin(2 * np.pi * f * t) for f in (100, 3000, 15_000))
    out = K.bandpass(low + mid + high, 1000, 6000, RATE)
    assert np.abs(out - mid)[500:-500].max() < 0.05
    assert np.abs(K.bandstop(low + mid, 1000, 6000, RATE) - low)[500:-500].max() < 0.1
    f, p = K.welch(mid, RATE, 480)
    assert abs(f[p.argmax()] - 3000) < 100 and np.trapezoid(p, f) == pytest.approx(0.5, rel=0.02)
    assert abs(K.centroid_frequency(mid * K.cosine_window(len(mid), 1.0), RATE, 2000, 4000) - 3000) < 20
    assert K.spectral_slope(mid, 2 * mid, RATE, 500, 4000) == pytest.approx(0, abs=1e-9)
    assert len(K.decimate(low, 4)) == 1200 and np.abs(K.decimate(low, 4) - low[::4])[100:-100].max() < 0.02


def test_window():
    w = K.cosine_window(100, 0.2)
    assert w[0] == 0 and (w[10:90] == 1).all() and w[-1] == 0 and len(K.cosine_window(3)) == 3


def test_polarity_and_amplitude():
    a = wavelet()
    assert K.relative_polarity(a, 0.3 * a, 0.5) > 0 > K.relative_polarity(a, -2 * a, 0.5)
    assert K.relative_polarity(a, np.random.default_rng(0).normal(size=400), 0.9) == 0
    assert K.relative_amplitude(a, 2.5 * a) == pytest.approx(2.5) and K.relative_amplitude(a * 0, a) is None


def test_peaks_keep_the_strongest():
    x = np.zeros(100)
    x[[10, 14, 50, 51, 80]] = [3, -5, 2, 4, 1]
    assert K.runs_of_peaks(x, 2, 10) == [14, 51] and K.runs_of_peaks(x, 9, 1) == []


def test_stacks_and_vectors():
    rng = np.random.default_rng(3)
    traces = np.array([wavelet() + rng.normal(0, 0.3, 400) for _ in range(20)])
    assert np.corrcoef(K.linear_stack(traces), wavelet())[0, 1] > 0.9
    assert np.abs(K.phase_weighted_stack(traces)[:100]).max() < np.abs(K.linear_stack(traces)[:100]).max()
    u = K.first_vector(np.outer([1, -2, 3.0], wavelet()))
    assert np.allclose(u, np.array([1, -2, 3]) / np.sqrt(14))
    assert np.allclose(K.low_rank(np.outer([1, 2.0], [3, 4.0])), [[3, 4], [6, 8]])
    assert K.coherence(traces[:2], traces[:2]) == pytest.approx(1)


def test_beams_point_at_the_source():
    rng = np.random.default_rng(4)
    coords, f, s, az = rng.uniform(-500, 500, (12, 2)), 2.0, 1e-3, 70.0
    v = K.steering(coords, az, s, f)
    csd = np.outer(v, np.conj(v)) + 0.01 * np.eye(12)
    for method in ("bartlett", "capon"):
        power = [K.beam_power(csd, coords, a, s, f, method) for a in range(0, 360, 10)]
        assert int(np.argmax(power)) * 10 == 70
    assert K.transfer_function(coords, 0, 0, np.array([1.0, 2.0])) == pytest.approx(1)
    x = rng.normal(size=(3, 512))
    c = K.cross_spectral_density(x, 128)
    assert np.allclose(c, np.conj(np.swapaxes(c, 1, 2)))
