"""Signal kernels over numpy arrays, and their application to array columns by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def on_arrays(kernel: Callable, returns: str, *columns: str | Column) -> Column:
    """A kernel of numpy arrays (and scalars) over columns; null where any input or the result is null."""

    names = [part.split()[0] for part in returns.split(",")] if " " in returns else []

    def run(*series):
        out = []
        for values in zip(*series):
            missing = any(v is None or (np.isscalar(v) and pd.isna(v)) for v in values)
            out.append(None if missing else kernel(*[np.asarray(v, float) if isinstance(v, (np.ndarray, list)) else v for v in values]))
        if names:
            return pd.DataFrame([f if f is not None else (None,) * len(names) for f in out], columns=names)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame if names else pd.Series}
    return F.pandas_udf(run, returns)(*columns)


# correlation

def normalised_correlation(template: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Pearson correlation of a template at every place of a longer signal; 0 where either is flat."""
    n = len(template)
    if n == 0 or len(image) < n:
        return np.zeros(0)
    t = template - template.mean()
    windows = np.lib.stride_tricks.sliding_window_view(image, n)
    size = 1 << int(np.ceil(np.log2(len(image) + n)))
    dot = np.fft.irfft(np.fft.rfft(image, size) * np.conj(np.fft.rfft(t, size)), size)[: len(windows)]
    spread = windows.std(axis=1) * np.sqrt(n) * np.sqrt((t**2).sum())
    return np.divide(dot, spread, out=np.zeros(len(windows)), where=spread > 1e-12)


def _parabola(y: np.ndarray, i: int) -> float:
    """Where a parabola through three neighbours has its top, as an offset from the middle one."""
    if i <= 0 or i >= len(y) - 1:
        return 0.0
    bend = y[i - 1] - 2 * y[i] + y[i + 1]
    return 0.0 if abs(bend) < 1e-15 else float(np.clip(0.5 * (y[i - 1] - y[i + 1]) / bend, -0.5, 0.5))


def correlation_lag(baseline: np.ndarray, epoch: np.ndarray, max_lag: int, guard: int = 1) -> tuple[float, float, bool]:
    """The lag of `epoch` behind `baseline` in samples, the correlation there, and whether it lies at the edge."""
    n = min(len(baseline), len(epoch))
    a, b = baseline[:n] - baseline[:n].mean(), epoch[:n] - epoch[:n].mean()
    norm = np.sqrt((a**2).sum() * (b**2).sum())
    if n == 0 or norm < 1e-15:
        return 0.0, 0.0, True
    max_lag = min(max_lag, n - 1)
    full = np.correlate(b, a, "full")[n - 1 - max_lag : n + max_lag] / norm
    i = int(np.argmax(full))
    return i - max_lag + _parabola(full, i), float(full[i]), bool(i <= guard - 1 or i >= len(full) - guard)


def envelope(x: np.ndarray) -> np.ndarray:
    """The modulus of the analytic signal."""
    n = len(x)
    spectrum = np.fft.fft(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * gain))


def envelope_lag(baseline: np.ndarray, epoch: np.ndarray, max_lag: int, smooth: int = 5) -> tuple[float, float, bool]:
    """A coarse lag from smoothed envelopes."""
    kernel = np.ones(smooth) / smooth
    return correlation_lag(np.convolve(envelope(baseline), kernel, "same"), np.convolve(envelope(epoch), kernel, "same"), max_lag)


def warping_lag(baseline: np.ndarray, epoch: np.ndarray, max_shift: int, strain: int = 2) -> tuple[float, float]:
    """The median lag along the least-cost path whose lag changes by one sample every `strain` samples at most, and the path's misfit."""
    n = min(len(baseline), len(epoch))
    shifts = np.arange(-max_shift, max_shift + 1)
    at = np.arange(n)[:, None] + shifts[None, :]
    inside = (at >= 0) & (at < n)
    error = np.where(inside, (baseline[:n, None] - epoch[np.clip(at, 0, n - 1)]) ** 2, (np.abs(baseline).max() + np.abs(epoch).max()) ** 2)
    blocks = np.add.reduceat(error, np.arange(0, n, strain), axis=0)
    total, step = blocks[0].copy(), []
    for row in blocks[1:]:
        options = np.stack([np.r_[np.inf, total[:-1]], total, np.r_[total[1:], np.inf]])
        choice = options.argmin(0)
        step.append(choice - 1)
        total = options.min(0) + row
    i = int(total.argmin())
    path = [i]
    for choice in reversed(step):
        i += int(choice[i])
        path.append(i)
    scale = max(float((baseline[:n] ** 2).sum()), 1e-15)
    return float(np.median(shifts[path])), float(total.min() / scale)


def relative_polarity(template: np.ndarray, detection: np.ndarray, least: float, max_lag: int = 10) -> float:
    """Sign of the strongest correlation peak times its lead over its neighbours; 0 below `least`, at an edge, or if it is the only one."""
    n = min(len(template), len(detection))
    a, b = template[:n] - template[:n].mean(), detection[:n] - detection[:n].mean()
    norm = np.sqrt((a**2).sum() * (b**2).sum())
    if norm < 1e-15:
        return 0.0
    c = np.correlate(b, a, "full")[n - 1 - max_lag : n + max_lag] / norm
    size = np.abs(c)
    peaks = np.flatnonzero((size[1:-1] >= size[:-2]) & (size[1:-1] >= size[2:])) + 1
    if len(peaks) < 2 or size.max() < least or int(size.argmax()) in (0, len(c) - 1):
        return 0.0
    k = int(np.argmax(size[peaks]))
    beside = [size[peaks[j]] for j in (k - 1, k + 1) if 0 <= j < len(peaks)]
    return float(np.sign(c[peaks[k]]) * (size[peaks[k]] - max(beside)))


# picking

def aic_pick(x: np.ndarray, margin: int = 10, least_snr: float = 0.0) -> int | None:
    """The sample that best splits a trace into two parts of different variance; null if it is too short or too weak."""
    n = len(x)
    if n < 2 * margin + 2:
        return None
    k = np.arange(1, n)
    s, q = np.cumsum(x), np.cumsum(x * x)
    left = np.maximum(q[:-1] / k - (s[:-1] / k) ** 2, 1e-20)
    right = np.maximum((q[-1] - q[:-1]) / (n - k) - ((s[-1] - s[:-1]) / (n - k)) ** 2, 1e-20)
    aic = k * np.log(left) + (n - k - 1) * np.log(right)
    pick = int(np.argmin(aic[margin - 1 : n - margin]) + margin)
    if least_snr and np.sqrt((x[pick:] ** 2).mean()) < least_snr * np.sqrt((x[:pick] ** 2).mean()):
        return None
    return pick


def sta_lta(x: np.ndarray, short: int, long: int) -> np.ndarray:
    """Ratio of mean energies over trailing windows; 0 until the long one is full."""
    q = np.r_[0, np.cumsum(x * x)]
    at = np.arange(long, len(x) + 1)
    ratio = np.zeros(len(x))
    if len(at):
        ratio[at - 1] = (q[at] - q[at - short]) / short / np.maximum((q[at] - q[at - long]) / long, 1e-20)
    return ratio


def sta_lta_pick(x: np.ndarray, short: int, long: int, threshold: float) -> int | None:
    """The first sample whose ratio reaches the threshold, else that of the highest."""
    if len(x) < long:
        return None
    ratio = sta_lta(x, short, long)
    over = np.flatnonzero(ratio >= threshold)
    return int(over[0]) if len(over) else int(ratio.argmax())


def gradient_pick(x: np.ndarray) -> int | None:
    """The sample of the steepest rise of |x|."""
    return int(np.argmax(np.diff(np.abs(x)))) + 1 if len(x) > 1 else None


def pick(x: np.ndarray, picker: str) -> int | None:
    """By the picker's name."""
    return {"aic": lambda: aic_pick(x), "stalta": lambda: sta_lta_pick(x, 4, 16, 3.0), "gradient": lambda: gradient_pick(x)}[picker]()


def runs_of_peaks(x: np.ndarray, threshold: float, apart: int) -> list[int]:
    """Of every run with |x| at the threshold or above its strongest sample, the strongest first, `apart` samples from any taken."""
    from .timeseries import strongest_first

    over = np.flatnonzero(np.abs(x) >= threshold)
    if not len(over):
        return []
    runs = np.split(over, np.flatnonzero(np.diff(over) > 1) + 1)
    tops = np.array([r[np.argmax(np.abs(x[r]))] for r in runs])
    return tops[strongest_first(tops.astype(float), np.abs(x[tops]), apart)].tolist()


def detections(stack: np.ndarray, kind: str, level: float, channels: int, apart: int) -> list[int]:
    """Peaks of a correlation stack over a threshold by MAD, absolute per channel, or mean (trap T-24: each as named)."""
    threshold = {"mad": level * float(np.median(np.abs(stack))), "absolute": level * channels, "average": level * float(np.abs(stack).mean())}[kind]
    return runs_of_peaks(stack, threshold, apart)


# filters and spectra

def cosine_window(n: int, share: float = 0.1) -> np.ndarray:
    """Ones with raised-cosine ends, `share` of the samples in both ends together."""
    w, k = np.ones(n), int(share * n / 2)
    if k:
        ramp = 0.5 * (1 - np.cos(np.pi * np.arange(k) / k))
        w[:k], w[n - k :] = ramp, ramp[::-1]
    return w


def preprocess(x: np.ndarray, clip: float, share: float = 0.1) -> np.ndarray:
    """Mean removed, clipped at `clip` deviations, tapered."""
    x = x - x.mean()
    limit = clip * x.std()
    return np.clip(x, -limit, limit) * cosine_window(len(x), share)


def _sections(order: int, low: float | None, high: float | None, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order Butterworth sections of a high pass at `low` and a low pass at `high`."""
    out = []
    for edge, kind in ((low, "high"), (high, "low")):
        if edge is None:
            continue
        k = np.tan(np.pi * edge / rate)
        for j in range(order // 2):
            q = 1 / (2 * np.cos(np.pi * (2 * j + 1) / (2 * order)))
            norm = 1 / (1 + k / q + k * k)
            b = np.array([1.0, -2.0, 1.0]) * norm if kind == "high" else np.array([1.0, 2.0, 1.0]) * k * k * norm
            out.append((b, np.array([1.0, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm])))
    return out


def _run_section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, z1, z2 = np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        out = b[0] * v + z1
        z1 = b[1] * v - a[1] * out + z2
        z2 = b[2] * v - a[2] * out
        y[i] = out
    return y


def bandpass(x: np.ndarray, low: float | None, high: float | None, rate: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band pass (even order), forwards and backwards over an odd extension."""
    pad = min(len(x) - 1, 3 * (order + 1) * 4)
    if pad < 1:
        return x.copy()
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    for b, a in _sections(order, low, high, rate):
        y = _run_section(b, a, _run_section(b, a, y)[::-1])[::-1]
    return y[pad : pad + len(x)]


def bandstop(x: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    """What a band pass of the same edges leaves."""
    return x - bandpass(x, low, high, rate)


def welch(x: np.ndarray, rate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power density of half-overlapping Hann windows, each without its mean."""
    size = min(size, len(x))
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    parts = [x[k : k + size] for k in range(0, len(x) - size + 1, max(1, size // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * w)) ** 2 for p in parts], axis=0) / (rate * (w**2).sum())
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def centroid_frequency(x: np.ndarray, rate: float, low: float = 0.0, high: float = np.inf) -> float | None:
    """The amplitude-weighted mean frequency."""
    f, a = np.fft.rfftfreq(len(x), 1 / rate), np.abs(np.fft.rfft(x - x.mean()))
    keep = (f >= low) & (f <= high)
    total = a[keep].sum()
    return float((f[keep] * a[keep]).sum() / total) if total > 0 else None


def spectral_slope(baseline: np.ndarray, epoch: np.ndarray, rate: float, low: float, high: float) -> float | None:
    """Slope over frequency of the log ratio of amplitude spectra."""
    n = min(len(baseline), len(epoch))
    f = np.fft.rfftfreq(n, 1 / rate)
    a, b = np.abs(np.fft.rfft(baseline[:n])), np.abs(np.fft.rfft(epoch[:n]))
    keep = (f >= low) & (f <= high) & (a > 1e-15) & (b > 1e-15)
    return float(np.polyfit(f[keep], np.log(b[keep] / a[keep]), 1)[0]) if keep.sum() >= 2 else None


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Every `factor`-th sample after a low pass at 0.4 of the new rate."""
    return bandpass(x, None, 0.4 / factor, 1.0)[::factor] if factor > 1 else x


# many traces

def coherence(a: np.ndarray, b: np.ndarray) -> float:
    """Mean zero-lag correlation of the channels (rows) that both have; 0 without any."""
    found = []
    for x, y in zip(a, b):
        x, y = x - x.mean(), y - y.mean()
        norm = np.sqrt((x**2).sum() * (y**2).sum())
        if norm > 1e-15:
            found.append(float((x * y).sum() / norm))
    return float(np.mean(found)) if found else 0.0


def linear_stack(traces: np.ndarray) -> np.ndarray:
    """G31"""
    return traces.mean(axis=0)


def phase_weighted_stack(traces: np.ndarray, power: float = 2.0) -> np.ndarray:
    """The mean trace weighted by how well phases agree."""
    n = traces.shape[1]
    gain = np.zeros(n)
    gain[0], gain[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        gain[n // 2] = 1
    analytic = np.fft.ifft(np.fft.fft(traces, axis=1) * gain, axis=1)
    phase = analytic / np.maximum(np.abs(analytic), 1e-15)
    return traces.mean(axis=0) * np.abs(phase.mean(axis=0)) ** power


def first_vector(matrix: np.ndarray) -> np.ndarray:
    """The first left singular vector, its largest entry positive."""
    u = np.linalg.svd(matrix, full_matrices=False)[0][:, 0]
    return u if u[np.abs(u).argmax()] >= 0 else -u


def low_rank(matrix: np.ndarray, rank: int = 1) -> np.ndarray:
    """The matrix from its largest singular values alone (trap T-21: returned)."""
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ v[:rank]


def relative_amplitude(a: np.ndarray, b: np.ndarray) -> float | None:
    """Amplitude of `b` relative to `a` from the first right singular vector of the two as columns."""
    n = min(len(a), len(b))
    xx, yy, xy = float((a[:n] ** 2).sum()), float((b[:n] ** 2).sum()), float((a[:n] * b[:n]).sum())
    if xx < 1e-20:
        return None
    top = (xx + yy + np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
    return (top - xx) / xy if abs(xy) > 1e-20 else (0.0 if xx >= yy else None)


def cross_spectral_density(traces: np.ndarray, size: int) -> np.ndarray:
    """Mean over half-overlapping windows of the outer products of spectra: frequency x station x station."""
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    parts = [np.fft.rfft(traces[:, k : k + size] * w, axis=1) for k in range(0, traces.shape[1] - size + 1, size // 2)]
    return np.mean([np.einsum("if,jf->fij", p, np.conj(p)) for p in parts], axis=0)


def steering(coords: np.ndarray, azimuth: float, slowness: float, frequency: float) -> np.ndarray:
    """Phases of a plane wave from a back-azimuth in degrees at the stations (rows east, north)."""
    a = np.radians(azimuth)
    delay = -slowness * (coords @ np.array([np.sin(a), np.cos(a)]))
    return np.exp(-2j * np.pi * frequency * delay)


def beam_power(csd: np.ndarray, coords: np.ndarray, azimuth: float, slowness: float, frequency: float, method: str = "bartlett", load: float = 1e-3) -> float:
    """Bartlett or Capon power of one frequency's cross-spectral matrix in one direction."""
    s, n = steering(coords, azimuth, slowness, frequency), len(coords)
    if method == "bartlett":
        return float(np.real(np.conj(s) @ csd @ s) / n**2)
    loaded = csd + load * np.trace(csd).real / n * np.eye(n)
    return float(1 / np.real(np.conj(s) @ np.linalg.solve(loaded, s)))


def transfer_function(coords: np.ndarray, azimuth: float, slowness: float, frequencies: np.ndarray) -> float:
    """Mean over frequencies of the array's response to a vertical wave steered in one direction."""
    return float(np.mean([np.abs(steering(coords, azimuth, slowness, f).mean()) ** 2 for f in frequencies]))
