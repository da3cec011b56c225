"""Lags, picks and polarities of array columns, a matrix of rows of one length at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .polarity import relative_polarities
from .stacks import analytic

#: Samples of windows that a task holds at once.
_AT_ONCE = 4_000_000


def on_matrices(kernel: Callable, returns: str, *columns: str | Column) -> Column:
    """`kernel` over matrices of the rows whose arrays have the same lengths: it gets a matrix a column and gives an array
    a field of `returns`. Rows with a null array, or a null or NaN within one, give null."""
    names = [part.split()[0] for part in returns.split(",")]

    def run(*series: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({n: pd.Series([None] * len(series[0]), dtype=object) for n in names})
        shapes: dict[tuple, list[int]] = {}
        for i, values in enumerate(zip(*series)):
            if all(v is not None and not any(x is None or x != x for x in v) for v in values):
                shapes.setdefault(tuple(len(v) for v in values), []).append(i)
        for lengths, rows in shapes.items():
            step = max(1, _AT_ONCE // max(1, max(lengths) ** 2))
            for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                found = kernel(*[np.array([s.iloc[i] for i in part], float).reshape(len(part), n) for s, n in zip(series, lengths)])
                for name, values in zip(names, found):
                    out.loc[part, name] = pd.Series(np.asarray(values).tolist(), index=part, dtype=object)
        return out

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, returns)(*columns)


def correlation_lags(baseline: np.ndarray, epoch: np.ndarray, max_lag: int, guard: int = 1):
    """Lag in samples (positive: the epoch is later), the normalised correlation there and whether it lies at the edge.

    Samples count as they are, without their means removed, and as zeros beyond the ends; the lag is refined by a
    parabola through the neighbours, which may lie outside the search. Without energy: 0, 0 and true.
    """
    n = min(baseline.shape[1], epoch.shape[1])
    b, e = baseline[:, :n], epoch[:, :n]
    size = np.sqrt((b * b).sum(1) * (e * e).sum(1))
    most = min(max_lag, n - 1)
    wide = np.pad(e, ((0, 0), (most + 1, most + 1)))
    windows = np.lib.stride_tricks.sliding_window_view(wide, n, axis=1)  # lags -most - 1 .. most + 1
    cc = np.divide(np.einsum("rn,rpn->rp", b, windows), size[:, None], out=np.zeros((len(b), 2 * most + 3)), where=size[:, None] > 0)
    inside = cc[:, 1:-1]
    at = inside.argmax(1)
    y0, y1, y2 = (np.take_along_axis(cc, (at + k)[:, None], 1)[:, 0] for k in range(3))
    bend = 2 * y1 - y0 - y2
    sub = np.clip(np.divide(y2 - y0, 2 * bend, out=np.zeros(len(b)), where=np.abs(bend) > 1e-12), -0.5, 0.5)
    sub[np.abs(at - most) >= n - 1] = 0.0  # no neighbour on one side
    some = size > 0
    edge = (at <= guard) | (at >= inside.shape[1] - 1 - guard) | ~some
    return np.where(some, at - most + sub, 0.0), np.where(some, y1, 0.0), edge


def aic_picks(x: np.ndarray, margin: int = 10, least_snr: float = 0.0):
    """The sample that best splits the squares of a trace into two parts of different size, and its signal-to-noise
    ratio (0.707 times the peak after it over the root mean square before). 0 where the trace is too short, has no
    energy, or the ratio is below `least_snr`."""
    n, margin = x.shape[1], max(margin, 1)
    if n < 2 * margin + 2:
        return np.zeros(len(x), int), np.zeros(len(x))
    q = x * x
    upto, whole = np.cumsum(q, 1), q.sum(1, keepdims=True)
    k = np.arange(margin, n - margin)
    first = upto[:, k - 1]
    tiny = np.finfo(float).tiny
    left, right = np.maximum(first / np.maximum(k - 1, 1), tiny), np.maximum((whole - first) / np.maximum(n - k - 1, 1), tiny)
    at = margin + (k * np.log10(left) + (n - k - 1) * np.log10(right)).argmin(1)
    place = np.arange(n)[None, :]
    before = (place >= margin) & (place < at[:, None])
    after = (place >= at[:, None]) & (place < n - margin)
    noise = np.sqrt(np.divide((q * before).sum(1), before.sum(1), out=np.full(len(x), tiny**2), where=before.sum(1) > 0))
    snr = 0.707 * (np.abs(x) * after).max(1) / np.maximum(noise, tiny)
    none = whole[:, 0] == 0
    return np.where(none | ((least_snr > 0) & (snr < least_snr)), 0, at), np.where(none, 0.0, snr)


def sta_lta_picks(x: np.ndarray, short: int, long: int, threshold: float):
    """The first sample whose ratio of mean squares over the last `short` and `long` samples (as many as there are at
    the start) reaches the threshold, else that of the largest ratio."""
    n = x.shape[1]
    if n == 0:
        return (np.zeros(len(x), int),)
    q = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, 1)], 1)
    i = np.arange(1, n + 1)

    def mean(width):
        return (q[:, i] - q[:, np.maximum(i - width, 0)]) / np.minimum(i, width)

    ratio = mean(short) / np.maximum(mean(long), 1e-30)
    over = ratio >= threshold
    return (np.where(over.any(1), over.argmax(1), ratio.argmax(1)),)


def gradient_picks(x: np.ndarray):
    """The sample of the largest step from the one before."""
    return (np.abs(np.diff(x, axis=1, prepend=x[:, :1])).argmax(1) if x.shape[1] else np.zeros(len(x), int),)


def pair_polarities(template: np.ndarray, detection: np.ndarray, least_cc: float):
    """The relative polarity of a template and a longer detection (see polarity.relative_polarities)."""
    n = template.shape[1]
    if not 0 < n <= detection.shape[1]:
        return (np.zeros(len(template)),)
    windows = np.lib.stride_tricks.sliding_window_view(detection, n, axis=1)
    t, w = template - template.mean(1, keepdims=True), windows - windows.mean(2, keepdims=True)
    size = np.sqrt((t * t).sum(1))[:, None] * np.sqrt((w * w).sum(2))
    return (relative_polarities(np.divide(np.einsum("rn,rpn->rp", t, w), size, out=np.zeros(size.shape), where=size > 1e-12), least_cc),)


def metric_batteries(baseline: np.ndarray, epoch: np.ndarray, rate: float, max_lag: int, least_cc: float):
    """Root mean square and centroid frequency of the epoch, its shift behind the baseline in microseconds, the
    correlation, and whether the shift is rejected: at the edge of the search, or with a correlation under `least_cc`."""
    lag, cc, edge = correlation_lags(baseline, epoch, max_lag)
    power = np.abs(np.fft.rfft(epoch, axis=1)) ** 2
    whole = power.sum(1)
    centroid = np.divide(power @ np.fft.rfftfreq(epoch.shape[1], 1 / rate), whole, out=np.zeros(len(epoch)), where=whole > 0)
    return np.sqrt((epoch * epoch).mean(1)), centroid, lag / rate * 1e6, cc, edge | (cc < least_cc)


def smoothed_envelopes(x: np.ndarray, smooth: int = 5) -> np.ndarray:
    """Lengths of the analytic signals, as running means of `smooth` samples with zeros beyond the ends."""
    size = np.abs(analytic(x))
    wide = np.pad(size, ((0, 0), (smooth // 2, smooth - 1 - smooth // 2)))
    return np.lib.stride_tricks.sliding_window_view(wide, smooth, axis=1).mean(2)


def envelope_lags(baseline: np.ndarray, epoch: np.ndarray, max_lag: int, smooth: int = 5):
    """A coarse lag, and its correlation, from smoothed envelopes; 0 and 0 for fewer than four samples or no energy."""
    if min(baseline.shape[1], epoch.shape[1]) < max(4, smooth):
        return np.zeros(len(baseline)), np.zeros(len(baseline))
    return correlation_lags(smoothed_envelopes(baseline, smooth), smoothed_envelopes(epoch, smooth), max_lag)[:2]


def welch_powers(x: np.ndarray, rate: float, size: int):
    """One-sided power density of every frequency, the mean over half-overlapping Hann windows of `size` samples (the
    whole trace if it is shorter), each without its mean."""
    size = min(size, x.shape[1])
    if size < 2:
        return (np.zeros((len(x), 0)),)
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: max(1, size // 2)]
    power = (np.abs(np.fft.rfft((parts - parts.mean(2, keepdims=True)) * w, axis=2)) ** 2).mean(1) / (rate * (w * w).sum())
    power[:, 1 : power.shape[1] - (size % 2 == 0)] *= 2
    return (power,)


def spectral_slopes(baseline: np.ndarray, epoch: np.ndarray, rate: float, low: float, high: float):
    """The least-squares slope over frequency, from `low` to `high`, of the log of the ratio of amplitude spectra, epoch
    over baseline; frequencies that one of them lacks don't count, and with fewer than two it is null."""
    n = min(baseline.shape[1], epoch.shape[1])
    f = np.fft.rfftfreq(n, 1 / rate) if n else np.zeros(0)
    a, b = (np.abs(np.fft.rfft(v[:, :n], axis=1)) if n else np.zeros((len(v), 0)) for v in (baseline, epoch))
    keep = (f >= low) & (f <= high) & (a > 1e-15) & (b > 1e-15)
    y = np.log(np.where(keep, b, 1) / np.where(keep, a, 1))
    k = keep.sum(1)
    mean_f, mean_y = (f * keep).sum(1) / np.maximum(k, 1), (y * keep).sum(1) / np.maximum(k, 1)
    d = (f - mean_f[:, None]) * keep
    spread = (d * d).sum(1)
    slope = np.divide((d * (y - mean_y[:, None])).sum(1), spread, out=np.zeros(len(d)), where=spread > 0)
    return (np.where((k >= 2) & (spread > 0), slope, None),)
