"""Amplitudes of detections relative to their templates, channel by channel, and magnitudes from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.ListArray, at: np.ndarray, n: int) -> np.ndarray:
    starts = column.offsets.to_numpy()[:-1][at]
    return column.values.to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(n)[None, :]]


def aligned(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of templates and longer traces: the place of the largest correlation, that, and the samples there."""
    n = x.shape[1]
    windows = np.lib.stride_tricks.sliding_window_view(y, n, axis=1)
    a = x - x.mean(1, keepdims=True)
    w = windows - windows.mean(2, keepdims=True)
    size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((w * w).sum(2))
    cc = np.divide(np.einsum("rn,rpn->rp", a, w), size, out=np.zeros_like(size), where=size > 1e-12)
    best = cc.argmax(1)
    return best, np.take_along_axis(cc, best[:, None], 1)[:, 0], np.take_along_axis(windows, best[:, None, None], 1)[:, 0]


def channel_amplitudes(pairs: DataFrame, keys: list[str], template: str, detection: str, template_noise: str) -> DataFrame:
    """keys, shift, cc, ratio, raw and corrected of every pair of a channel's template and detection.

    The detection is searched for the place where it correlates best, with the template's sign; there, `ratio` is the
    slope of the first principal axis of the two traces (G40), `raw` the log10 of the ratio of their standard deviations,
    and `corrected` that of cc times this ratio times 1 + 1 / SNR**2 of the template (G39: the part of the detection that
    is the template's, freed of the template's noise), null where its noise has no spread. Pairs with a null, or whose
    detection is shorter, or where a trace has no spread, have no row. Each pair is worked on where it lies.
    """
    rows = pairs.select(*keys, *[F.col(c).cast("array<double>").alias(n) for c, n in ((template, "x"), (detection, "y"), (template_noise, "z"))])
    rows = rows.where("size(x) > 1 and size(y) >= size(x) and not exists(x, v -> v is null or isnan(v)) and not exists(y, v -> v is null or isnan(v))")
    rows = rows.withColumn("noise", F.expr("sqrt(greatest(aggregate(z, 0D, (s, v) -> s + v * v) / size(z) - pow(aggregate(z, 0D, (s, v) -> s + v) / size(z), 2), 0))")).drop("z")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", shift int, cc double, ratio double, raw double, corrected double"
    k = len(keys)

    def run(batches):
        for batch in batches:
            x, y, noise = batch.column(k), batch.column(k + 1), batch.column(k + 2).to_numpy(zero_copy_only=False)
            shapes = np.stack([np.diff(x.offsets.to_numpy()), np.diff(y.offsets.to_numpy())], 1)
            for n, m in np.unique(shapes, axis=0).tolist():
                at = np.flatnonzero((shapes == (n, m)).all(1))
                step = max(1, 2_000_000 // (n * (m - n + 1)))
                for part in (at[i : i + step] for i in range(0, len(at), step)):
                    a = _matrix(x, part, n)
                    shift, cc, b = aligned(a, _matrix(y, part, m))
                    xx, yy, xy = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
                    top = (xx + yy + np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
                    sa, sb = a.std(1), b.std(1)
                    good = (sa > 1e-12) & (sb > 1e-12) & (np.abs(xy) > 1e-300)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ratio, raw = (top - xx) / xy, np.log10(sb / sa)
                        snr = sa / np.where(noise[part] > 1e-12, noise[part], np.nan)
                        corrected = np.log10(np.where(cc > 0, cc, np.nan) * sb / sa * (1 + 1 / snr**2))
                    found = np.flatnonzero(good)
                    own = batch.take(pa.array(part[found]))
                    columns = [*own.columns[:k], pa.array(shift[found], pa.int32()), pa.array(cc[found]), pa.array(ratio[found]), pa.array(raw[found]), pa.array(corrected[found], from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "shift", "cc", "ratio", "raw", "corrected"])

    return rows.mapInArrow(run, schema)


def party_magnitudes(templates: DataFrame, detections: DataFrame, keys: list[str], channel: str, detection_id: str, samples: str, noise: str, magnitude: str, least_cc: float, least_channels: int, slope: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Keys, detection, channels, relative_amplitude, delta_raw, delta and magnitude of the detections of templates.

    Template and detection traces meet by keys and channel, channels with a correlation under `least_cc` are left
    out, and the medians of the others count where there are `least_channels` of them or more. The magnitude is the
    template's (`slope` times its `magnitude` plus `offset`) plus two thirds of the log10 of the relative amplitude, which
    stands for the moments' ratio; it is null where that isn't positive.
    """
    t = templates.select(*keys, channel, F.col(samples).alias("_x"), F.col(noise).alias("_z"), F.col(magnitude).alias("_m"))
    d = detections.select(*keys, channel, detection_id, F.col(samples).alias("_y"))
    per = channel_amplitudes(d.join(t, [*keys, channel]), [*keys, detection_id, channel, "_m"], "_x", "_y", "_z").where(F.col("cc") >= least_cc)
    out = per.groupBy(*keys, detection_id).agg(
        F.count("*").alias("channels"), F.median("ratio").alias("relative_amplitude"), F.median("raw").alias("delta_raw"), F.median("corrected").alias("delta"), F.min("_m").alias("_m"),
    ).where(F.col("channels") >= least_channels)
    size = F.when(F.col("relative_amplitude") > 0, F.lit(slope) * F.col("_m") + offset + F.log10("relative_amplitude") * 2 / 3)
    return out.withColumn("magnitude", size).drop("_m")
