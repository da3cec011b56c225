"""Matched filtering of a record of channels with many templates, period by period."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.storage import cut

#: Templates of a block, and samples of all of them; a task filters a span of periods with one block.
BLOCK = 512
_BLOCK_SAMPLES = 4_000_000
#: Starts of a span (a period at least), and of the windows that are held as a matrix at once.
_SPAN = 32_768
_WINDOWS = 4096
#: Tasks where there are several blocks.
_TASKS = 200
#: Samples of a packed row of the record.
_PACK = 1024
#: Sums of correlations (templates times starts) that a task holds at once.
_AT_ONCE = 1 << 18


def unit_windows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without their mean and of length 1, and their lengths before; rows without spread or with NaN are zeros."""
    w = samples - samples.mean(1, keepdims=True)
    size = np.sqrt(np.einsum("ij,ij->i", w, w))
    size = np.where(np.isfinite(size), size, 0.0)
    return np.divide(w, size[:, None], out=np.zeros_like(w), where=size[:, None] > 0), size


def sliding_correlations(templates: np.ndarray, windows: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Pearson correlations of the rows of templates with those of a matrix of windows; 0 where either has no spread or a window isn't whole."""
    (t, a), (w, b) = unit_windows(templates), unit_windows(windows)
    w[~whole] = 0
    found = t @ w.T
    flat = np.flatnonzero(b * a.min(initial=np.inf) <= 1e-12)
    found[:, flat] = np.where(a[:, None] * b[flat] > 1e-12, found[:, flat], 0.0)
    return found


def medians(rows: np.ndarray) -> np.ndarray:
    """Medians of the rows of a matrix without NaN, by one partition each."""
    k = rows.shape[1] // 2
    parts = np.partition(rows, k, axis=1)
    return parts[:, k] if rows.shape[1] % 2 else (parts[:, :k].max(1) + parts[:, k]) / 2


def peaks_of_runs(stack: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places: of every run of places of a row where |stack| reaches the row's threshold the one of the largest, the first of equals."""
    size = np.abs(stack)
    row, place = np.divmod(np.flatnonzero(size >= threshold[:, None]), stack.shape[1])
    if not len(row):
        return row, place
    starts = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(row) != 0)])
    value = size[row, place]
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
    tops = np.flatnonzero(value == np.maximum.reduceat(value, starts)[run])
    tops = tops[np.unique(run[tops], return_index=True)[1]]
    return row[tops], place[tops]


def matched_filter(record: DataFrame, templates: DataFrame, channel: str, at: str, value: str, template: str, delay: str, samples: str, kind: str, level: float, period: int) -> DataFrame:
    """template, start, period, stack, channels and threshold of the detections of templates in a record.

    A record's row is a sample: channel, its index and value (of equal indices the mean counts); a template's row is one
    channel of it: its delay in samples and its samples. At a start, the correlations of all channels of a template,
    each at its delay, are added up; a channel whose window lacks a sample isn't counted and adds 0, and a start without any
    channel is none. The threshold of a template and a period (`period` starts, such as a day) is `level` times the median
    of the absolute stack (kind mad), times the template's channels (absolute), or times the mean of the absolute stack (average).
    Every run of starts over it gives its peak; runs end with the period. Rows with a null take no part.

    Spans of periods get the samples that their windows reach beyond them, packed in arrays, and are filtered with a block of
    templates a task, so that work is dealt however long the record and however many the templates. A window is brought to
    length 1 once for all templates of a block, and correlations are products of matrices.
    """
    if kind not in ("mad", "absolute", "average"):
        raise ValueError(f"unknown kind of threshold {kind}")
    rows = record.where(F.col(channel).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(channel).cast("string").alias("channel"), F.col(at).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("pack", F.floor(F.col("i") / _PACK)).groupBy("channel", "pack", "i").agg(F.avg("v").alias("v"))
    t = templates.select(F.col(template).cast("string").alias("template"), F.col(channel).cast("string").alias("channel"), F.col(delay).cast("long").alias("delay"), F.col(samples).cast("array<double>").alias("x"))
    t = cut(t.where("template is not null and channel is not null and delay is not null and size(x) > 1 and not exists(x, v -> v is null or isnan(v))"))
    shape = t.agg(F.min("delay"), F.max(F.col("delay") + F.size("x")), F.ceil(F.count_distinct("template") / BLOCK), F.ceil(F.sum(F.size("x")) / _BLOCK_SAMPLES)).first()
    schema = "template string, start long, period long, stack double, channels long, threshold double"
    if not shape[2]:
        return rows.sparkSession.createDataFrame([], schema)
    low, high, blocks = int(shape[0]), int(shape[1]), int(max(shape[2:]))
    span = max(1, _SPAN // period)  # periods
    packed = cut(rows.groupBy("channel", "pack").agg(F.collect_list(F.struct("i", "v")).alias("s")).select("channel", "pack", F.col("s.i").alias("i"), F.col("s.v").alias("v")))
    own = F.sequence(F.floor((F.array_min("i") - high + 1) / (period * span)), F.floor((F.array_max("i") - low) / (period * span)))
    dealt = packed.withColumn("p", F.explode(own))
    pieces = dealt.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("template"), F.lit(blocks)).cast("int")
    held = t.withColumn("tb", block).crossJoin(dealt.select(F.col("p").alias("tp")).distinct())  # templates meet every span: that is the work

    def of_period(p: int, x: np.ndarray, gone: np.ndarray, names: dict, group: list) -> pa.Table | None:
        """Detections of some templates, each a name and its channels, in one period."""
        stack, count = np.zeros((len(group), period)), np.zeros((len(group), period), np.int32)
        alike: dict[tuple, list] = {}
        for k, (_, parts) in enumerate(group):
            for c, d, samples in parts:
                if c in names:  # delays that lie closer than a period share their windows
                    alike.setdefault((names[c], len(samples), (d - low) // period), []).append((k, d - low, samples))
        for (c, n, _), parts in alike.items():
            delays = np.array([d for _, d, _ in parts])
            matrix = np.array([samples for _, _, samples in parts])
            first, last = int(delays.min()), int(delays.max()) + period
            windows = np.lib.stride_tricks.sliding_window_view(x[c, first : last + n - 1], n)
            whole = gone[c, first + n : last + n] == gone[c, first:last]
            for a in range(0, last - first, _WINDOWS):
                found = sliding_correlations(matrix, windows[a : a + _WINDOWS], whole[a : a + _WINDOWS])
                if last - first == period and [k for k, _, _ in parts] == list(range(len(group))):  # one delay, as often
                    stack[:, a : a + _WINDOWS] += found
                    continue
                for (k, d, _), row in zip(parts, found):
                    # the window at `first + a + j` belongs to the start `first + a + j - d` of the period
                    begin = first + a - d
                    i, j = max(begin, 0), min(begin + len(row), period)
                    if i < j:
                        stack[k, i:j] += row[i - begin : j - begin]
            for k, d, _ in parts:
                count[k] += whole[d - first : d - first + period]
        size = np.abs(stack)
        full = count.all(1)
        parts = np.array([len(parts) for _, parts in group], float)
        threshold = np.full(len(group), np.inf)
        if kind == "absolute":
            threshold[count.any(1)] = level * parts[count.any(1)]
        else:
            middle = medians if kind == "mad" else lambda rows: rows.mean(1)
            if full.any():
                threshold[full] = level * middle(size[full])
            for k in np.flatnonzero(~full & count.any(1)):
                threshold[k] = level * middle(size[k][None, count[k] > 0])[0]
        row, place = peaks_of_runs(stack, np.maximum(threshold, 1e-300))  # where no channel counts the stack is 0
        if not len(row):
            return None
        called = pa.array([name for name, _ in group], pa.string()).take(pa.array(row))
        columns = [called, pa.array(p * period + place), pa.array(np.full(len(row), p)), pa.array(stack[row, place]), pa.array(count[row, place].astype(np.int64)), pa.array(threshold[row])]
        return pa.table(columns, names=["template", "start", "period", "stack", "channels", "threshold"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            p = left["p"][0].as_py() * span
            first, size = p * period + low, span * period + high - low
            names = {name: k for k, name in enumerate(sorted(set(left["channel"].to_pylist())))}
            x, there = np.zeros((len(names), size)), np.zeros((len(names), size), bool)
            for c, i, v in zip(left["channel"].to_pylist(), left["i"], left["v"]):
                place, v = i.values.to_numpy() - first, v.values.to_numpy(zero_copy_only=False)
                inside = (place >= 0) & (place < size)
                x[names[c], place[inside]] = v[inside]
                there[names[c], place[inside]] = True
            gone = np.zeros((len(names), size + 1), np.int32)
            np.cumsum(~there, axis=1, out=gone[:, 1:])
            by: dict[str, list] = {}
            for name, c, d, samples in zip(right["template"].to_pylist(), right["channel"].to_pylist(), right["delay"].to_pylist(), right["x"]):
                by.setdefault(name, []).append((c, d, samples.values.to_numpy(zero_copy_only=False)))
            groups, step = sorted(by.items()), max(1, _AT_ONCE // period)
            for k in range(span):
                at = slice(k * period, (k + 1) * period + high - low)
                for a in range(0, len(groups), step):
                    out.append(of_period(p + k, x[:, at], gone[:, k * period : (k + 1) * period + high - low + 1], names, groups[a : a + step]))
        out = [found for found in out if found is not None]
        if out:
            return pa.concat_tables(out)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        return pa.table([pa.array([], k) for k in kinds], names=["template", "start", "period", "stack", "channels", "threshold"])

    if blocks > 1:  # few bytes are much work: tasks aren't to be joined by their bytes
        pieces, held = pieces.repartition(_TASKS, "p", "b"), held.repartition(_TASKS, "tp", "tb")
    return pieces.groupBy("p", "b").cogroup(held.groupBy("tp", "tb")).applyInArrow(work, schema)
