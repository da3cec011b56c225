"""Recursive STA/LTA triggers per channel and their coincidences, as stateful streams that go on from a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

TRIGGERS = "network string, station string, channel string, on_us long, off_us long, known_us long, peak double, n_samples long"
COINCIDENCES = "network string, start_us long, end_us long, n_stations long, n_triggers long, peak double"
#: Samples that the recursive averages take at once.
_BLOCK = 128
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that transformWithState asks for, for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def recursive_mean(x: np.ndarray, before: float, length: float) -> np.ndarray:
    """y[i] = y[i - 1] + (x[i] - y[i - 1]) / length from y[-1] = before, a block of samples at a time."""
    keep = 1 - 1 / length
    powers = keep ** np.arange(_BLOCK + 1)
    lags = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)[None, :]
    within = np.where(lags >= 0, powers[np.maximum(lags, 0)], 0) / length
    blocks = np.zeros(-(-len(x) // _BLOCK) * _BLOCK)
    blocks[: len(x)] = x
    out = blocks.reshape(-1, _BLOCK) @ within.T
    for row in out:  # each block starts from the end of the one before
        row += before * powers[1:]
        before = row[-1]
    return out.ravel()[: len(x)]


def onsets(ratio: np.ndarray, t: np.ndarray, on: float, off: float, longest: int, opened: int | None) -> Iterator[tuple[int | None, int | None]]:
    """(first, end) of the triggers of a piece of a record: samples from one at or above `on` to before one under `off`
    or more than `longest` after the first. `opened` is the time of a trigger that is open from before: first is None;
    end is None for one that stays open."""
    starts, stops = np.flatnonzero(ratio >= on), np.flatnonzero(ratio < off)
    at, first = 0, None
    since = opened
    while True:
        if since is None:
            k = np.searchsorted(starts, at)
            if k == len(starts):
                return
            first = int(starts[k])
            since, at = int(t[first]), first + 1
        k = np.searchsorted(stops, at)
        end = int(stops[k]) if k < len(stops) else len(ratio)
        end = min(end, max(at, int(np.searchsorted(t, since + longest, side="right"))))
        yield first, end if end < len(ratio) else None
        if end >= len(ratio):
            return
        at, first, since = end, None, None


class ChannelTriggers(StatefulProcessor):
    """Averages and an open trigger of one channel; a timer ends the channel that has had no sample for `idle`."""

    def __init__(self, short: float, long: float, on: float, off: float, longest_us: int, idle_us: int):
        self.short, self.long, self.on, self.off, self.longest, self.idle = short, long, on, off, longest_us, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.averages = handle.getValueState("averages", "sta double, lta double, n long, last_us long")
        self.open = handle.getValueState("open", "on_us long, peak double, n_samples long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["t_us", "seq"], kind="stable")
        sta, lta, n, last = self.averages.get() if self.averages.exists() else (0.0, 0.0, 0, None)
        if last is not None:
            frame = frame[frame["t_us"] >= last]
        if not len(frame):
            return
        t, power = frame["t_us"].to_numpy(np.int64), frame["value"].to_numpy(float) ** 2
        stas, ltas = recursive_mean(power, sta, self.short), recursive_mean(power, lta, self.long)
        ready = (n + 1 + np.arange(len(t)) >= self.long) & (ltas > 0)
        ratio = np.where(ready, stas / np.where(ltas > 0, ltas, 1), 0)
        since, peak, seen = self.open.get() if self.open.exists() else (None, 0.0, 0)
        was = since
        self.open.clear()
        out = []
        for first, end in onsets(ratio, t, self.on, self.off, self.longest, was):
            begin = 0 if first is None else first
            if first is not None:
                since, peak, seen = int(t[first]), 0.0, 0
            part = ratio[begin : len(ratio) if end is None else end]
            peak, seen = max([peak, *part.tolist()]), seen + len(part)
            if end is None:
                self.open.update((since, float(peak), int(seen)))
            else:
                final = int(t[end - 1]) if end > 0 else last
                out.append((*key, since, final, int(t[end]), peak, seen))
        self.averages.update((float(stas[-1]), float(ltas[-1]), int(n + len(t)), int(t[-1])))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer((int(t[-1]) + self.idle) // 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIGGERS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.open.exists():
            since, peak, seen = self.open.get()
            out.append((*key, since, self.averages.get()[3], expiredTimerInfo.getExpiryTimeInMs() * 1000, peak, seen))
        self.open.clear()
        self.averages.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIGGERS.split(", ")])

    def close(self) -> None:
        pass


def channel_triggers(samples: DataFrame, late: str, short: float, long: float, on: float, off: float, longest: float, idle: float) -> DataFrame:
    """Triggers of a stream of samples (network, station, channel, ts, seq, value): TRIGGERS.

    Averages of squared samples with lengths of `short` and `long` samples are kept per channel; the ratio counts once
    `long` samples were seen. A trigger lasts from a ratio of `on` or more to the last before one under `off`, `longest`
    seconds at most. A channel without samples for `idle` seconds of event time is given up and its open trigger ended.
    Samples are taken in order of ts and seq within a batch; those before the last one of an earlier batch, and rows
    with a null, don't count. known_us is when the end of the trigger is known.
    """
    use_state_store(samples.sparkSession)
    rows = samples.where("network is not null and station is not null and channel is not null and ts is not null and value is not null")
    rows = rows.withWatermark("ts", late).select("network", "station", "channel", "ts", F.unix_micros("ts").alias("t_us"), F.coalesce("seq", F.lit(0)).alias("seq"), F.col("value").cast("double").alias("value"))
    processor = ChannelTriggers(short, long, on, off, int(longest * 1e6), int(idle * 1e6))
    return rows.groupBy("network", "station", "channel").transformWithStateInPandas(processor, TRIGGERS, "Append", "EventTime")


class NetworkCoincidences(StatefulProcessor):
    """Triggers of one network that aren't joined to a final coincidence yet."""

    def __init__(self, least: int, longest_us: int, gap_us: int):
        self.least, self.longest, self.gap = least, longest_us, gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "on_us long, off_us long, station string, peak double")

    def _finish(self, key, passed_us: int):
        """Groups of overlapping triggers that no trigger to come can touch."""
        rows = sorted(tuple(r) for r in self.waiting.get())
        groups: list[list] = []
        end = None
        for r in rows:
            if end is None or r[0] > end + self.gap:
                groups.append([])
                end = r[1]
            groups[-1].append(r)
            end = max(end, r[1])
        ends = [max(r[1] for r in g) + self.gap + self.longest for g in groups]
        final = 0
        while final < len(groups) and ends[final] < passed_us:  # groups before one that is open are final only with their order
            final += 1
        rest = [r for g in groups[final:] for r in g]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(ends[final] // 1000 + 1)
        else:
            self.waiting.clear()
        out = []
        for g in groups[:final]:
            stations = {r[2] for r in g}
            if len(stations) >= self.least:
                out.append((*key, g[0][0], max(r[1] for r in g), len(stations), len(g), max(r[3] for r in g)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COINCIDENCES.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            self.waiting.appendList(list(zip(frame["on_us"].tolist(), frame["off_us"].tolist(), frame["station"].tolist(), frame["peak"].tolist())))
        yield self._finish(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._finish(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def network_coincidences(triggers: DataFrame, late: str, least: int, longest: float, gap: float = 0.0) -> DataFrame:
    """Groups of overlapping triggers (at most `gap` seconds apart) of a network with `least` stations or more: COINCIDENCES.

    `triggers` is a stream of TRIGGERS, whose known_us is the event time. As a trigger lasts `longest` seconds at most, a
    group is final when the watermark has passed its end by that; a timer emits it then, and its triggers are forgotten.
    """
    use_state_store(triggers.sparkSession)
    rows = triggers.withColumn("known", F.timestamp_micros("known_us")).withWatermark("known", late)
    processor = NetworkCoincidences(least, int(longest * 1e6), int(gap * 1e6))
    return rows.groupBy("network").transformWithStateInPandas(processor, COINCIDENCES, "Append", "EventTime")
