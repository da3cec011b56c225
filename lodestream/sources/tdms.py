"""TDMS files (segments of channels in binary) as a data source: the segments are indexed first, then read in parallel."""

from __future__ import annotations

import json
import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, opened

_SCHEMA = "file string, group string, channel string, index long, value double, text string, time_us long"
#: Bytes of raw data that one task reads, about.
BYTES_A_TASK = 64 << 20
#: Parts of a segment, as bits of its head (fixed values of the format).
METADATA, NEW_LIST, RAW, INTERLEAVED, BIG, DAQMX = 1 << 1, 1 << 2, 1 << 3, 1 << 5, 1 << 6, 1 << 7
#: Types of values: code, letter (fixed values of the format).
NUMBERS = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8", 0x19: "f4", 0x1A: "f8", 0x21: "u1"}
TEXT, TIME = 0x20, 0x44
_NO_DATA, _AS_BEFORE = 0xFFFFFFFF, 0
_TO_END = (1 << 64) - 1
#: Seconds from 1904, where times start, to 1970.
_EPOCH = 2082844800


@dataclass
class Layout:
    """A channel's values in a chunk of a segment."""

    kind: int
    count: int
    size: int

    @staticmethod
    def of(kind: int, count: int, text_bytes: int) -> Layout:
        if kind == TEXT:
            return Layout(kind, count, text_bytes)
        if kind == TIME:
            return Layout(kind, count, 16 * count)
        if kind not in NUMBERS:
            raise ValueError(f"values of type {kind:#x} can't be read")
        return Layout(kind, count, int(NUMBERS[kind][1]) * count)


@dataclass
class Segment:
    at: int
    chunks: int
    interleaved: bool
    big: bool
    channels: list[tuple[str, Layout, int]]  # path, layout, index of the first value
    bytes: int = field(default=0)


class _Head:
    """Reads the numbers and texts of a segment's head in its byte order."""

    def __init__(self, f, big: bool):
        self.f, self.order = f, ">" if big else "<"

    def number(self, code: str):
        return struct.unpack(self.order + code, self.f.read(struct.calcsize(code)))[0]

    def text(self) -> str:
        return self.f.read(self.number("I")).decode()

    def skip_property(self) -> None:
        self.text()
        kind = self.number("I")
        if kind == TEXT:
            self.text()
        else:
            self.f.seek(16 if kind == TIME else int(NUMBERS[kind][1]), os.SEEK_CUR)


def segments(f) -> list[Segment]:
    """The segments of a file with raw data; of the file their heads are read and the rest is passed over."""
    f.seek(0, os.SEEK_END)
    end, at = f.tell(), 0
    layouts: dict[str, Layout] = {}
    order: list[str] = []
    active: set[str] = set()
    read: dict[str, int] = {}
    out = []
    while at + 28 <= end:
        f.seek(at)
        if f.read(4) != b"TDSm":
            raise ValueError(f"no segment begins at byte {at}")
        (toc,) = struct.unpack("<I", f.read(4))
        if toc & DAQMX:
            raise ValueError("raw values of a DAQmx driver can't be read")
        head = _Head(f, bool(toc & BIG))
        head.number("I")
        after, raw = head.number("Q"), head.number("Q")
        stop = end if after == _TO_END else min(end, at + 28 + after)
        if toc & NEW_LIST:
            order, active = [], set()
        if toc & METADATA:
            for _ in range(head.number("I")):
                path, length = head.text(), head.number("I")
                if path not in order:
                    order.append(path)
                if length == _NO_DATA:
                    active.discard(path)
                else:
                    active.add(path)
                    if length != _AS_BEFORE:
                        kind, _, count = head.number("I"), head.number("I"), head.number("Q")
                        layouts[path] = Layout.of(kind, count, head.number("Q") if kind == TEXT else 0)
                for _ in range(head.number("I")):
                    head.skip_property()
        channels = [(p, layouts[p], read.get(p, 0)) for p in order if p in active]
        chunk = sum(layout.size for _, layout, _ in channels)
        if toc & RAW and chunk:
            first = at + 28 + raw
            whole = (stop - first) // chunk
            if whole:
                out.append(Segment(first, whole, bool(toc & INTERLEAVED), bool(toc & BIG), channels, whole * chunk))
                for path, layout, _ in channels:
                    read[path] = read.get(path, 0) + whole * layout.count
        at = stop
    return out


def names(path: str) -> tuple[str, str]:
    """Group and channel of an object's path, '/'group'/'channel'' with doubled quotes inside names."""
    parts = [p.replace("''", "'") for p in path.strip("/").strip("'").split("'/'")]
    return parts[0], parts[1] if len(parts) > 1 else ""


def _values(data: bytes, layout: Layout, big: bool):
    """Numbers as doubles, texts, or microseconds since 1970, whichever the layout says; the others are null."""
    order, n = ">" if big else "<", layout.count
    if layout.kind == TIME:
        kind = np.dtype([("s", ">i8"), ("f", ">u8")] if big else [("f", "<u8"), ("s", "<i8")])
        v = np.frombuffer(data, kind)
        micros = (v["f"].astype(np.float64) / 2.0**64 * 1e6).round().astype(np.int64)
        return pa.nulls(n, pa.float64()), pa.nulls(n, pa.string()), pa.array((v["s"].astype(np.int64) - _EPOCH) * 1_000_000 + micros)
    if layout.kind == TEXT:
        ends = np.frombuffer(data[: 4 * n], order + "u4")
        starts, texts = [0, *ends[:-1].tolist()], data[4 * n :]
        return pa.nulls(n, pa.float64()), pa.array([texts[a:b].decode() for a, b in zip(starts, ends.tolist())], pa.string()), pa.nulls(n, pa.int64())
    return pa.array(np.frombuffer(data, order + NUMBERS[layout.kind]).astype(np.float64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())


class _Part(InputPartition):
    def __init__(self, path: str, parts: list[Segment]):
        self.path, self.parts = path, parts


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.bytes = json.loads(options["paths"]), int(options["bytes_a_task"])
        self.wanted = json.loads(options["channels"]) if "channels" in options else None

    def partitions(self):
        out = []
        for path in self.paths:
            with opened(path) as f:
                held: list[Segment] = []
                for segment in segments(f):
                    if held and sum(s.bytes for s in held) + segment.bytes > self.bytes:
                        out.append(_Part(path, held))
                        held = []
                    held.append(segment)
                if held:
                    out.append(_Part(path, held))
        return out

    def read(self, partition):
        if partition is None:
            return
        with opened(partition.path) as f:
            for s in partition.parts:
                f.seek(s.at)
                for k in range(s.chunks):
                    for path, layout, data in self._chunk(f, s):
                        group, channel = names(path)
                        if self.wanted is not None and channel not in self.wanted:
                            continue
                        n = layout.count
                        first = next(i for p, _, i in s.channels if p == path) + k * n
                        columns = [pa.array([v] * n) for v in (partition.path, group, channel)] + [pa.array(np.arange(first, first + n))]
                        yield pa.RecordBatch.from_arrays([*columns, *_values(data, layout, s.big)], names=["file", "group", "channel", "index", "value", "text", "time_us"])

    @staticmethod
    def _chunk(f, s: Segment):
        """Path, layout and bytes of every channel of the chunk at the file's place."""
        if not s.interleaved:
            for path, layout, _ in s.channels:
                yield path, layout, f.read(layout.size)
            return
        widths = [layout.size // layout.count for _, layout, _ in s.channels]
        rows = np.frombuffer(f.read(sum(layout.size for _, layout, _ in s.channels)), np.uint8).reshape(-1, sum(widths))
        at = 0
        for (path, layout, _), width in zip(s.channels, widths):
            yield path, layout, np.ascontiguousarray(rows[:, at : at + width]).tobytes()
            at += width


class TdmsSource(DataSource):
    """Format `tdms`: options paths and channels (JSON lists) and bytes_a_task."""

    @classmethod
    def name(cls):
        return "tdms"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def values(spark: SparkSession, path: str, channels: list[str] | None = None, bytes_a_task: int = BYTES_A_TASK) -> DataFrame:
    """Values of the channels (all by default) of the files at `path`: file, group, channel, index (from 0) and
    value, text or time_us (microseconds since 1970), whichever the channel has. A last chunk that was cut off is left out."""
    spark.dataSource.register(TdmsSource)
    options = {"paths": json.dumps(listed(spark, path, ".tdms")), "bytes_a_task": str(bytes_a_task)}
    if channels is not None:
        options["channels"] = json.dumps(channels)
    return spark.read.format("tdms").options(**options).load()


def pump_data(spark: SparkSession, path: str, group: str = "Channels", zone: str = "Etc/GMT+1") -> DataFrame:
    """Time (UTC, without a zone), Pressure (MPa) and Flow of pump files whose times are in `zone`; rows without a time are left out."""
    rows = values(spark, path, ["Time", "Interval pressure", "Pump flow"]).where(F.col("group") == group)

    def of(channel, column):
        return F.max(F.when(F.col("channel") == channel, F.col(column)))

    wide = rows.groupBy("file", "index").agg(of("Time", "time_us").alias("t"), of("Interval pressure", "value").alias("p"), of("Pump flow", "value").alias("f"))
    local = F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(t AS decimal(18, 0)) / 1000000)")
    return wide.where("t is not null").select(F.convert_timezone(F.lit(zone), F.lit("UTC"), local).alias("time"), (F.col("p") / 1000).alias("Pressure"), F.col("f").alias("Flow"))


def segment(channels: dict[str, tuple[int, list]], group: str = "Channels", big: bool = False, interleaved: bool = False, same: bool = False, properties: dict[str, str] | None = None) -> bytes:
    """A segment of these channels, each a type and its values (times as microseconds since 1970). With `same` it has no
    list of objects: they are those of the segment before."""
    order = ">" if big else "<"

    def text(s):
        return struct.pack(order + "I", len(s.encode())) + s.encode()

    def one(kind, v):
        if kind == TIME:
            s, us = divmod(v, 1_000_000)
            fraction = int(us * 2**64) // 1_000_000
            return struct.pack(">qQ", s + _EPOCH, fraction) if big else struct.pack("<Qq", fraction, s + _EPOCH)
        return np.array([v]).astype(order + NUMBERS[kind]).tobytes()

    def raw(kind, vs):
        if kind == TEXT:
            coded = [v.encode() for v in vs]
            return b"".join(struct.pack(order + "I", n) for n in np.cumsum([len(c) for c in coded]).tolist()) + b"".join(coded)
        return b"".join(one(kind, v) for v in vs)

    data = {n: raw(k, vs) for n, (k, vs) in channels.items()}
    body = b"".join(one(k, vs[i]) for i in range(max(len(v) for _, v in channels.values())) for k, vs in channels.values()) if interleaved else b"".join(data.values())
    quoted = [f"/'{group}'/'" + n.replace("'", "''") + "'" for n in channels]
    objects = struct.pack(order + "I", len(channels) + 1) + text("/") + struct.pack(order + "II", _NO_DATA, len(properties or {}))
    for k, v in (properties or {}).items():
        objects += text(k) + struct.pack(order + "I", TEXT) + text(v)
    for path, (n, (kind, vs)) in zip(quoted, channels.items()):
        index = struct.pack(order + "IIQ", kind, 1, len(vs)) + (struct.pack(order + "Q", len(data[n])) if kind == TEXT else b"")
        objects += text(path) + struct.pack(order + "I", len(index) + 4) + index + struct.pack(order + "I", 0)
    head = b"" if same else objects
    toc = RAW | (0 if same else METADATA | NEW_LIST) | (BIG if big else 0) | (INTERLEAVED if interleaved else 0)
    return b"TDSm" + struct.pack("<I", toc) + struct.pack(order + "IQQ", 4713, len(head) + len(body), len(head)) + head + body
