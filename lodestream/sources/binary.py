"""Readers of binary and document formats, a file at a time on the executors."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_cubes(spark: SparkSession, paths: str | list[str], bad_channels: tuple[int, ...] = ()) -> DataFrame:
    """Compressed numpy archives with an array `data` of source x receiver x sample, one file an epoch:
    epoch (the file's name), source, receiver, samples. Bad receivers and pairs of zeros have no row."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                data = np.load(io.BytesIO(content))["data"]
                epoch = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for source in range(data.shape[0]):  # a source at a time, so that a batch stays small
                    keep = [r for r in range(data.shape[1]) if r not in bad_channels and np.any(data[source, r])]
                    if keep:
                        yield pd.DataFrame({"epoch": epoch, "source": source, "receiver": keep, "samples": [data[source, r].astype(np.float32).tolist() for r in keep]})

    return files.mapInPandas(run, "epoch string, source int, receiver int, samples array<float>")


def scatter_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Location scatter files: a count and three unused numbers, then x, y, z, probability as 32-bit floats."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                n = min(struct.unpack_from("<i", content)[0], (len(content) - 16) // 16)
                points = np.frombuffer(content, "<f4", 4 * n, 16).reshape(n, 4)
                yield pd.DataFrame(points, columns=["x", "y", "z", "p"]).assign(event=path.rsplit("/", 1)[-1].rsplit(".", 1)[0])[["event", "x", "y", "z", "p"]]

    return files.mapInPandas(run, "event string, x float, y float, z float, p float")


def catalog_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of catalog documents: id, time, longitude, latitude, depth, magnitude and an array of picks."""
    schema = (
        "_publicID STRING, preferredOriginID STRING, "
        "origin ARRAY<STRUCT<_publicID: STRING, time: STRUCT<value: STRING>, longitude: STRUCT<value: DOUBLE>, latitude: STRUCT<value: DOUBLE>, depth: STRUCT<value: DOUBLE>>>, "
        "magnitude ARRAY<STRUCT<mag: STRUCT<value: DOUBLE>>>, "
        "pick ARRAY<STRUCT<time: STRUCT<value: STRING>, waveformID: STRUCT<_stationCode: STRING, _channelCode: STRING>, phaseHint: STRING>>"
    )
    events = spark.read.format("xml").option("rowTag", "event").schema(schema).load(paths)
    preferred = F.filter("origin", lambda o: o["_publicID"] == F.col("preferredOriginID"))
    o = F.coalesce(F.get(preferred, F.lit(0)), F.get("origin", F.lit(0)))
    picks = F.transform("pick", lambda p: F.struct(p["waveformID"]["_stationCode"].alias("station"), p["waveformID"]["_channelCode"].alias("channel"), p["phaseHint"].alias("phase"), p["time"]["value"].try_cast("timestamp_ntz").alias("ts")))
    return events.select(
        F.element_at(F.split("_publicID", "/"), -1).alias("event_id"), o["time"]["value"].try_cast("timestamp_ntz").alias("ts"), o["longitude"]["value"].alias("longitude"),
        o["latitude"]["value"].alias("latitude"), o["depth"]["value"].alias("depth"), F.get("magnitude", F.lit(0))["mag"]["value"].alias("magnitude"), F.coalesce(picks, F.array().cast("array<struct<station:string,channel:string,phase:string,ts:timestamp_ntz>>")).alias("picks"),
    )


_ORIGIN = re.compile(r"GEOGRAPHIC\s+OT\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)\s+Lat\s+(\S+)\s+Long\s+(\S+)\s+Depth\s+(\S+)")
_EVENT = re.compile(r"^(?=NLLOC\b)", re.M)  # events that lack their end
_QUALITY = re.compile(r"QUALITY\b.*?RMS\s+(\S+)\s+Nphs\s+(\d+)\s+Gap\s+(\S+)")
_PHASE = re.compile(r"^(\w+)\s+\S+\s+\S+\s+\S\s+(\w)\s+.*?>\s+(\S+)\s+(\S+)", re.M)


def location_outputs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Location output documents: origin, quality, and the phases with predicted time and residual.

    A file holds one event or many; events end with END_NLLOC, so that Spark splits large files between them.
    """
    files = spark.read.text(paths, lineSep="END_NLLOC").select(F.col("_metadata.file_name").alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            events = ((name, event) for name, text in zip(batch["file"], batch["value"]) for event in _EVENT.split(text))
            for name, text in events:
                if not (m := _ORIGIN.search(text)):
                    continue
                y, mo, d, h, mi, s = m.groups()[:6]
                at = pd.Timestamp(int(y), int(mo), int(d), int(h), int(mi)) + pd.Timedelta(seconds=float(s))
                q = _QUALITY.search(text)
                phases = [{"station": p[0], "phase": p[1], "predicted": float(p[2]), "residual": float(p[3])} for p in _PHASE.findall(text)]
                out.append((name, at, float(m[7]), float(m[8]), float(m[9]), float(q[1]) if q else None, int(q[2]) if q else None, phases))
            yield pd.DataFrame(out, columns=["file", "ts", "latitude", "longitude", "depth", "rms", "n_phases", "phases"])

    return files.mapInPandas(run, "file string, ts timestamp_ntz, latitude double, longitude double, depth double, rms double, n_phases int, phases array<struct<station:string,phase:string,predicted:double,residual:double>>")


def day_partitions(spark: SparkSession, path: str, days: list[str], stations: list[str] | None = None) -> DataFrame:
    """An archive partitioned by day and station, pruned before a file is opened."""
    df = spark.read.parquet(path).where(F.col("day").isin(days))
    return df.where(F.col("station").isin(stations)) if stations else df


_MAT_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _mat_element(data: bytes, at: int) -> tuple[int, bytes, int]:
    """Type, contents and end of the tagged element at a place; small elements hold their data in the tag."""
    kind, size = struct.unpack_from("<II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + size + (0 if kind == 15 else -size % 8)


def mat_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a level-5 MAT file by name; other variables are left out."""
    found, at = {}, 128
    while at + 8 <= len(content):
        kind, body, at = _mat_element(content, at)
        if kind == 15:
            kind, body, _ = _mat_element(zlib.decompress(body), 0)
        if kind != 14:
            continue
        _, flags, p = _mat_element(body, 0)
        if flags[0] not in range(6, 16) or flags[1] & 8:
            continue
        _, dims, p = _mat_element(body, p)
        _, name, p = _mat_element(body, p)
        stored, values, _ = _mat_element(body, p)
        found[name.decode()] = np.frombuffer(values, "<" + _MAT_KINDS[stored]).reshape(np.frombuffer(dims, "<i4"), order="F")
    return found


def mat_file(matrices: dict[str, np.ndarray]) -> bytes:
    """A level-5 MAT file of matrices of doubles, as bytes."""

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, matrix in matrices.items():
        m = np.atleast_2d(np.asarray(matrix, float))
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack(f"<{m.ndim}i", *m.shape)) + element(1, name.encode()) + element(9, m.tobytes(order="F"))
        out += struct.pack("<II", 14, len(body)) + body
    return out


def mat_matrices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """File, variable, row, values of every matrix; a task holds one file."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for name, matrix in mat_arrays(content).items():
                    rows = matrix.reshape(matrix.shape[0], -1).astype(float)
                    yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "variable": name, "row": np.arange(len(rows), dtype=np.int32), "values": rows.tolist()})

    return files.mapInPandas(run, "file string, variable string, row int, values array<double>")


def gridded_arrays(spark: SparkSession, paths: str | list[str], value: str = "strain") -> DataFrame:
    """Numpy archives with time (microseconds), depth and a time x depth array, as rows of ts, depth (3 digits) and value."""
    files = spark.read.format("binaryFile").load(paths).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = np.load(io.BytesIO(content))
                depth = np.round(data["depth"], 3)
                for t, row in zip(data["time"].tolist(), data[value]):
                    yield pd.DataFrame({"ts": pd.Timestamp(t, unit="us"), "depth": depth, value: row.astype(float)})

    return files.mapInPandas(run, f"ts timestamp_ntz, depth double, `{value}` double")


def header_times(spark: SparkSession, path: str, line: int, form: str) -> list:
    """The tab-separated times of one header line, last first; cells that are no time are left out."""
    cells = spark.read.text(path).limit(line + 1).collect()[line][0].split("\t")
    df = spark.createDataFrame([(i, c.strip()) for i, c in enumerate(cells)], "i int, c string")
    parsed = df.select("i", F.try_to_timestamp("c", F.lit(form)).cast("timestamp_ntz").alias("t")).where("t is not null").orderBy(F.desc("i"))
    return [r.t for r in parsed.collect()]


def fiber_by_well(frames: DataFrame, segments: DataFrame, width: float = 50.0) -> DataFrame:
    """Frame rows (ts, channel depth) with the well segment [start, stop) that holds them, at the depth along the well."""
    from lodestream.operators.ranges import interval_join

    return interval_join(frames, segments, "depth", "start", "stop", width).withColumn("along", (F.col("depth") - F.col("start")) * F.col("stretch"))
