"""Incremental ingestion with Structured Streaming: file arrival, duplicates, triggers and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", pattern: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """Files as they arrive; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema).format(kind)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.load(path)


def distinct_events(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of every key within the watermark; rows later than it are dropped and counted by Spark (trap T-06)."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_means(stream: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str) -> DataFrame:
    """A01 as a stream: means of closed windows."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys)
    return grouped.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *keys, "mean", "n")


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that has arrived, appended once; run again for what comes later."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, check: Callable[[DataFrame], bool], write: Callable[[DataFrame, int], None], log: str | None = None) -> None:
    """A batch is checked and then written. Without `log`, one that fails stops the query, to be run
    again; with it, the failure is a row (batch, error) of the table at that path and the loop goes on."""

    def put(batch: DataFrame, number: int) -> None:
        try:
            if not check(batch):
                raise ValueError(f"batch {number} failed its check")
            write(batch, number)
        except Exception as e:  # noqa: BLE001  a failed batch is reported, not hidden
            if log is None:
                raise
            failure = batch.sparkSession.createDataFrame([(number, f"{type(e).__name__}: {e}")], "batch long, error string")
            failure.write.mode("append").parquet(log)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def trigger_states(stream: DataFrame, key: str, ts: str, value: str, short: float, long: float, on: float) -> DataFrame:
    """Recursive short- and long-term averages of squared samples per channel, kept between batches: key, ts, ratio of
    the samples at or above `on`, once `long` samples have been seen. Samples of a batch are taken in time order."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        sta, lta, n = state.get if state.exists else (0.0, 0.0, 0)
        ratio = np.empty(len(rows))
        for i, x in enumerate(rows[value].to_numpy(float) ** 2):
            sta, lta = sta + (x - sta) / short, lta + (x - lta) / long
            n += 1
            ratio[i] = sta / lta if lta > 0 and n >= long else 0.0
        state.update((float(sta), float(lta), int(n)))
        over = ratio >= on
        yield pd.DataFrame({key: rows[key][over], ts: rows[ts][over], "ratio": ratio[over]})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, ratio double"
    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(run, out, "sta double, lta double, n long", "append", GroupStateTimeout.NoTimeout)


def coincidences(triggers: DataFrame, station: str, ts: str, width: str, least: int) -> DataFrame:
    """Windows in which `least` stations or more triggered."""
    grouped = triggers.groupBy(F.window(ts, width).alias("w")).agg(F.count_distinct(station).alias("stations"))
    return grouped.where(F.col("stations") >= least).select(F.col("w.start").alias("start"), "stations")


def changed(listing: DataFrame, manifest: DataFrame) -> bool:
    """Whether files (path, size) differ from the manifest of the last run, either way."""
    a, b = listing.select("path", "size"), manifest.select("path", "size")
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
