"""Hourly panes of a stream with revisions, kept by transformWithState.

Rows come in batches. A pane is a kind and an hour of event time; it is emitted once the event time of earlier
batches has passed its end by `due_after` hours, revised (the old totals retracted, new ones put in their place)
when rows arrive after that, and closed, so that further rows are late, after `closed_after` hours.

A kind is dealt to shards by the hour's remainder, so that a hot kind has several keys and a pane one. The state
of a key is a ring of NumPy arrays by hour, serialised as one Arrow batch, and a sparse map of the open panes that
lie outside the ring. Before the shuffle every task adds up the rows of a pane, so that a hot pane sends a row a task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .shared import folder, give_back, settings

#: Hours of a kind that one ring slot step spans, and the slots of a ring: 8 x 32 hours are held densely.
SHARDS = 8
SLOTS = 32
#: Panes that a task holds before it sends them on.
_HELD = 100_000
#: The state is kept in RocksDB. As each start is another run, its stores are given up with it, not later by maintenance.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
_ADDED = "kind string, shard long, hour long, n_rows long, cents long"
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
_STAGED = "kind string, hour long, click_id long, cents long, n long"


def _combined(batches):
    """Sums of n and cents by kind and hour, over all batches of a task."""
    held, size = [], 0

    def flush():
        table = pa.concat_tables(held).group_by(["kind", "hour"]).aggregate([("n_rows", "sum"), ("cents", "sum")])
        hours = table.column("hour").to_numpy()
        columns = [table.column("kind"), pa.array(hours % SHARDS), table.column("hour"), table.column("n_rows_sum"), table.column("cents_sum")]
        return pa.table(columns, names=["kind", "shard", "hour", "n_rows", "cents"]).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["kind", "hour"]).aggregate([("n", "sum"), ("cents", "sum")])
        held.append(table.rename_columns(["kind", "hour", "n_rows", "cents"]))
        size += len(table)
        if size >= _HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
    give_back()


def exact_bincount(slots: np.ndarray, amounts: np.ndarray, length: int) -> np.ndarray:
    """Sums of int64 `amounts` by slot; bincount adds doubles, so halves of 32 bits are added apart."""
    low = np.bincount(slots, weights=(amounts & 0xFFFFFFFF).astype(float), minlength=length)
    high = np.bincount(slots, weights=(amounts >> 32).astype(float), minlength=length)
    return (high.astype(np.int64) << 32) + low.astype(np.int64)


class Ring:
    """The open panes of one key, by hour: arrays that wrap around from `base`, and a map of those outside."""

    def __init__(self, shard: int, base: int | None = None, packed: bytes | None = None, outside: dict | None = None):
        self.shard, self.base, self.outside = shard, base, outside or {}
        if packed:
            batch = pa.ipc.open_stream(packed).read_next_batch()
            self.n, self.cents, self.sent = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(3))
        else:
            self.n, self.cents, self.sent = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool)

    def packed(self) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(self.n), pa.array(self.cents), pa.array(self.sent)], names=["n", "cents", "sent"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def add(self, hours: np.ndarray, n: np.ndarray, cents: np.ndarray) -> None:
        if not len(hours):
            return
        steps = hours // SHARDS
        if self.base is None:
            self.base = int(steps.min())
        inside = (steps >= self.base) & (steps < self.base + SLOTS)
        at = steps[inside] % SLOTS
        self.n += exact_bincount(at, n[inside], SLOTS)
        self.cents += exact_bincount(at, cents[inside], SLOTS)
        for hour, k, c in zip(hours[~inside].tolist(), n[~inside].tolist(), cents[~inside].tolist()):
            old = self.outside.get(hour, (0, 0, False))
            self.outside[hour] = (old[0] + k, old[1] + c, old[2])

    def table(self):
        """Hours in ascending order with their places (a slot, or -1 for the map), n, cents and sent."""
        steps = np.arange(SLOTS) + (self.base or 0)
        at = steps % SLOTS
        hours = steps * SHARDS + self.shard
        rest = sorted(self.outside)
        if not rest:
            return hours, at, self.n[at], self.cents[at], self.sent[at]
        values = [self.outside[h] for h in rest]
        hours = np.concatenate([hours, np.array(rest, np.int64)])
        columns = [np.concatenate([own[at], np.array([v[i] for v in values], own.dtype)]) for i, own in enumerate((self.n, self.cents, self.sent))]
        order = np.argsort(hours, kind="stable")
        return (hours[order], np.concatenate([at, np.full(len(rest), -1)])[order], *(c[order] for c in columns))

    def mark(self, hours: np.ndarray, at: np.ndarray) -> None:
        """These panes are emitted."""
        self.sent[at[at >= 0]] = True
        for hour in hours[at < 0].tolist():
            self.outside[hour] = (*self.outside[hour][:2], True)

    def forget(self, upto: int) -> None:
        """Panes of hours up to `upto` are closed: their slots are free, and panes of the map that now fit move in."""
        self.outside = {h: v for h, v in self.outside.items() if h > upto}
        if self.base is None:
            return
        first = -((self.shard - upto - 1) // SHARDS)  # least step whose hour is later than upto
        if first > self.base:
            free = (np.arange(self.base, min(first, self.base + SLOTS))) % SLOTS
            self.n[free], self.cents[free], self.sent[free] = 0, 0, False
            self.base = first
        for hour in [h for h in self.outside if self.base <= h // SHARDS < self.base + SLOTS]:
            at = hour // SHARDS % SLOTS
            self.n[at], self.cents[at], self.sent[at] = self.outside.pop(hour)


class PaneProcessor(StatefulProcessor):
    """One batch of one key: rows are added, then due panes emitted, changed ones revised and closed ones forgotten."""

    def __init__(self, batch: int, seen: int | None, due_after: int, closed_after: int, last: bool):
        self.batch, self.seen, self.last = batch, seen, last
        self.due, self.closed = (None, None) if seen is None else (seen - 1 - due_after, seen - 1 - closed_after)

    def init(self, handle) -> None:
        self.ring = handle.getValueState("ring", "base long, panes binary, n_outside long")
        self.outside = handle.getMapState("outside", "hour long", "n long, cents long, sent boolean")

    def _load(self, shard: int) -> Ring:
        if not self.ring.exists():
            return Ring(shard)
        base, packed, n_outside = self.ring.get()
        rest = {k[0]: tuple(v) for k, v in self.outside.iterator()} if n_outside else {}
        return Ring(shard, base, bytes(packed), rest)

    def _save(self, ring: Ring, before: set) -> None:
        if ring.base is None or not (ring.n.any() or ring.outside):  # nothing is open
            self.ring.clear()
        else:
            self.ring.update((ring.base, ring.packed(), len(ring.outside)))
        for hour in before - ring.outside.keys():
            self.outside.removeKey((hour,))
        for hour, value in ring.outside.items():
            self.outside.updateValue((hour,), value)

    def handleInputRows(self, key, rows, timerValues):
        kind, shard = key
        ring = self._load(int(shard))
        before = set(ring.outside)
        old_hours, _, old_n, old_cents, old_sent = ring.table()
        for frame in rows:
            n = frame["n_rows"].to_numpy(np.int64)
            some = n > 0
            ring.add(frame["hour"].to_numpy(np.int64)[some], n[some], frame["cents"].to_numpy(np.int64)[some])
        hours, at, n, cents, sent = ring.table()
        parts = []

        def write(record, which, n, cents):
            if len(which):
                parts.append(pd.DataFrame({
                    "batch": self.batch, "hour": hours[which], "click_id": -1, "n_rows": n[which], "cents": cents[which], "record": record, "kind": kind,
                }))

        was_n, was_cents, was_sent = (np.zeros(len(hours), a.dtype) for a in (n, cents, sent))
        place = np.searchsorted(hours, old_hours)  # a pane of the old table is one of the new, unless the ring only now begins
        keep = (place < len(hours)) & (hours[np.minimum(place, len(hours) - 1)] == old_hours)
        for new, old in ((was_n, old_n), (was_cents, old_cents), (was_sent, old_sent)):
            new[place[keep]] = old[keep]
        dirty = np.flatnonzero(was_sent & (n > was_n))
        write("retract", dirty, was_n, was_cents)
        write("replace", dirty, n, cents)
        if self.due is not None:
            due = np.flatnonzero((n > 0) & ~sent & (np.arange(len(hours)) < np.searchsorted(hours, self.due, "right")))
            write("emit", due, n, cents)
            ring.mark(hours[due], at[due])
            sent[due] = True
        if self.last:
            write("final", np.flatnonzero((n > 0) & ~sent), n, cents)
        if self.closed is not None:
            ring.forget(self.closed)
        self._save(ring, before)
        yield from parts

    def close(self) -> None:
        pass


def _move(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = a.getFileSystem(conf)
    if files.exists(a) and not files.rename(a, b):
        raise OSError(f"{source} can't be moved")


def revisions(rows: DataFrame, batches: int, due_after: int = 12, closed_after: int = 48) -> DataFrame:
    """What a pane query writes over `batches` batches of rows: RECORDS.

    `rows` has batch (0 .. batches - 1; other rows are ignored), kind, hour (event hour, may be negative),
    click_id and cents (null: 0); a null kind is `none`, rows without an hour are dropped, repeated rows count
    each, and further columns are ignored. Records are `late` (a row of a closed pane), `emit`, `retract`,
    `replace` and, in the last batch, `final`. An empty table gives no records. The rows are written to a new
    folder, a folder a batch; for every batch a streaming query is started anew on one checkpoint. Every batch
    holds a row without content for every key, so that panes fall due in batches without rows. What the driver
    gets is the latest hour of every batch.
    """
    spark = rows.sparkSession
    root = f"{folder(spark)}/lodestream/panes-{uuid.uuid4().hex}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(name):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")

    kinds = F.coalesce("kind", F.lit("none"))
    taken = rows.where(F.col("hour").isNotNull() & F.col("batch").between(0, batches - 1))
    taken = taken.select(
        F.col("batch").cast("int").alias("batch"), kinds.alias("kind"), F.col("hour").cast("long").alias("hour"),
        F.col("click_id").cast("long").alias("click_id"), F.coalesce(F.col("cents").cast("long"), F.lit(0)).alias("cents"), F.lit(1).cast("long").alias("n"),
    )
    taken.write.partitionBy("batch").parquet(f"{root}/rows")
    kept = spark.read.schema(f"{_STAGED}, batch int").parquet(f"{root}/rows")
    latest = {r["batch"]: r["latest"] for r in kept.groupBy("batch").agg(F.max("hour").alias("latest")).collect()}
    ticks = kept.select("kind").distinct().select(
        "kind", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)).cast("array<long>")).alias("hour"),
        F.lit(None).cast("long").alias("click_id"), F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("n"),
    )
    ticks.select("*", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")).write.partitionBy("batch").parquet(f"{root}/ticks")
    seen: dict[int, int | None] = {}
    now = None
    for k in range(batches):
        seen[k] = now
        if k in latest:
            now = latest[k] if now is None else max(now, latest[k])
    fs.mkdirs(path("source"))
    fs.mkdirs(path("out"))
    with settings(spark, _STATE):
        for k in range(batches if latest else 0):
            for name in ("rows", "ticks"):
                _move(spark, f"{root}/{name}/batch={k}", f"{root}/source/{name}-{k}")
            _start(spark, root, k, seen[k], due_after, closed_after, k == batches - 1).awaitTermination()
    for name in ("rows", "ticks", "source", "checkpoint"):
        fs.delete(path(name), True)
    return spark.read.schema(RECORDS).parquet(f"{root}/out")


def _start(spark: SparkSession, root: str, batch: int, seen: int | None, due_after: int, closed_after: int, last: bool):
    """The query of one batch, which has just been moved to the source folder."""
    stream = spark.readStream.schema(_STAGED).option("recursiveFileLookup", "true").parquet(f"{root}/source")
    late = F.lit(False) if seen is None else (F.col("n") > 0) & (F.col("hour") < seen - closed_after)
    added = stream.where(~late).select("kind", "hour", "n", "cents").mapInArrow(_combined, _ADDED)
    panes = added.groupBy("kind", "shard").transformWithStateInPandas(
        PaneProcessor(batch, seen, due_after, closed_after, last), RECORDS, "Append", "None"
    )
    out = stream.where(late).select(
        F.lit(batch).cast("long").alias("batch"), "hour", "click_id", F.col("n").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind"
    ).union(panes)
    sink = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    return sink.outputMode("append").trigger(availableNow=True).start()
