"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn from the law that a uniform shuffle of all rows
would give (rows of the matrix add up to the partitions' sizes, columns to the shards'). A partition then
permutes its rows and deals them out by its row of the matrix, and each shard permutes what it received.
The permutations are keyed bijections of a row's place, so that no task holds a whole partition or shard,
and a row computed again after a loss goes to the same place.
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import store

#: Partitions that are told apart at most, which bounds the matrix; more are joined without a shuffle.
PARTITIONS = 1 << 14
#: numpy draws from populations below this only.
_NUMPY_LIMIT = 10**9
_ROUNDS = 6


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` items out of good + bad are good."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n, k):
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    peak = exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - peak
    left = right = mode
    p_left = p_right = peak
    while u > 0 and (left > low or right < high):  # outward from the mode until the drawn mass is used up
        if right < high:
            p_right *= (good - right) / (right + 1) * (drawn - right) / (bad - drawn + right + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left / (good - left + 1) * (bad - drawn + left) / (drawn - left + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """counts[p] rows of partition p over shards of the given sizes, as a uniform shuffle would send them."""
    rng = np.random.default_rng(seed)
    room = [int(s) for s in sizes]
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        left, others = int(n), sum(room)
        for j in range(len(room)):
            others -= room[j]
            got = hypergeometric(rng, room[j], others, left)
            out[p, j] = got
            room[j] -= got
            left -= got
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (fixed multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(place: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where `place` of 0 .. size - 1 goes under the permutation named by `key` (all arrays of one length).

    A Feistel network over the least even number of bits that holds `size`, walked until it falls inside.
    """
    x, size, key = (np.asarray(a).astype(np.uint64) for a in (place, size, key))
    half = np.ones(len(x), np.uint64)
    for h in range(1, 32):
        half += np.uint64(1) * (size > (np.uint64(1) << np.uint64(2 * h)))
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        v, h, m, k = x[todo], half[todo], low[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(_ROUNDS):
            left, right = right, left ^ (_mix(right + k + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows with shard (int, 0 .. shards - 1) and slot (long, gapless from 0 in a shard).

    Shard sizes differ by one at most, whatever the values: nulls, ties and repeated rows count as any row.
    The rows are written to the shared folder once, so that what a partition holds is fixed before counts
    are drawn; the same rows in the same partitions and the same seed give the same result. Columns of
    `rows` named shard or slot are replaced. An empty table gives an empty result. The rows leave
    partitioned by shard and in slot order.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = rows.drop("shard", "slot")
    at = "at"
    while at in rows.columns:
        at = "_" + at
    kept = store(rows.coalesce(PARTITIONS).withColumn(at, F.monotonically_increasing_id()), "rows")
    found = kept.groupBy(F.shiftright(at, 33).alias("p")).count().collect()  # PARTITIONS rows at most
    counts = {r["p"]: r["count"] for r in found}
    order = sorted(counts)
    total = sum(counts.values())
    sizes = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    sent = matrix([counts[p] for p in order], sizes.tolist(), seed)
    apart = max(counts.values(), default=0) + 1  # rows of the matrix, cumulated and moved apart, are one sorted list
    held = kept.sparkSession.sparkContext.broadcast((
        np.array(order, np.int64),
        np.array([counts[p] for p in order], np.int64),
        np.cumsum(sent, axis=1) + np.arange(len(order))[:, None] * apart,
        sent,
        np.cumsum(sent, axis=0) - sent,
    ))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches):
        partitions, counts, upto, sent, before = held.value
        for batch in batches:
            place = batch.column(len(names)).to_numpy()
            p = np.searchsorted(partitions, place >> 33)
            x = permute(place & ((1 << 33) - 1), counts[p], _mix(np.uint64(2 * seed) + (partitions[p].astype(np.uint64) << np.uint64(20))))
            x = x + p * apart
            shard = np.searchsorted(upto.ravel(), x, side="right") - p * shards
            received = before[p, shard] + x - (upto[p, shard] - sent[p, shard])
            slot = permute(received, sizes[shard], _mix(np.uint64(2 * seed + 1) + (shard.astype(np.uint64) << np.uint64(20))))
            columns = [batch.column(i) for i in range(len(names))] + [pa.array(shard, pa.int32()), pa.array(slot, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "shard", "slot"])

    dealt = kept.select(*[F.col(f"`{c}`") for c in names], at).mapInArrow(run, schema)
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """The shuffled rows as Parquet, a folder for each shard."""
    shuffle_into_shards(rows, shards, seed).write.partitionBy("shard").parquet(path)
