"""Relative polarities of templates and detections (G28) and coherences of events (G07), of all pairs, block by block as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.storage import cut, small

#: Rows of a block of templates or detections; every two blocks of a key are compared in a task.
BLOCK = 512
#: Blocks of events beyond which a key's blocks grow instead, to `_LARGE` events each.
_BLOCKS, _LARGE = 24, 4096
#: Correlations that a task holds at once.
_AT_ONCE = 4_000_000


def sliding_correlation(templates: np.ndarray, traces: np.ndarray) -> np.ndarray:
    """Pearson correlations of every template at every place of every trace: (templates, traces, places); 0 without spread."""
    n = templates.shape[1]
    windows = np.lib.stride_tricks.sliding_window_view(traces, n, axis=1)
    t = templates - templates.mean(1, keepdims=True)
    size = np.sqrt((t * t).sum(1))
    t = np.divide(t, size[:, None], out=np.zeros_like(t), where=size[:, None] > 1e-12)
    w = windows - windows.mean(2, keepdims=True)
    spread = np.sqrt((w * w).sum(2))
    product = np.einsum("tn,dpn->tdp", t, w, optimize=True)
    return np.divide(product, spread[None], out=np.zeros_like(product), where=spread[None] > 1e-12)


def relative_polarities(cc: np.ndarray, least_cc: float) -> np.ndarray:
    """Sign of the largest absolute correlation times its height above the higher of the peaks beside it.

    The last axis holds correlations by place. Peaks are higher than two places on either side. The value is 0 where
    the largest lies at an end, is under `least_cc` or no peak, or where there is no other peak.
    """
    a = np.abs(cc)
    places = a.shape[-1]
    if places < 3:
        return np.zeros(a.shape[:-1])
    peak = np.ones(a.shape, bool)
    for shift in (1, 2):
        for sign in (1, -1):
            other = np.take(a, np.clip(np.arange(places) + sign * shift, 0, places - 1), axis=-1)
            peak &= a > other
    at = a.argmax(-1)
    top = np.take_along_axis(a, at[..., None], -1)[..., 0]
    place = np.arange(places)
    none = -np.ones(a.shape[:-1], int)
    before = np.where(peak & (place < at[..., None]), place, -1).max(-1, initial=-1)
    after = np.where(peak & (place > at[..., None]), place, places).min(-1, initial=places)
    left = np.where(before >= 0, np.take_along_axis(a, np.maximum(before, 0)[..., None], -1)[..., 0], -np.inf)
    right = np.where(after < places, np.take_along_axis(a, np.minimum(after, places - 1)[..., None], -1)[..., 0], -np.inf)
    second = np.maximum(left, right)
    own = np.take_along_axis(peak, at[..., None], -1)[..., 0]
    good = (at > 0) & (at < places - 1) & (top >= least_cc) & own & ((before > none) | (after < places))
    sign = np.sign(np.take_along_axis(cc, at[..., None], -1)[..., 0])
    return np.where(good, sign * (top - np.where(good, second, 0)), 0.0)


def polarity_matrix(templates: DataFrame, detections: DataFrame, keys: list[str], id_col: str, samples: str, least_cc: float, level: float = 0.0) -> DataFrame:
    """keys, template, detection and polarity of all pairs of a key (phase and channel) whose absolute polarity is over `level`.

    Templates are slid along detections, whose samples are as many or more. Both are dealt to blocks by a hash of their
    id, more of them where a key has more rows, and a task gets two blocks, so that a hot key is many tasks; only pairs
    over the level leave it. Rows with a null key, id or sample, or without any sample but zeros, have no polarity, nor
    have templates longer than the detection.
    """

    def prepared(df, name):
        rows = df.select(*keys, F.col(id_col).alias(name), F.col(samples).cast("array<double>").alias("x"))
        for c in [*keys, name, "x"]:
            rows = rows.where(F.col(c).isNotNull())
        return cut(rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("x", lambda v: v != 0)))

    t, d = prepared(templates, "template"), prepared(detections, "detection")
    blocks = t.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_a")).join(d.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_b")), keys)
    blocks = cut(blocks)

    def dealt(rows, name, own, others):
        mine = F.pmod(F.xxhash64(name, F.lit(11)), F.col(own)).cast("int")
        copies = rows.join(small(blocks), keys).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return copies.select(*keys, F.col("_mine" if own == "_a" else "_other").alias("p"), F.col("_other" if own == "_a" else "_mine").alias("q"), name, "x")

    kinds = dict(t.dtypes) | dict(d.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "template", "detection"]) + ", polarity double"

    def arrays(table):
        """Ids and samples by length."""
        lists = table["x"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(starts)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            yield at, flat[starts[:-1][at][:, None] + np.arange(n)[None, :]]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            for i, a in arrays(left):
                for j, b in arrays(right):
                    if a.shape[1] > b.shape[1]:
                        continue
                    places = b.shape[1] - a.shape[1] + 1
                    step = max(1, _AT_ONCE // (max(len(a), a.shape[1]) * places))
                    for k in range(0, len(b), step):
                        value = relative_polarities(sliding_correlation(a, b[k : k + step]), least_cc)
                        p, q = np.nonzero(np.abs(value) > level)
                        found.append((i[p], j[k + q], value[p, q]))
        at, other, value = (np.concatenate(x) for x in zip(*found))
        columns = [left[c].combine_chunks().take(pa.array(at)) for c in [*keys, "template"]] if len(left) else [right[c].combine_chunks().take(pa.array(other)) for c in keys] + [pa.array([], left["template"].type)]
        columns += [right["detection"].combine_chunks().take(pa.array(other)), pa.array(value)]
        return pa.table(columns, names=[*keys, "template", "detection", "polarity"])

    a, b = dealt(t, "template", "_a", "_b"), dealt(d, "detection", "_b", "_a")
    return a.groupBy(*keys, "p", "q").cogroup(b.groupBy(*keys, "p", "q")).applyInArrow(work, schema)


def event_coherences(df: DataFrame, keys: list[str], event: str, channel: str, samples: str, least: float, min_channels: int = 1) -> DataFrame:
    """Keys, a, b, coherence and channels of all pairs of events a < b of a key whose coherence is `least` or more:
    the mean zero-lag correlation over the channels that both have, if these are `min_channels` or more.

    Events are dealt to blocks by a hash, more of them where a key has more events, and a task gets two blocks with all
    their channels as matrices, compared strip by strip; only pairs over the threshold leave it. A trace goes to every block
    of its key, BLOCK events each up to _BLOCKS of them; then blocks grow, so that copies don't, and samples that are
    floats go as such. Traces with a null key, event or channel, with
    null samples or without spread, and pairs of other lengths, don't count; of traces that repeat an event and a channel, the least counts.
    """
    rows = df.select(*keys, F.col(event).alias("event"), F.col(channel).alias("channel"), F.col(samples).cast("array<double>").alias("x"))
    for c in [*keys, "event", "channel", "x"]:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).groupBy(*keys, "event", "channel").agg(F.min("x").alias("x"))
    rows = cut(rows)
    events = F.count_distinct("event")
    many = F.greatest(F.least(F.ceil(events / BLOCK), F.lit(_BLOCKS)), F.ceil(events / _LARGE))
    blocks = cut(rows.groupBy(*keys).agg(many.cast("int").alias("_n"), F.bool_and(F.forall("x", lambda v: v == v.cast("float").cast("double"))).alias("_exact")))
    exact = blocks.agg(F.bool_and("_exact")).first()[0]
    own = F.pmod(F.xxhash64("event", F.lit(13)), F.col("_n")).cast("int")
    sent = rows.withColumn("x", F.col("x").cast("array<float>")) if exact else rows  # without any loss
    dealt = sent.join(small(blocks.drop("_exact")), keys).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cells = dealt.select(*keys, F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"), "_own", "event", "channel", "x")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", a {kinds['event']}, b {kinds['event']}, coherence double, channels long"

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        event, channel, owner = (table[c].combine_chunks() for c in ("event", "channel", "_own"))
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        names = event.unique()
        names = names.take(pc.sort_indices(names))
        code = pc.index_in(event, names).to_numpy(zero_copy_only=False)
        lists = table["x"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        lengths, owner = np.diff(starts), owner.to_numpy(zero_copy_only=False)
        groups = pc.index_in(channel, channel.unique()).to_numpy(zero_copy_only=False)
        left, right = (np.unique(code[owner == k]) for k in (p, q))  # events of the blocks, in their order
        parts = []
        for g in np.unique(groups):
            for n in np.unique(lengths[groups == g]):
                at = np.flatnonzero((groups == g) & (lengths == n))
                m = flat[starts[:-1][at][:, None] + np.arange(n)[None, :]].astype(float)
                m = m - m.mean(1, keepdims=True)
                size = np.sqrt((m * m).sum(1))
                at, m = at[size > 1e-12], m[size > 1e-12] / size[size > 1e-12][:, None]
                side = [(np.searchsorted(block, code[at[owner[at] == k]]), m[owner[at] == k]) for block, k in ((left, p), (right, q))]
                order = np.argsort(side[0][0])
                parts.append((side[0][0][order], side[0][1][order], *side[1]))
        found = []
        step = max(1, _AT_ONCE // max(1, len(right)))
        for k in range(0, len(left), step):
            strip = left[k : k + step]
            total, count = np.zeros((len(strip), len(right))), np.zeros((len(strip), len(right)), np.int32)
            for i, a, j, b in parts:
                own = slice(*np.searchsorted(i, (k, k + step)))
                if len(j) == len(right) and own.stop - own.start == len(strip):
                    total[:, j] += a[own] @ b.T
                    count += 1
                elif own.stop > own.start and len(j):
                    cell = np.ix_(i[own] - k, j)
                    total[cell] += a[own] @ b.T
                    count[cell] += 1
            good = count >= max(1, min_channels)
            if p == q:  # each pair once
                good &= strip[:, None] < right[None, :]
            mean = np.divide(total, count, out=np.zeros_like(total), where=good)
            a, b = np.nonzero(good & (mean >= least))
            found.append((np.minimum(strip[a], right[b]), np.maximum(strip[a], right[b]), mean[a, b], count[a, b]))
        a, b, mean, count = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int))
        columns = [pa.array([table[c][0].as_py()] * len(a), table[c].type) for c in keys]
        columns += [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(mean), pa.array(count.astype(np.int64))]
        return pa.table(columns, names=[*keys, "a", "b", "coherence", "channels"])

    return cells.groupBy(*keys, "p", "q").applyInArrow(work, schema)
