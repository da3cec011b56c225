"""Stacks, principal vectors and coherences of groups of waveforms, from sums that meet: no group goes to one task whole.

Samples are added up by position, or as small matrices per task, before anything is shuffled. Rows with a null key,
null samples or samples of length 0 take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.storage import cut, small

from .signals import correlation


#: Values of a key's traces up to which they go to one task as they are.
_FEW = 1 << 16
#: Values of the matrices that a task holds at once.
_HELD = 1 << 22


def _kinds(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _usable(df: DataFrame, keys: list[str], samples: str, *more: str) -> DataFrame:
    rows = df.select(*keys, *more, F.col(samples).cast("array<double>").alias("x")).where("size(x) > 0")
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def _unit(x: Column) -> Column:
    """Samples over their root mean square; zeros stay."""
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))
    return F.transform(x, lambda v: F.coalesce(v / F.nullif(rms, F.lit(0.0)), F.lit(0.0)))


def _by_position(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Element-wise sums of array columns per key, and n, the rows that reach furthest."""
    zipped = rows.select(*keys, *[c.alias(n) for n, c in columns.items()])
    flat = zipped.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("i", "v"))
    sums = flat.groupBy(*keys, "i").agg(*[F.sum(f"v.{n}").alias(n) for n in columns], F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", *columns)))
    return sums.groupBy(*keys).agg(ordered.alias("a"), F.max("n").alias("n")).select(*keys, "n", *[F.col(f"a.{n}").alias(n) for n in columns])


def two_pass_members(df: DataFrame, keys: list[str], id_col: str, samples: str, least: float, first: float = 0.6) -> DataFrame:
    """Which traces of a key belong together: keys, id, first_cc, cc and member.

    The stack of all traces, each over its root mean square, picks those that correlate with it by more than `first`;
    the stack of these decides, by more than `least`. A trace without spread, or of another length than the stack, has
    no correlation and is no member; neither is any trace of a key whose first pass picks none.
    """
    rows = cut(_usable(df, keys, samples, id_col))

    def against(rows, stacked, name):
        return rows.join(small(stacked.select(*keys, F.col("s").alias("_s"))), keys, "left").withColumn(name, F.when(F.size("x") == F.size("_s"), correlation(F.col("x"), F.col("_s")))).drop("_s")

    one = against(rows, _by_position(rows, keys, {"s": _unit(F.col("x"))}), "first_cc")
    one = cut(one)
    two = _by_position(one.where(F.col("first_cc") > first), keys, {"s": _unit(F.col("x"))})
    return against(one, two, "cc").select(*keys, id_col, "first_cc", "cc", F.coalesce(F.col("cc") > least, F.lit(False)).alias("member"))


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signals of the rows of a matrix."""
    n = x.shape[1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * keep, axis=1)


def _phasors(samples: pd.Series) -> pd.DataFrame:
    """Unit phasors of the analytic signal, rows of one length at a time; 0 where it vanishes."""
    re, im = [None] * len(samples), [None] * len(samples)
    lengths = samples.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        z = analytic(np.array([samples.iloc[k] for k in at], float))
        size = np.abs(z)
        z = np.divide(z, size, out=np.zeros_like(z), where=size > 1e-12)
        for k, row in zip(at, z):
            re[k], im[k] = row.real, row.imag
    return pd.DataFrame({"re": re, "im": im})


def phase_weighted_stack(df: DataFrame, keys: list[str], samples: str, weight: float = 2.0) -> DataFrame:
    """Keys, n, linear, coherence and stacked: the sum of the traces over their root mean squares, times the length
    of the mean phasor to the power `weight`, sample by sample. Phasors have length 1 (the evident intent)."""
    rows = _usable(df, keys, samples)
    phasors = F.pandas_udf(_phasors, "struct<re: array<double>, im: array<double>>")
    p = rows.withColumn("p", phasors("x"))
    sums = _by_position(p, keys, {"linear": _unit(F.col("x")), "re": F.col("p.re"), "im": F.col("p.im")})
    length = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b) / F.col("n"))
    out = sums.withColumn("coherence", length)
    return out.select(*keys, "n", "linear", "coherence", F.zip_with("linear", "coherence", lambda v, c: v * F.pow(c, F.lit(weight))).alias("stacked"))


def _gram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and length the cells (i <= j) of the sum of all products of two samples; a matrix a task and key is sent,
    and sent early where a task would hold too many of them."""
    kinds = _kinds(rows, keys)

    def sent(held):
        for key, g in held.items():
            i, j = np.triu_indices(len(g))
            columns = [pa.array([key[k]] * len(i)).cast(rows_schema.field(c).type) for k, c in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(i), len(g)), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], names=[*keys, "n", "i", "j", "v"])

    def partial(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            frame = pd.DataFrame({c: batch.column(k).to_pandas() for k, c in enumerate(keys)})
            values = batch.column(len(keys))
            starts, flat = values.offsets.to_numpy()[:-1], values.values.to_numpy(zero_copy_only=False)
            frame["_n"] = lengths = np.diff(values.offsets.to_numpy())
            for key, at in frame.groupby([*keys, "_n"], sort=False).indices.items():
                n = int(lengths[at[0]])
                m = flat[starts[at][:, None] + np.arange(n)[None, :]]
                if key not in held:
                    if held and size + n * n > _HELD:
                        yield from sent(held)
                        held, size = {}, 0
                    size += n * n
                held[key] = held.get(key, 0) + m.T @ m
        yield from sent(held)

    from pyspark.sql.pandas.types import to_arrow_schema

    rows_schema = to_arrow_schema(rows.select(*keys).schema)
    cells = rows.mapInArrow(partial, f"{kinds}, n int, i int, j int, v double")
    return cells.groupBy(*keys, "n", "i", "j").agg(F.sum("v").alias("v"))


def principal_vectors(df: DataFrame, keys: list[str], samples: str, most: int) -> DataFrame:
    """Per key (and length n) the first `most` right singular vectors of its traces: rank (from 1), sigma,
    share (of the energy, with those before) and vector, whose largest component is positive. Vectors of no energy are left out.

    The traces of a key go to one task where they are few, and meet as sums of their products where they are many."""
    rows = cut(_usable(df, keys, samples))
    counts = rows.groupBy(*keys, F.size("x").alias("n")).agg((F.count("*") * F.size("x") <= _FEW).alias("_few"))

    def vectors(g: np.ndarray):
        """sigma, share and vector, as many as count."""
        value, vector = np.linalg.eigh(g)
        value, vector = np.maximum(value[::-1][:most], 0), vector.T[::-1][:most]
        whole = max(float(np.trace(g)), 1e-300)
        some = value > 1e-12 * whole
        value, vector = value[some], vector[some]
        sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)]) if len(vector) else np.zeros(0)
        return np.sqrt(value), np.cumsum(value) / whole, vector * sign[:, None]

    def result(heads: pa.Table, found: list) -> pa.Table:
        """A row for each vector of the keys of `heads`."""
        ranks = [len(sigma) for sigma, _, _ in found]
        columns = [heads[c].take(pa.array(np.repeat(np.arange(len(found)), ranks))) for c in [*keys, "n"]]
        columns += [pa.array(np.concatenate([np.arange(1, k + 1) for k in ranks] or [[]]), pa.int32())]
        columns += [pa.array(np.concatenate([f[k] for f in found] or [[]]), pa.float64()) for k in (0, 1)]
        return pa.table([*columns, pa.array([v for f in found for v in f[2]], pa.list_(pa.float64()))], names=[*keys, "n", "rank", "sigma", "share", "vector"])

    def solve_cells(cells: pa.Table) -> pa.Table:
        n = cells["n"][0].as_py()
        g = np.zeros((n, n))
        i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
        g[i, j] = g[j, i] = cells["v"].to_numpy()
        return result(cells.slice(0, 1), [vectors(g)])

    def solve_traces(traces: pa.Table) -> pa.Table:
        n = traces["n"][0].as_py()
        lists = traces["x"].combine_chunks()
        m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists])]).reshape(-1, n)
        return result(traces.slice(0, 1), [vectors(m.T @ m)])

    schema = f"{_kinds(rows, keys)}, n int, rank int, sigma double, share double, vector array<double>"
    counted = cut(counts)
    full = counted.where("not _few").select(*keys, "n")
    sized = rows.withColumn("n", F.size("x"))
    cold = sized.join(small(full), [*keys, "n"], "left_anti").groupBy(*keys, "n").applyInArrow(solve_traces, schema)
    hot = _gram(sized.join(small(full), [*keys, "n"], "left_semi").drop("n"), keys).groupBy(*keys, "n").applyInArrow(solve_cells, schema)
    return cold.unionByName(hot)


def first_weights(df: DataFrame, keys: list[str], id_col: str, samples: str) -> DataFrame:
    """Keys, id and weight, the trace's component of the first left singular vector: its product with the first right one."""
    rows = cut(_usable(df, keys, samples, id_col))
    first = principal_vectors(rows.withColumnRenamed("x", samples), keys, samples, 1).select(*keys, "n", "sigma", "vector")
    found = rows.withColumn("n", F.size("x")).join(small(cut(first)), [*keys, "n"], "left")
    product = F.aggregate(F.zip_with("x", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return found.select(*keys, id_col, F.coalesce(product / F.col("sigma"), F.lit(0.0)).alias("weight"))


def subspace_design(df: DataFrame, keys: list[str], samples: str, share: float = 0.9, most: int = 64) -> DataFrame:
    """The fewest principal vectors of a key that hold `share` of its energy (`most` at most): the detector's basis."""
    found = principal_vectors(df, keys, samples, most)
    before = F.col("share") - F.col("sigma") * F.col("sigma") / F.max(F.col("sigma") * F.col("sigma") / F.nullif(F.col("share"), F.lit(0.0))).over(_whole(keys))
    return found.withColumn("_before", before).where((F.col("_before") < share - 1e-12) | (F.col("rank") == 1)).drop("_before")


def _whole(keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys, "n")  # `most` rows at most


def window_coherence(df: DataFrame, station: str, at: str, value: str, nodes: dict[str, dict], length: int, step: int, chunk: int = 100_000, least: float = 0.0) -> DataFrame:
    """Node, start, coherence and pairs: over windows of `length` samples, every `step`, the mean absolute
    correlation of all pairs of stations, each station shifted by its lag at the node (samples, 0 where none is given).

    A row is a sample: station, its index and value; of equal indices the mean counts. A window of a station with a sample
    missing, or without spread, takes no part; a window without any pair has no row, nor has one whose coherence is
    below `least`. Windows start at multiples of `step` in aligned time. The record is cut into chunks with a halo of
    the largest lag and a window, whose work doesn't depend on its length. (The shift that is evidently meant; padding a
    trace that was cut by as much leaves it in place.)
    """
    if chunk % step or not nodes:
        raise ValueError("chunk must be a multiple of step, and nodes can't be empty")
    lags = [int(v) for per in nodes.values() for v in per.values()] or [0]
    low, high = min(0, *lags), max(0, *lags) + length
    rows = df.where(F.col(station).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    rows = rows.groupBy(F.col(station).cast("string").alias("station"), F.col(at).cast("long").alias("i")).agg(F.avg(F.col(value).cast("double")).alias("v"))
    # chunk c has window starts c * chunk .. and so samples from c * chunk + low to (c + 1) * chunk + high
    owners = F.sequence(F.floor((F.col("i") - high) / chunk), F.floor((F.col("i") - low) / chunk))
    dealt = rows.withColumn("c", F.explode(owners))

    def work(table: pa.Table) -> pa.Table:
        c = table["c"][0].as_py()
        names, code = np.unique(np.array(table["station"].to_pylist()), return_inverse=True)
        first, size = c * chunk + low, chunk + high - low
        place = table["i"].to_numpy() - first
        inside = (place >= 0) & (place < size)
        x, there = np.zeros((len(names), size)), np.zeros((len(names), size))
        x[code[inside], place[inside]] = table["v"].to_numpy()[inside]
        there[code[inside], place[inside]] = 1
        a, b = np.triu_indices(len(names), 1)
        starts = np.arange(0, chunk, step)
        out = []

        def sums(m):
            total = np.zeros((len(m), m.shape[1] + 1))
            np.cumsum(m, axis=1, out=total[:, 1:])
            return total[:, starts + length] - total[:, starts]

        for node, per in nodes.items():
            shifted, mask = (np.stack([m[k, int(per.get(str(s), 0)) - low : int(per.get(str(s), 0)) - low + chunk + length] for k, s in enumerate(names)]) for m in (x, there))
            full = sums(mask) > length - 0.5
            mean = (shifted.sum(1) / np.maximum(mask.sum(1), 1))[:, None]
            y = (shifted - mean) * mask  # a constant taken off first keeps the sums small
            s1, s2 = sums(y), sums(y * y)
            spread = s2 - s1 * s1 / length
            good = full & (spread > 1e-12 * np.maximum(s2, 1e-300))
            total, count = np.zeros(len(starts)), np.zeros(len(starts), int)
            for p, q in zip(a, b):
                both = good[p] & good[q]
                xy = sums((y[p] * y[q])[None, :])[0] - s1[p] * s1[q] / length
                r = np.abs(np.divide(xy, np.sqrt(np.maximum(spread[p] * spread[q], 0)), out=np.zeros(len(starts)), where=both))
                total, count = total + r, count + both
            found = np.flatnonzero(count > 0)
            value = total[found] / count[found]
            keep = value >= least
            columns = [pa.array([node] * int(keep.sum()), pa.string()), c * chunk + starts[found][keep], value[keep], count[found][keep].astype(np.int64)]
            out.append(pa.table(columns, names=["node", "start", "coherence", "pairs"]))
        return pa.concat_tables(out)

    return dealt.groupBy("c").applyInArrow(work, "node string, start long, coherence double, pairs long")


def beam_powers(df: DataFrame, keys: list[str], samples: str, east: str, north: str, azimuths: list[float], slownesses: list[float], frequency: float, rate: float, size: int) -> DataFrame:
    """Keys, azimuth, slowness, power, response and stations: per key (an array's record, a row a station) the
    Bartlett power of plane waves from every back-azimuth (degrees) and slowness, and the array's response to a vertical wave.

    Spectra at the frequency nearest `frequency` of half-overlapping Hann windows of `size` samples are turned by each
    wave's phase at the station and added up over stations, window by window, so that partial sums meet; the power is the mean
    over the windows of the squared length, by the number of stations squared. Rows with a null, or shorter than a window, take no part.
    """
    from .picks import on_matrices

    at = int(np.argmin(np.abs(np.fft.rfftfreq(size, 1 / rate) - frequency)))
    taper = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    turn = np.exp(-2j * np.pi * at * np.arange(size) / size) * taper

    def spectra(x):
        if x.shape[1] < size:
            return [None] * len(x), [None] * len(x)
        z = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: size // 2] @ turn
        return z.real, z.imag

    rows = _usable(df, keys, samples, east, north).where(F.col(east).isNotNull() & F.col(north).isNotNull())
    found = rows.withColumn("z", on_matrices(spectra, "re array<double>, im array<double>", "x")).where("z.re is not null")
    waves = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(s)).alias("s")) for a in azimuths for s in slownesses])
    each = found.select(*keys, east, north, F.posexplode(F.arrays_zip("z.re", "z.im")).alias("w", "v"))
    each = each.select(*keys, "w", "v", east, north, F.explode(waves).alias("k"))
    phase = 2 * np.pi * frequency * F.col("k.s") * (F.col(east) * F.sin(F.radians("k.a")) + F.col(north) * F.cos(F.radians("k.a")))
    c, s, re, im = F.cos(phase), F.sin(phase), F.col("v.re"), F.col("v.im")
    sums = each.groupBy(*keys, "w", "k").agg(
        F.sum(re * c + im * s).alias("re"), F.sum(im * c - re * s).alias("im"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.count("*").alias("n"),
    )
    square = F.col("n") * F.col("n")
    out = sums.groupBy(*keys, "k").agg(F.avg((F.col("re") ** 2 + F.col("im") ** 2) / square).alias("power"), F.avg((F.col("c") ** 2 + F.col("s") ** 2) / square).alias("response"), F.max("n").alias("stations"))
    return out.select(*keys, F.col("k.a").alias("azimuth"), F.col("k.s").alias("slowness"), "power", "response", "stations")
