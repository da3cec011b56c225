"""Time-series operators: resampling, gap filling, islands, rolling windows, integrals.

Every operator takes the partition keys explicitly; a window without keys would gather the table in one task.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestream.storage import cut, small


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def bucket(ts: str, width: str) -> Column:
    """Start of the time bucket of `width`, without zone."""
    return F.window(ts, width)["start"].cast("timestamp_ntz")


def resample_mean(df: DataFrame, ts: str, width: str, values: list[str], keys: list[str] = (), digits: int = 6) -> DataFrame:
    """Means per bucket; buckets without rows are absent, buckets of nulls only go."""
    out = df.groupBy(*keys, F.window(ts, width).alias("w")).agg(*[F.round(F.avg(v), digits).alias(v) for v in values])
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), *values).dropna("all", subset=values)


def densify(df: DataFrame, ts: str, step: str, keys: list[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A row for every step between the ends of each key's buckets; the values of new rows are null."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence(first if first is not None else F.col("_a"), last if last is not None else F.col("_b"), F.expr(f"INTERVAL {step}"))).alias(ts))
    return spine.join(df, [*keys, ts], "left")


def interpolate(df: DataFrame, value: str, keys: list[str], order: str, name: str | None = None) -> DataFrame:
    """Linear in row position between known neighbours; the last known value is carried on, leading nulls stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = (Window.unboundedPreceding, 0)  # what follows is read in the other direction: frames that grow are linear
    back, ahead = w.rowsBetween(*upto), Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(*upto)
    df = df.withColumn("_n", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.col("_n"))
    left, right = F.last(value, True).over(back), F.last(value, True).over(ahead)
    at, to = F.last(known, True).over(back), F.last(known, True).over(ahead)
    share = (F.col("_n") - at) / F.nullif(to - at, F.lit(0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(right.isNull(), left).otherwise(left + (right - left) * share)
    return df.withColumn(name or value, filled).drop("_n")


def islands(df: DataFrame, keys: list[str], start: Column, end: Column, gap: Column | None = None, chunk_seconds: float | None = None) -> DataFrame:
    """Runs of intervals that touch or overlap (or lie within `gap`): keys, island start, island end, n.

    With `chunk_seconds` the intervals that start in one stretch of time are merged first, and then what is left
    of all stretches, so that a key with many rows is not sorted in one task.
    """
    rows = df.select(*keys, start.alias("start"), end.alias("end"), F.lit(1).cast("long").alias("n"))
    if chunk_seconds:
        rows = rows.withColumn("_c", F.floor(micros("start") / (chunk_seconds * 1e6)))
        rows = _merge(rows, [*keys, "_c"], gap).drop("_c")
    return _merge(rows, keys, gap)


def _merge(rows: DataFrame, keys: list[str], gap: Column | None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    limit = reach if gap is None else reach + gap
    fresh = F.when(reach.isNull() | (F.col("start") > limit), 1).otherwise(0)
    marked = rows.withColumn("_f", fresh).withColumn("_i", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_i")


def rolling_in_chunks(df: DataFrame, keys: list[str], ts: str, seconds: float, chunk_seconds: float, results: dict) -> DataFrame:
    """W06, X07 for keys with many rows: `results` (name -> function of a window) over (t - seconds, t].

    Time is cut into chunks; a row is also copied to the chunks that begin within `seconds` after it, where it only
    serves the frames of others. A task sorts a chunk of a key, not the key.
    """
    at, width = micros(ts), chunk_seconds * 1e6
    first, last = F.floor(at / width), F.floor((at + seconds * 1e6 - 1) / width)
    rows = df.withColumn("_own", first).withColumn("_c", F.explode(F.sequence(first, last)))
    w = rolling_time([*keys, "_c"], ts, seconds)
    for name, result in results.items():
        rows = rows.withColumn(name, result(w))
    return rows.where("_c = _own").drop("_c", "_own")


def frame_statistics(t: np.ndarray, v: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, median and sample deviation of the values with t in (at - width, at], for every `at`; t and `at` ascend.

    A frame's values are kept in order and its sums are differences of running sums, so that a step costs what enters
    and leaves it. NaN is the largest value; frames without values, and deviations of one value, are NaN.
    """
    lo, hi = np.searchsorted(t, at - width, "right"), np.searchsorted(t, at, "right")
    n = hi - lo
    odd, nan = ~np.isfinite(v), np.isnan(v)
    centre = v[~odd].mean() if not odd.all() else 0.0
    d = np.where(odd, 0.0, v - centre).astype(np.longdouble)
    running = lambda x: np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    one, two, odds, nans = running(d), running(d * d), running(odd.astype(np.int64)), running(nan.astype(np.int64))
    with np.errstate(all="ignore"):
        part = one[hi] - one[lo]
        square = two[hi] - two[lo] - part * part / n
        mean = np.asarray(centre + part / n, float)
        sd = np.sqrt(np.asarray(np.maximum(square, 0) / (n - 1), float))
    lost = two[hi] * np.longdouble(1e-17) > np.longdouble(1e-9) * square  # much larger values lie before the frame
    med = np.full(len(at), np.nan)
    frame: list[float] = []
    a = b = 0
    for i in range(len(at)):
        p, q = int(lo[i]), int(hi[i])
        if p >= b or (q - b) + (p - a) > len(frame) // 8:
            frame = np.sort(v[p:q][~nan[p:q]]).tolist()
        else:
            for x in v[b:q].tolist():
                if x == x:
                    bisect.insort(frame, x)
            for x in v[a:p].tolist():
                if x == x:
                    del frame[bisect.bisect_left(frame, x)]
        a, b = p, q
        if p == q:
            continue
        k, last = q - p - 1, len(frame) - 1
        if (k + 1) // 2 <= last:
            med[i] = frame[k // 2] if k % 2 == 0 or frame[k // 2] == frame[k // 2 + 1] else frame[k // 2] * 0.5 + frame[k // 2 + 1] * 0.5
        if odds[q] > odds[p]:
            mean[i], sd[i] = v[p:q].sum(), np.nan
        elif frame[0] == frame[-1]:
            mean[i], sd[i] = frame[0], 0.0
        elif lost[i]:
            mean[i], sd[i] = v[p:q].mean(), v[p:q].std(ddof=1)
    return mean, med, np.where(n > 1, sd, np.nan)


def rolling_statistics(df: DataFrame, keys: list[str], ts: str, seconds: float, chunk_seconds: float, value: str) -> DataFrame:
    """`df` with mean, med and sd of `value` over (t - seconds, t] of its key, null without values (sd: without two).

    Time is cut into chunks; a row is also copied to the chunks that begin within `seconds` after it. Spark's own sliding
    frames look at all rows of the frame again for every row; here a task goes once through a chunk of a key. Rows
    without a time are frames among themselves.
    """
    at, width = micros(ts), int(seconds * 1e6)
    long = chunk_seconds * 1e6
    first, last = F.floor(at / long), F.floor((at + width - 1) / long)
    rows = df.withColumn("_t", at).withColumn("_v", F.col(value).cast("double")).withColumn("_own", first)
    rows = rows.withColumn("_c", F.explode(F.coalesce(F.sequence(first, last), F.array(F.lit(None).cast("long")))))
    names = list(df.columns)

    def run(table: pa.Table) -> pa.Table:
        t = table["_t"].fill_null(0).to_numpy()
        order = np.argsort(t, kind="stable")
        known = order[~pc.is_null(table["_v"]).to_numpy()[order]]
        v = table["_v"].fill_null(0.0).to_numpy()
        own = order[pc.fill_null(pc.equal(table["_c"], table["_own"]), True).to_numpy()[order]]
        moments = np.unique(t[own])
        place = np.searchsorted(moments, t[own])
        some = np.searchsorted(t[known], moments, "right") > np.searchsorted(t[known], moments - width, "right")
        pairs = np.searchsorted(t[known], moments, "right") - np.searchsorted(t[known], moments - width, "right") > 1
        out = table.select(names).take(pa.array(own))
        for name, x, there in zip(("mean", "med", "sd"), frame_statistics(t[known], v[known], moments, width), (some, some, pairs)):
            out = out.append_column(name, pa.array(x[place], mask=~there[place]))
        return out

    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in ("mean", "med", "sd")]])
    return rows.groupBy(*keys, "_c").applyInArrow(run, schema)


def running_total(df: DataFrame, keys: list[str], ts: str, ties: list, value: Column, chunk_seconds: float, name: str = "total") -> DataFrame:
    """W04, A26, W28 for keys with many rows: the sum of `value` up to each row in time order.

    Sums within chunks of time are added to the totals of the chunks before, of which there are few.
    """
    rows = df.withColumn("_v", value).withColumn("_c", F.floor(micros(ts) / (chunk_seconds * 1e6)))
    sums = rows.groupBy(*keys, "_c").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_c", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*keys, "_c").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_w", F.sum("_v").over(inner))
    return here.join(offsets, [*keys, "_c"]).withColumn(name, F.col("_w") + F.col("_o")).drop("_v", "_c", "_w", "_o")


def rolling_time(keys: list[str], ts: str, seconds: float) -> Window:
    """The frame (t - seconds, t], its left edge left out as the usual data-frame libraries do (trap T-05)."""
    return Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-int(seconds * 1e6) + 1, 0)


def rolling_rows(keys: list[str], order: list, before: int, after: int = 0) -> Window:
    """A frame of rows around the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)


def percentile(value: str | Column, share: float = 0.5) -> Column:
    """A percentile that window frames accept, linear between ranks."""
    return F.percentile(value, F.lit(share))


#: Rows of a key that one window takes; a hot key has many windows.
ROWS_A_WINDOW = 20_000


def _meet(rows: DataFrame, other: DataFrame, on: list[str], few: bool = False) -> DataFrame:
    """`rows` with the further columns of `other`, which has a row for each of their keys; nulls meet nulls."""
    named = other.select(*[F.col(c).alias("_k" + c) if c in on else F.col(c) for c in other.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("_k" + c)) for c in on])
    return rows.join(small(cut(named)) if few else named, same).drop(*["_k" + c for c in on])


def number_within(df: DataFrame, keys: list[str], order: list, name: str = "_i") -> DataFrame:
    """`df`, stored in ranges of keys and order, with each row's number from 1 within its key; null keys are one key.

    A row's number is its place in its range after those of its key in the ranges before, which are few numbers.
    """
    laid = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut(laid.withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))
    counts = rows.groupBy(*keys, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    shifts = counts.select(*keys, "_p", (before - F.col("_first") + 1).alias("_shift"))
    return _meet(rows, shifts, [*keys, "_p"], few=True).withColumn(name, F.col("_m") + F.col("_shift")).drop("_m", "_p", "_shift")


def beside(rows: DataFrame, keys: list[str], columns: dict[str, Column], back: int = 1, ahead: int = 0) -> DataFrame:
    """`rows` of number_within with window columns that look `back` rows before and `ahead` rows after each: windows of ROWS_A_WINDOW rows of a key, which get the rows beside them too."""
    own = F.floor((F.col("_i") - 1) / ROWS_A_WINDOW)
    copies = F.array_distinct(F.array(F.floor((F.col("_i") - 1 - ahead) / ROWS_A_WINDOW), own, F.floor((F.col("_i") - 1 + back) / ROWS_A_WINDOW)))
    dealt = rows.withColumn("_own", own).withColumn("_c", F.explode(copies))
    w = Window.partitionBy(*keys, "_c").orderBy("_i")
    for name, make in columns.items():
        dealt = dealt.withColumn(name, make(w))
    return dealt.where("_c = _own").drop("_c", "_own")


def running_count(rows: DataFrame, keys: list[str], flag: str, name: str) -> DataFrame:
    """The sum of `flag` up to each row of number_within: sums within windows of rows, and of the windows before."""
    dealt = rows.withColumn("_w", F.floor((F.col("_i") - 1) / ROWS_A_WINDOW))
    sums = dealt.groupBy(*keys, "_w").agg(F.sum(flag).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_w").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    here = F.sum(flag).over(Window.partitionBy(*keys, "_w").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    found = _meet(dealt.withColumn("_h", here), sums.select(*keys, "_w", before.alias("_o")), [*keys, "_w"])
    return found.withColumn(name, F.col("_h") + F.col("_o")).drop("_w", "_h", "_o")


def despike(df: DataFrame, value: str, keys: list[str], order: list, threshold: float) -> DataFrame:
    """The median of a row and its neighbours replaces values off by over `threshold` times the key's MAD.

    At the ends the median of the two there are is their mean.
    """
    smooth = beside(number_within(df, keys, order), keys, {"_m": lambda w: percentile(value).over(w.rowsBetween(-1, 1))}, 1, 1)
    off = smooth.withColumn("_d", F.abs(F.col(value) - F.col("_m"))).drop("_i")
    middle = off.groupBy(*keys).agg(percentile("_d").alias("_c"))
    spread = off.join(middle, keys).groupBy(*keys).agg(percentile(F.abs(F.col("_d") - F.col("_c"))).alias("_s"))
    joined = off.join(spread, keys)
    return joined.withColumn("clean", F.when(F.col("_d") > threshold * F.col("_s"), F.col("_m")).otherwise(F.col(value))).drop("_m", "_d", "_s")


def delta_first(value: str, keys: list[str], order: list) -> Column:
    """A value less the key's first."""
    return F.col(value) - F.first(value).over(Window.partitionBy(*keys).orderBy(*order))


def detrend(df: DataFrame, value: str, keys: list[str], order: list, name: str = "residual") -> DataFrame:
    """A value less its least-squares line over row position, per key."""
    numbered = number_within(df, keys, order)
    lines = numbered.groupBy(*keys).agg(F.regr_slope(value, "_i").alias("_a"), F.regr_intercept(value, "_i").alias("_b"))
    return numbered.join(lines, keys).withColumn(name, F.col(value) - (F.col("_a") * F.col("_i") + F.col("_b"))).drop("_i", "_a", "_b")


def trapezoid(df: DataFrame, x: Column, y: str, keys: list[str], tie: list = ()) -> DataFrame:
    """The integral of y over x per key."""
    w = Window.partitionBy(*keys).orderBy("_x", *tie)
    rows = df.withColumn("_x", x)
    part = (F.lead("_x").over(w) - F.col("_x")) * (F.lead(y).over(w) + F.col(y)) / 2
    return rows.withColumn("_p", part).groupBy(*keys).agg(F.sum("_p").alias("integral"))


def cumulative_rate(rate: str, seconds: Column, keys: list[str], order: list) -> tuple[Column, Column]:
    """Columns of the step volume 0.5 (r0 + r1) dt, nulls as 0, and the frame that sums it up."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = F.coalesce(F.col(rate), F.lit(0.0))
    step = F.coalesce((F.lag(r).over(w) + r) / 2 * (seconds - F.lag(seconds).over(w)), F.lit(0.0))
    return step, w.rowsBetween(Window.unboundedPreceding, 0)


def near_duplicates_in_time(df: DataFrame, keys: list[str], ts: str, order: list, seconds: float) -> DataFrame:
    """Rows less than `seconds` after the one before; the first row has none before it (trap T-02: intent)."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    return df.withColumn("_gap", (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6).where(F.col("_gap") < seconds).drop("_gap")


def strongest_first(times: np.ndarray, strength: np.ndarray, apart: float) -> np.ndarray:
    """Places kept when the strongest is taken first and whatever lies nearer than `apart` to one taken goes."""
    taken: list[int] = []
    order = np.lexsort((times, -strength))
    placed: list[float] = []
    for i in order:
        k = bisect.bisect_left(placed, times[i])
        if (k == 0 or times[i] - placed[k - 1] >= apart) and (k == len(placed) or placed[k] - times[i] >= apart):
            placed.insert(k, times[i])
            taken.append(i)
    return np.sort(np.array(taken, int))


def decluster(df: DataFrame, keys: list[str], ts: str, strength: str, seconds: float) -> DataFrame:
    """Greedy non-maximum suppression per key: the strongest detection stays, nearer ones go.

    Detections are first cut into runs whose neighbours lie nearer than `seconds`. No choice reaches over a
    larger gap, so a call gets a few hundred runs and not a whole key.
    """
    rows = number_within(df.withColumn("_t", micros(ts) / 1e6), keys, ["_t"])
    rows = beside(rows, keys, {"_g": lambda w: F.when(F.col("_t") - F.lag("_t").over(w) < seconds, 0).otherwise(1)})
    rows = running_count(rows, keys, "_g", "_run").withColumn("_run", F.floor(F.col("_run") / 256)).drop("_i")
    columns = list(df.columns)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(columns, kind="stable").reset_index(drop=True)
        return part.iloc[strongest_first(part["_t"].to_numpy(), part[strength].to_numpy(), seconds)][columns]

    return rows.drop("_g").groupBy(*keys, "_run").applyInPandas(choose, df.schema)


def rolling_b_value(df: DataFrame, mag: str, keys: list[str], order: list, rows: int) -> DataFrame:
    """The maximum-likelihood b-value of the last `rows` magnitudes; null until there are so many."""
    w = rolling_rows(keys, order, rows - 1)
    mean, low, n = F.avg(mag).over(w), F.min(mag).over(w), F.count(mag).over(w)
    return df.withColumn("b", F.when(n >= rows, F.log10(F.lit(float(np.e))) / F.nullif(mean - low, F.lit(0.0))))


def gain_steps(df: DataFrame, value: str, keys: list[str], order: list, threshold: float) -> DataFrame:
    """Jumps of over `threshold` between neighbours are taken out of all that follows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    jump = F.col(value) - F.lag(value).over(w)
    marked = df.withColumn("_j", F.when(F.abs(jump) > threshold, jump).otherwise(0.0))
    return marked.withColumn("corrected", F.col(value) - F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def short_runs(df: DataFrame, valid: Column, keys: list[str], order: list, longest: int) -> DataFrame:
    """Marks runs of valid rows of `longest` or fewer that invalid rows enclose (intent; trap T-01)."""
    rows = number_within(df.withColumn("_v", valid), keys, order)
    rows = beside(rows, keys, {"_x": lambda w: F.when(F.col("_v") != F.lag("_v").over(w), 1).otherwise(0)})
    rows = running_count(rows, keys, "_x", "_r").drop("_i", "_x")
    sizes = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    most = sizes.groupBy(*keys).agg(F.max("_r").alias("_last"))
    found = _meet(_meet(rows, sizes, [*keys, "_r"]), most, keys)
    inside = (F.col("_r") > 0) & (F.col("_r") < F.col("_last"))
    return found.withColumn("short", F.col("_v") & inside & (F.col("_n") <= longest)).drop("_v", "_r", "_n", "_last")
