"""Catalog operators: matching, relocation geometry, grids and small inversions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.storage import cut, discard, small

from .timeseries import number_within


def match_self_detections(templates: DataFrame, detections: DataFrame, key: str, mag: str, tolerance: float, order: str) -> DataFrame:
    """Every template with its detection of the nearest magnitude below `tolerance`; key, matched order or null."""
    t = templates.select(key, F.col(mag).alias("_m"))
    near = detections.join(t, key).withColumn("_d", F.abs(F.col(mag) - F.col("_m"))).where(F.col("_d") < tolerance)
    best = near.groupBy(key).agg(F.min_by(order, F.struct("_d", order)).alias("matched"))
    return templates.select(key).join(best, key, "left")


def borehole_plane(survey: DataFrame, keys: list[str], depth: str, xyz: list[str], point: list[float], normal: list[float]) -> DataFrame:
    """Where the straight line from a borehole's first to its last survey point meets a plane, and the depth of the
    nearest survey point by Euclidean distance (trap T-13: intent). Boreholes along the plane have no row."""
    ends = survey.groupBy(*keys).agg(*[F.min_by(c, depth).alias(f"_a{i}") for i, c in enumerate(xyz)], *[F.max_by(c, depth).alias(f"_b{i}") for i, c in enumerate(xyz)])
    along = sum((F.lit(n) * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i, n in enumerate(normal)), F.lit(0.0))
    ahead = sum((F.lit(n) * (F.lit(p) - F.col(f"_a{i}")) for i, (n, p) in enumerate(zip(normal, point))), F.lit(0.0))
    share = ahead / F.when(F.abs(along) > 1e-6, along)
    hit = ends.withColumn("_t", share).where("_t is not null").select(*keys, *[(F.col(f"_a{i}") + F.col("_t") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"hit_{c}") for i, c in enumerate(xyz)])
    off = F.sqrt(sum((F.pow(F.col(c) - F.col(f"hit_{c}"), 2) for c in xyz), F.lit(0.0)))
    near = survey.join(hit, keys).groupBy(*keys, *[f"hit_{c}" for c in xyz])
    return near.agg(F.min_by(depth, F.struct(off, depth)).alias("depth"))


def front_geometry(gallery: DataFrame, target: list[float], xyz: list[str]) -> DataFrame:
    """distance, azimuth and plunge (degrees) of every front position to a point."""
    d = [F.lit(t) - F.col(c) for t, c in zip(target, xyz)]
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    out = [F.sqrt(flat * flat + d[2] * d[2]).alias("distance"), F.pmod(F.degrees(F.atan2(d[0], d[1])), F.lit(360.0)).alias("azimuth"), F.degrees(F.atan2(-d[2], flat)).alias("plunge")]
    return gallery.select("*", *out)


def travel_time_grid(stations: DataFrame, lats: tuple, lons: tuple, depths: tuple, km_s: float, station: str = "station") -> DataFrame:
    """Station x grid node with a straight-ray time; axes are (first, last, step). The product is the table asked for."""
    spark = stations.sparkSession
    grid = spark.range(1)
    for name, (first, last, step) in (("lat", lats), ("lon", lons), ("depth", depths)):
        n = int(round((last - first) / step))
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn(name, F.lit(float(first)) + F.col(name) * float(step))
    s = stations.select(station, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    from .ranges import haversine_km

    flat = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return grid.drop("id").crossJoin(s).select(station, "lat", "lon", "depth", (F.sqrt(flat * flat + F.col("depth") * F.col("depth")) / km_s).alias("time_s"))


def brightness(traces: DataFrame, lags: DataFrame, channel: str, position: str, value: str) -> DataFrame:
    """Per node and position the sum of the channels' values at the node's lags, with partial sums before the shuffle."""
    moved = traces.join(small(lags), channel).select("node", (F.col(position) - F.col("lag")).alias(position), value)
    return moved.groupBy("node", position).agg(F.sum(value).alias("brightness"))


#: Columns up to which a key's normal equations are solved as one matrix in a task (some 34 MB).
DENSE_COLUMNS = 2048
#: Columns of a block of a larger system, and blocks of a vector up to which it is sent to every task (some 16 MB).
_BLOCK, _BLOCKS = 256, 8192


def least_squares(rows: DataFrame, keys: list[str], row: str, column: str, value: str, target: str, damping: float) -> DataFrame:
    """Damped least squares per key from sparse rows (row, column, value, target): key, column, solution.

    The normal equations are summed by joins on the row. A key of up to DENSE_COLUMNS columns is solved as a matrix; larger
    ones by conjugate gradients over sparse blocks of the equations, to a relative residual of 1e-13: no task holds
    more than blocks.
    """
    entries = cut(rows.select(*keys, row, F.col(column).alias("_i"), F.col(value).cast("double").alias("_v"), F.col(target).cast("double").alias("_d")))
    atd = entries.groupBy(*keys, "_i").agg(F.sum(F.col("_v") * F.col("_d")).alias("_b"))
    sizes = cut(atd.groupBy(*keys).agg(F.count("*").alias("_size")))
    few, many = (small(sizes.where(c).select(*keys)) for c in (F.col("_size") <= DENSE_COLUMNS, F.col("_size") > DENSE_COLUMNS))
    found = _solved_whole(entries.join(few, keys, "left_semi"), keys, row, column, damping)
    most = sizes.agg(F.max("_size")).first()[0] or 0
    if most <= DENSE_COLUMNS:
        return found
    return found.union(_solved_by_blocks(entries.join(many, keys, "left_semi"), keys, row, column, damping, most))


def _solved_whole(entries: DataFrame, keys: list[str], row: str, column: str, damping: float) -> DataFrame:
    a, b = entries, entries.select(*keys, row, F.col("_i").alias("_j"), F.col("_v").alias("_w"))
    ata = a.join(b, [*keys, row]).groupBy(*keys, "_i", "_j").agg(F.sum(F.col("_v") * F.col("_w")).alias("_n"))
    atd = a.groupBy(*keys, "_i").agg(F.sum(F.col("_v") * F.col("_d")).alias("_b"))
    system = ata.join(atd, [*keys, "_i"])
    kinds = {f.name: f.dataType.simpleString() for f in system.schema.fields}

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(part["_i"].unique())
        n = np.zeros((len(names), len(names)))
        n[np.searchsorted(names, part["_i"]), np.searchsorted(names, part["_j"])] = part["_n"]
        d = part.drop_duplicates("_i").set_index("_i")["_b"].reindex(names).to_numpy()
        out = pd.DataFrame({column: names, "solution": np.linalg.solve(n + damping * np.eye(len(names)), d)})
        for c in keys:
            out[c] = part[c].iloc[0]
        return out[[*keys, column, "solution"]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", `{column}` {kinds['_i']}, solution double"
    return system.groupBy(*keys).applyInPandas(solve, schema)


def _solved_by_blocks(entries: DataFrame, keys: list[str], row: str, column: str, damping: float, most: int) -> DataFrame:
    """Conjugate gradients, preconditioned by the diagonal, for all keys at once; the driver gets a few sums per key."""
    sums = entries.where("_i is not null").groupBy(*keys, "_i").agg(F.sum(F.col("_v") * F.col("_d")).alias("_b"))
    sums = number_within(sums, keys, ["_i"], "_number").withColumn("_blk", F.expr(f"cast((_number - 1) div {_BLOCK} as int)")).withColumn("_at", F.expr(f"cast((_number - 1) % {_BLOCK} as int)")).drop("_number")
    sums = cut(sums)
    placed = cut(entries.join(sums.select(*keys, "_i", "_blk", "_at"), [*keys, "_i"]).select(*keys, row, "_blk", "_at", "_v"))
    other = placed.select(*keys, row, F.col("_blk").alias("_blk2"), F.col("_at").alias("_at2"), F.col("_v").alias("_w"))
    cells = placed.join(other, [*keys, row]).groupBy(*keys, "_blk", "_blk2", "_at", "_at2").agg(F.sum(F.col("_v") * F.col("_w")).alias("_n"))
    packed = cells.groupBy(*keys, "_blk", "_blk2").agg(F.collect_list(F.struct("_at", "_at2", "_n")).alias("_e"))
    packed = packed.select(*keys, "_blk", "_blk2", F.col("_e._at").alias("_rows"), F.col("_e._at2").alias("_columns"), F.col("_e._n").alias("_n"))
    matrix = cut(packed.repartitionByRange(*keys, "_blk").sortWithinPartitions(*keys, "_blk"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(_BLOCK))
    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in keys)
    names = [*keys, "_blk"]

    def stretched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            full = []
            for at, x in zip(part["_at"], part["_x"]):
                y = np.zeros(_BLOCK)
                y[at] = x
                full.append(y)
            yield part[names].assign(_x=full)

    def vector(t: DataFrame, x: str, name: str) -> DataFrame:
        lists = t.groupBy(*names).agg(F.collect_list(F.struct("_at", F.col(x).alias("_x"))).alias("_l")).select(*names, F.col("_l._at").alias("_at"), F.col("_l._x").alias("_x"))
        return lists.mapInPandas(stretched, f"{kinds}, _blk int, _x array<double>").withColumnRenamed("_x", name)

    diagonal = matrix.where("_blk = _blk2").select(*names, F.explode(F.arrays_zip("_rows", "_columns", "_n")).alias("_z")).where("_z._rows = _z._columns").select(*names, F.col("_z._rows").alias("_at"), (F.col("_z._n") + damping).alias("_y"))
    diagonal = vector(diagonal, "_y", "_g")
    inverse = F.transform("_g", lambda g: F.when(g > 0, 1 / g).otherwise(0.0))
    begin = vector(sums, "_b", "r").join(diagonal, names).select(*names, inverse.alias("m"), zeros.alias("x"), "r")
    state = cut(begin.withColumn("p", F.zip_with("r", "m", lambda a, b: a * b)))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None
        for part in batches:
            out = []
            for item in part.itertuples(index=False):
                name = item[: len(names)]
                if name != held:
                    if held is not None:
                        out.append((*held, total))
                    held, total = name, np.zeros(_BLOCK)
                total += np.bincount(item[-3], weights=item[-1][item[-2]] * item[-4], minlength=_BLOCK)
            yield pd.DataFrame(out, columns=[*names, "_y"])
        if held is not None:
            yield pd.DataFrame([(*held, total)], columns=[*names, "_y"])

    blocks = state.count()
    dot = lambda *v: F.sum(F.aggregate(reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a * b), map(F.col, v)), F.lit(0.0), lambda t, z: t + z))
    start: dict = {}
    spark, batch = sums.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(batch, None)
    spark.conf.set(batch, "4194304")  # a row holds a block
    try:
        for turn in itertools.count():
            p = state.select(*keys, F.col("_blk").alias("_blk2"), "p")
            met = matrix.join(F.broadcast(p) if blocks <= _BLOCKS else p, [*keys, "_blk2"]).select(*names, "_n", "_rows", "_columns", "p")
            parts = met.mapInPandas(products, f"{kinds}, _blk int, _y array<double>").select(*names, F.posexplode("_y").alias("_at", "_y"))
            q = vector(parts.groupBy(*names, "_at").agg(F.sum("_y").alias("_y")), "_y", "q")
            full = cut(state.join(q, names).withColumn("q", F.zip_with("q", "p", lambda a, b: a + damping * b)))
            tally = full.groupBy(*keys).agg(dot("r", "r", "m").alias("rr"), dot("p", "q").alias("pq"), dot("r", "q", "m").alias("rq"), dot("q", "q", "m").alias("qq")).collect()
            steps, going = [], False
            for t in tally:
                key = tuple(t[c] for c in keys)
                start.setdefault(key, t.rr)
                a = b = 0.0
                if t.rr is None or t.pq is None or t.rr != t.rr or t.pq != t.pq:  # values that are no numbers: nor is the solution
                    a, going = float("nan"), going or turn == 0
                elif t.rr > start[key] * 1e-26:
                    if t.pq <= 0:
                        raise ValueError("the normal equations are not positive definite")
                    going, a = True, t.rr / t.pq
                    b = max(t.rr - 2 * a * t.rq + a * a * t.qq, 0.0) / t.rr
                steps.append((*key, a, b))
            if not going:
                break
            if turn > 10 * most:
                raise ValueError("the normal equations are too near to singular")
            s = F.broadcast(spark.createDataFrame(steps, f"{kinds}, a double, b double"))
            nxt = full.join(s, keys).withColumn("x", F.zip_with("x", "p", lambda x, p: x + F.col("a") * p)).withColumn("r", F.zip_with("r", "q", lambda r, q: r - F.col("a") * q))
            z = F.zip_with(F.zip_with("r", "m", lambda r, m: r * m), "p", lambda z, p: z + F.col("b") * p)
            discard(state)
            state = cut(nxt.withColumn("p", z).select(*names, "m", "x", "r", "p"))
            discard(full)
    finally:
        spark.conf.unset(batch) if before is None else spark.conf.set(batch, before)
    discard(matrix, placed)
    solved = full.select(*names, F.posexplode("x").alias("_at", "solution"))
    return sums.join(solved, [*names, "_at"]).select(*keys, F.col("_i").alias(column), F.when(~F.isnan("solution"), F.col("solution")).alias("solution"))


def pressure_curve(x: Column, a: float, b: float, c: float) -> Column:
    """a + b exp(-c x)"""
    return a + b * F.exp(-c * x)


def moment_bounds(volume: Column, shear: float = 3e10) -> tuple[Column, Column]:
    """upper bounds of the seismic moment of an injected volume: linear, and with its power 3/2."""
    return shear * volume, 0.4 * 1.5e9 * F.pow(volume, 1.5)


def keep_epochs(df: DataFrame, keys: list[str], epoch: str, until: Column, samples: str) -> DataFrame:
    """The element-wise baseline of the epochs up to a time."""
    from .signals import stack

    return stack(df.where(F.col(epoch) <= until), keys, samples).select(*keys, "traces", F.col("mean").alias("baseline"))


def positions_in_runs(df: DataFrame, keys: list[str], order: list) -> Column:
    """W12"""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
