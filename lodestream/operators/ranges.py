"""Range, nearest and radius joins as equi-joins on buckets or cells, then an exact test.

A row is copied to the few buckets that its range touches, so no side is compared with all of the other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.storage import cut, joined_with, small

EARTH_KM = 6371.0


#: Comparisons of a point with a span up to which a bucket is one key of the join.
COMPARISONS = 20_000_000

#: Comparisons of a cell up to which radius_counts makes its pairs; steps of a task beyond that, and places of both sides in it.
PAIRED, STEPS, LEFT, RIGHT = 1_000_000, 50_000_000, 250_000, 100_000

#: Places up to which k_nearest sends those that look again to every task.
FEW = 10_000


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, width: float, on: list[str] = ()) -> DataFrame:
    """Points with the spans [start, stop) that hold them; `width` is the bucket size of the equi-join.

    The points of a bucket with many comparisons are dealt to parts, each of which gets all its spans, so that a full
    bucket is many tasks.
    """
    copies = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    left = points.withColumn("_b", F.floor(F.col(at) / width))
    right = spans.where(F.col(start) < F.col(stop)).withColumn("_b", F.explode(copies))
    key = [*on, "_b"]
    work = left.groupBy(*key).agg(F.count("*").alias("_m")).join(right.groupBy(*key).agg(F.count("*").alias("_n")), key)
    full = work.withColumn("_parts", F.ceil(F.col("_m").cast("double") * F.col("_n") / COMPARISONS).cast("int")).where(F.col("_parts") > 1)
    full = cut(full.select(*key, "_parts"))
    total = full.agg(F.sum("_parts")).first()[0]
    if total:
        parts = small(full)
        spread = F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(1))).cast("int")
        tasks = int(min(max(total, 200), 2000))
        left = left.join(parts, key, "left").withColumn("_part", spread).drop("_parts")
        right = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        key = [*key, "_part"]
        left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
    joined = left.join(right, key).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop)))
    return joined.drop("_b", "_part")


def nearest(left: DataFrame, right: DataFrame, at: str, on: list[str], order: list[str], name: str = "nearest") -> DataFrame:
    """For every row of `left` the row of `right` of the same key nearest in `at`, as a struct.

    Both sides are laid in one order, written in ranges of key and place, and looked through range by range; what a range
    lacks at its ends is the last right row of a range before and the first of one after, so that a hot key is many tasks.
    Ties go to the earlier place, then to the least `order`. Rows without any partner get null; keys that are null meet.
    """
    pick = F.struct(*[F.col(c) for c in right.columns])
    mark = F.struct(*[F.col(c) for c in left.columns])
    kind = left.select(mark.alias("_")).schema[0].dataType
    r = right.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("_at"), pick.alias("_r"), F.struct(*order).alias("_o"))
    r = r.groupBy(*on, "_at").agg(F.min_by("_r", "_o").alias("_r")).select(*on, "_at", "_r", F.lit(None).cast(kind).alias("_l"))
    l = left.select(*on, F.col(at).alias("_at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), mark.alias("_l"))
    laid = l.unionByName(r).repartitionByRange(*on, "_at")
    rows = cut(laid.withColumn("_p", F.spark_partition_id()))
    whole = Window.partitionBy(*on).orderBy("_p")
    ends = rows.groupBy(*on, "_p").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_at"))).alias("_z"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_at"))).alias("_y"))
    before = F.last("_z", True).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_y", True).over(whole.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select(*[F.col(c).alias("_k" + c) for c in on], F.col("_p").alias("_kp"), before.alias("_z"), after.alias("_y"))
    w = Window.partitionBy(*on, "_p").orderBy("_at", F.col("_l").isNotNull())
    back = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    v = Window.partitionBy(*on, "_p").orderBy(F.desc("_at"), F.col("_l").isNotNull())
    ahead = F.last("_r", True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_b", back).withColumn("_a", ahead).where("_l is not null")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("_k" + c)) for c in on], F.col("_p") == F.col("_kp"))
    found = found.join(small(cut(carried)), same, "left").withColumn("_b", F.coalesce("_b", "_z")).withColumn("_a", F.coalesce("_a", "_y"))
    to_back, to_ahead = F.abs(F.col("_at") - F.col(f"_b.{at}")), F.abs(F.col(f"_a.{at}") - F.col("_at"))
    best = F.when(F.col("_at").isNull(), None).when(F.col("_a").isNull() | (to_back <= to_ahead), F.col("_b")).otherwise(F.col("_a"))
    return found.select("_l.*", best.alias(name))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """F30"""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def radius_join(left: DataFrame, right: DataFrame, coords: list[str], radius: float, suffix: str = "_r") -> DataFrame:
    """Pairs of rows whose coordinates lie within `radius`; columns of `right` get the suffix.

    Cells are `radius` wide; a right row is copied to the cells around its own. The copies are never broadcast.
    """
    return _near_in_cells(left, right, coords, radius, suffix).drop(*[f"_c{i}" for i in range(len(coords))])


def _in_cells(df: DataFrame, coords: list[str], radius: float) -> DataFrame:
    """Rows with their cell _c0, _c1, ..."""
    return df.select("*", *[F.floor(F.col(c) / radius).alias(f"_c{i}") for i, c in enumerate(coords)])


def _around(df: DataFrame, coords: list[str], radius: float) -> DataFrame:
    """Rows, copied to the cells _c0, _c1, ... around their own."""
    for i, c in enumerate(coords):
        df = df.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(F.col(c) / radius) - 1, F.floor(F.col(c) / radius) + 1)))
    return df


def _near_in_cells(left: DataFrame, right: DataFrame, coords: list[str], radius: float, suffix: str, hint: str = "merge") -> DataFrame:
    """radius_join with the cells _c0, _c1, ... of the left rows, by which its result is partitioned unless one side is sent."""
    b = _around(right.select(*[F.col(c).alias(c + suffix) for c in right.columns]), [c + suffix for c in coords], radius)
    square = reduce(lambda x, y: x + y, [F.pow(F.col(c) - F.col(c + suffix), 2) for c in coords])
    near = _in_cells(left, coords, radius).join(b.hint(hint), [f"_c{i}" for i in range(len(coords))])
    return near.withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)


def count_within(x: list[np.ndarray], n: np.ndarray, y: list[np.ndarray], m: np.ndarray, radii: list[float]) -> list[int]:
    """Sums of n * m over the pairs of places x and y within each of the ascending radii, found without the pairs.

    Places x that are equal in all coordinates but the first are a line. On it those within a radius of a place y are
    neighbours, whose ends are found by bisection with the distance itself, as it is rounded.
    """
    order = np.lexsort(x)
    x, total = [v[order] for v in x], np.concatenate([[0], np.cumsum(n[order])])
    fresh = np.arange(len(order)) == 0
    for v in x[1:]:
        fresh[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(order))
    found, step = [0] * len(radii), max(1, 500_000 // len(starts))
    for at in range(0, len(m), step):
        k = np.repeat(np.arange(at, min(at + step, len(m))), len(starts))
        line = np.tile(np.arange(len(starts)), len(k) // len(starts))
        rest = [np.square(v[starts[line]] - u[k]) for v, u in zip(x[1:], y[1:])]
        near = np.sqrt(reduce(np.add, rest, np.zeros(len(k)))) <= radii[-1]
        k, line, rest = k[near], line[near], [r[near] for r in rest]
        here = y[0][k]

        def bisect(low: np.ndarray, high: np.ndarray, before) -> np.ndarray:
            """The first place from low to high for which `before` doesn't hold."""
            low, high = low.copy(), high.copy()
            while (open := low < high).any():
                middle = np.minimum((low + high) // 2, len(order) - 1)
                less = before(middle)
                low, high = np.where(open & less, middle + 1, low), np.where(open & ~less, middle, high)
            return low

        def inside(place: np.ndarray, radius: float) -> np.ndarray:
            return np.sqrt(reduce(np.add, rest, np.square(x[0][place] - here))) <= radius

        first = last = bisect(starts[line], stops[line], lambda place: x[0][place] < here)
        for i, radius in enumerate(radii):
            first = bisect(starts[line], first, lambda place, r=radius: ~inside(place, r))
            last = bisect(last, stops[line], lambda place, r=radius: inside(place, r))
            found[i] += int(((total[last] - total[first]) * m[k]).sum())
    return found


def radius_counts(left: DataFrame, right: DataFrame, coords: list[str], radii: list[float]) -> DataFrame:
    """Radius, n: how many pairs of rows lie within each radius that has any; both sides are places with their number of `rows`.

    Pairs are made in cells of few comparisons. The places of a full cell are counted along lines of the first coordinate
    (count_within), so that a right place costs steps by the lines near it and not by the places. A full cell is dealt to
    tasks by its lines, by the places of these and by its right places.
    """
    radii, keys, most = sorted(radii), [f"_c{i}" for i in range(len(coords))], max(radii)
    placed = reduce(lambda x, y: x & y, [F.abs(F.col(c)) < float("inf") for c in coords])
    left, right = (cut(t.where(placed).select(*[F.col(c).cast("double").alias(c) for c in coords], "rows")) for t in (left, right))
    a, b = _in_cells(left, coords, most), _around(right, coords, most)
    lines = F.count_distinct(F.struct(*coords[1:])) if coords[1:] else F.lit(1)
    work = a.groupBy(*keys).agg(F.count("*").cast("double").alias("_m"), lines.alias("_l")).join(b.groupBy(*keys).agg(F.count("*").cast("double").alias("_n")), keys)
    full = work.where(F.col("_m") * F.col("_n") > PAIRED).withColumn("_q", F.ceil(F.col("_n") / RIGHT))
    full = full.withColumn("_p", F.ceil(F.col("_l") * F.least(F.col("_n"), F.lit(RIGHT)) / STEPS)).withColumn("_o", F.ceil(F.col("_m") / F.col("_p") / LEFT))
    full = cut(full.select(*keys, "_q", "_p", "_o"))
    total = full.agg(F.sum(F.col("_q") * F.col("_p") * F.col("_o"))).first()[0]
    sparse = a.join(joined_with(full.select(*keys)), keys, "left_anti").drop(*keys) if total else left
    pairs = radius_join(sparse, right, coords, most)
    within = F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: F.col("distance") <= r)
    found = pairs.select(F.explode(within).alias("radius"), (F.col("rows") * F.col("rows_r")).alias("n"))
    if total:
        tasks, key, parts = int(min(max(total, 200), 2000)), [*keys, "_i", "_j", "_k"], joined_with(full)
        dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        a = a.join(parts, keys).withColumn("_i", dealt("_p", *(coords[1:] or [F.lit(0)]))).withColumn("_j", dealt("_o", *coords, F.lit(1))).withColumn("_k", every("_q"))
        b = b.join(parts, keys).withColumn("_i", every("_p")).withColumn("_j", every("_o")).withColumn("_k", dealt("_q", *coords, F.lit(2)))
        a, b = (t.select(*key, *coords, "rows").repartition(tasks, *key) for t in (a, b))

        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            n = [0] * len(radii)
            if len(x) and len(y):
                sides = [([t[c].to_numpy() for c in coords], t["rows"].to_numpy()) for t in (x, y)]
                n = count_within(*sides[0], *sides[1], radii)
            return pa.table({"radius": pa.array(radii, pa.float64()), "n": pa.array(n, pa.int64())})

        counted = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(run, "radius double, n long")
        found = found.union(counted.where("n > 0"))
    return found.groupBy("radius").agg(F.sum("n").alias("n"))


def geodesic_join(left: DataFrame, right: DataFrame, lat: str, lon: str, km: float, suffix: str = "_r") -> DataFrame:
    """Pairs of rows within `km` of each other on the sphere (haversine), with their distance; columns of `right`
    get the suffix. Places without a latitude of -90 to 90 or without a longitude have no pair; longitudes may have any turn.

    Cells are bands of latitude as high as the radius, each cut into as many equal columns as are at least as wide as
    the radius where the band is narrowest; a band that comes near a pole is one cell. A right row is copied to the
    columns of three bands that its own reach in longitude touches, around the date line too.
    """
    reach = min(km / EARTH_KM, 3.1415)  # as an angle
    high = max(reach * 57.29577951308232 * (1 + 1e-9), 1e-6)
    last = int(180 / high)

    def extent(phi: Column) -> Column:
        """Half the range of longitudes, in degrees, that the radius reaches at a latitude; 180 or more is all."""
        most = F.abs(F.radians(phi)) + reach
        side = F.sin(F.lit(reach)) / F.cos(F.radians(phi))
        return F.when((most >= 1.5707) | (side >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(side, F.lit(1.0)))) * (1 + 1e-9))

    def columns(band: Column) -> Column:
        edge = F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90))
        return F.greatest(F.floor(F.lit(360.0) / extent(F.least(edge, F.lit(90.0)))), F.lit(1))

    def turned(x: Column) -> Column:
        return F.pmod(x.cast("double") + 180, F.lit(360.0))

    def band_of(x: Column) -> Column:
        return F.least(F.floor((x.cast("double") + 90) / high), F.lit(last))

    placed = (F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) < 1e9)
    a = left.where(placed).withColumn("_b", band_of(F.col(lat)))
    a = a.withColumn("_c", F.least(F.floor(turned(F.col(lon)) * columns(F.col("_b")) / 360), columns(F.col("_b")) - 1))
    b = right.where(placed).select(*[F.col(c).alias(c + suffix) for c in right.columns])
    own = band_of(F.col(lat + suffix))
    b = b.withColumn("_b", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(last)))))
    n, wide, x = columns(F.col("_b")), extent(F.col(lat + suffix)), turned(F.col(lon + suffix))
    some = F.sequence(F.floor((x - wide) * n / 360), F.floor((x + wide) * n / 360))
    cells = F.when(wide >= 180, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array_distinct(F.transform(some, lambda c: F.pmod(c, n))))
    b = b.withColumn("_c", F.explode(cells))
    far = haversine_km(F.col(lat), F.col(lon), F.col(lat + suffix), F.col(lon + suffix))
    return a.join(b, ["_b", "_c"]).withColumn("distance", far).where(F.col("distance") <= km).drop("_b", "_c")


def k_nearest(df: DataFrame, id_col: str, coords: list[str], k: int, first_radius: float) -> DataFrame:
    """The k nearest rows of every row, itself included: id, rank, other, distance; ties to the smaller id.

    Rows of equal coordinates are one place with its k least ids. The first radius is made smaller until a cell holds few
    places. A place whose k nearest rows lie within the radius is done; the others look again within twice the radius.
    What is broadcast is counted first: copies of FEW places at most, and narrow tables of storage.SMALL rows.
    Rows without finite coordinates take no part.
    """
    xs = [f"_x{i}" for i in range(len(coords))]
    rows = df.select(F.col(id_col), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(coords, xs)])
    rows = rows.where(reduce(lambda x, y: x & y, [F.abs(F.col(x)) < float("inf") for x in xs]))
    wanted = min(k, rows.limit(k).count())
    least = F.row_number().over(Window.partitionBy(*xs).orderBy(id_col))
    places = rows.withColumn("_m", least).where(F.col("_m") <= wanted).groupBy(*xs).agg(F.array_sort(F.collect_list(id_col)).alias("_ids"))
    places = cut(places)
    radius = first_radius
    for _ in range(30):
        cells = places.groupBy(*[F.floor(F.col(x) / radius) for x in xs]).agg(F.count("*").cast("double").alias("n"))
        mean = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if mean is None or mean <= max(4 * k, 16):
            break
        radius /= 4
    todo, done = places.select(*xs), None
    while not todo.isEmpty():
        if todo.limit(FEW + 1).count() <= FEW:  # the few are sent to the places, not all places to the cells around
            sent = todo.select(*[F.col(x).alias(x + "_r") for x in xs])
            pairs = _near_in_cells(places.select(*[F.col(x).alias(x + "_r") for x in xs], F.col("_ids").alias("_ids_r")), sent, [x + "_r" for x in xs], radius, "_l", "broadcast")
            pairs, own = pairs.select(*[F.col(x + "_r_l").alias(x) for x in xs], "_ids_r", "distance"), xs
        else:
            pairs = _near_in_cells(todo, places, xs, radius, "_r")
            own = [*[f"_c{i}" for i in range(len(xs))], *xs] if done is None else xs  # at first a cell's pairs are few and stay in its task
        first = F.row_number().over(Window.partitionBy(*own).orderBy("distance", F.col("_ids_r")[0]))
        few = pairs.withColumn("_m", first).where(F.col("_m") <= wanted).withColumn("other", F.explode("_ids_r"))
        rank = F.row_number().over(Window.partitionBy(*own).orderBy("distance", "other"))
        best = few.withColumn("rank", rank).where(F.col("rank") <= wanted).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("rank", "other", "distance"))).alias("_best"))
        part = cut(best.where(F.size("_best") == wanted).select(*xs, "_best"))
        done = part if done is None else done.union(part)
        todo = cut(todo.join(joined_with(part.select(*xs)), xs, "left_anti"))
        radius *= 2
    if done is None:
        done = places.select(*xs, F.array().cast(f"array<struct<rank:int,other:{rows.schema[id_col].dataType.simpleString()},distance:double>>").alias("_best"))
    return rows.join(joined_with(done, max(wanted, 1)), xs).select(id_col, F.explode("_best").alias("_b")).select(id_col, "_b.rank", "_b.other", "_b.distance")


def space_time_semi(df: DataFrame, id_col: str, seconds: Column, coords: list[str], within_s: float, within: float) -> DataFrame:
    """Rows that have another row within both limits (another row is another id, not other values; trap T-27)."""
    rows = df.withColumn("_t", seconds)
    scaled = rows.withColumn("_b", F.floor(F.col("_t") / within_s))
    other = rows.select(F.col(id_col).alias("_id"), F.col("_t").alias("_u"), *[F.col(c).alias("_" + c) for c in coords])
    other = other.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_u") / within_s) - 1, F.floor(F.col("_u") / within_s) + 1)))
    square = reduce(lambda x, y: x + y, [F.pow(F.col(c) - F.col("_" + c), 2) for c in coords])
    test = (scaled["_b"] == other["_b"]) & (F.col(id_col) != F.col("_id")) & (F.abs(F.col("_t") - F.col("_u")) <= within_s) & (square <= within * within)
    return scaled.join(other, test, "left_semi").select(*df.columns)
