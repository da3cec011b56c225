"""Components, density clustering, single linkage and plane fits."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.storage import cut

from .components import components
from .ranges import EARTH_KM, haversine_km
from .relational import number_rows


#: Vectors of a block, and of one where there are many; every two blocks are compared in a task as matrices.
BLOCK, LARGE_BLOCK, MANY_BLOCKS = 1024, 4096, 32

#: Pairs that a task holds and returns at once.
PAIRS = 1_000_000


def spanning_links(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of a matrix of links that connect its rows and columns as all of them do: one fewer than these, at most."""
    rows, columns = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)  # those not reached yet
    turned = np.ascontiguousarray(near.T)
    p, q = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start] = False
        todo = [(start, True)]
        while todo:
            k, is_row = todo.pop()
            line, fresh = (near[k], columns) if is_row else (turned[k], rows)
            found = np.flatnonzero(line & fresh)
            if len(found):
                fresh[found] = False
                same = np.full(len(found), k)
                p.append(same if is_row else found)
                q.append(found if is_row else same)
                todo += [(f, not is_row) for f in found.tolist()]
    return np.concatenate(p), np.concatenate(q)


def cosine_links(vectors: DataFrame, id_col: str, vector_col: str, most: float) -> DataFrame:
    """Of cosine_pairs as many as connect the same vectors: a task returns a spanning forest of its two blocks' pairs."""
    return cosine_pairs(vectors, id_col, vector_col, most, True)


def cosine_pairs(vectors: DataFrame, id_col: str, vector_col: str, most: float = math.inf, forest: bool = False) -> DataFrame:
    """(a, b, d) of all pairs a < b of vectors of one length with their cosine distance d; of those with `most` or less, if given.

    Vectors are dealt to blocks by a hash of their id, so that no block grows with a group of alike ones; a task gets
    two blocks, multiplies them as matrices in strips of PAIRS pairs, and returns strip by strip. Null vectors, and those
    of zero length or with null or non-finite parts, have no distance and no pair.
    """
    e = F.col(vector_col)  # single precision is sent as it is and computed as double
    e = e if vectors.select(e.alias("e")).schema["e"].dataType.simpleString() == "array<float>" else e.cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), e.alias("e")).where("id is not null and e is not null")
    rows = cut(rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    count = rows.count()
    blocks = max(1, -(-count // (LARGE_BLOCK if count > MANY_BLOCKS * BLOCK else BLOCK)))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    cells = rows.select("id", "e", own.alias("own"), F.explode(dealt).alias("c")).select("c.x", "c.y", "own", "id", "e")
    if blocks > 1:  # as many tasks as pairs of blocks, not joined by the bytes that they get
        cells = cells.repartition(min(blocks * (blocks + 1) // 2, 2000), "x", "y")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, owner = table["id"], table["own"].to_numpy()
        lists = table["e"].combine_chunks() if isinstance(table["e"], pa.ChunkedArray) else table["e"]
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths, starts = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1]
        values, x, y = lists.values.to_numpy(zero_copy_only=False), table["x"][0].as_py(), table["y"][0].as_py()

        def named(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = (ids.take(pa.array(k)) for k in (i, j))
            swap = pc.greater(a, b)
            found = pa.table({"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b), "d": pa.array(d)})
            yield from found.filter(pc.not_equal(found["a"], found["b"])).to_batches()

        for n in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == n)
            m = values[starts[at][:, None] + np.arange(n)[None, :]].astype(float)
            m = np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])  # exact; no square is too large or small
            norm = np.sqrt((m * m).sum(1))
            at, m = at[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
            i, j = at[owner[at] == x], at[owner[at] == y]
            u, v = m[owner[at] == x], m[owner[at] == y].T
            near = np.zeros((len(i) if forest else 0, len(j)), bool)
            strip = max(1, PAIRS // max(len(j), 1))
            for k in range(0, len(i), strip):
                d = 1 - u[k : k + strip] @ v
                if forest:
                    near[k : k + strip] = d <= most
                    continue
                p, q = np.nonzero(d <= most)
                if x == y:
                    p, q = p[(once := p + k < q)], q[once]
                yield from named(i[p + k], j[q], d[p, q])
            if forest:
                if x == y:
                    np.fill_diagonal(near, True)  # a row and a column of one vector are one
                p, q = spanning_links(near)
                yield from named(i[p], j[q], 1 - (u[p] * v.T[q]).sum(1))

    return cells.groupBy("x", "y").applyInArrow(run, f"a {id_type}, b {id_type}, d double")


def dbscan(df: DataFrame, id_col: str, coords: list[str], eps: float, least: int) -> DataFrame:
    """Id, cluster (the least core id of it; null for noise), core. A row counts itself among its neighbours.

    Border rows, which several clusters may reach, join that of their least core neighbour.
    """
    at = [F.col(c).cast("double") for c in coords]
    square = lambda a, b: reduce(lambda x, y: x + y, [F.pow(F.col(f"{a}_x{i}") - F.col(f"{b}_x{i}"), 2) for i in range(len(coords))])
    near = lambda a, b: F.sqrt(square(a, b)) <= eps
    there = reduce(lambda x, y: x & y, [F.abs(x) < float("inf") for x in at])
    return _density(df, id_col, at, at, there, eps, near, least)


def dbscan_geodesic(df: DataFrame, id_col: str, lat: str, lon: str, km: float, least: int) -> DataFrame:
    """As dbscan, for places on the sphere and their haversine distance. Rows without a place are noise."""
    p, q = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    space = [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]
    chord = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)
    near = lambda a, b: haversine_km(F.col(f"{a}_x0"), F.col(f"{a}_x1"), F.col(f"{b}_x0"), F.col(f"{b}_x1")) <= km
    there = (F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) < 1e9)
    return _density(df, id_col, [F.col(lat).cast("double"), F.col(lon).cast("double")], space, there, chord, near, least)


def _density(df: DataFrame, id_col: str, at: list[Column], space: list[Column], there: Column, eps: float, near: Callable[[str, str], Column], least: int) -> DataFrame:
    """Density clusters without the pairs of dense places.

    Rows of equal coordinates are one place. Space is cut into cells whose places are all near each other (their diagonal
    is just below `eps`), so a cell of `least` rows is core as it is, and all core places of a cell are of one cluster.
    Only places of cells with fewer rows are compared with those of the cells around. Cells are linked by their outermost
    core places first; all core places are compared only between cells that this leaves in different clusters.
    """
    d = len(space)
    side = max(eps, 1e-300) / math.sqrt(d) * (1 - 1e-6)
    reach = int(eps / side) + 1 if eps > 0 else 1
    cell, xs = [f"_c{i}" for i in range(d)], [f"_x{i}" for i in range(len(at))]
    rows = df.where(there).select(F.col(id_col).alias("_id"), *[(x + 0.0).alias(n) for x, n in zip(at, xs)], *[F.floor(x / side).alias(n) for x, n in zip(space, cell)])
    places = cut(rows.groupBy(*cell, *xs).agg(F.min("_id").alias("_id"), F.count("*").alias("_n")))
    steps = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if math.sqrt(sum(max(abs(k) - 1, 0) ** 2 for k in o)) * side <= eps * (1 + 1e-6)]
    around = F.explode(F.array(*[F.struct(*[F.lit(k).cast("long").alias(f"o{i}") for i, k in enumerate(o)]) for o in steps]))

    def named(t: DataFrame, mark: str) -> DataFrame:
        return t.select(*[F.col(c).alias(mark + c) for c in t.columns])

    def neighbours(cells: DataFrame, others: DataFrame) -> DataFrame:
        """Cells (a_c...) with the cells around them and themselves (b_c...) among the others."""
        moved = named(cells.select(*cell), "a").withColumn("_o", around).select(*["a" + c for c in cell], *[(F.col("a" + c) + F.col(f"_o.o{i}")).alias("b" + c) for i, c in enumerate(cell)])
        return moved.join(named(others.select(*cell), "b"), ["b" + c for c in cell], "left_semi")

    def compared(few: DataFrame, many: DataFrame, links: DataFrame) -> DataFrame:
        """Places of linked cells that are near each other, with the columns of both."""
        left = named(few, "a").join(links, ["a" + c for c in cell])
        return left.join(named(many, "b"), ["b" + c for c in cell]).where(near("a", "b"))

    cells = cut(places.groupBy(*cell).agg(F.sum("_n").alias("_rows")))
    sparse = places.join(cells.where(F.col("_rows") < least).select(*cell), cell, "left_semi")
    counted = compared(sparse, places, neighbours(cells.where(F.col("_rows") < least), cells)).groupBy(*["a" + x for x in xs]).agg((F.sum("b_n") >= least).alias("_core"))
    judged = places.join(cells, cell).join(counted.select(*[F.col("a" + x).alias(x) for x in xs], "_core"), xs, "left")
    judged = cut(judged.withColumn("_core", F.coalesce((F.col("_rows") >= least) | F.col("_core"), F.lit(False))))
    core = judged.where("_core").select(*cell, *xs, "_id")
    ends = [f(F.struct(*xs), x) for x in xs for f in (F.min_by, F.max_by)] + [f(F.struct(*xs), reduce(lambda u, v: u + v, [k * F.col(x) for k, x in zip(sign, xs)])) for sign in itertools.product((1, -1), repeat=len(xs)) if len(xs) > 1 for f in (F.max_by,)]
    hubs = cut(core.groupBy(*cell).agg(F.min("_id").alias("_id"), F.array_distinct(F.array(*ends)).alias("_ends")))
    beside = cut(neighbours(hubs, hubs).where(F.struct(*["a" + c for c in cell]) < F.struct(*["b" + c for c in cell])))
    tips = hubs.select(*cell, "_id", F.explode("_ends").alias("_e")).select(*cell, "_id", "_e.*")
    first = compared(tips, tips, beside).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    alone = hubs.select(F.col("_id").alias("a"), F.col("_id").alias("b"))
    roots = cut(hubs.select(*cell, "_id").join(components(first.union(alone)).select(F.col("node").alias("_id"), F.col("root").alias("_root")), "_id"))
    apart = beside.join(named(roots.select(*cell, "_root"), "a"), ["a" + c for c in cell]).join(named(roots.select(*cell, "_root"), "b"), ["b" + c for c in cell]).where("a_root <> b_root")
    bare = core.select(*cell, *xs)
    second = cut(compared(bare, bare, cut(apart)).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    last = components(second).select(F.col("node").alias("_root"), F.col("root").alias("_last"))
    found = cut(roots.join(last, "_root", "left").select(*cell, F.coalesce("_last", "_root").alias("cluster")))
    own = core.join(found, cell).select(*xs, "cluster", F.lit(True).alias("core"))
    border = judged.where("not _core")
    joined = compared(border.select(*cell, *xs), core.join(found, cell), neighbours(border.select(*cell).distinct(), hubs))
    joined = joined.groupBy(*["a" + x for x in xs]).agg(F.min_by("bcluster", "b_id").alias("cluster")).select(*[F.col("a" + x).alias(x) for x in xs], "cluster", F.lit(False).alias("core"))
    placed = df.select(F.col(id_col), *[F.when(there, x + 0.0).alias(n) for x, n in zip(at, xs)])
    return placed.join(own.union(joined), xs, "left").select(id_col, "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def single_linkage(pairs: DataFrame, a: str, b: str, distance: str, most: float) -> DataFrame:
    """Clusters of single linkage at a threshold are the components of the near pairs: exact."""
    return components(pairs.where(F.col(distance) <= most), a, b)


def group_by_delays(df: DataFrame, keys: list[str], channel: str, delay: str, digits: int = 2) -> DataFrame:
    """Groups of rows with the same rounded delays on the same channels: group (least key), members, channels."""
    shape = F.array_sort(F.collect_list(F.struct(F.col(channel), F.bround(delay, digits).alias("d"))))
    per = df.groupBy(*keys).agg(shape.alias("shape"))
    return per.groupBy("shape").agg(F.min(F.struct(*keys)).alias("k"), F.count("*").alias("members")).select("k.*", "members", F.size("shape").cast("long").alias("channels"))


def plane(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c per key, with strike and dip in degrees."""
    cov = {p + q: F.covar_pop(p_, q_) for p, p_ in (("x", x), ("y", y)) for q, q_ in (("x", x), ("y", y), ("z", z))}
    m = df.groupBy(*keys).agg(*[c.alias(n) for n, c in cov.items()], F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    m = m.withColumn("a", (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).withColumn("b", (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    steep = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return m.select(
        *keys, "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"),
        F.pmod(F.degrees(F.atan2(-F.col("a"), -F.col("b"))) - 90, F.lit(360.0)).alias("strike"), F.degrees(F.atan(steep)).alias("dip"),
    )


def kmeans(df: DataFrame, id_col: str, coords: list[str], k: int, seed: int = 1) -> DataFrame:
    """Id and cluster number; numbers mean nothing but sameness."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=coords, outputCol="_v").transform(df.select(id_col, *[F.col(c).cast("double") for c in coords]))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).select(id_col, "cluster")


def largest_first(df: DataFrame, cluster: str, over: int) -> DataFrame:
    """Clusters of more than `over` rows with their rank by size, the largest first."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n")).where(F.col("n") > over)
    return number_rows(sizes, [F.desc("n"), F.col(cluster)], "rank")
