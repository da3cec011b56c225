"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector. A pass over the vectors counts the scores of each query in
equal bins; the bin that holds the k-th highest is cut into finer bins in the next pass, until a bin is one
score wide. With the k-th value known, one more pass keeps what lies above it and, of the scores equal to
it, as many of the least ids as are still wanted. Scores are never moved, only counts and results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, store

#: Queries that are scored in one pass; more queries take more passes, so that what is broadcast is bounded.
QUERIES_AT_ONCE = 2048
#: Bins of a query's histogram in one pass.
BINS = 512
VECTORS_AT_ONCE = 2048
#: Scores of this magnitude or more raise an error: they are no longs.
LARGEST = 1 << 63
PAIRS_AT_ONCE = 1 << 14


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, e): the rows, numbered, without ids or vectors that are null and vectors with null or non-finite parts."""
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("e")).where("id is not null and e is not null")
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "e")


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(values * scale)


def _blocks(batch: pa.RecordBatch, scale: float):
    """(rows, ids, quantised matrix) for each vector length in a batch."""
    rows, ids, lists = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2))
    lengths = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1]
    values = quantise(lists.values.to_numpy(zero_copy_only=False), scale)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), VECTORS_AT_ONCE):
            part = at[k : k + VECTORS_AT_ONCE]
            yield rows[part], ids[part], values[starts[part][:, None] + np.arange(n)[None, :]]


def _scores(matrix: np.ndarray, queries: np.ndarray, counts: np.ndarray | bool = True) -> np.ndarray:
    """Inner products as int64 (queries x vectors) of the pairs that count, exact: by floats where no sum can pass
    2^53, else by integers."""
    n = matrix.shape[1]
    most = np.abs(queries).max(1, initial=0)[:, None] * np.abs(matrix).max(1, initial=0)[None, :] * n
    if most.max(initial=0) < 2.0**53:
        return (queries @ matrix.T).astype(np.int64)
    large = most >= 2.0**53
    out = np.where(large, 0, queries @ np.where(large.all(0)[:, None], 0, matrix).T).astype(np.int64)
    q, v = np.nonzero(large & counts)
    for k in range(0, len(q), PAIRS_AT_ONCE):
        i, j = q[k : k + PAIRS_AT_ONCE], v[k : k + PAIRS_AT_ONCE]
        long = most[i, j] < 2.0**62  # products and sums of int64
        out[i[long], j[long]] = np.einsum("ij,ij->i", queries[i[long]].astype(np.int64), matrix[j[long]].astype(np.int64))
        for x, y in zip(i[~long].tolist(), j[~long].tolist()):
            score = sum(int(a) * int(b) for a, b in zip(queries[x].tolist(), matrix[y].tolist()))
            if abs(score) >= LARGEST:
                raise OverflowError(f"a score of {score} is too large for a long")
            out[x, y] = score
    return out


def _search(rows: DataFrame, block: list, k: int, scale: float) -> DataFrame:
    """Results for a block of queries (row, id, e): query_row, query_id, vec_id, score; all above the k-th value and the
    ties each task keeps."""
    spark = rows.sparkSession
    by_length: dict[int, list[int]] = {}
    for i, q in enumerate(block):
        by_length.setdefault(len(q[2]), []).append(i)
    own_rows, ids = (np.array([q[c] for q in block], np.int64) for c in (0, 1))
    held = spark.sparkContext.broadcast(
        {n: (np.array(at), own_rows[at], quantise(np.array([block[i][2] for i in at], np.float64).reshape(len(at), n), scale)) for n, at in by_length.items()}
    )
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def scored(batch):
        """(query places, vector ids, scores, whether they count) over a batch; a query's own row doesn't."""
        for vec_rows, vec_ids, matrix in _blocks(batch, scale):
            if (found := held.value.get(matrix.shape[1])) is not None:
                at, own, queries = found
                others = own[:, None] != vec_rows[None, :]
                yield at, vec_ids, _scores(matrix, queries, others), others

    def extent(batches):
        low, high, n = np.full(len(ids), most), np.full(len(ids), least), np.zeros(len(ids), np.int64)
        for batch in batches:
            for at, _, s, own in scored(batch):
                low[at] = np.minimum(low[at], s.min(1, where=own, initial=most))
                high[at] = np.maximum(high[at], s.max(1, where=own, initial=least))
                n[at] += own.sum(1)
        q = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, low[q], high[q], n[q])], names=["q", "low", "high", "n"])

    low, width = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64)  # a width may pass the longs
    above, wanted = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    spread = rows.mapInArrow(extent, "q long, low long, high long, n long")
    for q, lo, hi, n in spread.groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")).collect():  # a row for each query
        low[q], width[q], wanted[q] = lo, hi - lo + 1, min(k, n)
    while (width > 1).any():
        bins = np.maximum(width // BINS + (width % BINS > 0), 1).astype(np.uint64)

        def histogram(batches, at_low=low.copy(), bins=bins, width=width.copy(), still=wanted - above):
            counts = np.zeros((len(ids), BINS), np.int64)
            for batch in batches:
                for at, _, s, own in scored(batch):
                    over = (s - at_low[at][:, None]).view(np.uint64)  # differences of longs, exact where they aren't negative
                    ok = own & (s >= at_low[at][:, None]) & (over < width[at][:, None])
                    place = (over // bins[at][:, None]).astype(np.int64) + np.arange(len(at))[:, None] * BINS
                    counts[at] += np.bincount(place[ok], minlength=len(at) * BINS).reshape(len(at), BINS)
            higher = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (higher < still[:, None]))  # lower bins can't hold the k-th highest of all
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "b", "n"])

        total = rows.mapInArrow(histogram, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("b")))
        want = F.element_at(F.array(*[F.lit(int(w)) for w in wanted - above]), F.col("q").cast("int") + 1)
        reached = total.withColumn("upto", upto).where(F.col("upto") >= want)
        kth = reached.groupBy("q").agg(F.max(F.struct("b", F.col("upto") - F.col("n"))).alias("x")).select("q", "x.*")
        for q, b, over in kth.collect():  # a row for each query of the block
            passed = b * int(bins[q])
            low[q], width[q] = int(low[q]) + passed, min(int(bins[q]), int(width[q]) - passed)
            above[q] += over

    def keep(batches):
        out: dict[int, list] = {}
        for batch in batches:
            for at, vec_ids, s, own in scored(batch):
                q, c = np.nonzero(own & (s >= low[at][:, None]))
                order = np.lexsort((vec_ids[c], -s[q, c], q))
                q, c = q[order], c[order]
                first = np.r_[True, q[1:] != q[:-1]]
                place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
                for i, j in zip(q[place < k], c[place < k]):
                    out.setdefault(int(at[i]), []).append((-int(s[i, j]), int(vec_ids[j])))
            for i, found in out.items():
                out[i] = sorted(found)[:k]
        flat = [(int(own_rows[i]), int(ids[i]), v, -s) for i, found in out.items() for s, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], pa.int64()) for i in range(4)], names=names)

    names = ["query_row", "query_id", "vec_id", "score"]
    schema = T.StructType()
    for name in names:
        schema = schema.add(name, "long")
    found = store(rows.mapInArrow(keep, schema), "found")
    held.destroy()
    return found


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest-scoring vectors of each query: query_id, rank (int, from 1), vec_id, score (long).

    Queries are the rows whose id is divisible by `every`, candidates all other rows of the same length. A
    component x counts as floor(scale * x), x as double, and the score is the exact integer inner product;
    one of LARGEST or more raises an error. Ties go to the smaller id; a query with fewer than k candidates
    gets them all, one without any gets no row. Rows without a usable vector or id take no part (see
    `usable`). Rows that repeat an id are rows like others: each of them is a candidate, for its twins too, and
    each a query, whose results have the same query_id. Other columns are not read.
    """
    spark = vectors.sparkSession
    numbered = store(usable(vectors, id_col, vector_col), "vectors")
    n = numbered.count()
    rows = store(numbered.repartition(max(1, math.ceil(n / (4 * VECTORS_AT_ONCE)))), "vectors")
    drop(numbered)
    asked = rows.where(F.col("id") % every == 0)
    parts = []
    last = -1
    while True:  # blocks of queries in order of their rows
        block_rows = asked.where(F.col("row") > last).select("row").orderBy("row").limit(QUERIES_AT_ONCE)
        bounds = block_rows.agg(F.min("row"), F.max("row")).first()
        if bounds[0] is None:
            break
        last = bounds[1]
        block = asked.where(F.col("row").between(*bounds)).collect()  # QUERIES_AT_ONCE rows at most
        parts.append(_search(rows, block, k, scale))
    drop(rows)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
