"""Binary archives: tables are written as files of a bounded number of rows each, by the tasks that hold them, and read back."""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators import relational as R
from lodestream.session import table
from lodestream.sources import binary, files, readers
from lodestream.storage import checkpoint_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its own name with its DuckDB counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _path(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _npz(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


@query("""
SELECT o_orderkey AS key, TIMESTAMP '2018-01-01' + to_microseconds((dayofyear(o_orderdate) - 1) * 86400000000::BIGINT) AS ts, round(o_totalprice / 60, 6) AS flow,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS pressure
FROM orders""")
def mat_scan(spark, sf):
    """Matrices of MAT files, all their rows together; a day number with the year 2018, NaN as null"""
    path = _path(spark, "mat")
    o = table(spark, sf, "orders")
    pressure = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    rows = o.select(F.expr("o_orderkey div 5000").alias("file"), F.col("o_orderkey").cast("double").alias("key"), F.dayofyear("o_orderdate").cast("double").alias("day"), (F.col("o_totalprice") / 60).alias("flow"), pressure.alias("pressure"))
    files.write_each(rows, ["file"], path, ".mat", lambda f: binary.mat_file({"note": np.zeros((1, 2)), "hydro": f[["key", "day", "flow", "pressure"]].to_numpy()}))
    v = binary.mat_matrices(spark, path).where("variable = 'hydro'").select(*[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("key", "day", "flow", "pressure"))])
    ts = F.expr("timestamp_ntz'2018-01-01' + make_dt_interval(cast(day AS int) - 1)")
    return v.select(F.col("key").cast("long").alias("key"), ts.alias("ts"), F.round("flow", 6).alias("flow"), F.when(~F.isnan("pressure"), F.col("pressure")).alias("pressure"))


def _cube(frame):
    data = np.zeros((3, 4, 64), np.float32)
    for r in frame.itertuples():
        data[r.vec_id % 12 // 4, r.vec_id % 4] = r.x
    return _npz(data=data)


@query("""
SELECT 'epoch' || vec_id // 12 AS epoch, (vec_id % 12 // 4)::INT AS source, (vec_id % 4)::INT AS receiver, round(embedding[64]::DOUBLE, 5) AS last, len(embedding)::INT AS n
FROM embeddings WHERE vec_id % 4 <> 2 AND vec_id % 7 <> 3""")
def epoch_cube_scan(spark, sf):
    """Archives of source x receiver x sample, an epoch each; a bad receiver and pairs without a signal are left out"""
    path = _path(spark, "cubes")
    e = table(spark, sf, "embeddings").where("vec_id % 7 <> 3").select(F.concat(F.lit("epoch"), F.expr("vec_id div 12")).alias("file"), "vec_id", F.col("embedding").alias("x"))
    files.write_each(e, ["file"], path, ".npz", _cube)
    c = binary.epoch_cubes(spark, path, bad_channels=(2,))
    return c.select("epoch", "source", "receiver", F.round(F.element_at("samples", -1).cast("double"), 5).alias("last"), F.size("samples").alias("n"))


def _grid(frame):
    frame = frame.sort_values("vec_id")
    return _npz(time=frame["vec_id"].to_numpy() * 3_600_000_000, depth=np.arange(64) * 0.25 + 1e-5, strain=np.stack(frame["x"].to_list()))


@query("""
SELECT TIMESTAMP '1970-01-01' + to_hours(vec_id) AS ts, (i - 1) * 0.25::DOUBLE AS depth, round(embedding[i]::DOUBLE, 6) AS strain FROM embeddings, range(1, 65) r(i)""")
def gridded_scan(spark, sf):
    """Time x depth arrays as rows, depths with three digits"""
    path = _path(spark, "grids")
    e = table(spark, sf, "embeddings").select(F.expr("vec_id div 20").alias("file"), "vec_id", F.col("embedding").alias("x"))
    files.write_each(e, ["file"], path, ".npz", _grid)
    return binary.gridded_arrays(spark, path).withColumn("strain", F.round("strain", 6))


def _scatter(frame):
    points = frame[["x", "y", "z", "p"]].to_numpy().astype("<f4")
    return struct.pack("<ifff", len(points), 0, 0, 0) + points.tobytes()


@query("""
SELECT 'event' || p_partkey // 500 AS event, p_size::FLOAT::DOUBLE AS x, p_retailprice::FLOAT::DOUBLE AS y, -p_size::FLOAT::DOUBLE AS z, (1.0 / p_size)::FLOAT::DOUBLE AS p FROM part""")
def scatter_scan(spark, sf):
    """Clouds of places of events with their weights, as 32-bit numbers"""
    path = _path(spark, "scatter")
    p = table(spark, sf, "part")
    rows = p.select(F.concat(F.lit("event"), F.expr("p_partkey div 500")).alias("file"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (-F.col("p_size")).cast("double").alias("z"), (1 / F.col("p_size")).alias("p"))
    files.write_each(rows, ["file"], path, ".scat", _scatter)
    return binary.scatter_points(spark, path).select("event", *[F.col(c).cast("double").alias(c) for c in "xyzp"])


@query("""
SELECT TIMESTAMP '2024-03-01' + to_minutes(c_custkey) AS ts, 40 + c_custkey % 150 / 10.0::DOUBLE AS lat, -130 + c_custkey % 97 / 8.0::DOUBLE AS lon, c_acctbal AS energy
FROM customer WHERE 40 + c_custkey % 150 / 10.0 BETWEEN 46.5 AND 50 AND -130 + c_custkey % 97 / 8.0 BETWEEN -126.5 AND -121.5""")
def tremor_scan(spark, sf):
    """A tremor list within a box, both ends included (the box is the arguments', as it evidently should be)"""
    path = _path(spark, "tremor")
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    when = F.date_format(F.expr("timestamp_ntz'2024-03-01' + make_dt_interval(0, 0, cast(c_custkey AS int))"), "yyyy-MM-dd HH:mm:ss")
    c.select(when.alias("starttime"), (40 + key % 150 / 10).alias("lat"), (-130 + key % 97 / 8).alias("lon"), F.col("c_acctbal").alias("energy")).write.option("header", "true").csv(path)
    kinds = {"ts": "timestamp_ntz", "lat": "double", "lon": "double", "energy": "double"}
    rows = readers.csv(spark, path, {"ts": ("starttime",), "lat": ("lat",), "lon": ("lon",), "energy": ("energy",)}, kinds, ("ts",))
    return R.bounding_box(rows, {"lat": (46.5, 50.0), "lon": (-126.5, -121.5)})
