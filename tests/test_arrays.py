import itertools
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from lodestream.operators import arrays as A
from lodestream.sources import binary as B
from pyspark.sql import functions as F


def test_overlapping_windows(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [1])], "id int, x array<int>")
    got = [(r.start, r.window, r.before) for r in A.overlapping_windows(df, "x", 4, 3, 2).collect()]
    assert got == [(0, [0, 1, 2, 3, 4, 5], 0), (3, [1, 2, 3, 4, 5, 6, 7, 8], 2), (6, [4, 5, 6, 7, 8, 9], 2)]


def test_hulls():
    cube = np.array(list(itertools.product([0, 2], repeat=3)), float)
    inside = np.random.default_rng(0).uniform(0, 2, (200, 3))
    assert A.hull_volume(np.r_[cube, inside]) == pytest.approx(8)
    assert A.hull_volume(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])) == pytest.approx(1 / 6)
    assert A.hull_volume(np.c_[inside[:, :2], np.zeros(200)]) == 0 and A.hull_volume(cube[:3]) == 0
    ball = np.random.default_rng(1).normal(size=(600, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    assert 0.95 * 4.18879 < A.hull_volume(ball) < 4.18879


def test_subspace_and_spikes():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2, 50))
    traces = rng.normal(size=(20, 2)) @ base
    u = A.subspace(traces, 0.999)
    x = rng.normal(0, 0.1, 400)
    x[100:150] += base[0] - base[1]
    stat = A.subspace_statistic(u, x)
    assert len(u) == 2 and stat.argmax() == 100 and stat[100] > 0.95
    spike = np.array([0, 5, -9, 4, 0.0])
    y = rng.normal(0, 0.01, 100)
    y[40:45] += spike
    y[70:75] += 0.1 * spike
    assert A.spikes(y, spike, 0.9, 0.5) == [40]


def test_grid_and_quadtree_and_volumes(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1.0), (2.0, 0.0, 3.0)], "x double, y double, v double")
    grid = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (50.0, 50.0)], "x double, y double")
    got = {r.x: r.v for r in A.interpolate_scattered(pts, grid, ["x", "y"], "v", 1.5).collect()}
    assert got[1.0] == pytest.approx(2) and got[0.0] == pytest.approx(1) and 50.0 not in got
    cells = [r.c for r in spark.createDataFrame([(0.1, 0.1), (1.0, 1.0), (0.6, 0.1), (2.0, 0.0)], "x double, y double").select(A.quadtree_cells(F.col("x"), F.col("y"), (0, 0, 1, 1), 2).alias("c")).collect()]
    assert cells == ["00", "33", "10", None]
    cube = [("k", float(a), float(b), float(c)) for a, b, c in itertools.product([0, 1], repeat=3)]
    assert A.hull_volumes(spark.createDataFrame(cube, "k string, x double, y double, z double"), ["k"], ["x", "y", "z"]).first().volume == pytest.approx(1)


def test_failed_items_are_reported(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "k string, v double")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        if (p["v"] == 0).any():
            raise ZeroDivisionError("zero")
        return pd.DataFrame({"k": p["k"], "out": 1 / p["v"], "error": None})

    got = {r.k: (r.out, r.error) for r in A.per_item(df, ["k"], work, "k string, out double, error string", "error").collect()}
    assert got["a"] == (1.0, None) and got["b"][1] == "ZeroDivisionError: zero"


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, values):
    body = element(6, struct.pack("<BBHI", 6, 0, 0, 0)) + element(5, struct.pack("<2i", *values.shape)) + element(1, name.encode()) + element(9, values.astype("<f8").tobytes(order="F"))
    return element(14, body)


def test_matrices_grids_and_header_times(spark, tmp_path):
    m = np.array([[1.0, 2], [3, 4], [5, 6]])
    packed = zlib.compress(matrix("second", m.T))
    (tmp_path / "a.mat").write_bytes(b"MATLAB 5.0".ljust(128, b" ") + matrix("first", m) + struct.pack("<II", 15, len(packed)) + packed)
    got = {(r.variable, r.row): r["values"] for r in B.mat_matrices(spark, str(tmp_path / "a.mat")).collect()}
    assert got[("first", 2)] == [5, 6] and got[("second", 0)] == [1, 3, 5] and len(got) == 5
    np.savez(tmp_path / "g.npz", time=np.array([0, 1_000_000]), depth=np.array([1.00049, 2.0]), strain=np.array([[1, 2], [3, 4.0]]))
    rows = sorted((str(r.ts), r.depth, r.strain) for r in B.gridded_arrays(spark, str(tmp_path / "g.npz")).collect())
    assert rows[0] == ("1970-01-01 00:00:00", 1.0, 1.0) and rows[-1] == ("1970-01-01 00:00:01", 2.0, 4.0)
    (tmp_path / "h.txt").write_text("x\nTime\t2024/01/01 00:00:00\t2024/01/02 00:00:00\n")
    assert [str(t) for t in B.header_times(spark, str(tmp_path / "h.txt"), 1, "yyyy/MM/dd HH:mm:ss")] == ["2024-01-02 00:00:00", "2024-01-01 00:00:00"]
    frames = spark.createDataFrame([(1, 5.0), (2, 25.0)], "id int, depth double")
    segments = spark.createDataFrame([("w", 0.0, 10.0, 2.0)], "well string, start double, stop double, stretch double")
    assert [(r.id, r.well, r.along) for r in B.fiber_by_well(frames, segments).collect()] == [(1, "w", 10.0)]


def test_hulls_of_parts_and_of_thin_clouds(spark):
    rng = np.random.default_rng(8)
    ball = rng.normal(size=(3000, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    stretched = ball * [1e6, 1.0, 1e-3] + [5.0, 1e3, 0.0]
    assert A.hull_volume(stretched) == pytest.approx(A.hull_volume(ball) * 1e3, rel=1e-6)
    box = np.array([[x, y, z] for x in (0, 9) for y in (0, 1) for z in (0, 5)], float)
    faces = rng.uniform(0, 1, (500, 3)) * [9, 1, 5]
    faces[np.arange(500), rng.integers(0, 3, 500)] = 0  # many points on the box's own sides
    assert A.hull_volume(np.r_[faces, box]) == pytest.approx(45)
    rows = [("ball", *map(float, r)) for r in ball[:800]] + [("box", *map(float, r)) for r in np.r_[faces, box]] + [(None, *map(float, r)) for r in box]
    rows += [("flat", float(i), 1.0, float(i * i)) for i in range(9)] + [("ball", None, 0.0, 0.0), ("ball", float("inf"), 0.0, 0.0), ("ball", float("nan"), 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(11)
    got = {r.k: r.volume for r in A.hull_volumes(df, ["k"], ["x", "y", "z"]).collect()}
    assert got == {"ball": pytest.approx(A.hull_volume(ball[:800])), "box": pytest.approx(45), None: pytest.approx(45), "flat": 0.0}
