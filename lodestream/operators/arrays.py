"""Overlapping windows of arrays, subspaces, spikes, scattered interpolation and hulls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .ranges import radius_join


def overlapping_windows(df: DataFrame, samples: str, size: int, step: int, pad: int = 0, name: str = "window") -> DataFrame:
    """A row for every window of `size` samples, `step` apart, with up to `pad` samples of its neighbours on
    either side, so that a filter's edges fall outside the window; `before` says how many stand before it."""
    n = F.size(samples)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step)))
    first = F.greatest(F.col("_s") - pad, F.lit(0))
    cut = F.slice(samples, first + 1, F.least(F.col("_s") + size + pad, n) - first)
    return df.withColumn("_s", F.explode(starts)).withColumn(name, cut).withColumn("before", F.col("_s") - first).withColumnRenamed("_s", "start")


def subspace(traces: np.ndarray, share: float = 0.9) -> np.ndarray:
    """The fewest orthonormal rows that hold `share` of the traces' energy."""
    _, s, v = np.linalg.svd(traces, full_matrices=False)
    upto = np.cumsum(s**2) / max((s**2).sum(), 1e-20)
    return v[: int(np.searchsorted(upto, share) + 1)]


def subspace_statistic(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of energy inside the subspace at every place of a signal."""
    windows = np.lib.stride_tricks.sliding_window_view(x, basis.shape[1])
    energy = (windows**2).sum(1)
    return np.divide(((windows @ basis.T) ** 2).sum(1), energy, out=np.zeros(len(windows)), where=energy > 1e-20)


def spikes(x: np.ndarray, template: np.ndarray, least_cc: float, share: float) -> list[int]:
    """Places where a spike template correlates and the window's peak is at least `share` of the template's."""
    cc = K.normalised_correlation(template, x)
    found = K.runs_of_peaks(cc, least_cc, len(template))
    return [i for i in found if np.abs(x[i : i + len(template)]).max() >= share * np.abs(template).max()]


def interpolate_scattered(points: DataFrame, grid: DataFrame, coords: list[str], value: str, radius: float) -> DataFrame:
    """Inverse-distance means (power 2) of the points within `radius` of every grid node; an approximation of a
    triangulated interpolation. A node without points has no row, one on a point takes its value."""
    pairs = radius_join(grid, points, coords, radius)
    weight = 1 / F.greatest(F.col("distance"), F.lit(1e-9)) ** 2
    return pairs.groupBy(*coords).agg((F.sum(weight * F.col(f"{value}_r")) / F.sum(weight)).alias(value), F.count("*").alias("n"))


def hull_faces(points: np.ndarray) -> np.ndarray | None:
    """The triangles (n x 3 corners x 3 coordinates) of the convex hull of points in space, built a point at a time; None if they are flat.

    Places are judged in the points' own box, so that long and thin clouds are judged like round ones."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 4 or (np.ptp(points, axis=0) == 0).any():
        return None
    p = (points - points.min(0)) / np.ptp(points, axis=0)
    a = 0
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    c = int(np.argmax((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1)))
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs((p - p[a]) @ normal)))
    if np.linalg.norm(normal) < 1e-12 or abs((p[d] - p[a]) @ normal) < 1e-12:
        return None
    centre = p[[a, b, c, d]].mean(0)

    def outward(faces):
        """Faces turned so that the centre lies behind them, their normals of length 1 and distances."""
        tri = p[faces]
        n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
        turn = np.einsum("ij,ij->i", centre - tri[:, 0], n) > 0
        faces[turn] = faces[turn][:, ::-1]
        n[turn] *= -1
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        return faces, n, np.einsum("ij,ij->i", tri[:, 0], n)

    faces, normals, far = outward(np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]))
    ids, fresh = np.arange(4), 4
    rest, owner, height = np.arange(len(p)), np.zeros(len(p), int), np.full(len(p), -1.0)

    def deal(at, normals, far, ids):
        """Points (places in `rest`) go to the face that they are furthest above; those above none lie inside for good."""
        h = p[rest[at]] @ normals.T - far
        best = h.argmax(1)
        owner[at], height[at] = ids[best], h[np.arange(len(at)), best]

    deal(np.arange(len(rest)), normals, far, ids)
    while True:
        out = height > 1e-10
        rest, owner, height = rest[out], owner[out], height[out]
        if not len(rest):
            return points[faces]
        q = int(rest[height.argmax()])  # the point furthest out is a corner
        seen = normals @ p[q] - far > 1e-10
        edges: set = set()
        for x, y, z in faces[seen].tolist():
            for u, v in ((x, y), (y, z), (z, x)):
                if (v, u) in edges:
                    edges.remove((v, u))
                else:
                    edges.add((u, v))
        new, n, f = outward(np.array([[u, v, q] for u, v in sorted(edges)]))
        names = np.arange(fresh, fresh + len(new))
        fresh += len(new)
        deal(np.flatnonzero(np.isin(owner, ids[seen])), n, f, names)
        faces, normals, far, ids = np.concatenate([faces[~seen], new]), np.concatenate([normals[~seen], n]), np.concatenate([far[~seen], f]), np.concatenate([ids[~seen], names])


def hull_volume(points: np.ndarray) -> float:
    """The volume of the convex hull of points in space; 0 if they are flat."""
    tri = hull_faces(points)
    if tri is None:
        return 0.0
    centre = tri.reshape(-1, 3).mean(0)
    return float(np.abs(np.einsum("ij,ij->i", tri[:, 0] - centre, np.cross(tri[:, 1] - centre, tri[:, 2] - centre))).sum() / 6)


def hull_corners(points: np.ndarray) -> np.ndarray:
    """Points that may be corners of a hull of more points: the corners of theirs, or all different ones if they are flat."""
    tri = hull_faces(points)
    return np.unique(np.asarray(points, float) if tri is None else tri.reshape(-1, 3), axis=0)


#: Points of a key that a task gathers before it keeps their corners only.
_GATHERED = 20_000


def hull_volumes(df: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    """Keys and the volume of the convex hull of a key's points in three coordinates.

    A hull of points is the hull of the hulls of its parts: every task sends the corners of what it holds of a key, and
    only they meet. Points with a null or non-finite coordinate don't count; keys may be null, and flat ones have volume 0.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(coords)])
    for i in range(3):
        rows = rows.where(F.abs(F.col(f"_{i}")) < float("inf"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    marks = [f"_{i}" for i in range(3)]

    def partial(frames):
        held: dict = {}
        heads: dict = {}

        def corners(key):
            held[key] = [hull_corners(np.concatenate(held[key]))]
            return held[key][0]

        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False, sort=False):
                name = repr(key)
                heads.setdefault(name, part[keys].head(1))
                held.setdefault(name, []).append(part[marks].to_numpy(float))
                if sum(map(len, held[name])) > _GATHERED:
                    corners(name)
        for name in list(held):
            found = corners(name)
            out = pd.DataFrame(found, columns=marks)
            for c in keys:
                out[c] = [heads[name][c].iloc[0]] * len(out)
            yield out[[*keys, *marks]]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = part[keys].head(1).copy()
        out["volume"] = hull_volume(part[marks].to_numpy(float))
        return out

    corners = rows.mapInPandas(partial, f"{schema}, _0 double, _1 double, _2 double")
    return corners.groupBy(*keys).applyInPandas(run, f"{schema}, volume double")


def quadtree_cells(x: Column, y: Column, box: tuple[float, float, float, float], depth: int) -> Column:
    """The quadtree path ('0' to '3' a level) of a place in a box; null outside."""
    x0, y0, x1, y1 = box
    n = 1 << depth
    i = F.least(F.floor((x - x0) / (x1 - x0) * n), F.lit(n - 1))
    j = F.least(F.floor((y - y0) / (y1 - y0) * n), F.lit(n - 1))
    digits = [(F.shiftright(i, depth - 1 - k) % 2 + 2 * (F.shiftright(j, depth - 1 - k) % 2)).cast("string") for k in range(depth)]
    return F.when((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1), F.concat(*digits))


def per_item(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, failed: str | None = None) -> DataFrame:
    """A function per key on the executors; with `failed`, a key whose call raises has its error in that
    column of one row and the others go on."""

    names = T.StructType.fromDDL(schema).names

    def run(part: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(part)
        except Exception as e:  # noqa: BLE001  a failed key is reported, not hidden
            if failed is None:
                raise
            row = {c: part[c].iloc[0] for c in keys} | {failed: f"{type(e).__name__}: {e}"}
            return pd.DataFrame([row]).reindex(columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)
