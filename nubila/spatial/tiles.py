"""Grids in tiles with a halo: how raster kernels run over areas of any size.

Cells are aggregated in the JVM, sent to the tiles that need them (their own and
those whose halo they fall in), and a NumPy kernel sees a dense tile. A kernel
whose reach is within the halo gives what it would give on the whole grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vptree import VPTree
from .metrics import euclidean

TILE = 128


def grid_kernel(cells: DataFrame, kernel, outputs: list[str], halo: int, cols: int, rows: int, tile: int = TILE) -> DataFrame:
    """``cells`` (c, r, z); ``kernel(z: 2-D array with NaN, origin (c0, r0)) -> dict of arrays``; gives (c, r, *outputs)."""
    span = lambda x: F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile))
    d = cells.select("c", "r", "z").withColumn("tc", F.explode(span("c"))).withColumn("tr", F.explode(span("r")))

    def run(key, pdf):
        tc, tr = int(key[0]), int(key[1])
        own = (pdf["c"] // tile == tc) & (pdf["r"] // tile == tr)
        names = ["c", "r", *outputs]
        if not own.any():
            return pd.DataFrame(columns=names)
        c0, r0 = max(0, tc * tile - halo), max(0, tr * tile - halo)
        c1, r1 = min(cols, (tc + 1) * tile + halo), min(rows, (tr + 1) * tile + halo)
        z = np.full((c1 - c0, r1 - r0), np.nan)
        z[pdf["c"].to_numpy() - c0, pdf["r"].to_numpy() - r0] = pdf["z"].to_numpy()
        got = kernel(z, (c0, r0))
        a, b = slice(tc * tile - c0, min(cols, (tc + 1) * tile) - c0), slice(tr * tile - r0, min(rows, (tr + 1) * tile) - r0)
        cc, rr = np.meshgrid(np.arange(c0, c1)[a], np.arange(r0, r1)[b], indexing="ij")
        return pd.DataFrame({"c": cc.ravel(), "r": rr.ravel(), **{n: (got[n][a, b].ravel() if got[n].ndim == 2 else list(got[n][a, b].reshape(-1, got[n].shape[2]))) for n in outputs}})

    kinds = ", ".join(f"{n} {'array<double>' if n.endswith('s') else 'double'}" for n in outputs)
    return d.groupBy("tc", "tr").applyInPandas(run, f"c bigint, r bigint, {kinds}")


def nearest_known(hole: np.ndarray) -> np.ndarray:
    """For each cell the (row, column) of the nearest cell that is no hole, by jump flooding with a last pass of step one."""
    n, m = hole.shape
    ii, jj = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    far = 10 * (n + m)
    si, sj = np.where(hole, -far, ii), np.where(hole, -far, jj)
    step = 1
    while step < max(n, m):
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    for s in [*steps, 2, 1]:
        for di in (-s, 0, s):
            for dj in (-s, 0, s):
                if (di or dj) and abs(di) < n and abs(dj) < m:
                    a = (slice(max(0, di), n + min(0, di)), slice(max(0, dj), m + min(0, dj)))
                    b = (slice(max(0, -di), n + min(0, -di)), slice(max(0, -dj), m + min(0, -dj)))
                    ci, cj = si[b], sj[b]
                    new = (ci - ii[a]) ** 2 + (cj - jj[a]) ** 2 < (si[a] - ii[a]) ** 2 + (sj[a] - jj[a]) ** 2
                    si[a], sj[a] = np.where(new, ci, si[a]), np.where(new, cj, sj[a])
    return np.stack((si, sj))


def fill_nearest(z: np.ndarray, k: int = 1) -> np.ndarray:
    """NaN cells take the mean of the k nearest filled ones (ties: any within the k)."""
    hole = np.isnan(z)
    if not hole.any() or hole.all():
        return z
    si, sj = nearest_known(hole)
    if k == 1:
        return np.where(hole, z[si, sj], z)
    known, empty = np.argwhere(~hole).astype(float), np.argwhere(hole).astype(float)
    values = z[~hole]
    tree = VPTree(known, euclidean)
    out, todo = np.zeros(len(empty)), np.arange(len(empty))
    radius = np.hypot(si[hole] - empty[:, 0], sj[hole] - empty[:, 1]) + 3.0
    k = min(k, len(known))
    while len(todo):
        q, p, d = tree.within(empty[todo], radius[todo])
        order = np.lexsort((p, d, q))
        q, p = q[order], p[order]
        first = np.searchsorted(q, np.arange(len(todo)), "left")
        n = np.searchsorted(q, np.arange(len(todo)), "right") - first
        done = n >= k
        use = done[q] & (np.arange(len(q)) - first[q] < k)
        out[todo[done]] = np.bincount(q[use], values[p[use]], len(todo))[done] / k
        todo = todo[~done]
        radius[todo] += 4.0
    z = z.copy()
    z[hole] = out
    return z


def _cross(z: np.ndarray, pick) -> np.ndarray:
    out = z.copy()
    out[1:] = pick(out[1:], z[:-1])
    out[:-1] = pick(out[:-1], z[1:])
    out[:, 1:] = pick(out[:, 1:], z[:, :-1])
    out[:, :-1] = pick(out[:, :-1], z[:, 1:])
    return out


def erode(z: np.ndarray, n: int) -> np.ndarray:
    """Least value of the diamond of radius n."""
    for _ in range(n):
        z = _cross(z, np.fmin)
    return z


def dilate(z: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        z = _cross(z, np.fmax)
    return z
