"""Registration of one cloud to another, and comparison of two."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from ..spatial.neighbors import knn_join, radius_join
from .assign import transformation
from .features import COV, eigen

XYZ = ["X", "Y", "Z"]


def rigid_fit(n: float, mean_a: np.ndarray, mean_b: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """4 x 4 transform of b onto a from their means and cross-covariance (b rows, a columns)."""
    u, _, vt = np.linalg.svd(cross)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ d @ u.T
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = r, mean_a - r @ mean_b
    return t


def icp(fixed: DataFrame, moving: DataFrame, max_iter: int = 100, rt: float = 0.99999, tt: float = 9e-8, mse_abs: float = 1e-12, max_similar: int = 0, max_dist: float | None = None, init: list[float] | None = None) -> tuple[DataFrame, dict]:
    """Rigid registration of ``moving`` onto ``fixed``: nearest neighbours, then the best rotation and shift, until little changes.

    A round is one nearest-neighbour join and one aggregation to 16 numbers. The
    moved cloud and {transform (flat), converged, mse, iterations} are returned.
    """
    c = fixed.agg(*(F.avg(a) for a in XYZ)).first()
    centre = np.array([x or 0.0 for x in c], dtype=float)
    shift = lambda df: df.select("pid", *((F.col(a) - float(v)).alias(a) for a, v in zip(XYZ, centre)))
    f, m = staged(shift(fixed), "fixed"), staged(shift(moving), "moving")
    f = f.select("pid", *XYZ, *(F.col(a).alias(f"_f{a}") for a in XYZ))
    back, forth = np.eye(4), np.eye(4)
    back[:3, 3], forth[:3, 3] = centre, -centre
    total = forth @ np.array(init, dtype=float).reshape(4, 4) @ back if init is not None else np.eye(4)
    before, similar, converged, mse, done = 0.0, 0, False, math.nan, 0
    for done in range(1, max_iter + 1):
        now = transformation(m, total.ravel().tolist())
        j = knn_join(now, f, 1, XYZ, keep=("_fX", "_fY", "_fZ"))
        if max_dist is not None:
            j = j.where(F.col("d2") < max_dist**2)
        j = j.join(now.select(F.col("pid").alias("lpid"), *XYZ), "lpid")
        aggs = [F.count(F.lit(1)), F.avg(F.sqrt("d2")), *(F.avg(f"_f{a}") for a in XYZ), *(F.avg(a) for a in XYZ), *(F.covar_pop(b, f"_f{a}") for b in XYZ for a in XYZ)]
        row = j.agg(*aggs).first()
        if not row[0]:
            break
        mse = row[1]
        t = rigid_fit(row[0], np.array(row[2:5]), np.array(row[5:8]), np.array(row[8:17]).reshape(3, 3))
        total = t @ total
        cos, move = 0.5 * (np.trace(t[:3, :3]) - 1), float((t[:3, 3] ** 2).sum())
        same = abs(mse - before) < mse_abs or (cos >= rt and move <= tt)
        if same and similar >= max_similar:
            converged = True
            break
        similar = similar + 1 if same else 0
        before = mse
    final = back @ total @ forth
    return transformation(moving, final.ravel().tolist()), {"transform": final.ravel().tolist(), "converged": converged, "mse": mse, "iterations": done}


def m3c2(first: DataFrame, second: DataFrame, cores: DataFrame, normal_radius: float = 2.0, cyl_radius: float = 2.0, cyl_halflen: float = 5.0, reg_error: float = 0.0, orientation: str = "up", min_points: int = 1) -> DataFrame:
    """Change between two clouds along the local normal at core points: m3c2_distance, uncertainty (95 %), significant, std_dev1,
    std_dev2, count1, count2; null where a cylinder holds fewer than ``min_points``.

    The cylinder's ball bounds the join, an equi-join on cells; the cylinder is
    tested exactly and both clouds are summed a core in the JVM.
    """
    right = first.select("pid", *XYZ, *(F.col(a).alias(f"_r{a}") for a in XYZ))
    keep = ("_rX", "_rY", "_rZ")
    n = radius_join(cores, right, normal_radius, XYZ, keep=keep).join(cores.select(F.col("pid").alias("lpid"), *(F.col(a).alias(f"_l{a}") for a in XYZ)), "lpid")
    off = n.select(F.col("lpid").alias("pid"), *((F.col(f"_r{a}") - F.col(f"_l{a}")).alias(a.lower()) for a in XYZ))
    cov = off.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *(F.covar_samp(x[0], x[1]).alias(x) for x in COV)).where("n > 2")
    e = eigen(cov)
    flip = F.when((F.col("v0z") < 0) if orientation == "up" else (F.col("v0z") > 0) if orientation == "down" else F.lit(False), -1.0).otherwise(1.0)
    normals = staged(e.select("pid", *((F.col(f"v0{a.lower()}") * flip).alias(f"_n{a}") for a in XYZ)), "normals")
    core = staged(cores.select("pid", *XYZ).join(normals, "pid"), "cores")
    ball = math.sqrt(cyl_radius**2 + cyl_halflen**2) * (1 + 1e-9) + 1e-9

    def along(cloud, k):
        r = cloud.select("pid", *XYZ, *(F.col(a).alias(f"_r{a}") for a in XYZ))
        j = radius_join(core, r, ball, XYZ, keep=keep).join(core.select(F.col("pid").alias("lpid"), *(F.col(a).alias(f"_l{a}") for a in XYZ), "_nX", "_nY", "_nZ"), "lpid")
        d = sum(((F.col(f"_r{a}") - F.col(f"_l{a}")) * F.col(f"_n{a}") for a in XYZ), F.lit(0.0))
        j = j.withColumn("_d", d).where((F.col("d2") - F.col("_d") * F.col("_d") <= cyl_radius**2) & (F.abs("_d") <= cyl_halflen))
        return j.groupBy(F.col("lpid").alias("pid")).agg(F.count(F.lit(1)).alias(f"_c{k}"), F.avg("_d").alias(f"_m{k}"), F.var_pop("_d").alias(f"_v{k}")).where(F.col(f"_c{k}") >= min_points)

    s = along(first, 1).join(along(second, 2), "pid")
    lod = 1.96 * (F.sqrt(F.col("_v1") / F.col("_c1") + F.col("_v2") / F.col("_c2")) + reg_error)
    dist = F.col("_m2") - F.col("_m1")
    s = s.select("pid", dist.alias("m3c2_distance"), lod.alias("m3c2_uncertainty"), (F.abs(dist) > lod).cast("int").alias("m3c2_significant"), F.sqrt("_v1").alias("m3c2_std_dev1"), F.sqrt("_v2").alias("m3c2_std_dev2"), F.col("_c1").alias("m3c2_count1"), F.col("_c2").alias("m3c2_count2"))
    return cores.join(s, "pid", "left")
