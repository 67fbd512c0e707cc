"""Local geometry: covariance of neighbourhoods and what follows from its eigenvalues.

Neighbours come from the distributed joins; their sums are aggregated in the
JVM (nine numbers a row), and only the 3 x 3 eigenproblems go to NumPy, a batch
at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spatial.neighbors import knn_join, radius_join
from .neighborhood import XYZ, _with

COV = ["xx", "xy", "xz", "yy", "yz", "zz"]


def covariance(df: DataFrame, knn: int | None = 8, radius: float | None = None, stride: int = 1, min_k: int = 3) -> DataFrame:
    """(pid, n, mean offsets mx my mz, covariance of a sample) of each row's neighbourhood: the ``knn`` nearest, itself among
    them, every ``stride``-th of knn * stride, or all within ``radius`` where there are at least ``min_k``."""
    right = df.select("pid", *XYZ, *(F.col(a).alias(f"_r{a}") for a in XYZ))
    keep = tuple(f"_r{a}" for a in XYZ)
    if radius:
        n = radius_join(df, right, radius, XYZ, keep=keep)
    else:
        n = knn_join(df, right, knn * stride, XYZ, keep=keep)
        if stride > 1:
            n = n.where((F.col("place") - 1) % stride == 0)
    j = n.join(df.select(F.col("pid").alias("lpid"), *(F.col(a).alias(f"_l{a}") for a in XYZ)), "lpid")
    # offsets from the row itself, so that large coordinates lose no digits
    j = j.select(F.col("lpid").alias("pid"), *((F.col(f"_r{a}") - F.col(f"_l{a}")).alias(a.lower()) for a in XYZ), "d2")
    aggs = [F.count(F.lit(1)).alias("n"), F.max("d2").alias("far2"), *(F.avg(a).alias(f"m{a}") for a in "xyz"), *(F.covar_samp(c[0], c[1]).alias(c) for c in COV)]
    g = j.groupBy("pid").agg(*aggs)
    return g.where(F.col("n") >= min_k) if radius else g


def _matrices(pdf: pd.DataFrame) -> np.ndarray:
    m = np.zeros((len(pdf), 3, 3))
    for c in COV:
        a, b = "xyz".index(c[0]), "xyz".index(c[1])
        m[:, a, b] = m[:, b, a] = pdf[c].fillna(0.0).to_numpy()
    return m


def eigen(cov: DataFrame) -> DataFrame:
    """Add e0 <= e1 <= e2 and the vectors of the least (v0) and the greatest (v2)."""
    extra = [f"e{k}" for k in range(3)] + [f"v{k}{a}" for k in (0, 1, 2) for a in "xyz"]
    schema = cov.select("*", *(F.lit(0.0).alias(c) for c in extra)).schema

    def run(batches):
        for pdf in batches:
            if len(pdf):
                w, v = np.linalg.eigh(_matrices(pdf))
                out = pdf.assign(**{f"e{k}": w[:, k] for k in range(3)}, **{f"v{k}{a}": v[:, i, k] for k in (0, 1, 2) for i, a in enumerate("xyz")})
                yield out

    return cov.mapInPandas(run, schema)


def eigenvalues(df: DataFrame, knn: int = 8, normalize: bool = False, stride: int = 1, radius: float | None = None, min_k: int = 3) -> DataFrame:
    """Eigenvalue0 <= 1 <= 2 over knn + 1 rows (itself included) or the radius; ``normalize``: shares. Rows without stay 0."""
    e = eigen(covariance(df, knn + 1, radius, stride, min_k))
    total = F.col("e0") + F.col("e1") + F.col("e2")
    val = lambda k: F.coalesce(F.try_divide(f"e{k}", total), F.lit(0.0)) if normalize else F.col(f"e{k}")
    return _with(df, e.select("pid", *(val(k).alias(f"Eigenvalue{k}") for k in range(3))), Eigenvalue0=0.0, Eigenvalue1=0.0, Eigenvalue2=0.0)


def normal(df: DataFrame, knn: int = 8, radius: float | None = None, viewpoint: list[float] | None = None, always_up: bool = True) -> DataFrame:
    """NormalX, NormalY, NormalZ, Curvature; towards ``viewpoint``, else upwards."""
    e = eigen(covariance(df, knn, radius, min_k=3)).join(df.select("pid", *XYZ), "pid")
    if viewpoint:
        flip = sum(((float(v) - F.col(a)) * F.col(f"v0{a.lower()}") for v, a in zip(viewpoint, XYZ)), F.lit(0.0)) < 0
    else:
        flip = (F.col("v0z") < 0) if always_up else F.lit(False)
    sign = F.when(flip, -1.0).otherwise(1.0)
    curve = F.coalesce(F.abs(F.try_divide(F.col("e0"), F.col("e0") + F.col("e1") + F.col("e2"))), F.lit(0.0))
    out = e.select("pid", *((F.col(f"v0{a.lower()}") * sign).alias(f"Normal{a}") for a in XYZ), curve.alias("Curvature"))
    return _with(df, out, NormalX=0.0, NormalY=0.0, NormalZ=0.0, Curvature=0.0)


FEATURES = ("Linearity", "Planarity", "Scattering", "Verticality", "Omnivariance", "EigenvalueSum", "Eigenentropy", "Anisotropy", "SurfaceVariation", "DemantkeVerticality", "Density")


def covariancefeatures(df: DataFrame, knn: int = 10, feature_set: list[str] | str = "dimensionality", stride: int = 1, radius: float | None = None, min_k: int = 3, mode: str = "sqrt") -> DataFrame:
    """Features of the eigenvalues, raw, as square roots, or as shares. Sets: 'dimensionality' (the first four) or names, or 'all'."""
    want = list(FEATURES[:4]) if feature_set in ("dimensionality", ["dimensionality"]) else list(FEATURES) if feature_set in ("all", ["all"]) else list(feature_set)
    e = eigen(covariance(df, knn + 1, radius, stride, min_k))
    lam = [F.greatest(F.col(f"e{k}"), F.lit(0.0)) for k in (2, 1, 0)]
    if mode == "sqrt":
        lam = [F.sqrt(x) for x in lam]
    elif mode == "normalized":
        total = lam[0] + lam[1] + lam[2]
        lam = [F.coalesce(F.try_divide(x, total), F.lit(0.0)) for x in lam]
    e = e.withColumns({"l1": lam[0], "l2": lam[1], "l3": lam[2]})
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    s = l1 + l2 + l3
    z = lambda x: F.coalesce(x, F.lit(0.0))
    ent = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    # the vertical share of the axes, weighted by the eigenvalues
    unary = [sum((F.abs(F.col(f"v{k}{a}")) * lam_k for k, lam_k in ((0, l3), (1, l2), (2, l1))), F.lit(0.0)) for a in "xyz"]
    norm = F.sqrt(unary[0] * unary[0] + unary[1] * unary[1] + unary[2] * unary[2])
    volume = 4.0 / 3.0 * math.pi * F.pow(F.sqrt("far2"), F.lit(3.0))
    f = {
        "Linearity": z(F.try_divide(l1 - l2, l1)), "Planarity": z(F.try_divide(l2 - l3, l1)), "Scattering": z(F.try_divide(l3, l1)),
        "Verticality": z(F.try_divide(unary[2], norm)), "Omnivariance": F.pow(F.greatest(l1 * l2 * l3, F.lit(0.0)), F.lit(1.0 / 3)), "EigenvalueSum": s,
        "Eigenentropy": -(ent(l1) + ent(l2) + ent(l3)), "Anisotropy": z(F.try_divide(l1 - l3, l1)), "SurfaceVariation": z(F.try_divide(l3, s)),
        "DemantkeVerticality": 1 - F.abs("v0z"), "Density": z(F.try_divide(F.col("n").cast("double"), volume)),
    }
    return _with(df, e.select("pid", *(f[n].alias(n) for n in want)), **{n: 0.0 for n in want})


def approximatecoplanar(df: DataFrame, knn: int = 8, thresh1: float = 25.0, thresh2: float = 6.0) -> DataFrame:
    """Coplanar = 1 where e1 > thresh1 e0 and thresh2 e1 > e2, over knn rows, itself included."""
    e = eigen(covariance(df, knn))
    hit = (F.col("e1") > thresh1 * F.col("e0")) & (thresh2 * F.col("e1") > F.col("e2"))
    return _with(df, e.select("pid", hit.cast("int").alias("Coplanar")), Coplanar=0)


def estimaterank(df: DataFrame, knn: int = 8, thresh: float = 0.01) -> DataFrame:
    """Rank: singular values of the covariance above ``thresh`` times the greatest."""
    e = eigen(covariance(df, knn))
    above = sum(((F.abs(f"e{k}") > thresh * F.greatest(F.abs("e0"), F.abs("e1"), F.abs("e2"))).cast("int") for k in range(3)), F.lit(0))
    return _with(df, e.select("pid", above.alias("Rank")), Rank=0)


def planefit(df: DataFrame, knn: int = 8) -> DataFrame:
    """PlaneFit: d / (d + mean distance of the knn others to their plane), d the row's own distance to it."""
    others = _others(df, knn)

    def run(batches):
        for pdf in batches:
            size = pdf["p"].map(len)
            for s in size.unique():
                part = pdf[size == s]
                p = np.array(part["p"].tolist(), dtype=float).reshape(len(part), -1, 3)
                mean = p.mean(axis=1)
                c = np.einsum("nki,nkj->nij", p - mean[:, None], p - mean[:, None])
                v = np.linalg.eigh(c)[1][:, :, 0]
                own = np.abs(np.einsum("ni,ni->n", -mean, v))
                rest = np.abs(np.einsum("nki,ni->nk", p - mean[:, None], v)).mean(axis=1)
                total = own + rest
                yield pd.DataFrame({"pid": part["pid"], "PlaneFit": np.divide(own, total, out=np.zeros_like(own), where=total > 0)})

    return _with(df, others.mapInPandas(run, "pid bigint, PlaneFit double"), PlaneFit=0.0)


def _others(df: DataFrame, knn: int) -> DataFrame:
    """(pid, p): offsets of the knn nearest others, flat, nearest first; at most 3 * knn numbers a row."""
    right = df.select("pid", *XYZ, *(F.col(a).alias(f"_r{a}") for a in XYZ))
    n = knn_join(df, right, knn + 1, XYZ, keep=tuple(f"_r{a}" for a in XYZ)).where("lpid <> rpid")
    j = n.join(df.select(F.col("pid").alias("lpid"), *(F.col(a).alias(f"_l{a}") for a in XYZ)), "lpid")
    s = F.struct("d2", "rpid", F.array(*((F.col(f"_r{a}") - F.col(f"_l{a}")) for a in XYZ)).alias("o"))
    g = j.groupBy(F.col("lpid").alias("pid")).agg(F.slice(F.array_sort(F.collect_list(s)), 1, knn).alias("s"))
    return g.select("pid", F.flatten(F.transform("s", lambda x: x["o"])).alias("p"))


def optimalneighborhood(df: DataFrame, min_k: int = 10, max_k: int = 14) -> DataFrame:
    """OptimalKNN, OptimalRadius: of min_k to max_k neighbours (itself first) the number of least eigenentropy."""
    others = _others(df, max_k - 1)

    def run(batches):
        for pdf in batches:
            ks, rs = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf))
            best, size = np.full(len(pdf), np.inf), pdf["p"].map(len).to_numpy() // 3 + 1
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                p = np.zeros((len(at), n, 3))
                p[:, 1:] = np.stack(pdf["p"].iloc[at].to_numpy()).reshape(len(at), n - 1, 3) if n > 1 else 0
                for k in range(min_k, min(max_k, n) + 1):
                    c = p[:, :k] - p[:, :k].mean(axis=1, keepdims=True)
                    w = np.maximum(np.linalg.eigvalsh(np.matmul(c.transpose(0, 2, 1), c) / (k - 1)), 0)
                    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
                    e = -(w * np.log(np.where(w > 0, w, 1))).sum(axis=1)
                    less = e < best[at]
                    best[at[less]], ks[at[less]], rs[at[less]] = e[less], k, np.linalg.norm(p[less, k - 1], axis=1)
            yield pd.DataFrame({"pid": pdf["pid"], "OptimalKNN": ks, "OptimalRadius": rs})

    return _with(df, others.mapInPandas(run, "pid bigint, OptimalKNN bigint, OptimalRadius double"), OptimalKNN=0, OptimalRadius=0.0)


def smallest_balls(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the smallest balls around n sets of k points (n x k x 3).

    The ball is that of two to four of its points: all choices at once for all
    sets, the smallest that holds every point.
    """
    from itertools import combinations

    n, k, _ = p.shape
    scale = np.abs(p - p[:, :1]).max(axis=(1, 2)) + 1e-12
    centre, radius = p[:, 0].copy(), np.full(n, np.inf)
    alone = np.linalg.norm(p - p[:, :1], axis=2).max(axis=1) <= 1e-9 * scale
    radius[alone] = 0.0
    for size in range(2, min(4, k) + 1):
        for idx in combinations(range(k), size):
            q = p[:, idx]
            a = q[:, 1:] - q[:, :1]
            g = np.einsum("nik,njk->nij", a, a)
            det = np.linalg.det(g)
            ok = np.abs(det) > 1e-12 * scale ** (2 * (size - 1))
            g[~ok] = np.eye(size - 1)
            x = np.linalg.solve(2 * g, np.einsum("nik,nik->ni", a, a)[..., None])[..., 0]
            off = np.einsum("ni,nik->nk", x, a)
            r = np.linalg.norm(off, axis=1)
            c = q[:, 0] + off
            holds = np.linalg.norm(p - c[:, None], axis=2).max(axis=1) <= r + 1e-9 * scale
            better = ok & holds & (r < radius)
            centre[better], radius[better] = c[better], r[better]
    return centre, radius


def miniball(df: DataFrame, knn: int = 8) -> DataFrame:
    """Miniball: d / (d + 2 r / sqrt(3)) for the smallest ball (radius r) around the knn others, d the distance to its centre."""
    others = _others(df, knn)

    def run(batches):
        for pdf in batches:
            size = pdf["p"].map(len)
            for s in size.unique():
                part = pdf[size == s]
                c, r = smallest_balls(np.array(part["p"].tolist(), dtype=float).reshape(len(part), -1, 3))
                d = np.linalg.norm(c, axis=1)
                total = d + 2 * r / math.sqrt(3)
                yield pd.DataFrame({"pid": part["pid"], "Miniball": np.divide(d, total, out=np.zeros_like(d), where=total > 0)})

    return _with(df, others.mapInPandas(run, "pid bigint, Miniball double"), Miniball=0.0)
