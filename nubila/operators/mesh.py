"""Triangulation, what is read from triangles, and rasters of meshes."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spatial.neighbors import knn_join


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three indices, counterclockwise) of points of the plane, by incremental insertion.

    Repeated points are left out; fewer than three, or all on a line, give none.
    """
    pts, first = np.unique(xy, axis=0, return_index=True)
    n = len(pts)
    if n < 3:
        return np.empty((0, 3), dtype=np.int64)
    mid, span = pts.mean(axis=0), max(float(np.ptp(pts, axis=0).max()), 1e-9)
    p = np.vstack(((pts - mid) / span, [[-30.0, -20.0], [30.0, -20.0], [0.0, 40.0]]))
    tri = [(n, n + 1, n + 2)]
    circ = [_circle(p, tri[0])]
    for i in np.random.default_rng(1).permutation(n):
        c = np.array(circ)
        bad = np.flatnonzero(((p[i] - c[:, :2]) ** 2).sum(axis=1) < c[:, 2] * (1 + 1e-12))
        edges: dict[tuple, int] = {}
        for b in bad:
            t = tri[b]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                if (e[1], e[0]) in edges:
                    del edges[(e[1], e[0])]
                else:
                    edges[e] = 1
        gone = set(bad.tolist())
        tri = [t for k, t in enumerate(tri) if k not in gone]
        circ = [x for k, x in enumerate(circ) if k not in gone]
        for a, b in edges:
            t = (a, b, int(i))
            if abs(_area(p, t)) > 1e-18:
                tri.append(t)
                circ.append(_circle(p, t))
    out = [t for t in tri if max(t) < n]
    return first[np.array(out, dtype=np.int64)] if out else np.empty((0, 3), dtype=np.int64)


def _area(p, t):
    (ax, ay), (bx, by), (cx, cy) = p[t[0]], p[t[1]], p[t[2]]
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _circle(p, t):
    (ax, ay), (bx, by), (cx, cy) = p[t[0]], p[t[1]], p[t[2]]
    d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    if d == 0:
        return (ax, ay, np.inf)
    b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
    ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
    return (ax + ux, ay + uy, ux * ux + uy * uy)


def delaunay(df: DataFrame) -> DataFrame:
    """(a, b, c, view_id, face_seq): triangles as pids, counterclockwise, of each view (the whole cloud without views), in order.

    A triangulation has no seams, so a view is one task's; split a cloud of many files
    by file or tile into views first.
    """
    d = df.select("pid", "X", "Y", F.col("view_id").cast("bigint").alias("view_id") if "view_id" in df.columns else F.lit(0).cast("bigint").alias("view_id"))

    def run(key, pdf):
        pdf = pdf.sort_values("pid")
        t = triangulate(pdf[["X", "Y"]].to_numpy(float))
        out = pd.DataFrame(pdf["pid"].to_numpy()[t] if len(t) else np.empty((0, 3), dtype=np.int64), columns=["a", "b", "c"])
        return out.assign(view_id=key[0], face_seq=np.arange(len(out)))

    return d.groupBy("view_id").applyInPandas(run, "a bigint, b bigint, c bigint, view_id bigint, face_seq bigint")


def heights(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Z at each q (n x 2) of the Delaunay surface of its own k points (n x k x 3); NaN outside.

    Of all choices of three points the first whose triangle holds q and whose circle holds no other point.
    """
    n, k, _ = p.shape
    out = np.full(n, np.nan)
    todo = np.arange(n)
    r = p[:, :, :2] - q[:, None]
    scale = np.maximum(np.abs(r).max(axis=(1, 2)), 1e-300)[:, None, None]
    r = r / scale
    lift = (r**2).sum(axis=2)
    for i, j, m in itertools.combinations(range(k), 3):
        if not len(todo):
            break
        a, b, c = r[todo, i], r[todo, j], r[todo, m]
        det = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            u = ((b[:, 1] - c[:, 1]) * -c[:, 0] + (c[:, 0] - b[:, 0]) * -c[:, 1]) / det
            v = ((c[:, 1] - a[:, 1]) * -c[:, 0] + (a[:, 0] - c[:, 0]) * -c[:, 1]) / det
        ok = (np.abs(det) > 1e-12) & (np.minimum(np.minimum(u, v), 1 - u - v) >= -1e-12)
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        rows = todo[at]
        # the plane through the three lifted points: no point of the others lies below it
        la, lb, lc = lift[rows, i], lift[rows, j], lift[rows, m]
        A = np.stack((a[at] - c[at], b[at] - c[at]), axis=1)
        g = np.linalg.solve(A, np.stack((la - lc, lb - lc), axis=1)[:, :, None])[:, :, 0]
        plane = lc[:, None] + ((r[rows] - c[at][:, None]) * g[:, None]).sum(axis=2)
        empty = (lift[rows] - plane >= -1e-9).all(axis=1)
        rows, at = rows[empty], at[empty]
        out[rows] = u[at] * p[rows, i, 2] + v[at] * p[rows, j, 2] + (1 - u[at] - v[at]) * p[rows, m, 2]
        todo = np.setdiff1d(todo, rows, assume_unique=True)
    return out


def hag_delaunay(df: DataFrame, count: int = 10, allow_extrapolation: bool = True, ground_class: int = 2) -> DataFrame:
    """HeightAboveGround: Z less the height of the Delaunay surface of the ``count`` nearest ground rows in the plane; outside
    it the nearest ground row's Z, or without extrapolation 0. Ground rows 0."""
    ground = df.where(F.col("Classification") == ground_class).select("pid", "X", "Y", F.struct("X", "Y", F.col("Z").alias("Z")).alias("_g"))
    rest = df.where(F.col("Classification") != ground_class)
    n = knn_join(rest, ground, count, ["X", "Y"], keep=("_g",))
    g = n.groupBy(F.col("lpid").alias("pid")).agg(F.array_sort(F.collect_list(F.struct("place", "_g"))).alias("g"))
    g = g.join(rest.select("pid", "X", "Y", "Z"), "pid").select("pid", "X", "Y", "Z", F.flatten(F.transform("g", lambda s: F.array(s["_g"]["X"], s["_g"]["Y"], s["_g"]["Z"]))).alias("g"))

    def run(batches):
        for pdf in batches:
            z, out = pdf["Z"].to_numpy(float), np.zeros(len(pdf))
            size = pdf["g"].map(len).to_numpy() // 3
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                p = np.stack(pdf["g"].iloc[at].to_numpy()).reshape(len(at), k, 3)
                h = heights(pdf[["X", "Y"]].to_numpy(float)[at], p)
                out[at] = np.where(np.isnan(h), z[at] - p[:, 0, 2] if allow_extrapolation else 0.0, z[at] - h)
            yield pd.DataFrame({"pid": pdf["pid"], "HeightAboveGround": out})

    h = g.mapInPandas(run, "pid bigint, HeightAboveGround double")
    return df.drop("HeightAboveGround").join(h, "pid", "left").fillna(0.0, ["HeightAboveGround"])


def faceraster(points: DataFrame, faces: DataFrame, resolution: float, origin: tuple[float, float], width: int, height: int, max_triangle_edge_length: float | None = None) -> DataFrame:
    """(i, j, value): height of the first face (by view, then order) over each cell centre; cells without a face are absent."""
    view = F.col("view_id") if "view_id" in faces.columns else F.lit(0)
    seq = F.col("face_seq") if "face_seq" in faces.columns else F.least("a", "b", "c")
    f = faces.select("a", "b", "c", F.struct(view.alias("view"), seq.alias("seq")).alias("face_seq"))
    for k in "abc":
        f = f.join(points.select(F.col("pid").alias(k), *((F.col(d)).alias(f"{d}{k}") for d in "XYZ")), k)
    if max_triangle_edge_length is not None:
        for p, q in ("ab", "bc", "ca"):
            f = f.where((F.col(f"X{p}") - F.col(f"X{q}")) ** 2 + (F.col(f"Y{p}") - F.col(f"Y{q}")) ** 2 <= max_triangle_edge_length**2)
    lo = lambda d, o: F.ceil((F.least(*(F.col(f"{d}{k}") for k in "abc")) - o) / resolution - 0.5 - 1e-9)
    hi = lambda d, o: F.floor((F.greatest(*(F.col(f"{d}{k}") for k in "abc")) - o) / resolution - 0.5 + 1e-9)
    f = f.withColumns({"i0": F.greatest(lo("X", origin[0]), F.lit(0)), "i1": F.least(hi("X", origin[0]), F.lit(width - 1)), "j0": F.greatest(lo("Y", origin[1]), F.lit(0)), "j1": F.least(hi("Y", origin[1]), F.lit(height - 1))})
    f = f.where("i0 <= i1 and j0 <= j1").withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
    x, y = (F.col("i") + 0.5) * resolution + origin[0], (F.col("j") + 0.5) * resolution + origin[1]
    det = (F.col("Yb") - F.col("Yc")) * (F.col("Xa") - F.col("Xc")) + (F.col("Xc") - F.col("Xb")) * (F.col("Ya") - F.col("Yc"))
    u = F.try_divide((F.col("Yb") - F.col("Yc")) * (x - F.col("Xc")) + (F.col("Xc") - F.col("Xb")) * (y - F.col("Yc")), det)
    v = F.try_divide((F.col("Yc") - F.col("Ya")) * (x - F.col("Xc")) + (F.col("Xa") - F.col("Xc")) * (y - F.col("Yc")), det)
    f = f.withColumns({"_u": u, "_v": v}).where("_u >= -1e-12 and _v >= -1e-12 and 1 - _u - _v >= -1e-12")
    z = F.col("_u") * F.col("Za") + F.col("_v") * F.col("Zb") + (1 - F.col("_u") - F.col("_v")) * F.col("Zc")
    return f.groupBy("i", "j").agg(F.min_by(z, "face_seq").alias("value"))
