"""Polygons as flat vertex arrays, and exact point-in-polygon tests in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_SCHEMA = "region_id bigint, cx double, cy double, radius double, xy binary, ends binary"


def clean_ring(v: np.ndarray) -> np.ndarray | None:
    """Vertices (n x 2) of a ring without repeats, opened; None below three distinct ones."""
    if len(v):
        v = v[np.r_[True, (v[1:] != v[:-1]).any(axis=1)]]
    if len(v) > 1 and (v[0] == v[-1]).all():
        v = v[:-1]
    return v if len(v) > 2 else None


def polygon_parts(regions: DataFrame, id_col: str = "region_id", coordinates: str = "geom_coordinates") -> DataFrame:
    """One row a polygon: a bounding circle, the vertices of its rings and where each ring ends.
    A polygon whose outer ring is unusable gives no row; an unusable hole is left out.

    Polygons are taken apart in the JVM: a row of flat coordinates each, without nulls
    (of polygons, rings, vertices or their values), so a region of any number of polygons is no large row.
    """
    usable = lambda v: (F.abs(F.get(v, F.lit(0))) < 1e300) & (F.abs(F.get(v, F.lit(1))) < 1e300)
    rings = F.transform("polygon", lambda ring: F.filter(F.coalesce(ring, F.array()), usable))
    p = regions.select(F.col(id_col).cast("bigint").alias("id"), F.explode(coordinates).alias("polygon")).where("id is not null and size(polygon) > 0")
    p = p.select("id", rings.alias("rings")).select("id", F.transform("rings", F.size).alias("sizes"), F.transform(F.flatten("rings"), lambda v: v[0]).alias("x"), F.transform(F.flatten("rings"), lambda v: v[1]).alias("y"))

    def run(batches):
        for pdf in batches:
            out = []
            for rid, sizes, x, y in zip(pdf["id"], pdf["sizes"], pdf["x"], pdf["y"]):
                parts = np.split(np.stack((x, y), axis=1).astype(float), np.cumsum(sizes)[:-1])
                rings = [clean_ring(r) for r in parts]
                if rings[0] is None:
                    continue
                rings = [rings[0], *(r for r in rings[1:] if r is not None)]
                lo, hi = rings[0].min(axis=0), rings[0].max(axis=0)
                c = (lo + hi) / 2
                radius = float(np.sqrt(((rings[0] - c) ** 2).sum(axis=1)).max())
                out.append((int(rid), c[0], c[1], radius, np.concatenate(rings).tobytes(), np.cumsum([len(r) for r in rings]).astype(np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["region_id", "cx", "cy", "radius", "xy", "ends"])

    return p.mapInPandas(run, PART_SCHEMA)


def in_ring(px: np.ndarray, py: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd ray casting; the last vertex joins the first."""
    inside = np.zeros(len(px), dtype=bool)
    x1, y1 = ring[:, 0], ring[:, 1]
    x0, y0 = np.roll(x1, 1), np.roll(y1, 1)
    for ax, ay, bx, by in zip(x0, y0, x1, y1):
        if ay != by:
            crosses = (ay > py) != (by > py)
            inside[crosses] ^= px[crosses] < (bx - ax) * (py[crosses] - ay) / (by - ay) + ax
    return inside


def in_polygon(px: np.ndarray, py: np.ndarray, xy: bytes, ends: bytes) -> np.ndarray:
    """Inside the outer ring and outside every hole."""
    v, e = np.frombuffer(xy).reshape(-1, 2), np.frombuffer(ends, dtype=np.int64)
    outer = v[: e[0]]
    lo, hi = outer.min(axis=0), outer.max(axis=0)
    inside = (px >= lo[0]) & (px <= hi[0]) & (py >= lo[1]) & (py <= hi[1])
    at = np.flatnonzero(inside)
    ok = in_ring(px[at], py[at], outer)
    at = at[ok]
    for a, b in zip(e[:-1], e[1:]):
        at = at[~in_ring(px[at], py[at], v[a:b])]
    out = np.zeros(len(px), dtype=bool)
    out[at] = True
    return out
