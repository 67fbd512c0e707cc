"""The two joins behind the neighbourhood operators: within a radius, and the k nearest."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.nearby import assigned, fit_partition
from ..session import staged
from .metrics import METRICS
from .vptree import VPTree


def radius_join(left: DataFrame, right: DataFrame, radius: float, dims: list[str], left_id: str = "pid", right_id: str = "pid", keep: tuple[str, ...] = ()) -> DataFrame:
    """(lpid, rpid, d2, ``keep`` of the right) of all pairs nearer than ``radius``, a row itself included.

    Cells as wide as the radius; the right side goes to the 3^d cells around its
    own, then an equi-join on the cell and the exact test, all in the JVM.
    """
    cell = lambda d: F.floor(F.col(d) / radius)
    l = left.select(F.col(left_id).alias("lpid"), *(F.col(d).alias(f"_q{k}") for k, d in enumerate(dims)), *(cell(d).alias(f"_c{k}") for k, d in enumerate(dims)))  # noqa: E741
    r = right.select(F.col(right_id).alias("rpid"), *keep, *(F.col(d).alias(f"_p{k}") for k, d in enumerate(dims)), *(cell(d).alias(f"_b{k}") for k, d in enumerate(dims)))
    around = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    for k in range(len(dims)):
        r = r.withColumn("_o", F.explode(around)).withColumn(f"_c{k}", F.col(f"_b{k}") + F.col("_o")).drop("_o", f"_b{k}")
    d2 = reduce(lambda a, b: a + b, [(F.col(f"_q{k}") - F.col(f"_p{k}")) * (F.col(f"_q{k}") - F.col(f"_p{k}")) for k in range(len(dims))])
    j = l.join(r, [f"_c{k}" for k in range(len(dims))]).withColumn("d2", d2)
    return j.where(F.col("d2") < float(radius) ** 2).select("lpid", "rpid", "d2", *keep)


def places(df: DataFrame, dims: list[str]) -> DataFrame:
    """One row a distinct location: pid (its least), n (its rows) and ``dims``, staged."""
    return staged(df.select("pid", *(F.col(d).cast("double").alias(d) for d in dims)).groupBy(*dims).agg(F.min("pid").cast("bigint").alias("pid"), F.count(F.lit(1)).alias("n")), "places")


def radius_counts(left: DataFrame, right: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """(``dims``, count): of each row of ``left`` (``places``) the rows of ``right`` (``places``) nearer than the radius.

    Nothing is paired: each cell of the Voronoi partition counts in a tree, locations with
    their rows, crowded segments as a whole.
    """
    dims = list(dims)
    part = fit_partition(right, dims, "euclidean")
    r = assigned(right.select("n", *dims), dims, part, 0.0).where("home").select("cell", "n", *dims)
    l = assigned(left.select(*dims), dims, part, radius).select("cell", *dims)  # noqa: E741

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        q = lp[dims].to_numpy(float)
        n = VPTree(rp[dims].to_numpy(float), METRICS["euclidean"]).count(q, radius, rp["n"].to_numpy()) if len(rp) else np.zeros(len(q))
        return pd.DataFrame({**{d: q[:, k] for k, d in enumerate(dims)}, "count": n.astype(np.int64)})

    some = l.groupBy("cell").cogroup(r.groupBy("cell")).applyInPandas(run, ", ".join(f"`{d}` double" for d in dims) + ", count bigint")
    return some.groupBy(*dims).agg(F.sum("count").alias("count"))


def _nearest(tree: VPTree, queries: np.ndarray, k: int, limit: np.ndarray | None):
    """(query, point, distance) of the k nearest and all that tie with them: a segment of the tree around
    each query bounds the distance, one search within it finds the rest."""
    n = len(tree.points)
    k = min(k, n)
    bound = tree.bound(queries, k)
    if limit is not None:
        bound = np.minimum(bound, limit)
    return tree.within(queries, bound * (1 + 1e-9) + 1e-9)


def knn_join(left: DataFrame, right: DataFrame, k: int, dims: list[str], left_id: str = "pid", right_id: str = "pid", keep: tuple[str, ...] = (), cell_rows: int = 4000) -> DataFrame:
    """(lpid, rpid, d2, place, ``keep`` of the right): the k nearest right rows of each left row, ties by rpid, place from 1.

    Left rows of one location ask once, and of right rows at one location only the first k take part,
    found before anything is gathered.
    A Voronoi partition of the right side. In its own cell a left row finds k
    candidates; their farthest bounds the distance, and by the triangle
    inequality only cells whose pivot is within d(nearest pivot) + 2 bound can
    hold a nearer one. Only rows whose bound reaches another cell are sent on.
    """
    dims = list(dims)
    at = [f"_{i}" for i in range(len(dims))]
    r = right.select(F.col(right_id).cast("bigint").alias("rpid"), *(F.col(d).cast("double").alias(f"_{i}") for i, d in enumerate(dims)))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy("rpid"))).where(F.col("_n") <= k).drop("_n")
    rows = left.select(F.col(left_id).cast("bigint").alias("_id"), *(F.col(d).cast("double").alias(f"_{i}") for i, d in enumerate(dims)))
    asked = staged(rows.groupBy(*at).agg(F.min("_id").alias("lpid")), "asked")
    l, of = asked, list(at)  # noqa: E741
    flat = at if len(at) > 1 else [at[0], at[0]]
    part = fit_partition(r.select(*at) if len(at) > 1 else r.select(at[0], F.col(at[0]).alias("_1")), flat if len(at) > 1 else ["_0", "_1"], "euclidean", cell_rows)
    if len(at) == 1:
        l, r = (x.withColumn("_1", F.col("_0")) for x in (l, r))  # noqa: E741
        at = ["_0", "_1"]
    right_cells = staged(assigned(r, at, part, 0.0), "right-cells").where("home").drop("home")
    left_home = assigned(l, at, part, 0.0).where("home").drop("home")
    scale = 1.0 if len(dims) > 1 else 2.0  # one dimension stands twice
    first = "lpid bigint, rpid bigint, d double, bound double, " + ", ".join(f"{a} double" for a in at)

    def own(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        q = lp[at].to_numpy(float)
        pts = rp[at].to_numpy(float)
        rid = rp["rpid"].to_numpy()
        cols = ["lpid", "rpid", "d", "bound", *at]
        if not len(q):
            return pd.DataFrame(columns=cols)
        bound = np.full(len(q), np.inf)
        frames = []
        if len(pts):
            i, p, d = _nearest(VPTree(pts, METRICS["euclidean"]), q, k, None)
            order = np.lexsort((rid[p], d, i))
            i, p, d = i[order], p[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, "left")
            top = place < k
            i, p, d, place = i[top], p[top], d[top], place[top]
            full = place == k - 1
            bound[i[full]] = d[full]
            frames.append(pd.DataFrame({"lpid": lp["lpid"].to_numpy()[i], "rpid": rid[p], "d": d, "bound": np.nan, **{a: np.nan for a in at}}))
        frames.append(pd.DataFrame({"lpid": lp["lpid"].to_numpy(), "rpid": -1, "d": np.nan, "bound": bound, **{a: q[:, n] for n, a in enumerate(at)}}))
        return pd.concat(frames)[cols]

    found = staged(left_home.groupBy("cell").cogroup(right_cells.groupBy("cell")).applyInPandas(own, first), "nearest-own")
    asks = found.where("bound is not null").select("lpid", "bound", *at)
    # a bound of infinity reaches every cell
    asks = asks.withColumn("bound", F.least(F.col("bound") * (1 + 1e-9) + 1e-9, F.lit(1e15)))
    more = assigned(asks, at, part, "bound").where("not home").drop("home")

    def others(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame(columns=["lpid", "rpid", "d"])
        pts, q, limit = rp[at].to_numpy(float), lp[at].to_numpy(float), lp["bound"].to_numpy(float)
        i, p, d = _nearest(VPTree(pts, METRICS["euclidean"]), q, k, limit)
        return pd.DataFrame({"lpid": lp["lpid"].to_numpy()[i], "rpid": rp["rpid"].to_numpy()[p], "d": d})

    far = more.groupBy("cell").cogroup(right_cells.groupBy("cell")).applyInPandas(others, "lpid bigint, rpid bigint, d double")
    all_ = found.where("bound is null").select("lpid", "rpid", "d").unionByName(far)
    w = Window.partitionBy("lpid").orderBy("d", "rpid")
    out = all_.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    out = out.select("lpid", "rpid", (F.col("d") * F.col("d") / scale).alias("d2"), "place")
    out = rows.join(asked, of).select("_id", "lpid").join(out, "lpid").select(F.col("_id").alias("lpid"), "rpid", "d2", "place")
    if keep:
        out = out.join(right.select(F.col(right_id).cast("bigint").alias("rpid"), *keep), "rpid")
    return out
