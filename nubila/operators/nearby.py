"""Problem 1: points near other points, and the regions that contain them.

Voronoi partition around pivots with triangle-inequality replication, then in
each cell a vantage-point tree over its points and an exact polygon test.

The plan: rows are gathered by location (map-side combined, so a location that
a third of all rows share costs one row), each location is assigned to its cell
and the few neighbouring cells its radius reaches, regions go to the cells that
their bounding circles reach, and one cogroup joins both. Only the pairs found
are expanded to the rows that share a location.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from ..spatial.geometry import in_polygon, polygon_parts
from ..spatial.metrics import METRICS
from ..spatial.voronoi import CELL_ROWS, MAX_PIVOTS, MAX_SAMPLE, SAMPLE_PER_PIVOT, Partition
from ..spatial.vptree import VPTree

#: Members of a shared location that one join key holds.
BLOCK = 4096
HIT = "near boolean, a bigint, b bigint, a_rows bigint, b_rows bigint, a_tag bigint, b_tag bigint"


def locations(points: DataFrame, id_col: str, tag_col: str | None, dims: list[str]) -> DataFrame:
    """One row a distinct location: ``rep`` its least id, ``n`` its rows, ``tag`` of a single row."""
    tag = F.min(tag_col).cast("bigint") if tag_col else F.lit(None).cast("bigint")
    return points.groupBy(*dims).agg(F.min(id_col).cast("bigint").alias("rep"), F.count(F.lit(1)).alias("n"), tag.alias("tag"))


def fit_partition(locs: DataFrame, dims: list[str], metric: str, cell_rows: int = CELL_ROWS) -> Partition:
    """Pivots from a sample of at most MAX_SAMPLE rows (SAMPLE_PER_PIVOT a pivot), in the first two
    dimensions; distances there never exceed those in all dimensions, so the bounds hold."""
    rows = locs.count()
    want = min(MAX_SAMPLE, SAMPLE_PER_PIVOT * min(MAX_PIVOTS, max(1, -(-rows // cell_rows))) + 200)
    share = max(1, rows // want)
    sample = locs.where(F.pmod(F.xxhash64(*dims), F.lit(share)) == 0).select(*dims[:2]).limit(2 * want).toPandas()
    return Partition.fit(sample.to_numpy(dtype=float), rows, metric, cell_rows)


def assigned(rows: DataFrame, dims: list[str], part: Partition, radius) -> DataFrame:
    """``rows`` with ``cell`` and ``home``, a copy for each cell; radius: a number or a column name."""
    schema = rows.select("*", F.lit(0).cast("int").alias("cell"), F.lit(True).alias("home")).schema

    def run(batches):
        for pdf in batches:
            at, cell, home = part.assign(pdf[dims[:2]].to_numpy(dtype=float), pdf[radius].to_numpy(dtype=float) if isinstance(radius, str) else radius)
            yield pdf.iloc[at].assign(cell=cell.astype(np.int32), home=home)

    return rows.mapInPandas(run, schema)


def cell_join(pts: pd.DataFrame, regs: pd.DataFrame, dims: list[str], radius: float, metric: str) -> pd.DataFrame:
    """Hits of one cell: a pair is reported where its smaller ``rep`` is at home, a region hit where the point is."""
    rep, n, home = pts["rep"].to_numpy(), pts["n"].to_numpy(), pts["home"].to_numpy()
    tag, known = pts["tag"].fillna(-1).to_numpy(dtype=np.int64), pts["tag"].notna().to_numpy()
    xyz = pts[dims].to_numpy(dtype=float)
    own = np.flatnonzero(home)
    frames = []
    if radius > 0 and len(own):
        q, b, _ = VPTree(xyz, METRICS[metric]).within(xyz[own], radius)
        a = own[q]
        keep = rep[a] < rep[b]
        keep &= (n[a] > 1) | (n[b] > 1) | (known[a] & known[b] & (tag[a] != tag[b]))
        a, b = a[keep], b[keep]
        frames.append(pd.DataFrame({"near": True, "a": rep[a], "b": rep[b], "a_rows": n[a], "b_rows": n[b], "a_tag": pd.array(np.where(known[a], tag[a], 0), "Int64"), "b_tag": pd.array(np.where(known[b], tag[b], 0), "Int64")}))
        frames[-1].loc[~known[a], "a_tag"] = pd.NA
        frames[-1].loc[~known[b], "b_tag"] = pd.NA
    if len(regs) and len(own):
        order = own[np.argsort(xyz[own, 0], kind="stable")]
        px, py = xyz[order, 0], xyz[order, 1]
        hits: dict[int, list] = {}
        for rid, cx, r, xy, ends in zip(regs["region_id"], regs["cx"], regs["radius"], regs["xy"], regs["ends"]):
            lo, hi = np.searchsorted(px, cx - r, "left"), np.searchsorted(px, cx + r, "right")
            if hi > lo:
                at = lo + np.flatnonzero(in_polygon(px[lo:hi], py[lo:hi], xy, ends))
                if len(at):
                    hits.setdefault(rid, []).append(at)
        for rid, parts in hits.items():
            at = order[np.unique(np.concatenate(parts))]
            frames.append(pd.DataFrame({"near": False, "a": rid, "b": rep[at], "a_rows": 1, "b_rows": n[at], "a_tag": pd.array([pd.NA] * len(at), "Int64"), "b_tag": pd.array([pd.NA] * len(at), "Int64")}))
    columns = [c.split()[0] for c in HIT.split(", ")]
    return pd.concat(frames)[columns] if frames else pd.DataFrame(columns=columns)


def near_or_within(points: DataFrame, radius: float, regions: DataFrame | None = None, *, id_col: str = "pid", tag_col: str | None = "pointsourceid", dims: tuple[str, ...] = ("x", "y", "z"), metric: str = "euclidean", region_id: str = "region_id", coordinates: str = "geom_coordinates", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every pair of rows nearer than ``radius`` with different tags, and every (region, row) with the row inside.

    Result: case_kind ('near' or 'within'), id_a, id_b. With ``tag_col`` None all
    pairs count. Rows with a null id, dimension or NaN take no part; a null tag
    differs from none. Rows at one location are at distance 0. ``metric``:
    'euclidean' over all dims, or 'great_circle' over (longitude, latitude) in
    degrees with ``radius`` in metres (regions need 'euclidean'). Empty inputs
    give no rows. Other columns are not looked at.
    """
    dims = list(dims)
    p = points.select(F.col(id_col).cast("bigint").alias("id"), (F.col(tag_col).cast("bigint") if tag_col else F.col(id_col).cast("bigint")).alias("tag"), *(F.col(d).cast("double").alias(d) for d in dims)).dropna(subset=["id", *dims])
    p = p.where(" and ".join(f"not isnan(`{d}`)" for d in dims))
    locs = staged(locations(p, "id", "tag", dims), "locations")
    part = fit_partition(locs, dims, metric, cell_rows)
    cells = assigned(locs, dims, part, radius).groupBy("cell")
    if regions is None:
        hits = cells.applyInPandas(lambda pts: cell_join(pts, (), dims, radius, metric), HIT)
    else:
        parts = assigned(polygon_parts(regions, region_id, coordinates), ["cx", "cy"], part, "radius")
        hits = cells.cogroup(parts.groupBy("cell")).applyInPandas(lambda pts, regs: cell_join(pts, regs, dims, radius, metric), HIT)
    hits = staged(hits, "hits")

    single = (F.col("a_rows") == 1) & (F.col("b_rows") == 1)
    kind = F.when(F.col("near"), "near").otherwise("within").alias("case_kind")
    plain = hits.where(single).select(kind, "a", "b")
    shared = locs.where("n > 1").select(*dims, "rep", "n")
    members = staged(p.join(shared, dims).select("rep", "id", "tag", _block(F.col("id"), F.col("n")).alias("block")), "members")
    some = hits.where("near" if regions is None else "true").where(~single)
    # members come block by block, so no key holds more than BLOCK of them; a region's id in column a must not meet a location's
    for s, many in (("a", F.col("near") & (F.col("a_rows") > 1)), ("b", F.col("b_rows") > 1)):
        m = members.select(F.col("rep").alias(f"{s}_key"), F.col("block").alias(f"{s}_block"), F.col("id").alias(f"{s}_id"), F.col("tag").alias(f"{s}_of"))
        blocks = F.when(many, F.sequence(F.lit(0), _blocks(F.col(f"{s}_rows")) - 1)).otherwise(F.array(F.lit(0)))
        some = some.withColumns({f"{s}_key": F.when(many, F.col(s)), f"{s}_block": F.explode(blocks)}).join(m, [f"{s}_key", f"{s}_block"], "left")
    tag = lambda s: F.when(F.col(f"{s}_id").isNotNull(), F.col(f"{s}_of")).otherwise(F.col(f"{s}_tag"))
    some = some.where(~F.col("near") | (tag("a") != tag("b"))).select(kind, F.coalesce("a_id", "a").alias("a"), F.coalesce("b_id", "b").alias("b"))
    found = plain.unionByName(some)
    if radius > 0:
        found = found.unionByName(_at_one_place(members))
    near = F.col("case_kind") == "near"
    return found.select("case_kind", F.when(near, F.least("a", "b")).otherwise(F.col("a")).alias("id_a"), F.when(near, F.greatest("a", "b")).otherwise(F.col("b")).alias("id_b"))


def _blocks(rows):
    return F.ceil(rows / F.lit(BLOCK)).cast("int")


def _block(id_, rows):
    return F.pmod(F.xxhash64(id_), _blocks(rows)).cast("int")


def _at_one_place(members: DataFrame) -> DataFrame:
    """Pairs of members of one location with different tags: (case_kind, a, b).

    Blocks of the members of each tag are paired first, so every pair of blocks
    gives only pairs that are asked for, and no key holds more than two blocks.
    """
    m = members.where("tag is not null")
    n = m.groupBy("rep", "tag").agg(F.count(F.lit(1)).alias("of_tag"))
    m = m.join(n, ["rep", "tag"]).select("rep", "tag", "id", _block(F.col("id"), F.col("of_tag")).alias("block"))
    groups = n.select("rep", "tag", F.explode(F.sequence(F.lit(0), _blocks(F.col("of_tag")) - 1)).alias("block"))
    side = lambda d, s: d.select(*(F.col(c).alias(c if c == "rep" else f"{s}_{c}") for c in d.columns))
    pairs = side(groups, "a").join(side(groups, "b"), "rep").where("a_tag < b_tag")
    for s in "ab":
        pairs = pairs.join(side(m, s), ["rep", f"{s}_tag", f"{s}_block"])
    return pairs.select(F.lit("near").alias("case_kind"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))
