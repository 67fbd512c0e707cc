"""Ground and noise classification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import drop_view
from ..functions.expression import range_condition
from ..spatial.components import independent
from ..spatial.neighbors import radius_join
from ..spatial.tiles import dilate, erode, fill_nearest, grid_kernel
from .sample import _tile
from .select import _beside, prefixed, ranged


def _classified(df: DataFrame, value) -> DataFrame:
    t = df.schema["Classification"].dataType if "Classification" in df.columns else "int"
    return df.withColumn("Classification", value.cast(t))


def elm(df: DataFrame, cell: float = 10.0, threshold: float = 1.0, class_: int = 7) -> DataFrame:
    """Extended local minimum: in each cell, from the lowest up, rows are noise until the step to the next is below the threshold."""
    view = drop_view(df)
    d = _beside(df, df.groupBy(*view).agg(F.min("X").alias("_x"), F.min("Y").alias("_y")))
    d = d.withColumns({"_c": F.floor(F.floor(F.col("X") - F.col("_x")) / cell), "_r": F.floor(F.floor(F.col("Y") - F.col("_y")) / cell)})
    w = Window.partitionBy(*view, "_c", "_r").orderBy("Z", "pid")
    d = d.withColumn("_step", F.lead("Z").over(w) - F.col("Z"))
    # the last row of a cell ends the walk too
    d = d.withColumn("_end", (F.col("_step").isNull() | (F.col("_step") < threshold)).cast("int"))
    noise = F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0
    return _classified(d, F.when(noise, F.lit(class_)).otherwise(F.col("Classification"))).drop("_x", "_y", "_c", "_r", "_step", "_end")


def skewnessbalancing(df: DataFrame, ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Rows below the last height at which the skewness of all lower heights turns positive are ground.

    Skewness of the rows so far comes from sums of powers: within ranges of
    heights, then the ranges' totals; the row before is the same sums less the row.
    """
    mean = df.agg(F.avg("Z").alias("_m"))
    d = df.crossJoin(F.broadcast(mean)).select("pid", "Z", (F.col("Z") - F.col("_m")).alias("v"))  # one row
    r = ranged(d, "Z", "pid")
    powers = {"n": F.lit(1.0), "s1": F.col("v"), "s2": F.col("v") ** 2, "s3": F.col("v") ** 3}
    w = Window.partitionBy("_part").orderBy("Z", "pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = r.withColumns({f"c_{k}": F.sum(v).over(w) for k, v in powers.items()})
    t = prefixed(r, [], {f"b_{k}": F.sum(v) for k, v in powers.items()})
    run = run.join(F.broadcast(t), "_part").withColumns({k: F.col(f"c_{k}") + F.col(f"b_{k}") for k in powers})

    def skew(n, s1, s2, s3):
        m = s1 / n
        m2, m3 = s2 - n * m * m, s3 - 3 * m * s2 + 2 * n * m * m * m
        return F.when((n > 1) & (m2 > 1e-12), F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5)))

    now = skew(*(F.col(k) for k in powers))
    before = F.when(F.col("n") > 1, skew(*(F.when(F.col("n") > 1, F.col(k) - v) for k, v in powers.items())))
    run = run.select("Z", "pid", "n", now.alias("now"), ((now > 0) & (before <= 0)).alias("turn"))
    one = run.agg(F.max(F.when(F.col("turn"), F.struct("Z", "pid"))).alias("_at"), F.max_by("now", "n").alias("_last"))
    d = df.crossJoin(F.broadcast(one))  # one row
    below = F.struct("Z", "pid") < F.col("_at")
    ground = F.when(F.col("_at").isNotNull(), below).otherwise(F.coalesce(F.col("_last") <= 0, F.lit(False)))
    other = F.col("Classification") if only_ground else F.lit(other_class)
    return _classified(d, F.when(ground, F.lit(ground_class)).otherwise(other)).drop("_at", "_last")


def sparsesurface(df: DataFrame, radius: float = 1.0, ground_class: int = 2, low_point_class: int = 7) -> DataFrame:
    """From the lowest up: a row not yet labelled is ground, and what is within the radius in the plane is a low point."""
    d = df.select("pid", "X", "Y", "Z")
    links = radius_join(d, d, radius, ["X", "Y"]).where("lpid < rpid").select(F.col("lpid").alias("a"), F.col("rpid").alias("b"))
    kept = independent(d.select(F.col("pid").alias("id"), F.struct("Z", "pid").alias("rank"), _tile(radius)), links)
    j = df.join(kept.withColumnRenamed("id", "pid"), "pid")
    return _classified(j, F.when(F.col("kept"), F.lit(ground_class)).otherwise(F.lit(low_point_class))).drop("kept")


def _considered(df: DataFrame, ignore: str | None, returns: tuple[str, ...]):
    """The rows a ground filter looks at: not ignored, and of the returns wanted where return numbers are set."""
    cond = F.lit(True)
    if ignore:
        cond = ~range_condition(ignore, any_of=True)
    if returns and {"ReturnNumber", "NumberOfReturns"} <= set(df.columns):
        r, n = F.col("ReturnNumber"), F.col("NumberOfReturns")
        kinds = {"first": (r == 1) & (n > 1), "last": (r == n) & (n > 1), "only": n == 1, "intermediate": (r > 1) & (r < n)}
        wanted = F.lit(False)
        for k in returns:
            wanted = wanted | kinds[k]
        cond = cond & (wanted | ((r == 0) & (n == 0)))
    return cond


def _bounds(df: DataFrame, cell: float) -> tuple[float, float, int, int] | None:
    b = df.agg(F.min("X"), F.min("Y"), F.max("X"), F.max("Y")).first()
    if b[0] is None:
        return None
    return b[0], b[1], int((b[2] - b[0]) / cell + 1), int((b[3] - b[1]) / cell + 1)


def _cells(df: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    return df.withColumns({"c": F.floor((F.col("X") - x0) / cell), "r": F.floor((F.col("Y") - y0) / cell)})


def pmf(df: DataFrame, cell_size: float = 1.0, exponential: bool = True, initial_distance: float = 0.15, max_distance: float = 2.5, max_window_size: float = 33.0, slope: float = 1.0, ignore: str | None = None, returns: tuple[str, ...] = ("last", "only"), ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Progressive morphological filter: a row is ground if it stays below each opening plus its height threshold."""
    looked = _considered(df, ignore, returns)
    src = df.where(looked)
    b = _bounds(src, cell_size)
    if b is None:
        return df
    x0, y0, cols, rows = b
    windows, heights = [], []
    while not windows or windows[-1] < max_window_size:
        k = len(windows)
        windows.append(cell_size * (2.0 * 2**k + 1) if exponential else cell_size * (4.0 * (k + 1) + 1))
        heights.append(min(max_distance, initial_distance if k == 0 else slope * (windows[k] - windows[k - 1]) * cell_size + initial_distance))
    steps = [int(0.5 * (w - 1)) for w in windows]
    # the grid takes whole-metre offsets, the test exact ones
    low = src.select(F.floor(F.floor(F.col("X") - x0) / cell_size).alias("c"), F.floor(F.floor(F.col("Y") - y0) / cell_size).alias("r"), "Z").groupBy("c", "r").agg(F.min("Z").alias("z"))

    def kernel(z, _):
        z = fill_nearest(z)
        out = []
        for n in steps:
            z = dilate(erode(z, n), n)
            out.append(z)
        return {"opens": np.stack(out, axis=2)}

    halo = 2 * sum(steps) + 4
    surf = grid_kernel(low, kernel, ["opens"], halo, cols, rows)
    d = _cells(df.withColumn("_looked", looked), x0, y0, cell_size).join(surf, ["c", "r"], "left")
    ok = F.forall(F.zip_with("opens", F.array(*(F.lit(h) for h in heights)), lambda s, h: F.col("Z") - s < h), lambda x: x)
    other = F.col("Classification") if only_ground else F.lit(other_class)
    return _classified(d, F.when(~F.col("_looked"), F.col("Classification")).when(F.coalesce(ok, F.lit(False)), F.lit(ground_class)).otherwise(other)).drop("c", "r", "opens", "_looked")


def _progressive(z: np.ndarray, slope: float, window: float, cell: float) -> np.ndarray:
    before, eroded, obj = z, z, np.zeros(z.shape, dtype=bool)
    for radius in range(1, math.ceil(window / cell) + 1):
        eroded = erode(eroded, 1)
        opening = dilate(eroded, radius)
        obj |= np.abs(before - opening) > slope * cell * radius
        before = opening
    return obj


def smrf(df: DataFrame, cell: float = 1.0, slope: float = 0.15, scalar: float = 1.25, threshold: float = 0.5, window: float = 18.0, cut: float = 0.0, ignore: str | None = None, returns: tuple[str, ...] = ("last", "only"), ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Simple morphological filter: lowest rows a cell, low outliers and objects masked by growing openings, the holes
    filled by the mean of 8 cells; a row is ground within threshold + scalar * slope of that surface."""
    looked = _considered(df, ignore, returns)
    src = df.where(looked)
    b = _bounds(src, cell)
    if b is None:
        return df
    x0, y0, cols, rows = b
    low = _cells(src, x0, y0, cell).groupBy("c", "r").agg(F.min("Z").alias("z"))
    v = math.ceil(cut / cell) if cut > 0 else 0

    def kernel(z, origin):
        z = fill_nearest(z, 8)
        lows = _progressive(-z, 5.0, cell, cell)
        net = np.zeros(z.shape, dtype=bool)
        surface = z
        if v:
            net[(np.arange(z.shape[0]) + origin[0]) % v == 0] = True
            net[:, (np.arange(z.shape[1]) + origin[1]) % v == 0] = True
            surface = np.where(net, dilate(erode(z, 2 * v), 2 * v), z)
        obj = _progressive(surface, slope, window, cell)
        dem = fill_nearest(np.where(obj | lows | net, np.nan, z), 8)
        g = dem / cell
        gx = np.gradient(g, axis=0) if g.shape[0] > 1 else np.zeros_like(g)
        gy = np.gradient(g, axis=1) if g.shape[1] > 1 else np.zeros_like(g)
        return {"dem": dem, "steep": np.sqrt(gx * gx + gy * gy)}

    halo = 2 * math.ceil(window / cell) + 4 * v + 16
    surf = grid_kernel(low, kernel, ["dem", "steep"], halo, cols, rows)
    d = _cells(df.withColumn("_looked", looked), x0, y0, cell).join(surf, ["c", "r"], "left")
    ground = F.abs(F.col("dem") - F.col("Z")) <= threshold + scalar * F.col("steep")
    other = F.col("Classification") if only_ground else F.lit(other_class)
    return _classified(d, F.when(~F.col("_looked"), F.col("Classification")).when(F.coalesce(ground, F.lit(False)), F.lit(ground_class)).otherwise(other)).drop("c", "r", "dem", "steep", "_looked")


def csf(df: DataFrame, resolution: float = 1.0, step: float = 0.65, threshold: float = 0.5, rigidness: int = 3, iterations: int = 500, ignore: str | None = None, returns: tuple[str, ...] = ("last", "only"), ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Cloth simulation: a cloth falls on the inverted cloud; rows nearer than the threshold to it are ground.

    Cloth and terrain are grids in tiles with a halo of 32 cells, all from one height; a tile stops when its own
    cloth rests. What a cell feels of the cloth fades with the distance, so this comes near the untiled cloth but is not the same.
    """
    looked = _considered(df, ignore, returns)
    src = df.where(looked)
    b = _bounds(src, resolution)
    if b is None:
        return df
    x0, y0, cols, rows = b
    low = _cells(src, x0, y0, resolution).groupBy("c", "r").agg(F.min("Z").alias("z"))
    gravity = 0.2 * step * step
    # Of their difference a movable particle beside a fixed one closes 1 - 0.7^n, of two movable ones each 0.5 (1 - 0.4^n).
    beside, share = 1 - 0.7**rigidness, (1 - 0.4**rigidness) / 2
    top = -low.agg(F.min("z")).first()[0] + 0.05  # all tiles start at one height

    def kernel(z, _):
        ground = -fill_nearest(z)  # inverted: the cloth falls from above onto it
        y = np.full(ground.shape, top)
        old, fixed = y.copy(), np.zeros(y.shape, dtype=bool)
        for _ in range(iterations):
            new = np.where(fixed, y, y + (y - old) * (1 - 0.01) - gravity)
            old, y = y, new
            for axis in (0, 1):
                for start in (0, 1):
                    a = [slice(None)] * 2
                    c = [slice(None)] * 2
                    m = (y.shape[axis] - start) // 2 * 2
                    a[axis], c[axis] = slice(start, start + m, 2), slice(start + 1, start + m, 2)
                    a, c = tuple(a), tuple(c)
                    diff = y[c] - y[a]
                    fa, fc = fixed[a], fixed[c]
                    y[a] += np.where(fa, 0, np.where(fc, beside, share)) * diff
                    y[c] -= np.where(fc, 0, np.where(fa, beside, share)) * diff
            hit = y < ground
            y = np.where(hit, ground, y)
            fixed |= hit
            if np.abs(y - old)[~fixed].max(initial=0.0) < 0.005:
                break
        return {"cloth": -y}

    surf = grid_kernel(low, kernel, ["cloth"], 32, cols, rows)
    d = _cells(df.withColumn("_looked", looked), x0, y0, resolution).join(surf, ["c", "r"], "left")
    ground = F.abs(F.col("Z") - F.col("cloth")) < threshold
    other = F.col("Classification") if only_ground else F.lit(other_class)
    return _classified(d, F.when(~F.col("_looked"), F.col("Classification")).when(F.coalesce(ground, F.lit(False)), F.lit(ground_class)).otherwise(other)).drop("c", "r", "cloth", "_looked")


def _tiled(df: DataFrame, length: float, halo: float):
    """Each row with its tile and, at home false, the tiles whose halo it is in."""
    span = lambda a: F.sequence(F.floor((F.col(a) - halo) / length), F.floor((F.col(a) + halo) / length))
    d = df.withColumn("_tx", F.explode(span("X"))).withColumn("_ty", F.explode(span("Y")))
    return d.withColumn("_home", (F.floor(F.col("X") / length) == F.col("_tx")) & (F.floor(F.col("Y") / length) == F.col("_ty")))


def litree(df: DataFrame, min_points: int = 10, min_height: float = 3.0, cutoff: float = 10.0, tile: float = 200.0) -> DataFrame:
    """ClusterID of single trees: from the highest row down, rows go to the tree or away from it by the nearer of both sets.

    Needs HeightAboveGround. Sequential by nature, so it runs in square tiles
    with a halo of 2 * ``cutoff``; a tree belongs to the tile of its top, and an id
    is that top's ``pid``. Rows of no tree are 0.
    """
    d = _tiled(df.select("pid", "X", "Y", "HeightAboveGround"), tile, 2 * cutoff)

    def run(key, pdf):
        pdf = pdf.sort_values(["HeightAboveGround", "pid"], ascending=[False, True]).reset_index(drop=True)
        xy, h, pid, home = pdf[["X", "Y"]].to_numpy(), pdf["HeightAboveGround"].to_numpy(), pdf["pid"].to_numpy(), pdf["_home"].to_numpy()
        top = np.array([not (h[((xy - p) ** 2).sum(axis=1) < 4.0] > z).any() for p, z in zip(xy, h)], dtype=bool)
        left, out = np.ones(len(h), dtype=bool), []
        while left.any():
            t0 = int(np.flatnonzero(left)[0])
            if h[t0] < min_height:
                break
            tree, away = [t0], []
            d_tree, d_away = ((xy - xy[t0]) ** 2).sum(axis=1) ** 0.5, np.full(len(h), np.inf)
            reach = d_tree <= cutoff
            for i in np.flatnonzero(left & reach)[1:]:
                near = d_tree[i] <= d_away[i]
                if top[i]:
                    near = near and d_tree[i] <= (1.5 if h[i] <= 15 else 2.0)
                dist = ((xy - xy[i]) ** 2).sum(axis=1) ** 0.5
                if near:
                    tree.append(i)
                    d_tree = np.minimum(d_tree, dist)
                else:
                    away.append(i)
                    d_away = np.minimum(d_away, dist)
            left[tree] = False
            if len(tree) >= min_points and home[t0]:
                out += [(int(pid[i]), int(pid[t0])) for i in tree]
        return pd.DataFrame(out, columns=["pid", "ClusterID"])

    c = d.groupBy("_tx", "_ty").applyInPandas(run, "pid bigint, ClusterID bigint").groupBy("pid").agg(F.min("ClusterID").alias("ClusterID"))
    return df.drop("ClusterID").join(c, "pid", "left").fillna(0, ["ClusterID"])


def supervoxel(df: DataFrame, knn: int = 32, resolution: float = 1.0) -> DataFrame:
    """ClusterID of supervoxels: seeds are the rows nearest the voxel centres; rows go to the seed of least distance in space
    and in normal (both scaled), among the seeds within two voxels. Needs NormalX, NormalY, NormalZ. Ids are the seeds' pids."""
    from .sample import voxelcenternearestneighbor

    cols = ["pid", "X", "Y", "Z", "NormalX", "NormalY", "NormalZ"]
    seeds = voxelcenternearestneighbor(df.select(*cols), resolution)
    s = seeds.select("pid", "X", "Y", "Z", *(F.col(f"Normal{a}").alias(f"_s{a}") for a in "XYZ"))
    j = radius_join(df, s, 2 * resolution, ["X", "Y", "Z"], keep=("_sX", "_sY", "_sZ")).join(df.select(F.col("pid").alias("lpid"), *(F.col(f"Normal{a}").alias(f"_n{a}") for a in "XYZ")), "lpid")
    dot = sum((F.col(f"_s{a}") * F.col(f"_n{a}") for a in "XYZ"), F.lit(0.0))
    metric = 1 - F.abs(dot) + F.sqrt("d2") / resolution * 0.4
    best = j.groupBy(F.col("lpid").alias("pid")).agg(F.min_by("rpid", F.struct(metric.alias("m"), "rpid")).alias("ClusterID"))
    return df.drop("ClusterID").join(best, "pid", "left").withColumn("ClusterID", F.coalesce("ClusterID", "pid"))
