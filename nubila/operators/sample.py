"""Sampling, duplicates, and the best row of each cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import drop_view
from ..functions.expression import assignment
from ..session import discard, staged
from ..spatial.components import independent
from ..spatial.neighbors import places, radius_join
from .assign import _type
from .select import _beside, ranged


def _first(df: DataFrame, **cols: Column) -> DataFrame:
    """``cols`` of the first row (of each view), beside every row."""
    one = df.groupBy(*drop_view(df)).agg(*(F.min_by(c, "pid").alias(n) for n, c in cols.items()))
    return _beside(df, one)


def best_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row in ``order`` of each group: one aggregation, combined before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("_b"))
    return g.select(*keys, "_b.*").select(*df.columns)


def _tile(radius: float) -> Column:
    """Squares of 32 radii, for what is decided together."""
    return F.array(F.floor(F.col("X") / (32 * radius)), F.floor(F.col("Y") / (32 * radius))).alias("tile")


def sample(df: DataFrame, radius: float | None = None, cell: float | None = None, dimension: str | None = None) -> DataFrame:
    """Poisson thinning: a row stays unless an earlier row that stays is nearer than ``radius`` (cell * sqrt(3) / 2).

    ``dimension``: mark 1 and 0 instead of dropping.
    """
    if (radius is None) == (cell is None):
        raise ValueError("give a radius or a cell")
    r = radius if radius is not None else cell * math.sqrt(3) / 2
    d = places(df, ["X", "Y", "Z"])  # of rows at one location only the first can stay
    links = radius_join(d, d, r, ["X", "Y", "Z"]).where("lpid < rpid").select(F.col("lpid").alias("a"), F.col("rpid").alias("b"))
    kept = independent(d.select(F.col("pid").alias("id"), F.col("pid").alias("rank"), _tile(r)), links).withColumnRenamed("id", "pid")
    if dimension:
        return df.drop(dimension).join(kept, "pid", "left").withColumn(dimension, F.coalesce("kept", F.lit(False)).cast("int")).drop("kept")
    return df.join(kept.where("kept").select("pid"), "pid", "left_semi")


def voxeldownsize(df: DataFrame, cell: float = 0.001, mode: str = "center") -> DataFrame:
    """The first row of each voxel (from the first row's position less half a cell); 'center' moves it to the voxel's centre."""
    d = _first(df, **{f"_o{a}": F.col(a) - cell / 2 for a in "XYZ"})
    d = d.withColumns({f"_v{a}": F.floor((F.col(a) - F.col(f"_o{a}")) / cell) for a in "XYZ"})
    d = best_of(d, [*drop_view(df), "_vX", "_vY", "_vZ"], F.col("pid"))
    if mode == "center":
        d = d.withColumns({a: (F.col(f"_v{a}") + 0.5) * cell + F.col(f"_o{a}") for a in "XYZ"})
    elif mode != "first":
        raise ValueError("mode is center or first")
    return d.select(*df.columns)


def voxelcenternearestneighbor(df: DataFrame, cell: float = 1.0) -> DataFrame:
    """Of each voxel (from the least coordinates) the row nearest its centre, the first of ties."""
    one = df.groupBy(*drop_view(df)).agg(*(F.min(a).alias(f"_o{a}") for a in "XYZ"))
    d = _beside(df, one).withColumns({f"_v{a}": F.floor((F.col(a) - F.col(f"_o{a}")) / cell) for a in "XYZ"})
    off = [F.col(a) - (F.col(f"_o{a}") + (F.col(f"_v{a}") + 0.5) * cell) for a in "XYZ"]
    d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    return best_of(d.withColumn("_d", d2), [*drop_view(df), "_vX", "_vY", "_vZ"], F.col("_d"), F.col("pid")).select(*df.columns)


def voxelcentroidnearestneighbor(df: DataFrame, cell: float = 1.0) -> DataFrame:
    """Of each voxel (from the first row): of one row it, of two the one nearer the voxel's centre (tie: the second), of more the one nearest their mean."""
    keys = [*drop_view(df), "_vX", "_vY", "_vZ"]
    d = _first(df, **{f"_o{a}": F.col(a) for a in "XYZ"})
    d = d.withColumns({f"_v{a}": F.floor((F.col(a) - F.col(f"_o{a}")) / cell) for a in "XYZ"})
    m = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(a).alias(f"_m{a}") for a in "XYZ"))
    d = d.join(m, keys)
    off = [F.col(a) - F.when(F.col("_n") > 2, F.col(f"_m{a}")).otherwise(F.col(f"_o{a}") + (F.col(f"_v{a}") + 0.5) * cell) for a in "XYZ"]
    d = d.withColumn("_d", off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    tie = F.when(F.col("_n") == 2, -F.col("pid")).otherwise(F.col("pid"))
    return best_of(d.withColumn("_t", tie), keys, F.col("_d"), F.col("_t")).select(*df.columns)


def griddecimation(df: DataFrame, resolution: float = 1.0, output_type: str = "max", *values: str) -> DataFrame:
    """Apply assignments to the row of greatest or least Z of each XY cell (from the least X, Y), the first of ties; no row is dropped."""
    one = df.groupBy(*drop_view(df)).agg(F.min("X").alias("_ox"), F.min("Y").alias("_oy"))
    d = _beside(df, one).withColumns({"_i": F.floor((F.col("X") - F.col("_ox")) / resolution), "_j": F.floor((F.col("Y") - F.col("_oy")) / resolution)})
    z = -F.col("Z") if output_type == "max" else F.col("Z")
    top = d.groupBy(*drop_view(df), "_i", "_j").agg(F.min(F.struct(z.alias("z"), "pid")).alias("_t")).select(F.col("_t.pid").alias("pid"), F.lit(True).alias("_top"))
    d = d.drop("_i", "_j", "_ox", "_oy").join(top, "pid", "left")
    for text in values:
        from ..functions.dims import coerce

        name, value, where = assignment(text, df.columns)
        hit = F.col("_top").isNotNull() if where is None else F.col("_top").isNotNull() & where
        d = d.withColumn(name, F.when(hit, coerce(value, _type(df, name))).otherwise(F.col(name) if name in d.columns else F.lit(0.0)))
    return d.drop("_top")


def fps(df: DataFrame, count: int = 1000) -> DataFrame:
    """Farthest point sampling from the first row: each next row is the farthest from those taken (ties: the first).

    One row a round, each one aggregation over staged rows; distances are staged
    with them now and then. The input is returned where it has fewer rows.
    """
    d = staged(df.select("pid", "X", "Y", "Z"), "fps")
    n = d.count()
    if n <= count:
        return df
    taken = [d.orderBy("pid").first()]
    block = 32
    dist = F.lit(math.inf)
    while len(taken) < count:
        p = taken[-1]
        step = sum(((F.col(a) - float(p[a])) * (F.col(a) - float(p[a])) for a in "XYZ"), F.lit(0.0))
        dist = F.least(dist, step)
        best = d.select(F.max_by(F.struct("pid", "X", "Y", "Z"), F.struct(dist.alias("d"), (-F.col("pid")).alias("p"))).alias("b")).first()["b"]
        taken.append(best)
        if len(taken) % block == 0:
            d = staged(d.withColumn("_d", dist), "fps")
            dist = F.col("_d")
    ids = [int(p["pid"]) for p in taken]
    order = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "pid bigint, _k bigint")
    return df.join(F.broadcast(order), "pid").drop("_k")


#: Rows that come to the driver to be decided at once; taken rows up to which a task holds all of them.
DARTS, HELD = 20_000, 100_000


def _near(taken: DataFrame, radius: float) -> DataFrame:
    """(_cX, _cY, _cZ, _qX, _qY, _qZ, _qid): taken rows in each cell of 2.5 radii that their ball can reach, at most eight."""
    for a in "XYZ":
        edge = F.lit(radius * (1 + 1e-6)) + F.abs(a) * 1e-12  # beyond what rounding can move
        cell = lambda x: F.floor(x / (2.5 * radius))
        taken = taken.withColumn(f"_c{a}", F.explode(F.sequence(cell(F.col(a) - edge), cell(F.col(a) + edge))))
    return taken.select("_cX", "_cY", "_cZ", *(F.col(a).alias(f"_q{a}") for a in "XYZ"), F.col("pid").alias("_qid"))


def _clear(d: DataFrame, taken: list[pd.DataFrame], radius: float) -> DataFrame:
    """Rows of ``d`` that are not taken and that no taken row (pid, X, Y, Z) is nearer to than ``radius``."""
    all_ = pd.concat(taken)
    near = _near(d.sparkSession.createDataFrame(all_, "pid bigint, X double, Y double, Z double"), radius)
    rows = d.withColumns({f"_c{a}": F.floor(F.col(a) / (2.5 * radius)) for a in "XYZ"})
    off = [F.col(a) - F.col(f"_q{a}") for a in "XYZ"]
    hit = ((off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) < float(radius) ** 2) | (F.col("pid") == F.col("_qid"))
    for a in "XYZ":
        hit = hit & (rows[f"_c{a}"] == near[f"_c{a}"])
    return rows.join(F.broadcast(near) if len(all_) <= HELD else near, hit, "left_anti").select(*d.columns)


def _darts(xyz: np.ndarray, radius: float, most: int) -> list[int]:
    """Rows taken one after the other, each unless one before is nearer than ``radius``; at most ``most``."""
    free, out = np.ones(len(xyz), dtype=bool), []
    for i in range(len(xyz)):
        if free[i]:
            out.append(i)
            if len(out) == most:
                break
            off = xyz[i:] - xyz[i]
            free[i:] &= ~(off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2] < float(radius) ** 2)
    return out


def relaxationdartthrowing(df: DataFrame, count: int = 1000, radius: float = 1.0, decay: float = 0.9, terminal_radius: float = 0.001, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Greedy disk sampling in a shuffled order; the radius shrinks by ``decay`` until ``count`` rows are taken.

    What is taken stays taken. The first rows in order that are clear of all taken ones are decided
    together, then the others are tried against what is new, so no rows are paired with each other.
    The input is returned where it has fewer rows.
    """
    rank = F.xxhash64("pid", F.lit(seed)) if shuffle else F.col("pid").cast("bigint")
    at = (F.coalesce(F.col(a).cast("double"), F.lit(math.nan)).alias(a) for a in "XYZ")
    d = staged(df.select(F.col("pid").cast("bigint").alias("pid"), *at, rank.alias("_r")), "darts")
    rows = d.count()
    if rows < count:
        discard(d)
        return df
    taken, n, r = [], 0, float(radius)
    while n < count and r >= terminal_radius:
        clear = staged(_clear(d, taken, r), "clear") if taken else d
        left = rows if clear is d else clear.count()
        while left and n < count:
            some = clear
            if left > DARTS:
                last = clear.agg(F.percentile_approx("_r", DARTS / left, 10_000)).first()[0]
                some = clear.where(F.col("_r") <= last)
            t = some.select("_r", "pid", *"XYZ").toArrow().to_pandas().sort_values(["_r", "pid"])
            taken.append(t.iloc[_darts(t[list("XYZ")].to_numpy(float), r, count - n)].drop(columns="_r"))
            n += len(taken[-1])
            if left <= DARTS or n >= count:
                break
            rest = staged(_clear(clear.where(F.col("_r") > last), taken[-1:], r), "clear")
            left = rest.count()
            if clear is not d:
                discard(clear)
            clear = rest
        if clear is not d:
            discard(clear)
        r *= decay
    discard(d)
    if not n:
        return df.limit(0)
    first = df.sparkSession.createDataFrame(pd.concat(taken)[["pid"]], "pid bigint")
    return df.join(F.broadcast(first) if n <= HELD else first, "pid", "left_semi")


def label_duplicates(df: DataFrame, *dimensions: str) -> DataFrame:
    """Duplicate = 1 where all dimensions equal those of the row before it in order."""

    view = drop_view(df)
    r = ranged(df, "pid")
    key = F.struct(*dimensions)
    w = Window.partitionBy(*view, "_part").orderBy("pid")
    r = r.withColumn("_prev", F.lag(key).over(w))
    last = r.groupBy(*view, "_part").agg(F.max_by(key, "pid").alias("_k"))
    last = last.select(*view, "_part", F.lag("_k").over(Window.partitionBy(*view).orderBy("_part")).alias("_carry"))  # one row a partition
    j = r.join(F.broadcast(last), [*view, "_part"])
    same = F.coalesce(F.coalesce("_prev", "_carry") == key, F.lit(False))
    return j.withColumn("Duplicate", same.cast("int")).drop("_part", "_prev", "_carry")
