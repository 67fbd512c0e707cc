"""One view to many, many to one."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import drop_view, rounded
from ..functions.expression import condition
from ..session import staged
from .select import positions, prefixed, ranged


def groupby(df: DataFrame, dimension: str) -> DataFrame:
    """A view a value (rounded to a whole number), in ascending order of values."""
    d = df.withColumn("_key", rounded(F.col(dimension).cast("double")).cast("bigint"))
    keys = d.select("_key").distinct()
    ids = keys.withColumn("view_id", F.row_number().over(Window.orderBy("_key")) - 1)  # one row a value
    return d.drop("view_id").join(ids, "_key").drop("_key")


def divider(df: DataFrame, mode: str = "partition", count: int | None = None, capacity: int | None = None, expression: str | None = None) -> DataFrame:
    """Views of contiguous rows ('partition'), of every n-th ('round_robin'), or from each row where ``expression`` holds.

    ``count`` views (2 to 1000) of equal size, or ``capacity`` rows each.
    """
    if expression:
        d = running_sum(df.withColumn("_new", condition(expression, df.columns).cast("bigint")), "_new")
        first = d.groupBy().agg(F.min_by("_new", "pid").alias("_f"))
        # a first row that fits opens the first view, not a second
        return d.crossJoin(F.broadcast(first)).withColumn("view_id", F.col("_sum") - F.col("_f")).drop("_new", "_sum", "_f")
    if (count is None) == (capacity is None) or count is not None and not 2 <= count <= 1000:
        raise ValueError("give a count from 2 to 1000 or a capacity")
    n = df.count()
    size = math.ceil(n / count) if count else capacity
    views = count or math.ceil(n / capacity)
    p = positions(df.drop("view_id"))
    return p.withColumn("view_id", F.floor(F.col("pos") / max(1, size)) if mode == "partition" else F.col("pos") % max(1, views)).drop("pos")


def running_sum(df: DataFrame, column: str, name: str = "_sum", before: bool = False) -> DataFrame:
    """Sum of ``column`` over the rows up to each (``before``: without it) in pid order, ranges first, then their totals."""
    view = drop_view(df)
    r = ranged(df, "pid")
    before_ = prefixed(r, view, {"_before": F.sum(column)})
    w = Window.partitionBy(*view, "_part").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col(name) + F.col("_before") - (F.col(column) if before else F.lit(0))
    return r.withColumn(name, F.sum(column).over(w)).join(F.broadcast(before_), [*view, "_part"]).withColumn(name, total).drop("_part", "_before")


def splitter(df: DataFrame, length: float = 1000.0, origin_x: float | None = None, origin_y: float | None = None, buffer: float = 0.0) -> DataFrame:
    """Square tiles ``tile_x``, ``tile_y``; with ``buffer`` a row is also in the tiles whose border is nearer than it.

    The origin is the first row where none is given. A tile number is the whole
    part of the quotient, one less for negative distances.
    """
    if origin_x is None or origin_y is None:
        first = df.groupBy().agg(F.min_by("X", "pid").alias("_ox"), F.min_by("Y", "pid").alias("_oy"))
        d = df.crossJoin(F.broadcast(first))  # one row
        ox, oy = (F.col("_ox") if origin_x is None else F.lit(float(origin_x))), (F.col("_oy") if origin_y is None else F.lit(float(origin_y)))
    else:
        d, ox, oy = df, F.lit(float(origin_x)), F.lit(float(origin_y))
    tile = lambda v: (F.when(v < 0, F.ceil(v / length) - 1).otherwise(F.floor(v / length))).cast("int")
    d = d.withColumns({"_dx": F.col("X") - ox, "_dy": F.col("Y") - oy})
    d = d.withColumns({"tile_x": tile(F.col("_dx")), "tile_y": tile(F.col("_dy"))})
    if buffer:
        side = lambda v, t: F.when(v - t * length < buffer, -1).when((t + 1) * length - v < buffer, 1).otherwise(0)
        d = d.withColumns({"_sx": side(F.col("_dx"), F.col("tile_x")), "_sy": side(F.col("_dy"), F.col("tile_y"))})
        at = lambda sx, sy: F.struct((F.col("tile_x") + sx).alias("x"), (F.col("tile_y") + sy).alias("y"))
        sx, sy = F.col("_sx"), F.col("_sy")
        to = F.array_compact(F.array(at(F.lit(0), F.lit(0)), F.when(sx != 0, at(sx, F.lit(0))), F.when(sy != 0, at(F.lit(0), sy)), F.when((sx != 0) & (sy != 0), at(sx, sy))))
        d = d.withColumn("_to", F.explode(to)).withColumns({"tile_x": F.col("_to.x"), "tile_y": F.col("_to.y")}).drop("_to", "_sx", "_sy")
    return d.drop("_dx", "_dy", "_ox", "_oy")


#: Rows that one task of ``chipper`` splits to the end; bins counted, and rows that come to the driver, for the cuts of a round.
TASK_ROWS, BINS, CUT_ROWS = 200_000, 65_536, 100_000


def chip_ends(n: int, capacity: int) -> np.ndarray:
    """Rows before each view, and all: as few views as ``capacity`` allows, of sizes that differ by one at most."""
    views = -(-n // capacity)
    return np.concatenate(([0], np.floor(np.cumsum(np.full(views, n / max(1, views))) + 0.5))).astype(np.int64)


def _cuts(d: DataFrame, asks: dict[int, dict]) -> dict[int, tuple[float, int]]:
    """Of each box asked for, (value, pid) of the ``k``-th row (from 0) along ``axis`` in order of (value, pid).

    The rows in question are counted in bins until few enough are left to be looked at: bins of
    the value between its bounds there, then, where one value has too many rows, of pid.
    """
    spark, bins, few = d.sparkSession, max(2, BINS // len(asks)), max(1, CUT_ROWS // len(asks))

    def asked(which: list[int]) -> DataFrame:
        rows = [(b, q["axis"] == "X", q["by_pid"], *q["v"], *q["p"], max(q["v"][1] / 2 - q["v"][0] / 2, 5e-324), q["p"][1] - q["p"][0]) for b in which for q in [asks[b]]]
        t = spark.createDataFrame(rows, "_box bigint, _x boolean, _by_pid boolean, _v0 double, _v1 double, _p0 bigint, _p1 bigint, _vw double, _pw bigint")
        j = d.join(F.broadcast(t), "_box").withColumn("_v", F.when(F.col("_x"), F.col("X")).otherwise(F.col("Y")))
        return j.where("_v between _v0 and _v1 and pid between _p0 and _p1")

    while many := [b for b, q in asks.items() if q["n"] > few]:
        part = F.when(F.col("_by_pid"), (F.col("pid") - F.col("_p0")) / F.col("_pw")).otherwise((F.col("_v") / 2 - F.col("_v0") / 2) / F.col("_vw"))
        g = asked(many).groupBy("_box", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("_bin"))
        rows = g.agg(F.count(F.lit(1)).alias("n"), F.min("_v"), F.max("_v"), F.min("pid"), F.max("pid")).collect()
        for b, _, n, v0, v1, p0, p1 in sorted(rows, key=lambda r: (r[0], r[1])):
            q = asks[b]
            if q.get("found") is None and q["k"] < n:
                q["found"] = {"n": n, "v": (v0, v1), "p": (p0, p1), "by_pid": v0 == v1}
            elif q.get("found") is None:
                q["k"] -= n
        for b in many:
            asks[b].update(asks[b].pop("found"))
    t = asked(list(asks)).select("_box", "_v", "pid").toArrow()
    box, v, pid = (t[c].to_numpy() for c in ("_box", "_v", "pid"))
    order = np.lexsort((pid, v, box))
    at = {b: order[np.searchsorted(box, b, sorter=order) + q["k"]] for b, q in asks.items()}
    return {b: (float(v[i]), int(pid[i])) for b, i in at.items()}


def chipper(df: DataFrame, capacity: int = 5000) -> DataFrame:
    """Views of about equal size, at most ``capacity`` rows: boxes split at a row of the longer side, ties by pid, until each is a view.

    A round cuts all boxes that no task could hold, at exact rows (``_cuts``): a few aggregations,
    in which nothing but counts moves. A task splits a box of at most ``TASK_ROWS`` rows to the end.
    """
    most = sys.float_info.max
    at = lambda c: F.greatest(F.lit(-most), F.least(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(most)), F.lit(most)), F.lit(most))).alias(c)
    spark = df.sparkSession
    chips = staged(df.select(F.col("pid").cast("bigint").alias("pid"), at("X"), at("Y")), "chips")
    ends = chip_ends(chips.count(), capacity)
    d = chips.withColumn("_box", F.lit(0).cast("bigint"))
    # a box by its first view: the view behind its last, and the side that was split before
    boxes = {0: (len(ends) - 1, "X")}
    while large := {b: e for b, (e, _) in boxes.items() if e - b > 1 and ends[e] - ends[b] > TASK_ROWS}:
        asks = {}
        for b, n, x0, x1, y0, y1, p0, p1 in d.groupBy("_box").agg(F.count(F.lit(1)), *(f(c) for c in ("X", "Y", "pid") for f in (F.min, F.max))).collect():
            if b in large:
                v = {"X": (x0, x1), "Y": (y0, y1)}
                axis = _longer(boxes[b][1], {a: v[a][1] - v[a][0] for a in v})
                asks[b] = {"axis": axis, "k": int(ends[(b + large[b]) // 2] - ends[b]), "n": n, "v": v[axis], "p": (p0, p1), "by_pid": v[axis][0] == v[axis][1]}
        cuts = _cuts(d, asks)
        rows = [(b, (b + large[b]) // 2, asks[b]["axis"] == "X", *cuts[b]) for b in asks]
        t = spark.createDataFrame(rows, "_box bigint, _right bigint, _x boolean, _cv double, _cp bigint")
        v = F.when(F.col("_x"), F.col("X")).otherwise(F.col("Y"))
        right = (v > F.col("_cv")) | (v == F.col("_cv")) & (F.col("pid") >= F.col("_cp"))
        d = d.join(F.broadcast(t), "_box", "left").select("pid", "X", "Y", F.when(right, F.col("_right")).otherwise(F.col("_box")).alias("_box"))
        for b, c, *_ in rows:
            boxes[c], boxes[b] = (large[b], asks[b]["axis"]), (c, asks[b]["axis"])

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", kind="stable")
        v = {a: pdf[a].to_numpy() for a in ("X", "Y")}
        view = np.zeros(len(pdf), dtype=np.int64)
        first = int(pdf["_box"].iat[0])
        todo = [(first, *boxes[first], np.arange(len(pdf)))]
        while todo:
            b, e, axis, rows = todo.pop()
            if e - b <= 1:
                view[rows] = b
                continue
            with np.errstate(over="ignore"):
                axis = _longer(axis, {a: v[a][rows].max() - v[a][rows].min() for a in v})
            c = (b + e) // 2
            by = rows[np.argsort(v[axis][rows], kind="stable")]
            k = ends[c] - ends[b]
            todo += [(b, c, axis, np.sort(by[:k])), (c, e, axis, np.sort(by[k:]))]
        return pd.DataFrame({"pid": pdf["pid"].to_numpy(), "view_id": view})

    views = d.groupBy("_box").applyInPandas(split, "pid bigint, view_id bigint")
    df = df.drop("view_id")
    return df.join(views, "pid").select(*df.columns, "view_id")


def _longer(before: str, sides: dict[str, float]) -> str:
    """The longer side; of equal ones that which was not split before."""
    other = "Y" if before == "X" else "X"
    return before if sides[before] > sides[other] else other


def separatescanline(df: DataFrame, groupby: int = 1) -> DataFrame:
    """A new view behind each row that ends a flight line, ``groupby`` lines a view."""
    d = running_sum(df.drop("view_id").withColumn("_edge", (F.col("EdgeOfFlightLine") != 0).cast("bigint")), "_edge", before=True)
    return d.withColumn("view_id", F.floor(F.col("_sum") / groupby)).drop("_edge", "_sum")


def merge(*clouds: DataFrame) -> DataFrame:
    """All rows, in the order of the inputs; dimensions that one lacks are 0. ``pid`` is made anew, ``view_id`` dropped."""
    from .order import renumbered

    out = None
    for k, c in enumerate(clouds):
        c = c.drop("view_id").withColumn("_input", F.lit(k))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    numeric = [f.name for f in out.schema.fields if f.dataType.typeName() not in ("string", "boolean", "array", "map", "struct")]
    out = out.fillna(0, subset=numeric)
    return renumbered(out, F.asc("_input"), F.asc("pid")).drop("_input")
