"""Row selection. A cloud is a DataFrame with ``pid`` (order, unique); operators that make several
views add ``view_id``; where the input has one, ordered operators work view by view."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import drop_view
from ..functions.expression import condition, json_condition, range_condition
from ..session import staged


def ranged(df: DataFrame, *order) -> DataFrame:
    """Rows with ``_part``, the number of their range in ``order`` (views first), written once.

    The ranges come from a sample that differs from one evaluation to the next,
    so what is numbered by them must be one evaluation: it is staged.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(parts, *drop_view(df), *order).withColumn("_part", F.spark_partition_id()), "ranges")


def prefixed(df: DataFrame, view: list[str], totals: dict[str, Column]) -> DataFrame:
    """(view, _part, name: the sum of the total over the ranges before it); a row a range."""
    t = df.groupBy(*view, "_part").agg(*(c.alias(f"_t_{n}") for n, c in totals.items()))
    w = Window.partitionBy(*view).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(*view, "_part", *(F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(n) for n in totals))


def positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """Dense 0-based position in pid order, within the view where there is one.

    Rows are numbered in their range and moved by the counts before it, so that
    no task sorts all.
    """
    view = drop_view(df)
    r = ranged(df, "pid")
    before = prefixed(r, view, {"_before": F.count(F.lit(1))})
    n = F.row_number().over(Window.partitionBy(*view, "_part").orderBy("pid"))
    return r.withColumn("_n", n).join(F.broadcast(before), [*view, "_part"]).withColumn(name, F.col("_n") - 1 + F.col("_before")).drop("_part", "_n", "_before")


def expression(df: DataFrame, *expressions: str) -> DataFrame:
    """Rows where an expression holds; of several, each makes a view, and a row may be in several."""
    dims = df.columns
    if len(expressions) == 1:
        return df.where(condition(expressions[0], dims))
    hit = F.array_compact(F.array(*(F.when(condition(e, dims), F.lit(k)) for k, e in enumerate(expressions))))
    return df.withColumn("view_id", F.explode(hit))


def range_filter(df: DataFrame, limits: str) -> DataFrame:
    return df.where(range_condition(limits))


def mongo(df: DataFrame, tree: str | dict) -> DataFrame:
    return df.where(json_condition(tree))


def box_condition(bounds: list[float]) -> Column:
    """Within [minx, maxx, miny, maxy(, minz, maxz)], edges included."""
    c = [F.col(d).cast("double").between(float(lo), float(hi)) for d, lo, hi in zip("XYZ", bounds[::2], bounds[1::2])]
    return reduce(lambda a, b: a & b, c)


def circle_condition(center: list[float], distance: float) -> Column:
    d2 = reduce(lambda a, b: a + b, [(F.col(d) - float(c)) * (F.col(d) - float(c)) for d, c in zip("XYZ", center)])
    return d2 < float(distance) ** 2


def wkt_polygons(wkt: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons > rings > vertices of a POLYGON or MULTIPOLYGON text."""
    rings = [[tuple(map(float, v.split()[:2])) for v in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", wkt)]
    if "MULTI" not in wkt.upper():
        return [rings]
    body = re.sub(r"^[^(]*\(", "", wkt.strip())[:-1]
    out, k = [], 0
    for group in re.findall(r"\((?:\s*\([^()]*\)\s*,?)+\)", body):
        n = len(re.findall(r"\([^()]+\)", group))
        out.append(rings[k : k + n])
        k += n
    return out


def polygon_condition(polygons: list, x: str = "X", y: str = "Y") -> Column:
    """Inside an outer ring and outside its holes; the crossing count as one expression of the JVM."""

    def crossings(ring):
        pts = ring if ring[0] != ring[-1] else ring[:-1]
        total = F.lit(0)
        for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]]):
            if ay != by:
                across = (F.lit(ay) > F.col(y)) != (F.lit(by) > F.col(y))
                left = F.col(x) < (bx - ax) * (F.col(y) - ay) / (by - ay) + ax
                total = total + (across & left).cast("int")
        return total % 2 == 1

    def one(rings):
        return reduce(lambda a, b: a & ~b, [crossings(r) for r in rings])

    return reduce(lambda a, b: a | b, [one(p) for p in polygons])


def crop(df: DataFrame, *, bounds: list | None = None, polygons: list[str] | None = None, points: list | None = None, distance: float = 0.0, outside: bool = False) -> DataFrame:
    """Rows inside (``outside``: not inside) each geometry; of several, each makes a view."""
    boxes = [] if bounds is None else bounds if isinstance(bounds[0], (list, tuple)) else [bounds]
    conds = [box_condition(b) for b in boxes] + [polygon_condition(wkt_polygons(p)) for p in polygons or ()] + [circle_condition(p, distance) for p in points or ()]
    conds = [~c for c in conds] if outside else conds
    if len(conds) == 1:
        return df.where(conds[0])
    hit = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(conds))))
    return df.withColumn("view_id", F.explode(hit))


def raster_value(df: DataFrame, raster: DataFrame, origin: tuple[float, float], cell: tuple[float, float], value: str = "value") -> DataFrame:
    """Add ``value`` of the raster's pixel (i, j, value) at X, Y, null off the raster: an equi-join on the pixel."""
    d = df.withColumns({"_i": F.floor((F.col("X") - origin[0]) / cell[0]), "_j": F.floor((F.col("Y") - origin[1]) / cell[1])})
    r = raster.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias(value))
    return d.join(r, ["_i", "_j"], "left").drop("_i", "_j")


def dem(df: DataFrame, raster: DataFrame, origin, cell, dim: str, lower: float, upper: float) -> DataFrame:
    """Rows whose ``dim`` is within [value - lower, value + upper] of the raster at X, Y."""
    d = raster_value(df, raster, origin, cell, "_dem")
    return d.where(F.col(dim).between(F.col("_dem") - lower, F.col("_dem") + upper)).drop("_dem")


def head(df: DataFrame, count: int = 10, invert: bool = False) -> DataFrame:
    if not drop_view(df) and not invert:
        return df.orderBy("pid").limit(count)
    p = positions(df)
    return p.where(F.col("pos") >= count if invert else F.col("pos") < count).drop("pos")


def tail(df: DataFrame, count: int = 10, invert: bool = False) -> DataFrame:
    if not drop_view(df) and not invert:
        return df.orderBy(F.desc("pid")).limit(count)
    view = drop_view(df)
    n = df.groupBy(*view).agg(F.count(F.lit(1)).alias("_n"))
    p = positions(df)
    p = p.join(n, view) if view else p.crossJoin(n)  # one row
    return p.where(F.col("pos") < F.col("_n") - count if invert else F.col("pos") >= F.col("_n") - count).drop("pos", "_n")


def decimation(df: DataFrame, step: float = 1.0, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Positions offset + round(k step), round((last - offset) / step) of them, last = min(limit, rows)."""
    if step < 1:
        raise ValueError("step must be at least 1")
    view = drop_view(df)
    p = positions(df)
    n = p.groupBy(*view).agg(F.count(F.lit(1)).alias("_n"))
    p = p.join(F.broadcast(n), view) if view else p.crossJoin(F.broadcast(n))
    last = F.least("_n", F.lit(limit)) if limit is not None else F.col("_n")
    half = lambda x: F.floor(x + 0.5)  # noqa: E731  not negative here
    k = half((F.col("pos") - offset) / F.lit(float(step)))
    hit = lambda j: (j >= 0) & (half(j * float(step)) + offset == F.col("pos")) & (j < half((last - offset) / F.lit(float(step))))
    return p.where((F.col("pos") >= offset) & (hit(k) | hit(k - 1) | hit(k + 1))).drop("pos", "_n")


def returns(df: DataFrame, groups: list[str] = ("last",)) -> DataFrame:
    """Rows of the kinds of return wanted: first, intermediate, last, only; a view a kind."""
    r, n = F.col("ReturnNumber"), F.col("NumberOfReturns")
    kind = F.when(n <= 1, "only").when(r == 1, "first").when(r == n, "last").when((r > 1) & (r < n), "intermediate")
    ids = F.create_map(*(F.lit(x) for k, g in enumerate(("first", "intermediate", "last", "only")) for x in (g, k)))
    return df.withColumn("_kind", kind).where(F.col("_kind").isin(list(groups))).withColumn("view_id", ids[F.col("_kind")]).drop("_kind")


def locate(df: DataFrame, dimension: str, minmax: str = "max") -> DataFrame:
    """The row of the least or greatest value, the first of ties; nothing for another word."""
    if minmax not in ("min", "max"):
        return df.limit(0)
    order = [F.asc(dimension) if minmax == "min" else F.desc(dimension), "pid"]
    view = drop_view(df)
    if not view:
        return df.orderBy(*order).limit(1)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*view).orderBy(*order))).where("_r = 1").drop("_r")


def order_statistics(df: DataFrame, dimension: str | Column, shares: dict[str, float]) -> DataFrame:
    """One row (a view): the value at 0-based position int(n * share) of the sorted values, exactly.

    Values are counted first, so a task sorts distinct values with their counts
    of a range, and only the ranges' totals meet.
    """
    view = drop_view(df)
    x = F.col(dimension) if isinstance(dimension, str) else dimension
    c = df.select(*view, x.cast("double").alias("v")).groupBy(*view, "v").agg(F.count(F.lit(1)).alias("c"))
    # with its view as a plain column, c is staged by ranges of views and values
    c = ranged(c, "v")
    totals = c.groupBy(*view, "_part").agg(F.sum("c").alias("t"))
    w = Window.partitionBy(*view).orderBy("_part")
    totals = totals.withColumns({"before": F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("t").over(Window.partitionBy(*view))})
    inner = F.sum("c").over(Window.partitionBy(*view, "_part").orderBy("v"))
    j = c.withColumn("upto", inner).join(F.broadcast(totals), [*view, "_part"]).withColumn("upto", F.col("upto") + F.col("before"))
    at = lambda s: F.floor(F.col("n") * s)
    picks = [F.min(F.when(F.col("upto") > at(s), F.col("v"))).alias(name) for name, s in shares.items()]
    return j.groupBy(*view).agg(*picks)


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    view = drop_view(df)
    return df.join(F.broadcast(one), view) if view else df.crossJoin(F.broadcast(one))  # one row (a view)


def iqr(df: DataFrame, dimension: str, k: float = 1.5) -> DataFrame:
    """Rows strictly within k interquartile ranges of the quartiles (elements int(n/4), int(3n/4))."""
    q = order_statistics(df, dimension, {"_lo": 0.25, "_hi": 0.75})
    d = _beside(df, q).withColumn("_r", (F.col("_hi") - F.col("_lo")) * k)
    return d.where((F.col(dimension) > F.col("_lo") - F.col("_r")) & (F.col(dimension) < F.col("_hi") + F.col("_r"))).drop("_lo", "_hi", "_r")


def mad(df: DataFrame, dimension: str, k: float = 2.0, mad_multiplier: float = 1.4862) -> DataFrame:
    """Rows nearer than k scaled median deviations to the median (elements int(n/2))."""
    d = _beside(df, order_statistics(df, dimension, {"_med": 0.5}))
    dev = F.abs(F.col(dimension) - F.col("_med"))
    d = d.withColumn("_dev", dev)
    m = order_statistics(d, "_dev", {"_mad": 0.5})
    d = _beside(d, m)
    far = F.when(F.col("_mad") == 0, F.when(F.col("_dev") == 0, F.lit(math.nan)).otherwise(F.lit(math.inf))).otherwise(F.col("_dev") / (F.col("_mad") * mad_multiplier))
    return d.where(~F.isnan(far) & (far < k)).drop("_med", "_dev", "_mad")
