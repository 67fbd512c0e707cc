"""Statistics of dimensions, histograms, summaries, hexagonal bins and rasters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import drop_view
from ..functions.expression import condition
from .select import order_statistics


def stats(df: DataFrame, dimensions: list[str] | None = None, advanced: bool = False, robust: list[str] = ()) -> DataFrame:
    """One row a dimension (and view): count, minimum, maximum, average, variance, stddev (of a sample); ``advanced``:
    skewness, kurtosis (of a sample, excess); ``robust``: median and mad (elements int(n/2)) of these dimensions.

    NaN is left out of the extremes and makes the moments NaN. One pass for all.
    """
    dims = dimensions or [f.name for f in df.schema.fields if f.name not in ("pid", "view_id")]
    view = drop_view(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in dims:
        x = F.col(d).cast("double")
        real = F.when(~F.isnan(x), x)
        aggs += [F.min(real).alias(f"{d}|minimum"), F.max(real).alias(f"{d}|maximum"), F.avg(x).alias(f"{d}|average"), F.var_samp(x).alias(f"{d}|variance"), F.stddev_samp(x).alias(f"{d}|stddev")]
        if advanced:
            aggs += [F.skewness(x).alias(f"{d}|skew"), F.kurtosis(x).alias(f"{d}|kurt")]
    one = df.groupBy(*view).agg(*aggs)
    names = ["minimum", "maximum", "average", "variance", "stddev"] + (["skew", "kurt"] if advanced else [])
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), *(F.col(f"{d}|{s}").alias(s) for s in names)) for d in dims)))
    out = one.select(*view, F.col("n").alias("count"), rows.alias("s")).select(*view, "s.dimension", "count", *(f"s.{s}" for s in names))
    if advanced:
        n = F.col("count").cast("double")
        out = out.withColumns({
            "skewness": F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n > 3, ((n + 1) * F.col("kurt") + 6) * (n - 1) / ((n - 2) * (n - 3))),
        }).drop("skew", "kurt")
    for d in robust:
        from .select import _beside

        med = order_statistics(df, d, {"median": 0.5})
        dev = _beside(df, med.withColumnRenamed("median", "_m")).withColumn("_dev", F.abs(F.col(d) - F.col("_m")))
        extra = _beside(med, order_statistics(dev, "_dev", {"mad": 0.5})).withColumn("dimension", F.lit(d))
        out = out.join(extra, [*view, "dimension"], "left") if "median" not in out.columns else out.join(extra.select(*view, "dimension", F.col("median").alias("_a"), F.col("mad").alias("_b")), [*view, "dimension"], "left").withColumns({"median": F.coalesce("median", "_a"), "mad": F.coalesce("mad", "_b")}).drop("_a", "_b")
    return out


def enumerate_values(df: DataFrame, dimension: str) -> DataFrame:
    """(value, count) of a dimension."""
    return df.groupBy(*drop_view(df), F.col(dimension).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def expressionstats(df: DataFrame, dimension: str, *expressions: str) -> DataFrame:
    """(expression, value, count) of a dimension over the rows that fit each expression."""
    hit = F.array_compact(F.array(*(F.when(condition(e, df.columns), F.lit(e)) for e in expressions)))
    d = df.select(F.explode(hit).alias("expression"), F.col(dimension).cast("double").alias("value"))
    return d.groupBy("expression", "value").agg(F.count(F.lit(1)).alias("count"))


def info(df: DataFrame) -> DataFrame:
    """One row (a view): number of points and bounds."""
    b = [f(a).alias(f"{n}{a.lower()}") for n, f in (("min", F.min), ("max", F.max)) for a in "XYZ"]
    return df.groupBy(*drop_view(df)).agg(F.count(F.lit(1)).alias("num_points"), *b)


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.metadata.get("dim_type") or f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


def points_of(df: DataFrame, ids: str) -> DataFrame:
    """Rows at positions like ``1-5,10``."""
    from .select import positions

    p = positions(df)
    conds = []
    for part in ids.split(","):
        lo, _, hi = part.strip().partition("-")
        conds.append(F.col("pos").between(int(lo), int(hi or lo)))
    return p.where(reduce(lambda a, b: a | b, conds)).drop("pos")


def query_nearest(df: DataFrame, at: list[float], count: int = 10) -> DataFrame:
    """The ``count`` rows nearest to a place, with their squared distance ``d2``, ties in order: a top-k, no sort of all."""
    d2 = reduce(lambda a, b: a + b, [(F.col(a) - float(v)) * (F.col(a) - float(v)) for a, v in zip("XYZ", at)])
    return df.withColumn("d2", d2).orderBy("d2", "pid").limit(count)


SQRT3 = math.sqrt(3)


def hex_cells(df: DataFrame, edge: float, origin: tuple[float, float] | None = None) -> DataFrame:
    """Add ``hex_i``, ``hex_j``: the hexagon (flat sides of length ``edge`` above and below, columns 1.5 edges apart, odd
    columns half a height higher) that contains X, Y. Without an origin it is the first row's position."""
    from .select import _beside

    h = edge * SQRT3
    if origin is None:
        one = df.groupBy().agg(F.min_by("X", "pid").alias("_ox"), F.min_by("Y", "pid").alias("_oy"))
        d = _beside(df.drop("view_id"), one)
    else:
        d = df.withColumns({"_ox": F.lit(float(origin[0])), "_oy": F.lit(float(origin[1]))})
    # nearest of the centres of the two columns around the point
    d = d.withColumns({"_x": F.col("X") - F.col("_ox"), "_y": F.col("Y") - F.col("_oy")})
    c = F.floor(F.col("_x") / (1.5 * edge))

    def near(col):
        lift = F.when(F.pmod(col, F.lit(2)) == 1, h / 2).otherwise(0.0)
        j = F.floor((F.col("_y") - lift) / h + 0.5)
        dx, dy = F.col("_x") - col * 1.5 * edge, F.col("_y") - (j * h + lift)
        return F.struct((dx * dx + dy * dy).alias("d"), col.cast("bigint").alias("i"), j.cast("bigint").alias("j"))

    d = d.withColumn("_h", F.array_min(F.array(near(c), near(c + 1))))
    return d.withColumns({"hex_i": F.col("_h.i"), "hex_j": F.col("_h.j")}).drop("_h", "_x", "_y", "_ox", "_oy")


def hexbin(df: DataFrame, edge: float, threshold: int = 15, origin: tuple[float, float] | None = None) -> DataFrame:
    """(hex_i, hex_j, count) of the hexagons with at least ``threshold`` rows."""
    g = hex_cells(df, edge, origin).groupBy("hex_i", "hex_j").agg(F.count(F.lit(1)).alias("count"))
    return g.where(F.col("count") >= threshold)


def hex_boundary(bins: DataFrame, edge: float, origin: tuple[float, float]) -> DataFrame:
    """(x0, y0, x1, y1): sides of dense hexagons that no dense neighbour shares; together they are the boundary."""
    h = edge * SQRT3
    odd = F.pmod(F.col("hex_i"), F.lit(2))
    cx, cy = F.col("hex_i") * 1.5 * edge + origin[0], F.col("hex_j") * h + F.when(odd == 1, h / 2).otherwise(0.0) + origin[1]
    corners = [(edge, 0.0), (edge / 2, h / 2), (-edge / 2, h / 2), (-edge, 0.0), (-edge / 2, -h / 2), (edge / 2, -h / 2)]
    # side k, from corner k to the next, faces this neighbour (column step, row step of even and odd columns)
    faces = [(1, 0, 1), (0, 1, 1), (-1, 0, 1), (-1, -1, 0), (0, -1, -1), (1, -1, 0)]
    sides = F.array(*(F.struct((F.col("hex_i") + di).alias("ni"), (F.col("hex_j") + F.when(odd == 1, dj1).otherwise(dj0)).alias("nj"), (cx + corners[k][0]).alias("x0"), (cy + corners[k][1]).alias("y0"), (cx + corners[(k + 1) % 6][0]).alias("x1"), (cy + corners[(k + 1) % 6][1]).alias("y1")) for k, (di, dj0, dj1) in enumerate(faces)))
    s = bins.select(F.explode(sides).alias("s")).select("s.*")
    dense = bins.select(F.col("hex_i").alias("ni"), F.col("hex_j").alias("nj"))
    return s.join(dense, ["ni", "nj"], "left_anti").select("x0", "y0", "x1", "y1")


def hex_summary(bins: DataFrame, edge: float) -> DataFrame:
    """Area, density and average spacing of the dense hexagons."""
    area = 1.5 * SQRT3 * edge * edge
    return bins.groupBy().agg(F.count(F.lit(1)).alias("hexagons"), F.sum("count").alias("points"), (F.count(F.lit(1)) * area).alias("area"), (F.sum("count") / (F.count(F.lit(1)) * area)).alias("density"), F.sqrt(F.count(F.lit(1)) * area / F.sum("count")).alias("avg_spacing"))


def raster(df: DataFrame, resolution: float, output: list[str] = ("min", "max", "mean", "idw", "count", "stdev"), *, dimension: str = "Z", radius: float | None = None, power: float = 1.0, binmode: bool = False, origin: tuple[float, float] | None = None, width: int | None = None, height: int | None = None, window_size: int = 0) -> DataFrame:
    """(i, j, one column a statistic) of the cells with rows; i to the right, j upwards from ``origin`` (the least X, Y).

    ``binmode``: a row counts in its own cell; else in every cell whose centre is
    nearer than ``radius`` (resolution * sqrt(2)). stdev is of the population,
    pNN interpolates. ``window_size``: empty cells take the distance-weighted
    mean of the filled ones at most so many cells away.
    """
    if origin is None:
        b = df.agg(F.min("X"), F.min("Y")).first()
        if b[0] is None:
            return df.sparkSession.createDataFrame([], "i bigint, j bigint, " + ", ".join(f"{o} double" for o in output))
        origin = (b[0], b[1])
    ox, oy = map(float, origin)
    r = radius if radius is not None else resolution * math.sqrt(2)
    z = F.col(dimension).cast("double")
    d = df.select("pid", z.alias("z"), ((F.col("X") - ox) / resolution).alias("u"), ((F.col("Y") - oy) / resolution).alias("v"))
    if binmode:
        d = d.withColumns({"i": F.floor("u"), "j": F.floor("v"), "d": F.lit(None).cast("double")})
        di, dj = F.col("u") - F.col("i") - 0.5, F.col("v") - F.col("j") - 0.5
        d = d.withColumn("d", F.sqrt(di * di + dj * dj) * resolution)
    else:
        reach = r / resolution
        cells = lambda c: F.sequence(F.ceil(F.col(c) - 0.5 - reach), F.floor(F.col(c) - 0.5 + reach))
        d = d.withColumn("i", F.explode(cells("u"))).withColumn("j", F.explode(cells("v")))
        di, dj = F.col("u") - F.col("i") - 0.5, F.col("v") - F.col("j") - 0.5
        d = d.withColumn("d", F.sqrt(di * di + dj * dj) * resolution).where(F.col("d") < r)
    if width is not None:
        d = d.where(F.col("i").between(0, width - 1))
    if height is not None:
        d = d.where(F.col("j").between(0, height - 1))
    aggs = []
    for o in output:
        if o == "idw":
            w = F.when(F.col("d") > 0, F.pow("d", F.lit(-float(power))))
            aggs.append(F.coalesce(F.min_by(F.when(F.col("d") == 0, F.col("z")), F.when(F.col("d") == 0, F.col("pid"))), F.sum(F.col("z") * w) / F.sum(w)).alias("idw"))
        elif o == "count":
            aggs.append(F.count(F.lit(1)).cast("double").alias("count"))
        elif o.startswith("p"):
            aggs.append(F.percentile("z", float(o[1:]) / 100).alias(o))
        else:
            aggs.append({"min": F.min, "max": F.max, "mean": F.avg, "stdev": F.stddev_pop}[o]("z").alias(o))
    g = d.groupBy("i", "j").agg(*aggs)
    return filled(g, list(output), window_size) if window_size else g


def filled(grid: DataFrame, columns: list[str], window_size: int) -> DataFrame:
    """Empty cells at most ``window_size`` cells (in i and j) from filled ones take their means, weighted by 1 / distance."""
    k = window_size
    off = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-k, k + 1) for b in range(-k, k + 1) if a or b)))
    near = grid.withColumn("_o", off).withColumns({"i": F.col("i") + F.col("_o.a"), "j": F.col("j") + F.col("_o.b"), "_w": 1 / F.sqrt(F.col("_o.a") * F.col("_o.a") + F.col("_o.b") * F.col("_o.b"))})
    near = near.join(grid.select("i", "j"), ["i", "j"], "left_anti")
    b = grid.groupBy().agg(F.min("i").alias("a0"), F.max("i").alias("a1"), F.min("j").alias("b0"), F.max("j").alias("b1"))
    near = near.crossJoin(F.broadcast(b)).where("i between a0 and a1 and j between b0 and b1")  # one row
    new = near.groupBy("i", "j").agg(*(F.sum(F.col(c) * F.col("_w")) / F.sum("_w") for c in columns)).toDF("i", "j", *columns)
    return grid.unionByName(new)
