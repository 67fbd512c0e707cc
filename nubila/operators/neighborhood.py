"""Operators on nearest neighbours and on neighbours within a radius."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import coerce
from ..functions.expression import assignment, range_condition
from ..session import staged
from ..spatial.components import components
from ..spatial.neighbors import knn_join, places, radius_counts, radius_join
from .assign import _type

XYZ, XY = ["X", "Y", "Z"], ["X", "Y"]


def _with(df: DataFrame, extra: DataFrame, **fill) -> DataFrame:
    """``extra`` (pid and columns) beside ``df``; what is missing takes ``fill``."""
    d = df.drop(*(c for c in extra.columns if c != "pid")).join(extra, "pid", "left")
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()}) if fill else d


def nndistance(df: DataFrame, k: int = 10, mode: str = "kth") -> DataFrame:
    """NNDistance: the distance to the k-th nearest other row, or ('avg') the mean distance to the k nearest."""
    n = knn_join(df, df, k + 1, XYZ)
    # itself is the first of those at distance 0, whatever its id
    d = n.groupBy(F.col("lpid").alias("pid")).agg((F.max(F.sqrt("d2")) if mode == "kth" else F.sum(F.sqrt("d2")) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("NNDistance"))
    return _with(df, d)


def radialdensity(df: DataFrame, radius: float = 1.0) -> DataFrame:
    """RadialDensity: rows within the radius, itself included, by the sphere's volume (with pi as 3.14159)."""
    at = places(df, XYZ)
    n = radius_counts(at, at, radius, XYZ).select(*XYZ, (F.col("count") / (4.0 / 3.0 * 3.14159 * radius**3)).alias("RadialDensity"))
    return _with(df, df.select("pid", *XYZ).join(n, XYZ).select("pid", "RadialDensity"))


def lof(df: DataFrame, minpts: int = 10) -> DataFrame:
    """NNDistance (k-distance), LocalReachabilityDistance and LocalOutlierFactor; neighbourhoods hold the row itself."""
    n = staged(knn_join(df, df, minpts + 1, XYZ).select("lpid", "rpid", F.sqrt("d2").alias("d")), "lof")
    kd = n.groupBy(F.col("lpid").alias("pid")).agg(F.max("d").alias("NNDistance"))
    reach = n.join(kd.withColumnRenamed("pid", "rpid"), "rpid").groupBy(F.col("lpid").alias("pid")).agg((1 / F.avg(F.greatest("d", "NNDistance"))).alias("LocalReachabilityDistance"))
    reach = staged(reach, "lrd")
    f = n.join(reach.select(F.col("pid").alias("rpid"), F.col("LocalReachabilityDistance").alias("_o")), "rpid").groupBy(F.col("lpid").alias("pid")).agg(F.avg("_o").alias("_m"))
    out = kd.join(reach, "pid").join(f, "pid").withColumn("LocalOutlierFactor", F.try_divide("_m", "LocalReachabilityDistance")).drop("_m")
    return _with(df, out)


def reciprocity(df: DataFrame, knn: int = 8) -> DataFrame:
    """Reciprocity: of a row's k nearest others, the percentage that do not have it among theirs."""
    n = staged(knn_join(df, df, knn + 1, XYZ).select("lpid", "rpid"), "knn")
    back = n.select(F.col("rpid").alias("lpid"), F.col("lpid").alias("rpid"))
    one = n.join(back, ["lpid", "rpid"], "left_anti").groupBy(F.col("lpid").alias("pid")).agg((F.count(F.lit(1)) * 100.0 / knn).alias("Reciprocity"))
    return _with(df, one, Reciprocity=0.0)


def outlier(df: DataFrame, method: str = "statistical", min_k: int = 2, radius: float = 1.0, mean_k: int = 8, multiplier: float = 2.0, class_: int = 7) -> DataFrame:
    """Classification = ``class_`` for rows with at most min_k rows in the radius (itself included), or whose mean distance to
    mean_k neighbours is at least mean + multiplier * deviation of all. Where all would be outliers, none is."""
    if method == "radius":
        at = places(df, XYZ)
        n = radius_counts(at, at, radius, XYZ)
        marked = df.select("pid", *XYZ).join(n, XYZ).select("pid", (F.col("count") <= min_k).alias("_out"))
    else:
        n = knn_join(df, df, mean_k + 1, XYZ).groupBy(F.col("lpid").alias("pid")).agg((F.sum(F.sqrt("d2")) / mean_k).alias("_d"))
        n = staged(n, "means")
        one = n.agg(F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"))
        marked = n.crossJoin(F.broadcast(one)).select("pid", (F.col("_d") >= F.col("_m") + multiplier * F.col("_s")).alias("_out"))  # one row
    marked = staged(marked, "outliers")
    some = marked.agg(F.bool_and("_out").alias("_all"))
    d = df.join(marked, "pid", "left").crossJoin(F.broadcast(some))
    return d.withColumn("Classification", F.when(F.col("_out") & ~F.col("_all"), F.lit(class_)).otherwise(F.col("Classification")).cast(df.schema["Classification"].dataType)).drop("_out", "_all")


def _numbered(df: DataFrame, least: DataFrame, column: str, first: int, none: int) -> DataFrame:
    """Clusters (pid, top) numbered from ``first`` in order of their least row; others take ``none``."""
    tops = least.select("top").distinct()
    from .order import renumbered

    ids = renumbered(tops.select(F.col("top").alias("pid"), F.col("top").alias("_t")), F.asc("pid")).select(F.col("_t").alias("top"), (F.col("pid") + first).cast("bigint").alias(column))
    return _with(df, least.join(ids, "top").select("pid", column), **{column: none})


def cluster(df: DataFrame, min_points: int = 1, max_points: int | None = None, tolerance: float = 1.0, is3d: bool = True) -> DataFrame:
    """ClusterID: components of the radius graph with min_points to max_points rows, numbered from 1 in order of their first row; else 0."""
    dims = XYZ if is3d else XY
    at = places(df, dims)  # rows of one location are together
    links = radius_join(at, at, tolerance, dims).where("lpid < rpid").select(F.col("lpid").alias("a"), F.col("rpid").alias("b"))
    c = components(links)
    tops = at.join(c.withColumnRenamed("id", "pid"), "pid", "left").select(*dims, F.coalesce("component", "pid").alias("top"))
    all_ = staged(df.select("pid", *dims).join(tops, dims).select("pid", "top"), "tops")
    n = all_.groupBy("top").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    if max_points is not None:
        n = n.where(F.col("_n") <= max_points)
    return _numbered(df, all_.join(n.select("top"), "top"), "ClusterID", 1, 0)


def dbscan(df: DataFrame, min_points: int = 6, eps: float = 1.0, dimensions: list[str] = ("X", "Y", "Z")) -> DataFrame:
    """ClusterID by density: cores have min_points rows within eps (itself included); clusters from 0 in order of their first
    core; a border row goes to the lowest-numbered cluster around; noise is -1."""
    dims = list(dimensions)
    at = places(df, dims)  # rows of one location are all cores or none, in the same clusters
    core = staged(at.join(radius_counts(at, at, eps, dims).where(F.col("count") >= min_points), dims).select("pid", *dims), "cores")
    cc = radius_join(core, core, eps, dims).where("lpid < rpid").select(F.col("lpid").alias("a"), F.col("rpid").alias("b"))
    comp = core.join(components(cc).withColumnRenamed("id", "pid"), "pid", "left").select("pid", *dims, F.coalesce("component", "pid").alias("top"))
    comp = staged(comp, "tops")
    rest = at.join(core.select("pid"), "pid", "left_anti")
    border = radius_join(rest, comp, eps, dims, keep=("top",)).groupBy(F.col("lpid").alias("pid")).agg(F.min("top").alias("top"))
    tops = comp.select(*dims, "top").unionByName(rest.join(border, "pid").select(*dims, "top"))
    return _numbered(df, df.select("pid", *dims).join(tops, dims).select("pid", "top"), "ClusterID", 0, -1)


def lloydkmeans(df: DataFrame, k: int = 10, dimensions: list[str] = ("X", "Y", "Z"), maxiters: int = 10) -> DataFrame:
    """ClusterID: index of the nearest centre after ``maxiters`` rounds from farthest-point seeds. k centres are literals of the plan."""
    dims = list(dimensions)
    d = staged(df.select("pid", *(F.col(c).cast("double").alias(c) for c in dims)), "kmeans")
    first = d.orderBy("pid").first()
    if first is None:
        return df.withColumn("ClusterID", F.lit(0).cast("bigint"))
    centres = [[float(first[c]) for c in dims]]
    d2 = lambda c: reduce(lambda a, b: a + b, [(F.col(n) - v) * (F.col(n) - v) for n, v in zip(dims, c)])
    while len(centres) < k:
        near = d2(centres[0]) if len(centres) == 1 else F.least(*map(d2, centres))
        p = d.select(F.max_by(F.struct(*dims), F.struct(near.alias("d"), (-F.col("pid")).alias("p"))).alias("b"), F.max(near).alias("m")).first()
        if p["m"] == 0:
            break
        centres.append([float(p["b"][c]) for c in dims])

    def label(cs):
        return F.array_min(F.array(*(F.struct(d2(c).alias("d"), F.lit(i).cast("bigint").alias("i")) for i, c in enumerate(cs))))["i"]

    for _ in range(maxiters):
        rows = d.groupBy(label(centres).alias("i")).agg(*(F.avg(c).alias(c) for c in dims)).collect()  # k rows
        for r in rows:
            centres[r["i"]] = [r[c] for c in dims]
    return _with(df, d.select("pid", label(centres).alias("ClusterID")))


def neighborclassifier(df: DataFrame, k: int, dimension: str = "Classification", domain: str | None = None, candidate: DataFrame | None = None) -> DataFrame:
    """``dimension`` takes the value that more than half of the k nearest rows (of the candidates; itself included) have, all at once."""
    from_ = candidate if candidate is not None else df
    src = df.where(range_condition(domain, any_of=True)) if domain else df
    v = from_.select("pid", *XYZ, F.col(dimension).alias("_v"))
    n = knn_join(src, v, k, XYZ, keep=("_v",))
    c = n.groupBy("lpid", "_v").agg(F.count(F.lit(1)).alias("_n"))
    best = c.groupBy(F.col("lpid").alias("pid")).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("b")).where(-F.col("b.n") > k / 2).select("pid", F.col("b.v").alias("_new"))
    return df.join(best, "pid", "left").withColumn(dimension, F.coalesce("_new", dimension).cast(df.schema[dimension].dataType)).drop("_new")


def radiusassign(df: DataFrame, src_domain: str, reference_domain: str, radius: float, *update: str, is3d: bool = False, max2d_above: float = -1.0, max2d_below: float = -1.0) -> DataFrame:
    """Assignments for source rows with a reference row within the radius (2D: within the Z window where one is set)."""
    src = df.where(range_condition(src_domain, any_of=True)) if src_domain else df
    ref = (df.where(range_condition(reference_domain, any_of=True)) if reference_domain else df).select("pid", *XYZ, F.col("Z").alias("_rz"))
    j = radius_join(src, ref, radius, XYZ if is3d else XY, keep=("_rz",))
    if not is3d and (max2d_above >= 0 or max2d_below >= 0):
        j = j.join(src.select(F.col("pid").alias("lpid"), F.col("Z").alias("_lz")), "lpid")
        if max2d_above >= 0:
            j = j.where(F.col("_rz") - F.col("_lz") <= max2d_above)
        if max2d_below >= 0:
            j = j.where(F.col("_lz") - F.col("_rz") <= max2d_below)
    hit = j.select(F.col("lpid").alias("pid"), F.lit(True).alias("_hit")).distinct()
    d = df.join(hit, "pid", "left")
    for text in update:
        name, value, where = assignment(text, df.columns)
        cond = F.col("_hit").isNotNull() if where is None else F.col("_hit").isNotNull() & where
        d = d.withColumn(name, F.when(cond, coerce(value, _type(df, name))).otherwise(F.col(name) if name in d.columns else F.lit(0.0)))
    return d.drop("_hit")


def hag_nn(df: DataFrame, count: int = 1, max_distance: float | None = None, allow_extrapolation: bool = True, ground_class: int = 2) -> DataFrame:
    """HeightAboveGround: Z less the inverse-square-distance mean of the nearest ``count`` ground rows in the plane; a ground row
    at the same place decides alone; ground rows 0. Without extrapolation a row outside the ground rows' bounds is 0."""
    ground = df.where(F.col("Classification") == ground_class).select("pid", *XY, F.col("Z").alias("_gz"))
    rest = df.where(F.col("Classification") != ground_class)
    n = knn_join(rest, ground, count, XY, keep=("_gz",))
    if max_distance:
        n = n.where(F.col("d2") <= max_distance**2)
    w = F.when(F.col("d2") > 0, 1 / F.col("d2"))
    z = F.coalesce(F.min_by(F.when(F.col("d2") == 0, F.col("_gz")), F.when(F.col("d2") == 0, F.col("place"))), F.sum(F.col("_gz") * w) / F.sum(w))
    h = n.groupBy(F.col("lpid").alias("pid")).agg(z.alias("_g"))
    d = df.join(h, "pid", "left")
    hag = F.when(F.col("Classification") == ground_class, F.lit(0.0)).otherwise(F.coalesce(F.col("Z") - F.col("_g"), F.lit(0.0)))
    if not allow_extrapolation:
        b = ground.agg(F.min("X").alias("_x0"), F.max("X").alias("_x1"), F.min("Y").alias("_y0"), F.max("Y").alias("_y1"))
        d = d.crossJoin(F.broadcast(b))  # one row
        hag = F.when(F.col("X").between(F.col("_x0"), F.col("_x1")) & F.col("Y").between(F.col("_y0"), F.col("_y1")), hag).otherwise(F.lit(0.0))
    return d.withColumn("HeightAboveGround", hag).drop("_g", "_x0", "_x1", "_y0", "_y1")


def zsmooth(df: DataFrame, dim: str, radius: float = 1.0, medianpercent: float = 50.0) -> DataFrame:
    """``dim``: the percentile (interpolated) of Z of the other rows within the radius in the plane; a row alone keeps its Z."""
    n = radius_join(df, df.select("pid", *XYZ, F.col("Z").alias("_z")), radius, XY, keep=("_z",)).where("lpid <> rpid")
    s = n.groupBy(F.col("lpid").alias("pid")).agg(F.percentile("_z", medianpercent / 100).alias("_s"))
    return df.join(s, "pid", "left").withColumn(dim, F.coalesce("_s", "Z")).drop("_s")


def delta(source: DataFrame, candidate: DataFrame, dims: list[str] | None = None, detail: bool = False) -> DataFrame:
    """Source less its nearest candidate (3D), for each dimension: (dimension, min, max, mean), or ``detail``: a row a point."""
    dims = dims or XYZ
    c = candidate.select("pid", *XYZ, *(F.col(d).cast("double").alias(f"_c{d}") for d in dims))
    n = knn_join(source, c, 1, XYZ, keep=tuple(f"_c{d}" for d in dims))
    j = source.join(n.select(F.col("lpid").alias("pid"), *(f"_c{d}" for d in dims)), "pid")
    diff = j.select("pid", *((F.col(d).cast("double") - F.col(f"_c{d}")).alias(d) for d in dims))
    if detail:
        return diff
    one = diff.agg(*(f(d).alias(f"{d}|{n}") for d in dims for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), *(F.col(f"{d}|{n}").alias(n) for n in ("min", "max", "mean"))) for d in dims)))
    return one.select(rows.alias("s")).select("s.*")


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of squared nearest distances, both ways."""
    one = knn_join(a, b, 1, XYZ).agg(F.sum("d2").alias("x"))
    two = knn_join(b, a, 1, XYZ).agg(F.sum("d2").alias("y"))
    return one.crossJoin(two).select((F.col("x") + F.col("y")).alias("chamfer"))  # one row each


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest nearest distance of both ways, and ('modified') the larger mean."""
    one = knn_join(a, b, 1, XYZ).agg(F.max(F.sqrt("d2")).alias("x"), F.avg(F.sqrt("d2")).alias("mx"))
    two = knn_join(b, a, 1, XYZ).agg(F.max(F.sqrt("d2")).alias("y"), F.avg(F.sqrt("d2")).alias("my"))
    return one.crossJoin(two).select(F.greatest("x", "y").alias("hausdorff"), F.greatest("mx", "my").alias("modified"))


def confusion(predicted: DataFrame, truth: DataFrame, prediction_dim: str = "Classification", truth_dim: str = "Classification") -> DataFrame:
    """(truth, predicted, count): each truth row against its nearest predicted row."""
    p = predicted.select("pid", *XYZ, F.col(prediction_dim).cast("bigint").alias("predicted"))
    n = knn_join(truth, p, 1, XYZ, keep=("predicted",))
    j = n.join(truth.select(F.col("pid").alias("lpid"), F.col(truth_dim).cast("bigint").alias("truth")), "lpid")
    return j.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("count"))


def evaluate(predicted: DataFrame, truth: DataFrame, prediction_dim: str = "Classification", truth_dim: str = "Classification") -> DataFrame:
    """A row a label: support, intersection over union, f1, precision, sensitivity, specificity, accuracy."""
    c = staged(confusion(predicted, truth, prediction_dim, truth_dim), "confusion")
    labels = c.select(F.explode(F.array("truth", "predicted")).alias("label")).distinct()
    total = c.agg(F.sum("count").alias("total"))
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("called"))
    j = labels.join(t, "label", "left").join(p, "label", "left").fillna(0).crossJoin(total)  # a row a label
    tp, fp, fn = F.col("tp"), F.col("called") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("total") - tp - fp - fn
    return j.select("label", "support", F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"), F.try_divide(tp + tn, F.col("total")).alias("accuracy"))


