"""Columns computed row by row, and lookups in rasters, polygons and trajectories."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import SPARK, coerce, drop_view, type_of
from ..functions.expression import assignment, condition, range_condition, ranges
from .select import _beside, order_statistics, polygon_condition, positions, raster_value, wkt_polygons


def _type(df: DataFrame, name: str) -> str:
    """Logical type of a column: as noted with it, else of its well-known name where that fits, else of its Spark type."""
    f = df.schema[name] if name in df.columns else None
    if f is None:
        return type_of(name)
    plain = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "decimal(20,0)": "uint64"}
    known = type_of(name)
    return f.metadata.get("dim_type") or (known if SPARK[known] == f.dataType else plain.get(f.dataType.simpleString(), "double"))


def assign(df: DataFrame, *values: str) -> DataFrame:
    """``Dim = value [WHERE condition]`` in order, each seeing the results before it; a new dimension is a double."""
    for text in values:
        name, value, where = assignment(text, df.columns)
        known = {c.lower(): c for c in df.columns}
        name = known.get(name.lower(), name)
        t = _type(df, name) if name in df.columns else "double"
        new = coerce(value, t)
        if where is not None:
            old = F.col(name) if name in df.columns else F.lit(0.0)
            new = F.when(where, new).otherwise(old)
        df = df.withColumn(name, new.alias(name, metadata={"dim_type": t}))
    return df


def assign_ranges(df: DataFrame, assignments: str, where: str | None = None) -> DataFrame:
    """The older form ``Dim[lo:hi]=value, ...`` with one range condition for all."""
    import re

    for m in re.finditer(r"([A-Za-z]\w*\s*!?\s*[\[(][^\])]*[\])])\s*=\s*([-+.\deE]+)", assignments):
        r = ranges(m[1])[0]
        hit = r.column() if where is None else r.column() & range_condition(where)
        df = df.withColumn(r.name, F.when(hit, coerce(F.lit(float(m[2])), _type(df, r.name))).otherwise(F.col(r.name)))
    return df


def ferry(df: DataFrame, dimensions: str) -> DataFrame:
    """``A=>B`` copies, ``=>B`` makes zeros."""
    new, seen = {}, set()
    for part in dimensions.split(","):
        a, sep, b = (x.strip() for x in part.partition("=>"))
        if not sep or not b or a == b or b in seen:
            raise ValueError(f"bad ferry {part!r}")
        seen.add(b)
        if a and a not in df.columns:
            raise ValueError(f"no dimension {a!r}")
        new[b] = F.col(a) if a else F.lit(0).cast(SPARK[type_of(b)])
    return df.withColumns(new)


def transformation(df: DataFrame, matrix: list[float] | str, invert: bool = False) -> DataFrame:
    """4 x 4 homogeneous matrix on X, Y, Z."""
    m = np.array([float(v) for v in (matrix.split() if isinstance(matrix, str) else matrix)]).reshape(4, 4)
    if invert:
        m = np.linalg.inv(m)
    row = lambda k: reduce(lambda a, b: a + b, [F.col(d) * float(m[k, c]) for c, d in enumerate("XYZ")]) + float(m[k, 3])
    plain = bool((m[3] == (0, 0, 0, 1)).all())
    s = None if plain else row(3)
    return df.withColumns({d: row(k) if plain else F.when(s == 0, F.lit(math.nan)).otherwise(row(k) / s) for k, d in enumerate("XYZ")})


EARTH = 6378137.0


def reprojection(df: DataFrame, in_srs: str, out_srs: str) -> DataFrame:
    """Between EPSG:4326 (longitude, latitude), EPSG:3857 and UTM zones EPSG:326zz / 327zz, as Column arithmetic;
    other systems need a registered function (``register_projection``). Rows that cannot be brought over are dropped."""
    pair = (in_srs.upper(), out_srs.upper())
    if pair in _PROJECTIONS:
        return _PROJECTIONS[pair](df)
    lonlat = {"EPSG:4326": lambda d: d, "EPSG:3857": _from_mercator}.get(pair[0]) or _utm(pair[0], inverse=True)
    out = {"EPSG:4326": lambda d: d, "EPSG:3857": _to_mercator}.get(pair[1]) or _utm(pair[1], inverse=False)
    d = out(lonlat(df))
    return d.where(~F.isnan("X") & ~F.isnan("Y"))


_PROJECTIONS: dict = {}


def register_projection(in_srs: str, out_srs: str, f) -> None:
    _PROJECTIONS[(in_srs.upper(), out_srs.upper())] = f


def _to_mercator(df):
    ok = F.abs("Y") < 89.9999
    return df.withColumns({"X": F.radians("X") * EARTH, "Y": F.when(ok, F.log(F.tan(math.pi / 4 + F.radians("Y") / 2)) * EARTH).otherwise(F.lit(math.nan))})


def _from_mercator(df):
    return df.withColumns({"X": F.degrees(F.col("X") / EARTH), "Y": F.degrees(2 * F.atan(F.exp(F.col("Y") / EARTH)) - math.pi / 2)})


def _utm(code: str, inverse: bool):
    """Transverse Mercator by the series in the third flattening (Krueger, to n^4) on the WGS 84 ellipsoid."""
    if not (code.startswith(("EPSG:326", "EPSG:327")) and code[8:].isdigit() and 1 <= int(code[8:]) <= 60):
        raise ValueError(f"no transformation for {code}")
    zone, north = int(code[8:]), code[7] == "6"
    f = 1 / 298.257223563
    n = f / (2 - f)
    a1 = EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    lon0, k0, e, n0 = math.radians(6 * zone - 183), 0.9996, 500000.0, 0.0 if north else 1e7
    total = lambda terms: reduce(lambda p, q: p + q, terms)

    def forward(df):
        lat, dl = F.radians("Y"), F.radians("X") - lon0
        c = 2 * math.sqrt(n) / (1 + n)
        t = F.sinh(F.atanh(F.sin(lat)) - c * F.atanh(c * F.sin(lat)))
        d = df.withColumns({"_xi": F.atan2(t, F.cos(dl)), "_eta": F.atanh(F.sin(dl) / F.sqrt(1 + t * t))})
        x = F.col("_eta") + total([a * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta")) for j, a in enumerate(alpha, 1)])
        y = F.col("_xi") + total([a * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta")) for j, a in enumerate(alpha, 1)])
        return d.withColumns({"X": e + k0 * a1 * x, "Y": n0 + k0 * a1 * y}).drop("_xi", "_eta")

    def backward(df):
        d = df.withColumns({"_xi": (F.col("Y") - n0) / (k0 * a1), "_eta": (F.col("X") - e) / (k0 * a1)})
        xi = F.col("_xi") - total([b * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta")) for j, b in enumerate(beta, 1)])
        eta = F.col("_eta") - total([b * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta")) for j, b in enumerate(beta, 1)])
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi + total([b * F.sin(2 * j * chi) for j, b in enumerate(delta, 1)])
        return d.withColumns({"X": F.degrees(lon0 + F.atan2(F.sinh(eta), F.cos(xi))), "Y": F.degrees(lat)}).drop("_xi", "_eta")

    return backward if inverse else forward


def projpipeline(df: DataFrame, steps: list[dict], reverse: bool = False) -> DataFrame:
    """Steps {'op': 'affine', 'matrix': 16 numbers} / {'op': 'unit', 'factor': f} / {'op': 'reproject', 'from': a, 'to': b}."""
    for s in reversed(steps) if reverse else steps:
        if s["op"] == "affine":
            df = transformation(df, s["matrix"], invert=reverse)
        elif s["op"] == "unit":
            f = 1 / s["factor"] if reverse else s["factor"]
            df = df.withColumns({d: F.col(d) * float(f) for d in "XYZ"})
        elif s["op"] == "reproject":
            a, b = (s["to"], s["from"]) if reverse else (s["from"], s["to"])
            df = reprojection(df, a, b)
        else:
            raise ValueError(f"unknown step {s['op']!r}")
    return df


WEEK, DAY, GST = 604800.0, 86400.0, 1e9


def gpstimeconvert(df: DataFrame, in_time: str, out_time: str, start_date: str | None = None, wrap: bool = False, wrapped: bool = False, tolerance: float = 1.0) -> DataFrame:
    """GpsTime among gws (seconds of week), gds (of day), gt (GPS seconds) and gst (gt - 1e9).

    ``wrapped``: a drop of more than ``tolerance`` in order begins the next week
    or day. ``start_date`` (Y-m-d) fixes week or day for gws and gds.
    """
    from datetime import date

    t = F.col("GpsTime")
    period = {"gws": WEEK, "gds": DAY}
    if in_time in period and wrapped:
        view = drop_view(df)
        w = Window.partitionBy(*view).orderBy("pid")
        df = df.withColumn("_drop", (t + tolerance < F.lag(t).over(w)).cast("int"))
        df = df.withColumn("GpsTime", t + F.coalesce(F.sum("_drop").over(w), F.lit(0)) * period[in_time]).drop("_drop")
    if in_time == "gst":
        df = df.withColumn("GpsTime", t + GST)
    elif in_time in period:
        if start_date is None and out_time not in (in_time, "gws" if in_time == "gws" else in_time):
            raise ValueError("start_date is needed")
        if start_date is not None:
            days = (date.fromisoformat(start_date) - date(1980, 1, 6)).days
            base = (days // 7 * 7 if in_time == "gws" else days) * DAY
            df = df.withColumn("GpsTime", t + float(base))
    if out_time == "gst":
        return df.withColumn("GpsTime", t - GST)
    if out_time in period and not (in_time in period and start_date is None):
        p = period[out_time]
        if wrap:
            return df.withColumn("GpsTime", t - F.floor(t / p) * p)
        first = F.floor(F.first("GpsTime").over(Window.partitionBy(*drop_view(df)).orderBy("pid")) / p) * p if drop_view(df) else None
        if first is not None:
            return df.withColumn("GpsTime", t - first)
        one = df.groupBy().agg(F.min_by("GpsTime", "pid").alias("_t0"))
        return df.crossJoin(F.broadcast(one)).withColumn("GpsTime", t - F.floor(F.col("_t0") / p) * p).drop("_t0")
    return df


# Colour ramps as lists of red, green, blue at equal steps.
RAMPS = {"pestel_shades": [(69, 121, 133), (122, 176, 149), (193, 214, 164), (240, 228, 180), (219, 170, 130), (176, 113, 98)], "grey": [(0, 0, 0), (255, 255, 255)], "heat": [(0, 0, 128), (0, 255, 255), (255, 255, 0), (255, 0, 0)]}


def ramp_table(ramp: str | list, width: int = 256) -> list[tuple[int, int, int]]:
    stops = np.array(RAMPS[ramp] if isinstance(ramp, str) else ramp, dtype=float)
    at = np.linspace(0, len(stops) - 1, width)
    return [tuple(int(round(v)) for v in row) for row in np.stack([np.interp(at, np.arange(len(stops)), stops[:, k]) for k in range(3)], axis=1)]


def colorinterp(df: DataFrame, dimension: str = "Z", minimum: float | None = None, maximum: float | None = None, ramp="pestel_shades", clamp: bool = False, invert: bool = False, mad: bool = False, mad_multiplier: float = 1.4862, k: float = 0.0) -> DataFrame:
    """Red, Green, Blue of a ramp at (value - min) / (max - min); outside unchanged, or with ``clamp`` the ends.

    Without bounds: data extremes; with k: mean or median -+ k deviations.
    """
    x = F.col(dimension).cast("double")
    if minimum is None or maximum is None:
        if k and mad:
            med = order_statistics(df, dimension, {"_c": 0.5})
            dev = _beside(df, med).withColumn("_d", F.abs(x - F.col("_c")))
            one = order_statistics(dev, "_d", {"_m": 0.5})
            df = _beside(_beside(df, med), one).withColumns({"_lo": F.col("_c") - k * mad_multiplier * F.col("_m"), "_hi": F.col("_c") + k * mad_multiplier * F.col("_m")}).drop("_c", "_m")
        else:
            stats = df.groupBy(*drop_view(df)).agg(*((F.avg(x) - k * F.stddev_samp(x), F.avg(x) + k * F.stddev_samp(x)) if k else (F.min(x), F.max(x))))
            cols = stats.columns[-2:]
            df = _beside(df, stats.withColumnRenamed(cols[0], "_lo").withColumnRenamed(cols[1], "_hi"))
        lo, hi = F.col("_lo") if minimum is None else F.lit(float(minimum)), F.col("_hi") if maximum is None else F.lit(float(maximum))
    else:
        lo, hi = F.lit(float(minimum)), F.lit(float(maximum))
    table = ramp_table(ramp)
    width = len(table)
    factor = F.try_divide(x - lo, hi - lo)
    if clamp:
        factor = F.least(F.greatest(factor, F.lit(0.0)), F.lit(1.0))
    if invert:
        factor = 1 - factor
    index = F.least(F.floor(factor * width), F.lit(width - 1))
    inside = (factor >= 0) & (factor <= 1)
    new = {}
    for c, name in enumerate(("Red", "Green", "Blue")):
        old = F.col(name) if name in df.columns else F.lit(0)
        new[name] = F.when(inside, F.get(F.array(*(F.lit(t[c]) for t in table)), index.cast("int"))).otherwise(old).cast("int")
    return df.withColumns(new).drop("_lo", "_hi")


def colorization(df: DataFrame, bands: dict[str, DataFrame], origin, cell, scale: dict[str, float] | None = None) -> DataFrame:
    """Each named dimension takes its band's pixel value times its scale; off the raster it stays."""
    for name, raster in bands.items():
        df = raster_value(df, raster, origin, cell, "_band")
        new = F.col("_band") * float((scale or {}).get(name, 1.0))
        df = df.withColumn(name, F.coalesce(new, F.col(name).cast("double") if name in df.columns else F.lit(0.0))).drop("_band")
    return df


def hag_dem(df: DataFrame, raster: DataFrame, origin, cell, zero_ground: bool = True, min_clamp: float = 2.2250738585072014e-308, max_clamp: float = 1.7976931348623157e308, nodata_hag: float = 0.0, nodata: float | None = None, ground_class: int = 2) -> DataFrame:
    """HeightAboveGround = Z - raster, clamped; ground rows 0; nodata gives ``nodata_hag``; off the raster it stays."""
    d = raster_value(df, raster, origin, cell, "_dem")
    dem = F.col("_dem")
    hag = F.least(F.greatest(F.col("Z") - dem, F.lit(min_clamp)), F.lit(max_clamp))
    old = F.col("HeightAboveGround") if "HeightAboveGround" in df.columns else F.lit(0.0)
    new = F.when(dem.isNull(), old).when(F.isnan(dem) | (dem == F.lit(nodata) if nodata is not None else F.lit(False)), F.lit(nodata_hag)).otherwise(hag)
    if zero_ground:
        new = F.when(F.col("Classification") == ground_class, F.lit(0.0)).otherwise(new)
    return d.withColumn("HeightAboveGround", new).drop("_dem")


def overlay(df: DataFrame, regions: DataFrame, dimension: str, column: str, region_id: str = "region_id", coordinates: str = "geom_coordinates") -> DataFrame:
    """``dimension`` takes ``column`` of the first region (least id) that contains X, Y; others keep their value."""
    from .nearby import near_or_within

    p = df.select("pid", F.col("X").alias("x"), F.col("Y").alias("y"))
    hits = near_or_within(p, 0.0, regions.where(F.col(column).isNotNull()), tag_col=None, dims=("x", "y"), region_id=region_id, coordinates=coordinates)
    first = hits.where("case_kind = 'within'").groupBy(F.col("id_b").alias("pid")).agg(F.min("id_a").alias("_rid"))
    values = regions.select(F.col(region_id).cast("bigint").alias("_rid"), F.col(column).alias("_value"))
    d = df.join(first.join(values, "_rid").drop("_rid"), "pid", "left")
    old = F.col(dimension) if dimension in df.columns else F.lit(0)
    return d.withColumn(dimension, F.coalesce("_value", old)).drop("_value")


def segment_distance2(x: Column, y: Column, a, b) -> Column:
    """Squared distance in the plane to the segment a-b."""
    (ax, ay), (bx, by) = a, b
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    if n == 0:
        return (x - ax) * (x - ax) + (y - ay) * (y - ay)
    t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (ax + t * dx), y - (ay + t * dy)
    return ex * ex + ey * ey


def geomdistance(df: DataFrame, geometry: str, dimension: str = "distance", ring: bool = False) -> DataFrame:
    """Distance in the plane to a polygon (0 inside; ``ring``: to its border), line or point in WKT."""
    import re

    x, y = F.col("X"), F.col("Y")
    if geometry.strip().upper().startswith(("POLYGON", "MULTIPOLYGON")):
        polygons = wkt_polygons(geometry)
        edges = [(r[k - 1], r[k]) for p in polygons for r in p for k in range(len(r)) if r[k - 1] != r[k]]
        inside = polygon_condition(polygons)
    else:
        pts = [tuple(map(float, v.split()[:2])) for v in re.search(r"\(([^()]*)\)", geometry)[1].split(",")]
        edges, inside = list(zip(pts, pts[1:])) or [(pts[0], pts[0])], None
    d2 = [segment_distance2(x, y, a, b) for a, b in edges]
    d = F.sqrt(F.least(*d2) if len(d2) > 1 else d2[0])
    return df.withColumn(dimension, d if ring or inside is None else F.when(inside, F.lit(0.0)).otherwise(d))


def streamcallback(df: DataFrame, predicate) -> DataFrame:
    """Rows for which ``predicate`` (of a pandas frame, giving booleans) holds."""

    def run(batches):
        for pdf in batches:
            yield pdf[predicate(pdf)]

    return df.mapInPandas(run, df.schema)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], bucket: float = 3600.0) -> DataFrame:
    """Left rows with the nearest right rows at or before (``before_*``) and after (``after_*``) their time.

    Both sides go to time buckets; what a bucket lacks at its ends is carried
    from one row a bucket, so a window sorts a bucket and not all of time.
    """
    r = right.select(F.col(right_time).cast("double").alias("_t"), F.struct(F.col(right_time).cast("double").alias("t"), *columns).alias("_s"))
    left = left.withColumn("_t", F.col(left_time).cast("double"))
    both = left.withColumns({"_s": F.lit(None).cast(r.schema["_s"].dataType), "_left": F.lit(True)}).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("_t") / bucket))
    w = Window.partitionBy("_b").orderBy("_t", "_left")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_b").orderBy(F.desc("_t"), "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_before": F.last("_s", True).over(up), "_after": F.last("_s", True).over(down)}).where("_left")
    ends = r.withColumn("_b", F.floor(F.col("_t") / bucket)).groupBy("_b").agg(F.max_by("_s", "_t").alias("_last"), F.min_by("_s", "_t").alias("_first"))
    have = left.select(F.floor(F.col("_t") / bucket).alias("_b")).distinct()
    marks = ends.join(have, "_b", "full")
    o = Window.orderBy("_b")  # one row a bucket
    marks = marks.select("_b", F.last("_last", True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo"), F.first("_first", True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("_hi"))
    j = both.join(marks, "_b", "left").withColumns({"_before": F.coalesce("_before", "_lo"), "_after": F.coalesce("_after", "_hi")})
    out = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("_before", "before"), ("_after", "after")) for c in ("t", *columns)]
    return j.select(*[c for c in left.columns if c != "_t"], *out)


def georeference(df: DataFrame, trajectory: DataFrame, time_offset: float = 0.0, scan2imu: list[float] | None = None, reverse: bool = False) -> DataFrame:
    """Scanner coordinates to X (longitude), Y (latitude), Z (height) with an interpolated trajectory.

    ``trajectory``: GpsTime, X, Y (radians), Z, Roll, Pitch, Azimuth (radians), WanderAngle.
    Frame: north, east, down at the platform; a row outside the trajectory stays as it is.
    """
    d = transformation(df, scan2imu) if scan2imu else df
    d = d.withColumn("_time", F.col("GpsTime") + float(time_offset))
    j = asof(d, trajectory, "_time", "GpsTime", ["X", "Y", "Z", "Roll", "Pitch", "Azimuth", "WanderAngle"])
    span = F.col("after_t") - F.col("before_t")
    f = F.when(span == 0, F.lit(0.0)).otherwise((F.col("_time") - F.col("before_t")) / span)
    lin = lambda c: F.col(f"before_{c}") * (1 - f) + F.col(f"after_{c}") * f
    ang = lambda c: F.atan2(F.sin(f"before_{c}") * (1 - f) + F.sin(f"after_{c}") * f, F.cos(f"before_{c}") * (1 - f) + F.cos(f"after_{c}") * f)
    j = j.withColumns({"_lon": ang("X"), "_lat": ang("Y"), "_h": lin("Z"), "_r": ang("Roll"), "_p": ang("Pitch"), "_a": ang("Azimuth") - ang("WanderAngle")})
    sr, cr, sp, cp, sa, ca = F.sin("_r"), F.cos("_r"), F.sin("_p"), F.cos("_p"), F.sin("_a"), F.cos("_a")
    rot = [[ca * cp, ca * sp * sr - sa * cr, ca * sp * cr + sa * sr], [sa * cp, sa * sp * sr + ca * cr, sa * sp * cr - ca * sr], [-sp, cp * sr, cp * cr]]
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    s = 1 - e2 * F.sin("_lat") * F.sin("_lat")
    mr, nr = EARTH * (1 - e2) / F.pow(s, F.lit(1.5)) + F.col("_h"), (EARTH / F.sqrt(s) + F.col("_h")) * F.cos("_lat")
    known = F.col("before_t").isNotNull() & F.col("after_t").isNotNull()
    if reverse:
        ned = [(F.radians("Y") - F.col("_lat")) * mr, (F.radians("X") - F.col("_lon")) * nr, F.col("_h") - F.col("Z")]
        new = {c: reduce(lambda a, b: a + b, [rot[k][i] * ned[k] for k in range(3)]) for i, c in enumerate("XYZ")}
    else:
        north, east, down = (reduce(lambda a, b: a + b, [rot[i][k] * F.col(c) for k, c in enumerate("XYZ")]) for i in range(3))
        new = {"X": F.degrees(F.col("_lon") + east / nr), "Y": F.degrees(F.col("_lat") + north / mr), "Z": F.col("_h") - down}
    return j.withColumns({c: F.when(known, v).otherwise(F.col(c)) for c, v in new.items()}).select(*df.columns)


def straighten(df: DataFrame, polyline: list[tuple[float, float, float, float]], offset: float = 0.0, reverse: bool = False) -> DataFrame:
    """Along a track of (x, y, z, roll): X the distance along it + offset, Y the distance aside (left positive), Z the height.

    ``reverse`` brings such coordinates back. The track is a parameter of few vertices.
    """
    segs, along = [], 0.0
    for (ax, ay, az, am), (bx, by, bz, bm) in zip(polyline, polyline[1:]):
        n = math.hypot(bx - ax, by - ay)
        if n:
            segs.append((ax, ay, az, am, (bx - ax) / n, (by - ay) / n, bz - az, bm - am, n, along))
            along += n
    if not segs:
        raise ValueError("a track of two vertices is needed")
    x, y, z = F.col("X"), F.col("Y"), F.col("Z")
    opts = []
    for k, (ax, ay, az, am, ux, uy, dz, dm, n, s0) in enumerate(segs):
        if reverse:
            t = x - offset - s0
            inside = (t >= (-1e300 if k == 0 else 0)) & (t < (1e300 if k == len(segs) - 1 else n))
            roll = am + dm * t / n
            h, v = y * F.cos(roll) - z * F.sin(roll), y * F.sin(roll) + z * F.cos(roll)
            opts.append((inside, F.struct((ax + ux * t - uy * h).alias("X"), (ay + uy * t + ux * h).alias("Y"), (az + dz * t / n + v).alias("Z"))))
        else:
            t = (x - ax) * ux + (y - ay) * uy
            tc = F.least(F.greatest(t, F.lit(0.0)), F.lit(n))
            ex, ey = x - (ax + ux * tc), y - (ay + uy * tc)
            roll = am + dm * tc / n
            h, v = (y - ay) * ux - (x - ax) * uy, z - (az + dz * tc / n)
            opts.append(F.struct((ex * ex + ey * ey).alias("d"), F.lit(k).alias("k"), (s0 + t + offset).alias("X"), (h * F.cos(roll) + v * F.sin(roll)).alias("Y"), (v * F.cos(roll) - h * F.sin(roll)).alias("Z")))
    if reverse:
        best = reduce(lambda acc, o: acc.when(o[0], o[1]), opts[1:], F.when(*opts[0]))
    else:
        best = F.array_min(F.array(*opts))
    return df.withColumn("_s", best).withColumns({c: F.col(f"_s.{c}") for c in "XYZ"}).drop("_s")


def condition_columns(df: DataFrame, where: str) -> Column:
    return condition(where, df.columns)


def numbered(df: DataFrame) -> DataFrame:
    """``pid`` made dense, in its order."""
    return positions(df).withColumn("pid", F.col("pos").cast("bigint")).drop("pos")
