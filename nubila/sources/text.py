"""Text sources and sinks: delimited points, and lines of GeoJSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import SPARK, canonical, rounded, type_of
from ..operators.order import renumbered


def _lines(spark: SparkSession, path: str | list[str], ordered: bool) -> DataFrame:
    d = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("pid"))
    return renumbered(d, F.asc("_f"), F.asc("_s"), F.asc("pid")) if ordered else d


def parse_header(line: str, separator: str | None = None) -> tuple[list[str], str]:
    """(names, separator): quoted or plain names; the separator is the first sign that no name can hold."""
    line = line.strip().rstrip("\r")
    if separator is None:
        bare = re.sub(r'"[^"]*"', "x", line)
        m = re.search(r"[^\w.\"\-]", bare)
        separator = m[0] if m else " "
    if '"' in line:
        names = re.findall(r'"([^"]*)"', line)
    else:
        names = line.split() if separator == " " else [x.strip() for x in line.split(separator)]
    return [canonical(n) for n in names if n], separator


def _head(spark: SparkSession, path: str | list[str], n: int) -> list[str]:
    """The first ``n`` lines of the first file by name that has so many. Spark itself begins with the largest file."""
    d = spark.read.text(path)
    for f in sorted(d.inputFiles()):
        at = re.sub("^file:/*", "file:///", f)  # only this file is listed and read
        rows = d.where(F.regexp_replace("_metadata.file_path", "^file:/*", "file:///") == at).limit(n).collect()
        if len(rows) == n:
            return [r["value"] for r in rows]
    raise ValueError(f"no file of {path} has {n} lines")


def read_text(spark: SparkSession, path: str | list[str], separator: str | None = None, header: str | None = None, skip: int = 0, ordered: bool = True) -> DataFrame:
    """Points of delimited text. Names from ``header`` or the first line behind ``skip``; a field that is no number is 0, a line
    with another number of fields is left out. ``ordered``: pid follows the lines of all files; else it is only unique."""
    line = header if header is not None else _head(spark, path, skip + 1)[skip]
    names, sep = parse_header(line, separator)
    d = _lines(spark, path, False)
    if skip:
        # the first lines of each file, few
        at = F.row_number().over(Window.partitionBy("_f").orderBy("pid"))
        heads = d.where(F.col("_s") == 0).withColumn("_n", at).where(F.col("_n") <= skip).select("pid")
        d = d.join(F.broadcast(heads), "pid", "left_anti")
    if header is None:  # wherever a file repeats it
        d = d.where(F.col("value") != line.rstrip("\r ").rstrip())
    if ordered:
        d = renumbered(d, F.asc("_f"), F.asc("_s"), F.asc("pid"))
    parts = F.split(F.trim("value"), r"\s+" if sep == " " else r"\s*" + re.escape(sep) + r"\s*")
    d = d.withColumn("_p", parts).where(F.size("_p") == len(names))
    cols = []
    for k, n in enumerate(names):
        x = F.coalesce(F.get("_p", F.lit(k)).try_cast("double"), F.lit(0.0))
        t = type_of(n)
        cols.append((x if t == "double" else x.cast("float") if t == "float" else rounded(x).cast(SPARK[t])).alias(n, metadata={"dim_type": t}))
    return d.select("pid", *cols)


def read_pts(spark: SparkSession, path: str) -> DataFrame:
    """PTS: the first line is a count; X Y Z [Intensity + 2048] [Red Green Blue]; other lines are left out, bad numbers are 0."""
    d = _lines(spark, path, True).withColumn("_p", F.split(F.trim("value"), r"\s+"))
    x = lambda k: F.coalesce(F.get("_p", F.lit(k)).try_cast("double"), F.lit(0.0))
    d = d.where(F.size("_p").isin(3, 4, 6, 7))
    n = F.size("_p")
    i = F.when(n.isin(4, 7), rounded(x(3) + 2048)).otherwise(0).cast("int")
    color = lambda k: F.when(n == 7, rounded(x(4 + k))).when(n == 6, rounded(x(3 + k))).otherwise(0).cast("int")
    return d.select("pid", *(x(k).alias(a) for k, a in enumerate("XYZ")), i.alias("Intensity"), *(color(k).alias(c) for k, c in enumerate(("Red", "Green", "Blue"))))


def read_grid(spark: SparkSession, path: str, band: str = "band_1") -> DataFrame:
    """ASCII grid raster: one row a pixel centre. Header of ncols, nrows, xll*, yll*, cellsize [, NODATA_value]."""
    head = {k.lower(): v for k, v in (r["value"].split()[:2] for r in spark.read.text(path).limit(6).collect() if r["value"][:1].isalpha())}
    size, cols, rows = float(head["cellsize"]), int(head["ncols"]), int(head["nrows"])
    half = 0.5 if "xllcorner" in head else 0.0
    x0, y0 = float(head.get("xllcorner", head.get("xllcenter", 0))), float(head.get("yllcorner", head.get("yllcenter", 0)))
    d = _lines(spark, path, True).where(~F.col("value").rlike("^[A-Za-z]"))
    d = renumbered(d.select("pid", "value"), F.asc("pid")).select("pid", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "v"))
    v = F.col("v").try_cast("double")
    out = d.select((F.col("pid") * cols + F.col("i")).alias("pid"), ((F.col("i") + half) * size + x0).alias("X"), ((rows - 1 - F.col("pid") + half) * size + y0).alias("Y"), F.lit(0.0).alias("Z"), v.alias(band))
    return out.where(F.col(band) != float(head["nodata_value"])) if "nodata_value" in head else out


def read_ilvis2(spark: SparkSession, path: str, mapping: str = "all") -> DataFrame:
    """LVIS level 2 text of 12 fields: the low and the high point of a shot, or ('all') both where their heights differ."""
    names = ["LvisLfid", "ShotNumber", "GpsTime", "LongitudeCentroid", "LatitudeCentroid", "ElevationCentroid", "LongitudeLow", "LatitudeLow", "ElevationLow", "LongitudeHigh", "LatitudeHigh", "ElevationHigh"]
    d = _lines(spark, path, True).withColumn("_p", F.split(F.trim("value"), r"\s+")).where((F.size("_p") == 12) & ~F.col("value").startswith("#"))
    d = d.select("pid", *(F.get("_p", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names))).dropna()
    at = lambda k: F.struct(F.col(f"Longitude{k}").alias("X"), F.col(f"Latitude{k}").alias("Y"), F.col(f"Elevation{k}").alias("Z"))
    two = F.when(F.col("ElevationLow") != F.col("ElevationHigh"), F.array(at("Low"), at("High"))).otherwise(F.array(at("Low")))
    points = {"low": F.array(at("Low")), "high": F.array(at("High")), "all": two}[mapping.lower()]
    d = d.select("*", F.posexplode(points).alias("_k", "_s")).select(F.col("pid"), F.col("_k"), "_s.X", "_s.Y", "_s.Z", *names)
    return renumbered(d, F.asc("pid"), F.asc("_k")).drop("_k")


def text_lines(df: DataFrame, order: list[str] | None = None, keep_unspecified: bool = True, precision: int | dict[str, int] = 3, delimiter: str = ",", quote_header: bool = True) -> tuple[str, DataFrame]:
    """(header, one column ``value``): the dimensions in order, numbers with fixed digits."""
    order = [canonical(o) for o in order or []]
    rest = [c for c in df.columns if c not in ("pid", "view_id", *order)]
    names = order + (rest if keep_unspecified or not order else [])
    digits = lambda n: precision.get(n, 3) if isinstance(precision, dict) else precision
    header = delimiter.join(f'"{n}"' if quote_header else n for n in names)
    return header, df.select("pid", F.concat_ws(delimiter, *(F.format_string(f"%.{digits(n)}f", F.col(n).cast("double")) for n in names)).alias("value"))


def write_text(df: DataFrame, path: str, write_header: bool = True, ordered: bool = True, **options) -> None:
    """A folder of text files, in order of their names; the header is the first file's first line.

    A sort by ranges, not one task for all rows.
    """
    header, lines = text_lines(df, **options)
    lines = lines.orderBy("pid") if ordered else lines
    if write_header:
        first = df.sparkSession.createDataFrame([(-(2**62), header)], "pid bigint, value string")
        lines = lines.unionByName(first).orderBy("pid")
    lines.select("value").write.mode("overwrite").text(path)


def geojson_features(df: DataFrame) -> DataFrame:
    """One Feature a row: Point geometry of X, Y, Z, the dimensions as properties."""
    props = F.struct(*(F.col(c) for c in df.columns if c not in ("pid", "view_id")))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("X", "Y", "Z").alias("coordinates")).alias("geometry"), props.alias("properties"))
    return df.select("pid", F.to_json(f).alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    """A folder of GeoJSON lines (a Feature a line)."""
    geojson_features(df).orderBy("pid").select("value").write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Named properties of Features, a Feature a line; what is missing is 0."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("properties", T.StructType([T.StructField(n, T.DoubleType()) for n in names]))])
    d = _lines(spark, path, True).select("pid", F.from_json("value", schema).alias("f"))
    return d.select("pid", *(F.coalesce(f"f.properties.{n}", F.lit(0.0)).alias(n) for n in names))
