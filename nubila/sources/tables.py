"""Synthetic clouds, column files, indexes of files, and sinks that need no format of their own."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import SPARK, canonical, type_of


def faux(spark: SparkSession, count: int = 0, bounds: tuple[float, ...] = (0, 1, 0, 1, 0, 1), mode: str = "constant", mean=(0.0, 0.0, 0.0), stdev=(1.0, 1.0, 1.0), number_of_returns: int = 0, seed: int = 0) -> DataFrame:
    """X, Y, Z, OffsetTime [, ReturnNumber, NumberOfReturns] of made points; bounds are minx, maxx, miny, maxy, minz, maxz.

    constant: the low corner; ramp: evenly from low to high; uniform, normal:
    random by seed; grid: all whole positions of the bounds, x fastest; invalid:
    constant with NaN OffsetTime.
    """
    lo, hi = [float(b) for b in bounds[::2]], [float(b) for b in bounds[1::2]]
    if mode == "grid":
        n = [max(1, int(h - l)) for l, h in zip(lo, hi)]  # noqa: E741
        d = spark.range(n[0] * n[1] * n[2]).withColumnRenamed("id", "pid")
        at = [F.col("pid") % n[0], F.floor(F.col("pid") / n[0]) % n[1], F.floor(F.col("pid") / (n[0] * n[1]))]
        xyz = [at[k] + lo[k] for k in range(3)]
    else:
        d = spark.range(count).withColumnRenamed("id", "pid")
        if mode == "ramp":
            xyz = [F.lit(lo[k]) if count < 2 else lo[k] + F.col("pid") * ((hi[k] - lo[k]) / (count - 1)) for k in range(3)]
        elif mode == "uniform":
            xyz = [F.rand(seed * 3 + k) * (hi[k] - lo[k]) + lo[k] for k in range(3)]
        elif mode == "normal":
            xyz = [F.randn(seed * 3 + k) * float(stdev[k]) + float(mean[k]) for k in range(3)]
        elif mode in ("constant", "invalid"):
            xyz = [F.lit(v) for v in lo]
        else:
            raise ValueError(f"unknown mode {mode!r}")
    d = d.select("pid", *(v.cast("double").alias(a) for a, v in zip("XYZ", xyz)), (F.lit(float("nan")) if mode == "invalid" else F.col("pid")).alias("OffsetTime"))
    if number_of_returns:
        d = d.withColumns({"ReturnNumber": (F.col("pid") % number_of_returns + 1).cast("smallint"), "NumberOfReturns": F.lit(number_of_returns).cast("smallint")})
    return d


def read_columns(spark: SparkSession, path: str, geometry: str = "xyz", **dims: str) -> DataFrame:
    """Parquet of points: columns, or a list / struct / WKB column ``geometry`` that holds the coordinates.

    Renamed columns through ``dims`` (Name='column'); a column that exists keeps its name. ``pid`` is kept where there is one.
    """
    d = spark.read.parquet(path)
    for name, c in dims.items():
        d = d.withColumnRenamed(c, name)
    kind = dict(d.dtypes).get(geometry, "")
    if kind.startswith("array"):
        d = d.withColumns({a: F.coalesce(F.get(geometry, F.lit(k)).cast("double"), F.lit(0.0)) for k, a in enumerate("XYZ")}).drop(geometry)
    elif kind.startswith("struct"):
        d = d.withColumns({a: F.col(f"{geometry}.{a.lower()}").cast("double") for a in "XYZ"}).drop(geometry)
    elif kind == "binary":
        d = from_wkb(d, geometry).drop(geometry)
    d = d.toDF(*(canonical(c) if c not in ("pid", "view_id") else c for c in d.columns))
    return d if "pid" in d.columns else d.withColumn("pid", F.monotonically_increasing_id())


def from_wkb(df: DataFrame, column: str) -> DataFrame:
    """X, Y, Z of points in WKB of either byte order, Arrow batches through NumPy."""
    schema = df.select("*", *(F.lit(0.0).alias(a) for a in "XYZ")).schema

    def run(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), 3))
            for k, b in enumerate(pdf[column]):
                if b is not None:
                    v = np.frombuffer(b[5:29], "<f8" if b[0] == 1 else ">f8")
                    out[k, : len(v)] = v
            yield pdf.assign(X=out[:, 0], Y=out[:, 1], Z=out[:, 2])

    return df.mapInPandas(run, schema)


def write_columns(df: DataFrame, path: str, geometry: str | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet; ``geometry`` 'xyz': a list of the coordinates instead of three columns, 'wkb': points in WKB."""
    if geometry == "xyz":
        df = df.withColumn("xyz", F.array("X", "Y", "Z")).drop("X", "Y", "Z")
    elif geometry == "wkb":
        schema = df.drop("X", "Y", "Z").select("*", F.lit(b"").alias("wkb")).schema

        def run(batches):
            for pdf in batches:
                raw = np.zeros(len(pdf), np.dtype([("o", "u1"), ("t", "<u4"), ("c", "<f8", 3)]))
                raw["o"], raw["t"], raw["c"] = 1, 1001, pdf[["X", "Y", "Z"]].to_numpy()
                yield pdf.drop(columns=["X", "Y", "Z"]).assign(wkb=[r.tobytes() for r in raw])

        df = df.mapInPandas(run, schema)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_feather(df: DataFrame, path: str) -> None:
    """Feather (Arrow IPC) files, one a task, in a folder."""
    import os

    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        c = TaskContext.get()
        name = os.path.join(folder, f"part-{c.partitionId():05d}.feather")
        rows, sink = 0, None
        for b in batches:
            if sink is None:
                sink = pa.ipc.new_file(f"{name}.{c.taskAttemptId()}.tmp", b.schema)
            sink.write_batch(b)
            rows += b.num_rows
        if sink is not None:
            sink.close()
            os.replace(f"{name}.{c.taskAttemptId()}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.mapInArrow(run, "rows bigint").write.format("noop").mode("overwrite").save()


def write_null(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_grid(cells: DataFrame, path: str, value: str, resolution: float, origin: tuple[float, float], nodata: float = -9999.0) -> None:
    """An ASCII grid of (i, j, value), as a folder of text in order: a row of the grid a line, the top first.

    Each line is one group of at most a row's cells.
    """
    spark = cells.sparkSession
    b = cells.agg(F.max("i"), F.max("j")).first()
    if b[0] is None:
        return
    cols, rows = int(b[0]) + 1, int(b[1]) + 1
    lines = cells.groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("i", value))).alias("m"))
    lines = spark.range(rows).withColumnRenamed("id", "j").join(lines, "j", "left")
    cell = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda k: F.format_string("%s", F.coalesce(F.try_element_at("m", k.cast("bigint")), F.lit(nodata))))
    text = lines.select((rows - F.col("j")).alias("o"), F.concat_ws(" ", cell).alias("value"))
    head = f"ncols {cols}\nnrows {rows}\nxllcorner {origin[0]}\nyllcorner {origin[1]}\ncellsize {resolution}\nNODATA_value {nodata}"
    first = spark.createDataFrame([(0, head)], "o bigint, value string")
    text.unionByName(first).orderBy("o").select("value").coalesce(1).write.mode("overwrite").text(path)


def tile_index(clouds: dict[str, DataFrame]) -> DataFrame:
    """(location, count, minx ... maxz) of named clouds, one aggregation each, joined by union."""
    from ..operators.stats import info

    out = None
    for name, c in clouds.items():
        one = info(c.drop("view_id")).select(F.lit(name).alias("location"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def indexed_files(index: DataFrame, bounds: tuple[float, float, float, float] | None = None, where: str | None = None, location: str = "location") -> list[str]:
    """Files of an index whose box meets ``bounds`` (minx, maxx, miny, maxy) and that fit a SQL condition: what to read at all."""
    d = index
    if bounds:
        d = d.where((F.col("minx") <= bounds[1]) & (F.col("maxx") >= bounds[0]) & (F.col("miny") <= bounds[3]) & (F.col("maxy") >= bounds[2]))
    if where:
        d = d.where(where)
    return [r[0] for r in d.select(location).distinct().orderBy(location).collect()]


def stac_items(spark: SparkSession, path: str, *, items: list[str] | None = None, collections: list[str] | None = None, bounds: tuple[float, float, float, float] | None = None, dates: list[tuple[str, str]] | None = None, properties: dict[str, str] | None = None, assets: tuple[str, ...] = ("data",)) -> DataFrame:
    """(id, href) of the matching items of catalogue JSON files (items, or collections of features): id and property patterns,
    boxes that meet, date ranges. JSON is read with its own schema, rows are files or features."""
    raw = spark.read.option("wholetext", True).text(path)
    feature = "struct<id:string,collection:string,bbox:array<double>,properties:map<string,string>,assets:map<string,struct<href:string>>>"
    d = raw.select(F.from_json("value", f"struct<type:string,features:array<{feature}>>").alias("c"), F.from_json("value", feature).alias("f"))
    d = d.select(F.explode(F.when(F.col("c.type") == "FeatureCollection", F.col("c.features")).otherwise(F.array("f"))).alias("f")).select("f.*").where("id is not null")
    matches = lambda c, ps: c.rlike("|".join(f"^(?:{p})$" for p in ps))
    if items:
        d = d.where(matches(F.col("id"), items))
    if collections:
        d = d.where(matches(F.col("collection"), collections))
    if bounds:
        n = F.size("bbox") / 2
        g = lambda k: F.get("bbox", k.cast("int"))
        d = d.where((g(F.lit(0)) <= bounds[1]) & (g(n) >= bounds[0]) & (g(F.lit(1)) <= bounds[3]) & (g(n + 1) >= bounds[2]))
    for p, pattern in (properties or {}).items():
        d = d.where(F.col("properties")[p].rlike(pattern))
    if dates:
        t = F.col("properties")["datetime"]
        cond = F.lit(False)
        for a, b in dates:
            cond = cond | t.between(a, b)
        d = d.where(cond)
    return d.select("id", F.explode(F.array(*(F.lit(a) for a in assets))).alias("asset"), "assets").select("id", F.col("assets")[F.col("asset")]["href"].alias("href")).where("href is not null")


def from_memory(spark: SparkSession, data: dict[str, np.ndarray]) -> DataFrame:
    """A cloud of arrays of one length (grids are read row by row)."""
    import pandas as pd

    pdf = pd.DataFrame({canonical(k): np.asarray(v).ravel() for k, v in data.items()})
    pdf.insert(0, "pid", np.arange(len(pdf)))
    d = spark.createDataFrame(pdf)
    return d.withColumns({c: F.col(c).cast(SPARK[type_of(c)]) for c in d.columns if c != "pid" and type_of(c) != "double"})


def read_jdbc(spark: SparkSession, url: str, table: str, where: str | None = None, **options) -> DataFrame:
    """A table of points of a database, one row a point; ``where`` is evaluated there."""
    d = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return d.where(where) if where else d


def load_json(text: str) -> dict | list:
    """JSON with // and /* */ comments outside of strings."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(out)
