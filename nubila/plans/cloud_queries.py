"""Queries of the point-cloud operators over all located points, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import as_cloud
from ..functions.numbers import with_location
from ..operators import assign, features, ground, mesh, neighborhood, order, partition, register, sample, select, stats
from ..session import read, shared_dir
from ..sources import binary, tables, text
from ..streaming import operators as streaming
from .data_queries import LOCATED_SQL, P1_FOUND_SQL
from .pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CLOUD = f"""{LOCATED_SQL.strip()},
  cloud AS (SELECT pid, l.x AS X, l.y AS Y, l.z AS Z, coalesce(f.file_id, 0) AS OriginId,
  coalesce(f.classification, 0) AS Classification, coalesce(f.gpstime, 0) AS GpsTime, coalesce(f.pointsourceid, 0) AS PointSourceId,
  pid % 3 + 1 AS ReturnNumber, greatest(pid % 3 + 1, pid % 4 + 1) AS NumberOfReturns, CASE WHEN pid % 97 = 0 THEN 1 ELSE 0 END AS EdgeOfFlightLine
  FROM located l JOIN point_features f USING (pid))"""
SMALL = f"""{CLOUD}, small AS (SELECT pid, round((X - 412000) * 100) AS X, round((Y - 5207000) * 100) AS Y, round(Z * 100) AS Z,
  CASE WHEN Classification = 2 THEN 2 ELSE 1 END AS Classification, PointSourceId FROM cloud)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points with a location."""
    p = with_location(read(spark, sf_dir, "point_features")).dropna(subset=["x", "y", "z"])
    return as_cloud(p, "pid", X="x", Y="y", Z="z", OriginId="file_id", Classification="classification", GpsTime="gpstime", PointSourceId="pointsourceid", ReturnNumber="pid % 3 + 1", NumberOfReturns="greatest(pid % 3 + 1, pid % 4 + 1)", EdgeOfFlightLine="if(pid % 97 = 0, 1, 0)")


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points in whole centimetres from a corner, so that distances and their ties are exact."""
    p = with_location(read(spark, sf_dir, "point_features")).dropna(subset=["x", "y", "z"])
    return as_cloud(p, "pid", X="rint((x - 412000) * 100)", Y="rint((y - 5207000) * 100)", Z="rint(z * 100)", OriginId="file_id", Classification="if(classification = 2, 2, 1)", PointSourceId="pointsourceid")


def query(name: str, sql: str | None = None, of: Callable = cloud):
    """Register ``f(cloud)`` as a query; ``sql`` begins behind the table expressions."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(of(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {CLOUD if of is cloud else SMALL}" + (", " + sql if " AS (" in sql.split("SELECT")[0] else " " + sql)
        return f

    return add


def r6(*cols: str):
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]


# ---- selection --------------------------------------------------------------

query("expression", "SELECT pid, X, Y, Z FROM cloud WHERE (Z > 150 AND Z < 400 AND Classification = 2) OR PointSourceId = 17")(
    lambda c: select.expression(c, "(Z > 150 && Z < 400 && Classification == 2) || PointSourceId == 17").select("pid", "X", "Y", "Z")
)
query("expression_views", "SELECT CAST(0 AS BIGINT) AS view_id, pid FROM cloud WHERE Z > 200 UNION ALL SELECT 1, pid FROM cloud WHERE Classification = 2")(
    lambda c: select.expression(c, "Z > 200", "Classification == 2").select(F.col("view_id").cast("bigint"), "pid")
)
query("range", "SELECT pid FROM cloud WHERE Z BETWEEN 100 AND 200 AND (Classification BETWEEN 2 AND 5 OR Classification = 9) AND NOT (PointSourceId >= 10 AND PointSourceId < 20)")(
    lambda c: select.range_filter(c, "Z[100:200],Classification[2:5],Classification[9:9],PointSourceId![10:20)").select("pid")
)
query("mongo", "SELECT pid FROM cloud WHERE (Z > 300 OR Classification IN (2, 5)) AND NOT (PointSourceId = 17)")(
    lambda c: select.mongo(c, {"$and": [{"$or": [{"Z": {"$gt": 300}}, {"Classification": {"$in": [2, 5]}}]}, {"$not": {"PointSourceId": {"$eq": 17}}}]}).select("pid")
)
query("crop_box", "SELECT pid FROM cloud WHERE X BETWEEN 412050 AND 414650 AND Y BETWEEN 5207000 AND 5207800")(lambda c: select.crop(c, bounds=[412050, 414650, 5207000, 5207800]).select("pid"))
query("crop_circle", "SELECT pid FROM cloud WHERE NOT ((X - 412100) * (X - 412100) + (Y - 5207100) * (Y - 5207100) < 10000)")(
    lambda c: select.crop(c, points=[[412100, 5207100]], distance=100, outside=True).select("pid")
)
query("crop_polygon", "SELECT pid FROM cloud WHERE X + Y <= 5622000 AND X >= 412000.001 AND Y >= 5207000.001 AND NOT (X + Y <= 5619300 AND X >= 412050.001 AND Y >= 5207050.001)")(
    lambda c: select.crop(c, polygons=["POLYGON ((412000.001 5207000.001, 414999.999 5207000.001, 412000.001 5209999.999), (412050.001 5207050.001, 412249.999 5207050.001, 412050.001 5207249.999))"]).select("pid")
)
query("crop_views", "SELECT CAST(0 AS BIGINT) AS view_id, pid FROM cloud WHERE X BETWEEN 412000 AND 413000 AND Y BETWEEN 5207000 AND 5210000 UNION ALL SELECT 1, pid FROM cloud WHERE X BETWEEN 412500 AND 420000 AND Y BETWEEN 5207000 AND 5210000")(
    lambda c: select.crop(c, bounds=[[412000, 413000, 5207000, 5210000], [412500, 420000, 5207000, 5210000]]).select(F.col("view_id").cast("bigint"), "pid")
)
query("head", "SELECT pid FROM cloud ORDER BY pid LIMIT 100")(lambda c: select.head(c, 100).select("pid"))
query("head_invert", "SELECT pid FROM cloud ORDER BY pid OFFSET 100")(lambda c: select.head(c, 100, invert=True).select("pid"))
query("tail", "SELECT pid FROM cloud ORDER BY pid DESC LIMIT 50")(lambda c: select.tail(c, 50).select("pid"))
query("tail_invert", "SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY pid DESC) AS r FROM cloud) WHERE r > 50")(lambda c: select.tail(c, 50, invert=True).select("pid"))
query("decimation", "p AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS pos, count(*) OVER () AS n FROM cloud), k AS (SELECT unnest(range(CAST(floor((max(n) - 3) / 4.2 + 0.5) AS BIGINT))) AS k FROM p) SELECT pid FROM p WHERE pos IN (SELECT 3 + CAST(floor(k * 4.2::DOUBLE + 0.5) AS BIGINT) FROM k)")(
    lambda c: select.decimation(c, 4.2, 3).select("pid")
)
query("returns", "SELECT pid, CAST(CASE WHEN NumberOfReturns <= 1 THEN 3 WHEN ReturnNumber = 1 THEN 0 ELSE 2 END AS BIGINT) AS view_id FROM cloud WHERE NumberOfReturns <= 1 OR ReturnNumber = 1 OR ReturnNumber = NumberOfReturns")(
    lambda c: select.returns(c, ["first", "last", "only"]).select("pid", F.col("view_id").cast("bigint"))
)
query("locate", "SELECT pid, Z FROM cloud ORDER BY Z DESC, pid LIMIT 1")(lambda c: select.locate(c, "Z").select("pid", "Z"))
query("iqr", "q AS (SELECT list_sort(list(Z)) AS l FROM cloud), b AS (SELECT l[CAST(floor(len(l) * 0.25) AS INT) + 1] AS lo, l[CAST(floor(len(l) * 0.75) AS INT) + 1] AS hi FROM q) SELECT pid FROM cloud, b WHERE Z > lo - 1.5 * (hi - lo) AND Z < hi + 1.5 * (hi - lo)")(
    lambda c: select.iqr(c, "Z").select("pid")
)
query("mad", "q AS (SELECT list_sort(list(Z)) AS l FROM cloud), m AS (SELECT l[len(l) // 2 + 1] AS med FROM q), d AS (SELECT pid, abs(Z - med) AS dev FROM cloud, m), e AS (SELECT list_sort(list(dev)) AS l FROM d), f AS (SELECT l[len(l) // 2 + 1] AS mad FROM e) SELECT pid FROM d, f WHERE dev / (mad * 1.4862) < 2")(
    lambda c: select.mad(c, "Z").select("pid")
)

# ---- columns ----------------------------------------------------------------

query("assign", "SELECT pid, CASE WHEN Z > 200 THEN 6 ELSE Classification END AS Classification, round(CASE WHEN Z > 0 THEN ln(Z) / (X - 412000) ELSE 0 END, 6) AS Ratio FROM cloud")(
    lambda c: assign.assign(c, "Classification = 6 WHERE Z > 200", "Ratio = log(Z) / (X - 412000) WHERE Z > 0").select("pid", F.col("Classification").cast("int"), *r6("Ratio"))
)
SQL["assign"] = SQL["assign"].replace("6 ELSE Classification END AS", "6 ELSE CAST(Classification AS INT) END AS")
query("ferry", "SELECT pid, Z AS Height, 0.0::DOUBLE AS Empty FROM cloud")(lambda c: assign.ferry(c, "Z=>Height, =>Empty").select("pid", "Height", "Empty"))
query("transformation", "SELECT pid, round(-Y + 10, 6) AS X, round(X - 5, 6) AS Y, round(2 * Z + 1, 6) AS Z FROM cloud")(
    lambda c: assign.transformation(c, "0 -1 0 10 1 0 0 -5 0 0 2 1 0 0 0 1").select("pid", *r6("X", "Y", "Z"))
)
query("gpstimeconvert", "SELECT pid, round(GpsTime + date_diff('day', DATE '1980-01-06', DATE '2024-06-20') // 7 * 604800.0::DOUBLE - 1000000000.0::DOUBLE, 6) AS GpsTime FROM cloud")(
    lambda c: assign.gpstimeconvert(c, "gws", "gst", start_date="2024-06-20").select("pid", *r6("GpsTime"))
)
query("colorinterp", "SELECT pid, CAST(CASE WHEN Z BETWEEN 100 AND 300 THEN least(floor((Z - 100) / 200 * 256), 255) ELSE 0 END AS INT) AS Red FROM cloud")(
    lambda c: assign.colorinterp(c, "Z", 100, 300, ramp=[(0, 0, 0), (255, 255, 255)]).select("pid", "Red")
)
GRID = "g AS (SELECT CAST(floor((X - 412000) / 200) AS BIGINT) AS i, CAST(floor((Y - 5207000) / 200) AS BIGINT) AS j, min(Z) AS value FROM cloud WHERE PointSourceId <> 17 GROUP BY 1, 2)"


def _grid(c: DataFrame) -> DataFrame:
    return c.where("PointSourceId <> 17").groupBy(F.floor((F.col("X") - 412000) / 200).alias("i"), F.floor((F.col("Y") - 5207000) / 200).alias("j")).agg(F.min("Z").alias("value"))


AT = "CAST(floor((c.X - 412000) / 200) AS BIGINT) = g.i AND CAST(floor((c.Y - 5207000) / 200) AS BIGINT) = g.j"
query("dem", f"{GRID} SELECT c.pid FROM cloud c JOIN g ON {AT} WHERE Z BETWEEN value - 1 AND value + 20")(lambda c: select.dem(c, _grid(c), (412000, 5207000), (200, 200), "Z", 1, 20).select("pid"))
query("hag_dem", f"{GRID} SELECT c.pid, round(CASE WHEN Classification = 2 THEN 0 WHEN value IS NULL THEN 0 ELSE greatest(Z - value, 0) END, 6) AS HeightAboveGround FROM cloud c LEFT JOIN g ON {AT}")(
    lambda c: assign.hag_dem(c, _grid(c), (412000, 5207000), (200, 200)).select("pid", *r6("HeightAboveGround"))
)
query("colorization", f"{GRID} SELECT c.pid, round(coalesce(value * 2, 0), 6) AS Red FROM cloud c LEFT JOIN g ON {AT}")(
    lambda c: assign.colorization(c, {"Red": _grid(c)}, (412000, 5207000), (200, 200), {"Red": 2.0}).select("pid", *r6("Red"))
)
query("geomdistance", "SELECT pid, round(sqrt(pow(greatest(412000 - X, X - 413000, 0), 2) + pow(greatest(5207000 - Y, Y - 5207500, 0), 2)), 6) AS distance FROM cloud")(
    lambda c: assign.geomdistance(c, "POLYGON ((412000 5207000, 413000 5207000, 413000 5207500, 412000 5207500, 412000 5207000))").select("pid", *r6("distance"))
)
query("straighten")(lambda c: assign.straighten(c, [(412000, 5207000, 100, 0), (415000, 5208000, 120, 0.1), (420000, 5209000, 110, 0)]).select("pid", *r6("X", "Y", "Z")))
query("reprojection")(lambda c: assign.reprojection(c, "EPSG:32632", "EPSG:3857").select("pid", *(F.round(a, 3).alias(a) for a in "XYZ")))
query("georeference")(lambda c: assign.georeference(c.select("pid", "X", "Y", "Z", "GpsTime"), _track(c)).select("pid", *r6("X", "Y", "Z")))
QUERIES["overlay"] = lambda spark, sf_dir: assign.overlay(cloud(spark, sf_dir), read(spark, sf_dir, "regions"), "Zone", "cls").select("pid", F.col("Zone").cast("bigint"))
SQL["overlay"] = P1_FOUND_SQL.split("SELECT 'near'")[0].rstrip() + """,
inside AS (SELECT o.pid, min(o.region_id) AS region_id FROM crossed o JOIN regions g USING (region_id) WHERE g.cls IS NOT NULL AND o.place = 1
  AND NOT EXISTS (SELECT 1 FROM crossed h WHERE h.place > 1 AND h.region_id = o.region_id AND h.part = o.part AND h.pid = o.pid) GROUP BY o.pid)
SELECT pid, CAST(coalesce(g.cls, 0) AS BIGINT) AS Zone FROM located LEFT JOIN inside USING (pid) LEFT JOIN regions g ON g.region_id = inside.region_id"""


def _track(c: DataFrame) -> DataFrame:
    t = c.sparkSession.range(0, 605).selectExpr("cast(id * 1000 as double) GpsTime", "0.1 + id * 1e-6 X", "0.8 + id * 1e-6 Y", "500.0D + id Z", "0.01D Roll", "0.02D Pitch", "id * 0.001 Azimuth", "0.0D WanderAngle")
    return t


query("asof_join", "t AS (SELECT range * 1000.0::DOUBLE AS t, range AS v FROM range(0, 605)), m AS (SELECT pid, floor(GpsTime / 1000) AS b, GpsTime FROM cloud) SELECT pid, CAST(CASE WHEN b < 605 THEN b ELSE 604 END AS BIGINT) AS before_v, CAST(CASE WHEN GpsTime = b * 1000 THEN b ELSE b + 1 END AS BIGINT) AS after_v FROM m")(
    lambda c: assign.asof(c.select("pid", "GpsTime"), c.sparkSession.range(0, 700).selectExpr("cast(id * 1000 as double) t", "id v"), "GpsTime", "t", ["v"]).select("pid", "before_v", "after_v")
)

# ---- order and partition ------------------------------------------------------

query("sort", "SELECT row_number() OVER (ORDER BY Z, Classification, pid) - 1 AS pid, Classification::INT AS Classification, Z FROM cloud")(lambda c: order.sort(c, "Classification", "Z").select("pid", F.col("Classification").cast("int"), "Z"))
query("randomize")(lambda c: order.randomize(c, 7).select("pid", "X", "Y", "Z"))
query("mortonorder", "b AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM cloud), q AS (SELECT cloud.*, CAST(floor((X - x0) / (x1 - x0) * 2147483647) AS BIGINT) AS qx, CAST(floor((Y - y0) / (y1 - y0) * 2147483647) AS BIGINT) AS qy FROM cloud, b), m AS (SELECT pid, X, Y, list_sum(list_transform(range(31), lambda k: (((qx >> k) & 1) << (2 * k)) + (((qy >> k) & 1) << (2 * k + 1)))) AS code FROM q) SELECT row_number() OVER (ORDER BY code, pid) - 1 AS pid, X, Y FROM m")(
    lambda c: order.mortonorder(c).select("pid", "X", "Y")
)
query("mortonorder_reverse", "b AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1, CAST(floor(log2(floor(sqrt(count(*))))) AS BIGINT) + 1 AS bits FROM cloud), q AS (SELECT cloud.*, bits, CAST(floor((X - x0) / (x1 - x0) * ((1::BIGINT << bits) - 1)) AS BIGINT) AS qx, CAST(floor((Y - y0) / (y1 - y0) * ((1::BIGINT << bits) - 1)) AS BIGINT) AS qy FROM cloud, b), m AS (SELECT pid, X, Y, list_sum(list_transform(range(bits), lambda k: (((qx >> k) & 1) << (2 * bits - 1 - 2 * k)) + (((qy >> k) & 1) << (2 * bits - 2 - 2 * k)))) AS code FROM q) SELECT row_number() OVER (ORDER BY code, pid) - 1 AS pid, X, Y FROM m")(lambda c: order.mortonorder(c, reverse=True).select("pid", "X", "Y"))
query("groupby", "SELECT pid, dense_rank() OVER (ORDER BY PointSourceId) - 1 AS view_id FROM cloud")(lambda c: partition.groupby(c, "PointSourceId").select("pid", F.col("view_id").cast("bigint")))
query("divider_partition", "p AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS pos, count(*) OVER () AS n FROM cloud) SELECT pid, CAST(pos // CAST(ceil(n / 7) AS BIGINT) AS BIGINT) AS view_id FROM p")(lambda c: partition.divider(c, "partition", count=7).select("pid", F.col("view_id").cast("bigint")))
query("divider_round_robin", "SELECT pid, (row_number() OVER (ORDER BY pid) - 1) % 5 AS view_id FROM cloud")(lambda c: partition.divider(c, "round_robin", count=5).select("pid", F.col("view_id").cast("bigint")))
query("divider_expression", "p AS (SELECT pid, sum(CASE WHEN Classification = 9 THEN 1 ELSE 0 END) OVER (ORDER BY pid) AS s FROM cloud) SELECT pid, CAST(s - (SELECT s FROM p ORDER BY pid LIMIT 1) AS BIGINT) AS view_id FROM p")(lambda c: partition.divider(c, expression="Classification == 9").select("pid", F.col("view_id").cast("bigint")))
query("splitter", "SELECT pid, CAST(CASE WHEN X < 415000 THEN ceil((X - 415000) / 500) - 1 ELSE floor((X - 415000) / 500) END AS INT) AS tile_x, CAST(CASE WHEN Y < 5209000 THEN ceil((Y - 5209000) / 500) - 1 ELSE floor((Y - 5209000) / 500) END AS INT) AS tile_y FROM cloud")(
    lambda c: partition.splitter(c, 500, 415000, 5209000).select("pid", "tile_x", "tile_y")
)
query("splitter_buffer", "t AS (SELECT pid, X - 412000 AS dx, Y - 5207000 AS dy, floor((X - 412000) / 500) AS tx, floor((Y - 5207000) / 500) AS ty FROM cloud), s AS (SELECT *, CASE WHEN dx - tx * 500 < 20 THEN -1 WHEN (tx + 1) * 500 - dx < 20 THEN 1 ELSE 0 END AS sx, CASE WHEN dy - ty * 500 < 20 THEN -1 WHEN (ty + 1) * 500 - dy < 20 THEN 1 ELSE 0 END AS sy FROM t) SELECT pid, CAST(tx AS INT) AS tile_x, CAST(ty AS INT) AS tile_y FROM s UNION ALL SELECT pid, CAST(tx + sx AS INT), CAST(ty AS INT) FROM s WHERE sx <> 0 UNION ALL SELECT pid, CAST(tx AS INT), CAST(ty + sy AS INT) FROM s WHERE sy <> 0 UNION ALL SELECT pid, CAST(tx + sx AS INT), CAST(ty + sy AS INT) FROM s WHERE sx <> 0 AND sy <> 0")(
    lambda c: partition.splitter(c, 500, 412000, 5207000, 20).select("pid", "tile_x", "tile_y")
)
query("chipper")(lambda c: partition.chipper(c, 1000).groupBy("view_id").agg(F.count(F.lit(1)).alias("count")))
query("separatescanline", "p AS (SELECT pid, coalesce(sum(EdgeOfFlightLine) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cloud) SELECT pid, CAST(floor(s / 2) AS BIGINT) AS view_id FROM p")(lambda c: partition.separatescanline(c, 2).select("pid", F.col("view_id").cast("bigint")))
query("merge", "n AS (SELECT count(*) AS n FROM cloud) SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, X, GpsTime FROM cloud UNION ALL SELECT n + row_number() OVER (ORDER BY pid) - 1, X, 0 FROM cloud, n WHERE Classification = 2")(
    lambda c: partition.merge(c.select("pid", "X", "GpsTime"), c.where("Classification = 2").select("pid", "X")).select("pid", "X", "GpsTime")
)

# ---- sampling -----------------------------------------------------------------

FIRST = "o AS (SELECT X AS ox, Y AS oy, Z AS oz FROM cloud ORDER BY pid LIMIT 1)"
query("voxeldownsize", f"{FIRST}, v AS (SELECT pid, row_number() OVER (PARTITION BY floor((X - (ox - 25)) / 50), floor((Y - (oy - 25)) / 50), floor((Z - (oz - 25)) / 50) ORDER BY pid) AS r FROM cloud, o) SELECT pid FROM v WHERE r = 1")(lambda c: sample.voxeldownsize(c, 50, "first").select("pid"))
query("voxelcenternearestneighbor", "o AS (SELECT min(X) AS ox, min(Y) AS oy, min(Z) AS oz FROM cloud), v AS (SELECT pid, floor((X - ox) / 50) AS a, floor((Y - oy) / 50) AS b, floor((Z - oz) / 50) AS c, X - ox AS dx, Y - oy AS dy, Z - oz AS dz FROM cloud, o), w AS (SELECT pid, row_number() OVER (PARTITION BY a, b, c ORDER BY round(pow(dx - (a + 0.5) * 50, 2) + pow(dy - (b + 0.5) * 50, 2) + pow(dz - (c + 0.5) * 50, 2), 4), pid) AS r FROM v) SELECT count(*) AS n, CAST(sum(pid) AS BIGINT) AS ids FROM w WHERE r = 1")(
    lambda c: sample.voxelcenternearestneighbor(c, 50).agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("ids"))
)
query("voxelcentroidnearestneighbor", f"{FIRST}, v AS (SELECT pid, floor((X - ox) / 50) AS a, floor((Y - oy) / 50) AS b, floor((Z - oz) / 50) AS c, X - ox AS dx, Y - oy AS dy, Z - oz AS dz FROM cloud, o), m AS (SELECT *, count(*) OVER w AS n, avg(dx) OVER w AS mx, avg(dy) OVER w AS my, avg(dz) OVER w AS mz FROM v WINDOW w AS (PARTITION BY a, b, c)), d AS (SELECT pid, a, b, c, n, CASE WHEN n > 2 THEN pow(dx - mx, 2) + pow(dy - my, 2) + pow(dz - mz, 2) ELSE pow(dx - (a + 0.5) * 50, 2) + pow(dy - (b + 0.5) * 50, 2) + pow(dz - (c + 0.5) * 50, 2) END AS d FROM m), r AS (SELECT pid, row_number() OVER (PARTITION BY a, b, c ORDER BY round(d, 4), CASE WHEN n = 2 THEN -pid ELSE pid END) AS r FROM d) SELECT pid FROM r WHERE r = 1")(
    lambda c: sample.voxelcentroidnearestneighbor(c, 50).select("pid")
)
query("griddecimation", "o AS (SELECT min(X) AS ox, min(Y) AS oy FROM cloud), g AS (SELECT pid, Classification, row_number() OVER (PARTITION BY floor((X - ox) / 100), floor((Y - oy) / 100) ORDER BY Z DESC, pid) AS r FROM cloud, o) SELECT pid, CAST(CASE WHEN r = 1 THEN 64 ELSE Classification END AS INT) AS Classification FROM g")(
    lambda c: sample.griddecimation(c, 100, "max", "Classification = 64").select("pid", F.col("Classification").cast("int"))
)
query("label_duplicates", "SELECT pid, CAST(coalesce(CASE WHEN Classification = lag(Classification) OVER (ORDER BY pid) AND PointSourceId = lag(PointSourceId) OVER (ORDER BY pid) THEN 1 ELSE 0 END, 0) AS INT) AS Duplicate FROM cloud")(
    lambda c: sample.label_duplicates(c, "Classification", "PointSourceId").select("pid", "Duplicate")
)
query("sample", of=small)(lambda c: sample.sample(c, 500).select("pid"))
query("fps", of=small)(lambda c: sample.fps(c, 40).select("pid"))
query("relaxationdartthrowing", of=small)(lambda c: sample.relaxationdartthrowing(c, 60, 5000.0, 0.7).select("pid"))

# ---- statistics -----------------------------------------------------------------

query("stats", " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(*) AS count, min({d})::DOUBLE AS minimum, max({d})::DOUBLE AS maximum, round(avg({d}), 5) AS average, round(var_samp({d} - {o}), 3) AS variance, round(skewness({d} - {o}), 5) AS skewness, round(kurtosis({d} - {o}), 5) AS kurtosis FROM cloud" for d, o in (("X", 412000), ("Z", 0), ("Classification", 0))))(
    lambda c: stats.stats(c, ["X", "Z", "Classification"], advanced=True).select("dimension", "count", "minimum", "maximum", F.round("average", 5).alias("average"), F.round("variance", 3).alias("variance"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))
)
query("stats_global", "q AS (SELECT list_sort(list(Z)) AS l FROM cloud), m AS (SELECT l[len(l) // 2 + 1] AS med FROM q), e AS (SELECT list_sort(list(abs(Z - med))) AS l FROM cloud, m) SELECT 'Z' AS dimension, med AS median, round(e.l[len(e.l) // 2 + 1], 6) AS mad FROM e, m")(
    lambda c: stats.stats(c, ["Z"], robust=["Z"]).select("dimension", "median", *r6("mad"))
)
query("stats_views", "SELECT dense_rank() OVER (ORDER BY PointSourceId) - 1 AS view_id, n AS count, lo AS minimum, hi AS maximum FROM (SELECT PointSourceId, count(*) AS n, min(Z) AS lo, max(Z) AS hi FROM cloud GROUP BY 1)")(
    lambda c: stats.stats(partition.groupby(c, "PointSourceId"), ["Z"]).select(F.col("view_id").cast("bigint"), "count", "minimum", "maximum")
)
query("stats_enumerate", "SELECT Classification::DOUBLE AS value, count(*) AS count FROM cloud GROUP BY 1")(lambda c: stats.enumerate_values(c, "Classification"))
query("expressionstats", "SELECT 'Z > 200' AS expression, Classification::DOUBLE AS value, count(*) AS count FROM cloud WHERE Z > 200 GROUP BY 2 UNION ALL SELECT 'PointSourceId == 17', Classification::DOUBLE, count(*) FROM cloud WHERE PointSourceId = 17 GROUP BY 2")(
    lambda c: stats.expressionstats(c, "Classification", "Z > 200", "PointSourceId == 17")
)
query("info", "SELECT count(*) AS num_points, min(X) AS minx, max(X) AS maxx, min(Y) AS miny, max(Y) AS maxy, min(Z) AS minz, max(Z) AS maxz FROM cloud")(lambda c: stats.info(c).select("num_points", "minx", "maxx", "miny", "maxy", "minz", "maxz"))
query("info_query", "SELECT pid, round(pow(X - 415000, 2) + pow(Y - 5208000, 2) + pow(Z - 150, 2), 4) AS d2 FROM cloud ORDER BY pow(X - 415000, 2) + pow(Y - 5208000, 2) + pow(Z - 150, 2), pid LIMIT 10")(lambda c: stats.query_nearest(c, [415000, 5208000, 150], 10).select("pid", F.round("d2", 4).alias("d2")))
HEX = "h AS (SELECT 100 * sqrt(3) AS h), p AS (SELECT X - 412000 AS x, Y - 5207000 AS y, h, floor((X - 412000) / 150) AS c0 FROM cloud, h), n AS (SELECT x, y, h, c0 + k AS c, CASE WHEN CAST(c0 + k AS BIGINT) % 2 = 0 THEN 0 ELSE h / 2 END AS lift, row_number() OVER () AS id, c0 + k = c0 AS own FROM p, (SELECT unnest([0, 1]) AS k)), d AS (SELECT x, y, c, floor((y - lift) / h + 0.5) AS j, pow(x - c * 150, 2) + pow(y - (floor((y - lift) / h + 0.5) * h + lift), 2) AS d FROM n), b AS (SELECT x, y, arg_min(c, d) AS c, arg_min(j, d) AS j, count(*) // 2 AS k FROM d GROUP BY x, y) SELECT CAST(c AS BIGINT) AS hex_i, CAST(j AS BIGINT) AS hex_j, CAST(sum(k) AS BIGINT) AS count FROM b GROUP BY 1, 2 HAVING sum(k) >= 5"
query("hexbin", HEX)(lambda c: stats.hexbin(c, 100, 5, (412000, 5207000)))
query("hex_boundary")(lambda c: stats.hex_boundary(stats.hexbin(c, 100, 5, (412000, 5207000)), 100, (412000, 5207000)).select(*(F.round(x, 3).alias(x) for x in ("x0", "y0", "x1", "y1"))))
query("raster_binmode", "SELECT CAST(floor((X - 412000) / 100) AS BIGINT) AS i, CAST(floor((Y - 5207000) / 100) AS BIGINT) AS j, min(Z) AS min, max(Z) AS max, round(avg(Z), 6) AS mean, count(*)::DOUBLE AS count, round(stddev_pop(Z), 5) AS stdev, round(quantile_cont(Z, 0.9), 6) AS p90 FROM cloud GROUP BY 1, 2")(
    lambda c: stats.raster(c, 100, ["min", "max", "mean", "count", "stdev", "p90"], binmode=True, origin=(412000, 5207000)).select("i", "j", "min", "max", *r6("mean"), "count", F.round("stdev", 5).alias("stdev"), *r6("p90"))
)
query("raster_radius", "p AS (SELECT pid, Z, (X - 412000) / 100 AS u, (Y - 5207000) / 100 AS v FROM cloud), e AS (SELECT pid, Z, floor(u) + a AS i, floor(v) + b AS j, 100 * sqrt(pow(u - (floor(u) + a) - 0.5, 2) + pow(v - (floor(v) + b) - 0.5, 2)) AS d FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS a), (SELECT unnest([-2, -1, 0, 1, 2]) AS b)) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, count(*)::DOUBLE AS count, min(Z) AS min, round(sum(Z / d) / sum(1 / d), 6) AS idw FROM e WHERE d < 100 * sqrt(2) GROUP BY 1, 2")(
    lambda c: stats.raster(c, 100, ["count", "min", "idw"], origin=(412000, 5207000)).select("i", "j", "count", "min", *r6("idw"))
)

# ---- neighbourhoods ---------------------------------------------------------------

D2 = "(a.X - b.X) * (a.X - b.X) + (a.Y - b.Y) * (a.Y - b.Y) + (a.Z - b.Z) * (a.Z - b.Z)"
D2XY = "(a.X - b.X) * (a.X - b.X) + (a.Y - b.Y) * (a.Y - b.Y)"
PAIR = f"a.pid AS l, b.pid AS r, {D2} AS d2, {D2XY} AS d2xy, a.Z AS az, b.Z AS bz, a.Classification AS ac, b.Classification AS bc, a.PointSourceId AS al, b.PointSourceId AS bl"
#: All pairs within 50 m in the plane, by cells.
NEAR = f"""here AS (SELECT *, CAST(floor(X / 5000) AS BIGINT) AS ca, CAST(floor(Y / 5000) AS BIGINT) AS cb FROM small),
  around AS (SELECT * EXCLUDE (ca, cb), ca + da AS ca, cb + db AS cb FROM here, (SELECT unnest([-1, 0, 1]) AS da), (SELECT unnest([-1, 0, 1]) AS db)),
  near AS (SELECT {PAIR} FROM here a JOIN around b ON a.ca = b.ca AND a.cb = b.cb WHERE {D2XY} < 25000000)"""


def nearest(name: str, k: int, left: str = "TRUE", right: str = "TRUE", d: str = "d2", of: tuple[str, str] = ("TRUE", "TRUE")) -> str:
    """SQL: ``name``, the rows of ``near`` in order (p) of distance, complete to place k: rows with k near ones take those,
    others look at all. Conditions on the two rows: in terms of ``near``, and (``of``) of ``small``."""
    return f"""{name}_c AS (SELECT * FROM near WHERE {left} AND {right}), {name}_k AS (SELECT l FROM {name}_c WHERE {d} < 25000000 GROUP BY l HAVING count(*) >= {k}),
  {name}_f AS (SELECT * FROM small WHERE {of[0]} AND pid NOT IN (SELECT l FROM {name}_k)),
  {name}_a AS (SELECT * FROM {name}_c WHERE l IN (SELECT l FROM {name}_k) UNION ALL SELECT {PAIR} FROM {name}_f a, (SELECT * FROM small WHERE {of[1]}) b),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY {d}, r) AS p FROM {name}_a)"""


NN = f"{NEAR}, {nearest('nn', 12)}"


def closure(links: str) -> str:
    """SQL: ``reach``, all pairs (l, r) of rows that links (l, r; both ways, with each row's own) connect."""
    return f"reach AS (SELECT l, r FROM {links} UNION SELECT reach.l, k.r FROM reach JOIN {links} k ON reach.r = k.l)"


query("nndistance_kth", f"{NN} SELECT l AS pid, round(sqrt(max(d2)), 6) AS NNDistance FROM nn WHERE p <= 9 GROUP BY l", small)(lambda c: neighborhood.nndistance(c, 8).select("pid", *r6("NNDistance")))
query("nndistance_avg", f"{NN} SELECT l AS pid, round(sum(sqrt(d2)) / 8, 6) AS NNDistance FROM nn WHERE p <= 9 GROUP BY l", small)(lambda c: neighborhood.nndistance(c, 8, "avg").select("pid", *r6("NNDistance")))
query("radialdensity", f"{NEAR} SELECT l AS pid, round(count(*) / (4.0 / 3 * 3.14159 * 1000000000) * 1000000000, 6) AS RadialDensity FROM near WHERE d2 < 1000000 GROUP BY l", small)(
    lambda c: neighborhood.radialdensity(c, 1000).select("pid", F.round(F.col("RadialDensity") * 1e9, 6).alias("RadialDensity"))
)
query("lof", f"{NN}, k AS (SELECT l, max(sqrt(d2)) AS kd FROM nn WHERE p <= 11 GROUP BY l), lr AS (SELECT n.l, 1 / avg(greatest(sqrt(d2), kd)) AS lrd FROM nn n JOIN k ON n.r = k.l WHERE p <= 11 GROUP BY n.l) SELECT n.l AS pid, round(avg(o.lrd) / max(s.lrd), 5) AS LocalOutlierFactor FROM nn n JOIN lr o ON n.r = o.l JOIN lr s ON n.l = s.l WHERE p <= 11 GROUP BY n.l", small)(
    lambda c: neighborhood.lof(c, 10).select("pid", F.round("LocalOutlierFactor", 5).alias("LocalOutlierFactor"))
)
query("reciprocity", f"{NN}, e AS (SELECT l, r FROM nn WHERE p <= 9) SELECT s.pid, coalesce(x.n, 0) * 12.5 AS Reciprocity FROM small s LEFT JOIN (SELECT e.l, count(*) AS n FROM e LEFT JOIN e f ON e.l = f.r AND e.r = f.l WHERE f.l IS NULL GROUP BY e.l) x ON x.l = s.pid", small)(
    lambda c: neighborhood.reciprocity(c, 8).select("pid", F.col("Reciprocity").cast("double"))
)
SQL["reciprocity"] = SQL["reciprocity"].replace("* 12.5 AS", "* 12.5::DOUBLE AS")
query("outlier_statistical", f"{NN}, m AS (SELECT l, sum(sqrt(d2)) / 8 AS d FROM nn WHERE p <= 9 GROUP BY l), t AS (SELECT avg(d) + 2 * stddev_samp(d) AS t FROM m) SELECT s.pid, CAST(CASE WHEN d >= t THEN 7 ELSE Classification END AS INT) AS Classification FROM small s JOIN m ON m.l = s.pid, t", small)(
    lambda c: neighborhood.outlier(c).select("pid", F.col("Classification").cast("int"))
)
query("outlier_radius", f"{NEAR}, d AS (SELECT l, count(*) AS n FROM near WHERE d2 < 160000 GROUP BY 1) SELECT s.pid, CAST(CASE WHEN n <= 2 THEN 7 ELSE Classification END AS INT) AS Classification FROM small s JOIN d ON d.l = s.pid", small)(
    lambda c: neighborhood.outlier(c, "radius", 2, 400.0).select("pid", F.col("Classification").cast("int"))
)
query("cluster", of=small)(lambda c: neighborhood.cluster(c, 2, tolerance=100.0).select("pid", "ClusterID"))
query("dbscan", of=small)(lambda c: neighborhood.dbscan(c, 4, 150.0).select("pid", "ClusterID"))
SQL["cluster"] = f"WITH RECURSIVE {SMALL}, {NEAR}, links AS MATERIALIZED (SELECT l, r FROM near WHERE d2 < 10000), {closure('links')}, tops AS (SELECT l AS pid, min(r) AS top FROM reach GROUP BY l), kept AS (SELECT top, dense_rank() OVER (ORDER BY top) AS k FROM tops GROUP BY top HAVING count(*) >= 2) SELECT pid, CAST(coalesce(k, 0) AS BIGINT) AS ClusterID FROM tops LEFT JOIN kept USING (top)"
SQL["dbscan"] = f"WITH RECURSIVE {SMALL}, {NEAR}, n AS MATERIALIZED (SELECT l, r FROM near WHERE d2 < 22500), core AS MATERIALIZED (SELECT l AS pid FROM n GROUP BY l HAVING count(*) >= 4), links AS MATERIALIZED (SELECT l, r FROM n WHERE l IN (FROM core) AND r IN (FROM core)), {closure('links')}, tops AS (SELECT l AS pid, min(r) AS top FROM reach GROUP BY l), numbers AS (SELECT top, dense_rank() OVER (ORDER BY top) - 1 AS k FROM tops GROUP BY top), beside AS (SELECT n.l AS pid, min(top) AS top FROM n JOIN tops ON n.r = tops.pid GROUP BY 1) SELECT small.pid, CAST(coalesce(k, -1) AS BIGINT) AS ClusterID FROM small LEFT JOIN beside USING (pid) LEFT JOIN numbers USING (top)"
query("lloydkmeans", of=small)(lambda c: neighborhood.lloydkmeans(c, 6, maxiters=5).groupBy("ClusterID").agg(F.count(F.lit(1)).alias("count")))
query("neighborclassifier", f"{NN}, v AS (SELECT l, bc, count(*) AS n FROM nn WHERE p <= 7 GROUP BY 1, 2) SELECT s.pid, CAST(coalesce(v.bc, s.Classification) AS INT) AS Classification FROM small s LEFT JOIN v ON v.l = s.pid AND v.n > 3.5", small)(
    lambda c: neighborhood.neighborclassifier(c, 7).select("pid", F.col("Classification").cast("int"))
)
query("radiusassign", f"{NEAR}, h AS (SELECT DISTINCT l AS pid FROM near WHERE ac = 1 AND bc = 2 AND d2xy < 40000) SELECT s.pid, CAST(CASE WHEN h.pid IS NOT NULL THEN 8 ELSE Classification END AS INT) AS Classification FROM small s LEFT JOIN h ON h.pid = s.pid", small)(
    lambda c: neighborhood.radiusassign(c, "Classification[1:1]", "Classification[2:2]", 200.0, "Classification = 8").select("pid", F.col("Classification").cast("int"))
)
HAG = f"{NEAR}, {nearest('d', 3, 'ac <> 2', 'bc = 2', 'd2xy', ('Classification <> 2', 'Classification = 2'))}"
query("hag_nn", f"{HAG}, h AS (SELECT l AS pid, max(az) - coalesce(arg_min(CASE WHEN d2xy = 0 THEN bz END, CASE WHEN d2xy = 0 THEN p END), sum(bz / nullif(d2xy, 0)) / sum(1 / nullif(d2xy, 0))) AS h FROM d WHERE p <= 3 GROUP BY l) SELECT s.pid, round(coalesce(h, 0), 6) AS HeightAboveGround FROM small s LEFT JOIN h ON h.pid = s.pid", small)(
    lambda c: neighborhood.hag_nn(c, 3).select("pid", *r6("HeightAboveGround"))
)
query("hag_delaunay", of=small)(lambda c: mesh.hag_delaunay(c, 6).select("pid", *r6("HeightAboveGround")))
query("zsmooth", f"{NEAR}, d AS (SELECT l AS pid, bz FROM near WHERE l <> r AND d2xy < 250000), s AS (SELECT pid, quantile_cont(bz, 0.5) AS z FROM d GROUP BY pid) SELECT small.pid, coalesce(s.z, small.Z) AS Smooth FROM small LEFT JOIN s ON s.pid = small.pid", small)(
    lambda c: neighborhood.zsmooth(c, "Smooth", 500.0).select("pid", "Smooth")
)
ONE_SIDE, OTHER_SIDE = "PointSourceId < 20", "PointSourceId >= 20"
TWO = f"{NEAR}, {nearest('e', 1, 'al < 20', 'bl >= 20', 'd2', (ONE_SIDE, OTHER_SIDE))}, {nearest('f', 1, 'al >= 20', 'bl < 20', 'd2', (OTHER_SIDE, ONE_SIDE))}"
query("delta", f"{TWO} SELECT min(az - bz) AS min, max(az - bz) AS max, round(avg(az - bz), 6) AS mean FROM e WHERE p = 1", small)(
    lambda c: neighborhood.delta(c.where(ONE_SIDE), c.where(OTHER_SIDE), ["Z"]).select("min", "max", *r6("mean"))
)
query("chamfer", f"{TWO} SELECT round((SELECT sum(d2) FROM e WHERE p = 1) + (SELECT sum(d2) FROM f WHERE p = 1), 3) AS chamfer", small)(
    lambda c: neighborhood.chamfer(c.where(ONE_SIDE), c.where(OTHER_SIDE)).select(F.round("chamfer", 3).alias("chamfer"))
)
query("hausdorff", f"{TWO} SELECT round(greatest((SELECT max(sqrt(d2)) FROM e WHERE p = 1), (SELECT max(sqrt(d2)) FROM f WHERE p = 1)), 6) AS hausdorff, round(greatest((SELECT avg(sqrt(d2)) FROM e WHERE p = 1), (SELECT avg(sqrt(d2)) FROM f WHERE p = 1)), 6) AS modified", small)(
    lambda c: neighborhood.hausdorff(c.where(ONE_SIDE), c.where(OTHER_SIDE)).select(*r6("hausdorff", "modified"))
)
CONFUSION = f"{TWO}, m AS (SELECT ac::BIGINT AS truth, bc::BIGINT AS predicted, count(*) AS n FROM e WHERE p = 1 GROUP BY 1, 2)"
query("eval", f"{CONFUSION} SELECT truth, predicted, n AS count FROM m", small)(lambda c: neighborhood.confusion(c.where(OTHER_SIDE), c.where(ONE_SIDE)))
query("eval_scores", f"{CONFUSION}, t AS (SELECT label, sum(CASE WHEN truth = label AND predicted = label THEN n ELSE 0 END) AS tp, sum(CASE WHEN truth = label THEN n ELSE 0 END) AS sup, sum(CASE WHEN predicted = label THEN n ELSE 0 END) AS cal, sum(n) AS tot FROM m, (SELECT truth AS label FROM m UNION SELECT predicted FROM m) GROUP BY label) SELECT CAST(label AS BIGINT) AS label, CAST(sup AS BIGINT) AS support, round(tp / (sup + cal - tp), 6) AS iou, round(2 * tp / (sup + cal), 6) AS f1, round(tp / cal, 6) AS precision, round(tp / sup, 6) AS sensitivity, round((tot - sup - cal + tp) / (tot - sup), 6) AS specificity, round((tot - sup - cal + 2 * tp) / tot, 6) AS accuracy FROM t", small)(
    lambda c: neighborhood.evaluate(c.where(OTHER_SIDE), c.where(ONE_SIDE)).select(F.col("label").cast("bigint").alias("label"), F.col("support").cast("bigint").alias("support"), *r6("iou", "f1", "precision", "sensitivity", "specificity", "accuracy"))
)

# ---- geometry ---------------------------------------------------------------------

def _files(c: DataFrame) -> DataFrame:
    """A view a scan file."""
    return c.withColumn("view_id", F.col("OriginId"))


query("eigenvalue_sum", f"{NN}, n AS (SELECT l, b.X, b.Y, b.Z FROM nn JOIN small b ON b.pid = nn.r WHERE p <= 11) SELECT l AS pid, round(var_samp(X) + var_samp(Y) + var_samp(Z), 4) AS EigenvalueSum FROM n GROUP BY l", small)(
    lambda c: features.covariancefeatures(c, 10, ["EigenvalueSum"], mode="raw").select("pid", F.round("EigenvalueSum", 4).alias("EigenvalueSum"))
)
query("eigenvalues", of=small)(lambda c: features.eigenvalues(c, 8).select("pid", *r6("Eigenvalue0", "Eigenvalue1", "Eigenvalue2")))
query("covariancefeatures", of=small)(lambda c: features.covariancefeatures(c, 10, "all").select("pid", *r6(*features.FEATURES)))
query("normal", of=small)(lambda c: features.normal(c, 8).select("pid", *r6("NormalX", "NormalY", "NormalZ", "Curvature")))
query("approximatecoplanar", of=small)(lambda c: features.approximatecoplanar(c).select("pid", "Coplanar"))
query("estimaterank", of=small)(lambda c: features.estimaterank(c).select("pid", "Rank"))
query("planefit", of=small)(lambda c: features.planefit(c).select("pid", *r6("PlaneFit")))
query("miniball", of=small)(lambda c: features.miniball(c).select("pid", *r6("Miniball")))
query("optimalneighborhood", of=small)(lambda c: features.optimalneighborhood(c).select("pid", "OptimalKNN", *r6("OptimalRadius")))
query("delaunay", of=small)(lambda c: mesh.delaunay(_files(c)))
query("faceraster", of=small)(lambda c: mesh.faceraster(c, mesh.delaunay(_files(c)), 500.0, (0.0, 0.0), 100_000, 100_000))
query("m3c2", of=small)(lambda c: register.m3c2(c.where(ONE_SIDE), c.where(OTHER_SIDE), c, 1500.0, 1000.0, 500.0).select("pid", *r6("m3c2_distance", "m3c2_uncertainty"), "m3c2_count1", "m3c2_count2"))
query("icp", of=small)(lambda c: register.icp(c, assign.transformation(c, "1 0 0 2 0 1 0 -1 0 0 1 1 0 0 0 1"), max_iter=8)[0].select("pid", *(F.round(a, 3).alias(a) for a in "XYZ")))

# ---- ground -----------------------------------------------------------------------

query("elm", "b AS (SELECT min(X) AS x, min(Y) AS y FROM cloud), c AS (SELECT pid, Classification, Z, floor(floor(cloud.X - b.x) / 10) AS c, floor(floor(cloud.Y - b.y) / 10) AS r FROM cloud, b), l AS (SELECT *, coalesce(lead(Z) OVER w - Z, 0) < 1 AS stop FROM c WINDOW w AS (PARTITION BY c, r ORDER BY Z, pid)), s AS (SELECT pid, Classification, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY c, r ORDER BY Z, pid ROWS UNBOUNDED PRECEDING) AS n FROM l) SELECT pid, CAST(CASE WHEN n = 0 THEN 7 ELSE Classification END AS INT) AS Classification FROM s")(
    lambda c: ground.elm(c).select("pid", F.col("Classification").cast("int"))
)
query("skewnessbalancing", "m AS (SELECT avg(Z) AS m FROM cloud), v AS (SELECT pid, Z, Z - m AS v FROM cloud, m), s AS (SELECT pid, Z, row_number() OVER w AS n, sum(v) OVER w AS s1, sum(v * v) OVER w AS s2, sum(v * v * v) OVER w AS s3 FROM v WINDOW w AS (ORDER BY Z, pid ROWS UNBOUNDED PRECEDING)), k AS (SELECT pid, Z, n, s2 - s1 * s1 / n AS m2, s3 - 3 * s1 / n * s2 + 2 * s1 * s1 * s1 / n / n AS m3 FROM s), z AS (SELECT pid, Z, n, CASE WHEN n > 1 AND m2 > 1e-12 THEN sqrt(n) * m3 / pow(m2, 1.5) END AS sk FROM k), t AS (SELECT pid, Z, n, sk, sk > 0 AND lag(sk) OVER (ORDER BY n) <= 0 AS turn FROM z), x AS (SELECT max(CASE WHEN turn THEN n END) AS cut, arg_max(sk, n) AS last FROM t) SELECT pid, CASE WHEN cut IS NOT NULL THEN CASE WHEN n < cut THEN 2 ELSE 1 END WHEN last <= 0 THEN 2 ELSE 1 END AS Classification FROM t, x")(
    lambda c: ground.skewnessbalancing(c).select("pid", F.col("Classification").cast("int"))
)
query("sparsesurface", of=small)(lambda c: ground.sparsesurface(c, 200.0).select("pid", F.col("Classification").cast("int")))
query("pmf")(lambda c: ground.pmf(c, 5.0, max_window_size=40.0).select("pid", F.col("Classification").cast("int")))
query("smrf")(lambda c: ground.smrf(c, 5.0).select("pid", F.col("Classification").cast("int")))
query("csf")(lambda c: ground.csf(c, 5.0, iterations=60).select("pid", F.col("Classification").cast("int")))
query("litree")(lambda c: ground.litree(c.withColumn("HeightAboveGround", F.greatest(F.col("Z") - 140, F.lit(0.0)))).groupBy("ClusterID").agg(F.count(F.lit(1)).alias("count")))
query("supervoxel", of=small)(lambda c: ground.supervoxel(features.normal(c, 8), resolution=500.0).select("pid", "ClusterID"))

# ---- sources, sinks, pipelines, streams ---------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _round_trip(name: str, write, back, sql: str):
    def run(spark, sf_dir):
        path = _path(spark, name)
        write(cloud(spark, sf_dir), path)
        return back(spark, path)

    QUERIES[name] = run
    SQL[name] = f"WITH {CLOUD} {sql}"


NUMBERED = "SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, X, Y, Z, CAST(Classification AS INT) AS Classification FROM cloud"
_xyzc = lambda d: d.select("pid", *(F.round(a, 2).alias(a) for a in "XYZ"), F.col("Classification").cast("int"))
_round_trip("text_round_trip", lambda c, p: text.write_text(c.select("pid", "X", "Y", "Z", "Classification"), p, precision=2), lambda s, p: _xyzc(text.read_text(s, p)), NUMBERED)
_round_trip("geojson_round_trip", lambda c, p: text.write_geojson(c.select("pid", "X", "Y", "Z", "Classification"), p), lambda s, p: _xyzc(text.read_geojson(s, p, ["X", "Y", "Z", "Classification"])), NUMBERED)
for _kind, _opts in (("las", {}), ("ply", {"precision": 2}), ("pcd", {"compression": "binary"})):
    _round_trip(
        f"{_kind}_round_trip",
        lambda c, p, _k=_kind, _o=_opts: binary.write_points(order.renumbered(c, F.asc("pid")).select("pid", "X", "Y", "Z", "Classification").repartitionByRange(4, "pid"), _k, p, **_o),
        lambda s, p, _k=_kind: binary.read_points(s, _k, p).select(*(F.round(a, 2).alias(a) for a in "XYZ"), F.col("Classification").cast("int")),
        "SELECT X, Y, Z, CAST(Classification AS INT) AS Classification FROM cloud",
    )
for _geometry in ("xyz", "wkb"):
    _round_trip(f"parquet_{_geometry}_round_trip", lambda c, p, _g=_geometry: tables.write_columns(c.select("pid", "X", "Y", "Z"), p, _g), lambda s, p, _g=_geometry: tables.read_columns(s, p, _g).select("pid", "X", "Y", "Z"), "SELECT pid, X, Y, Z FROM cloud")
QUERIES["faux_grid"] = lambda spark, sf_dir: tables.faux(spark, bounds=(0, 10, 0, 10, 0, 10), mode="grid").select("pid", "X", "Y", "Z")
SQL["faux_grid"] = "SELECT range AS pid, (range % 10)::DOUBLE AS X, ((range // 10) % 10)::DOUBLE AS Y, (range // 100)::DOUBLE AS Z FROM range(1000)"
QUERIES["faux_ramp"] = lambda spark, sf_dir: tables.faux(spark, 400, (0, 399, 0, 399, 0, 399), "ramp", number_of_returns=3).select("pid", *r6("X"), F.col("ReturnNumber").cast("int"))
SQL["faux_ramp"] = "SELECT range AS pid, range::DOUBLE AS X, CAST(range % 3 + 1 AS INT) AS ReturnNumber FROM range(400)"


def _pipeline(spark, sf_dir):
    source = [
        {"type": "readers.buffer", "view": cloud(spark, sf_dir), "tag": "in"},
        {"type": "filters.assign", "value": "Classification = 1 WHERE Classification != 2", "inputs": ["in"]},
        {"type": "filters.range", "limits": "Z[100:300]"},
        {"type": "filters.assign", "value": ["Height = Z - 100"], "where": "Classification == 2"},
        {"type": "filters.sort", "dimension": "Z"},
    ]
    return Pipeline.from_json(source).build(spark).groupBy(F.col("Classification").cast("int").alias("Classification")).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("Height"), 3).alias("height"))


QUERIES["pipeline_json"] = _pipeline
SQL["pipeline_json"] = f"WITH {CLOUD} SELECT CASE WHEN Classification = 2 THEN 2 ELSE 1 END AS Classification, count(*) AS count, round(sum(CASE WHEN Classification = 2 THEN Z - 100 ELSE 0 END), 3) AS height FROM cloud WHERE Z BETWEEN 100 AND 300 GROUP BY 1"
QUERIES["tile_index"] = lambda spark, sf_dir: tables.tile_index({f"c{k}": cloud(spark, sf_dir).where(f"Classification = {k}") for k in (1, 2)}).select("location", "num_points", "minx", "maxx")
SQL["tile_index"] = f"WITH {CLOUD} SELECT 'c' || Classification AS location, count(*) AS num_points, min(X) AS minx, max(X) AS maxx FROM cloud WHERE Classification IN (1, 2) GROUP BY 1"
QUERIES["windowed_stats"] = lambda spark, sf_dir: streaming.windowed_stats(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 hour", keys=("event_type",)).select(F.unix_micros("start").alias("start"), "event_type", "count", "minimum", "maximum", *r6("average"))
SQL["windowed_stats"] = "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS count, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS average FROM events GROUP BY 1, 2"
QUERIES["sessions"] = lambda spark, sf_dir: streaming.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "2 hours").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "count")
SQL["sessions"] = "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS \"end\", count(*) AS count FROM s GROUP BY user_id, s"
