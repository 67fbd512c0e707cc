"""Queries of the problems on training texts and similarity (3, 5, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import located, number, with_location
from ..session import read
from .encode import encoded
from .leakage import leaks, removal_spans
from .mcl import describe, markov_clusters
from .percentiles import merged, sketches, stacked, wide_groups
from .reading import reading_bands


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_clusters(located(read(spark, sf_dir, "point_features"), "pid"), 1.005, 10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select(F.col("cluster").alias("cluster_pid"), F.col("id").alias("pid"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(_clusters(spark, sf_dir))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_location(read(spark, sf_dir, "point_features"))
    located_z = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("z"))
    return p.select("file_id", "pointsourceid", "captured_at", located_z.alias("z"), number(F.col("prop_intensity")).alias("intensity"), number(F.col("prop_returnnumber")).alias("returnnumber"))


#: A group is reported where its 95th percentile exceeds its 5th by more than this.
LIMITS = {"z": 50.0, "intensity": 1200.0, "returnnumber": 2.5}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.create_map(*(F.lit(x) for kv in LIMITS.items() for x in kv))
    return wide_groups(_measured(spark, sf_dir)).where(F.col("p95") - F.col("p5") > F.element_at(limit, F.col("field"))).select("field", "group_id")


def p5_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity of each flight line: sketches of days, merged."""
    day = sketches(_measured(spark, sf_dir).withColumn("day", F.to_date("captured_at")), ["pointsourceid", "day"], {"intensity": F.col("intensity")})
    return stacked(merged(day, ["pointsourceid"], ["intensity"]), "pointsourceid", ["intensity"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("item_id", "doc_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_bands(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_labels")).select("doc_id", "band")


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters, "p5_found": p5_found, "p5_by_day": p5_by_day, "p6_ids": p6_ids, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found}

_NUMBER = "CASE WHEN regexp_full_match(replace(trim({0}), ',', '.'), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(replace(trim({0}), ',', '.') AS DOUBLE) END"
_AXIS = ", ".join(f"round(coalesce(geom_coordinates[{k}], {_NUMBER.format('prop_' + a)}), 2) AS {a}" for k, a in enumerate("xyz", 1))
_GROUPS = " UNION ALL ".join((
    "SELECT 'z' AS field, file_id AS g, z AS v FROM m WHERE x IS NOT NULL AND y IS NOT NULL",
    "SELECT 'intensity', pointsourceid, intensity FROM m",
    "SELECT 'returnnumber', pointsourceid, returnnumber FROM m",
))
_MEASURED = f"WITH m AS (SELECT file_id, pointsourceid, {_NUMBER.format('prop_intensity')} AS intensity, {_NUMBER.format('prop_returnnumber')} AS returnnumber, {_AXIS} FROM point_features), v AS ({_GROUPS}), l AS (SELECT field, CAST(g AS BIGINT) AS group_id, list_sort(list(v)) AS l FROM v WHERE v IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2), p AS (SELECT field, group_id, len(l) AS n, l[len(l) * 5 // 100 + 1] AS p5, l[len(l) * 50 // 100 + 1] AS p50, l[len(l) * 95 // 100 + 1] AS p95 FROM l)"
#: What links connect, by a closure.
_GROUPED = f"""WITH RECURSIVE here AS (SELECT pid, x, y, z, CAST(floor(x / 1.005) AS BIGINT) AS a, CAST(floor(y / 1.005) AS BIGINT) AS b FROM (SELECT pid, {_AXIS} FROM point_features) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
around AS (SELECT pid, x, y, z, a + da AS a, b + db AS b FROM here, (SELECT unnest([-1, 0, 1]) AS da), (SELECT unnest([-1, 0, 1]) AS db)),
links AS MATERIALIZED (SELECT h.pid AS l, o.pid AS r FROM here h JOIN around o ON h.a = o.a AND h.b = o.b WHERE (h.x - o.x) ^ 2 + (h.y - o.y) ^ 2 + (h.z - o.z) ^ 2 < 1.005 ^ 2),
reach AS (SELECT l, r FROM links UNION SELECT reach.l, k.r FROM reach JOIN links k ON reach.r = k.l)
SELECT min(r) AS cluster_pid, l AS pid FROM reach GROUP BY l HAVING count(*) >= 10"""
#: Exact percentiles; the sketches equal them in groups of up to K values.
SQL = {
    "p3_found": _GROUPED,
    "p5_found": _MEASURED + " SELECT field, group_id FROM p WHERE p95 - p5 > CASE field WHEN 'z' THEN 50 WHEN 'intensity' THEN 1200 ELSE 2.5 END",
    "p5_by_day": _MEASURED + " SELECT * FROM p WHERE field = 'intensity'",
}
