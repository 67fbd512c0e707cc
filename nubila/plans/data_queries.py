"""Queries of the general training-data problems (1, 2 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import located
from ..operators.drift import one_name, schema_changes, unified
from ..operators.nearby import near_or_within
from ..operators.units import in_metres
from ..session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = located(read(spark, sf_dir, "point_features"), "pid", "pointsourceid")
    return near_or_within(points, 0.255, read(spark, sf_dir, "regions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [read(spark, sf_dir, n) for n in ("scan_files", "file_schemas", "dimensions")]
    return schema_changes(*t, same_key=True).select("file_id", "dimname", "change_kind").distinct()


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, schemas, dimensions, records = (read(spark, sf_dir, n) for n in ("scan_files", "file_schemas", "dimensions", "raw_records"))
    return unified(records, dimensions, one_name(files, schemas, dimensions, records))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = in_metres(read(spark, sf_dir, "scan_files"), read(spark, sf_dir, "fbi_headers"))
    v = v.where("recorded_in = 'header' or abs(metre_factor - 1) > 1e-9")
    return v.select("file_id", "recorded_in", "quantity", F.floor("metres").alias("metres")).distinct()


LOCATED_SQL = r"""
located AS (
  SELECT * FROM (SELECT pid, pointsourceid, file_id,
    round(coalesce(geom_coordinates[1], CASE WHEN regexp_full_match(replace(trim(prop_x), ',', '.'), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(replace(trim(prop_x), ',', '.') AS DOUBLE) END), 2) AS x,
    round(coalesce(geom_coordinates[2], CASE WHEN regexp_full_match(replace(trim(prop_y), ',', '.'), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(replace(trim(prop_y), ',', '.') AS DOUBLE) END), 2) AS y,
    round(coalesce(geom_coordinates[3], CASE WHEN regexp_full_match(replace(trim(prop_z), ',', '.'), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(replace(trim(prop_z), ',', '.') AS DOUBLE) END), 2) AS z
  FROM point_features) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"""

P1_FOUND_SQL = f"""
WITH {LOCATED_SQL},
here AS (SELECT *, CAST(floor(x) AS BIGINT) AS a, CAST(floor(y) AS BIGINT) AS b FROM located),
around AS (SELECT pid, pointsourceid, x, y, z, a + da AS a, b + db AS b FROM here, (SELECT unnest([-1, 0, 1]) AS da), (SELECT unnest([-1, 0, 1]) AS db)),
near AS (
  SELECT h.pid AS id_a, o.pid AS id_b FROM here h JOIN around o ON h.a = o.a AND h.b = o.b
  WHERE h.pid < o.pid AND h.pointsourceid <> o.pointsourceid AND (h.x - o.x) ^ 2 + (h.y - o.y) ^ 2 + (h.z - o.z) ^ 2 < 0.255 ^ 2),
polygons AS (SELECT region_id, unnest(geom_coordinates) AS polygon, generate_subscripts(geom_coordinates, 1) AS part FROM regions WHERE geom_coordinates IS NOT NULL),
rings AS (SELECT region_id, part, unnest(polygon) AS ring, generate_subscripts(polygon, 1) AS place FROM polygons),
vertices AS (SELECT region_id, part, place, ring, unnest(range(1, len(ring) + 1)) AS k FROM rings),
edges AS (SELECT region_id, part, place, ring[k][1] AS x1, ring[k][2] AS y1, ring[k % len(ring) + 1][1] AS x2, ring[k % len(ring) + 1][2] AS y2 FROM vertices),
crossed AS (
  SELECT region_id, part, place, pid FROM edges e JOIN located p ON p.y >= least(y1, y2) AND p.y < greatest(y1, y2)
  WHERE p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT 'near' AS case_kind, id_a, id_b FROM near
UNION ALL
SELECT DISTINCT 'within', CAST(o.region_id AS BIGINT), o.pid FROM crossed o
WHERE o.place = 1 AND NOT EXISTS (SELECT 1 FROM crossed h WHERE h.place > 1 AND h.region_id = o.region_id AND h.part = o.part AND h.pid = o.pid)
"""

P2_FOUND_SQL = r"""
WITH names AS (
  SELECT dimname, 0 AS place, dimname AS name FROM dimensions
  UNION ALL
  SELECT dimname, 1, unnest(CASE WHEN alt_names LIKE '[%' THEN from_json(alt_names, '["VARCHAR"]') ELSE [json_extract_string(alt_names, '$')] END)
  FROM dimensions WHERE alt_names IS NOT NULL),
keys AS (
  SELECT lower(regexp_replace(name, '[\s_-]+', '', 'g')) AS k, arg_min(dimname, place) AS dimname
  FROM names WHERE name IS NOT NULL GROUP BY 1),
typed AS (
  SELECT file_id, coalesce(dimname, k0) AS dim, dim_name, dim_pos,
    CASE WHEN coalesce(t, '') = '' THEN NULL WHEN regexp_matches(t, '^(float|double)') THEN 'floating' WHEN t LIKE 'u%' THEN 'unsigned' ELSE 'signed' END AS kind,
    CASE WHEN coalesce(t, '') = '' THEN NULL WHEN regexp_matches(t, '[0-9]+$') THEN CAST(regexp_extract(t, '[0-9]+$') AS INT) // 8
         WHEN t = 'double' THEN 8 WHEN t = 'float' THEN coalesce(dim_size, 4) ELSE dim_size END AS width
  FROM (SELECT *, lower(regexp_replace(dim_name, '[\s_-]+', '', 'g')) AS k0, regexp_replace(lower(trim(dim_type)), '_t$', '') AS t FROM file_schemas WHERE dim_name IS NOT NULL) s
  LEFT JOIN keys ON k = k0),
cols AS (
  SELECT file_id, dim, first(dim_name ORDER BY dim_pos) AS name, first(kind ORDER BY dim_pos) AS kind, first(width ORDER BY dim_pos) AS width
  FROM typed GROUP BY 1, 2),
pairs AS (
  SELECT file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY series_seq) AS prev FROM scan_files WHERE series_id IS NOT NULL AND series_seq IS NOT NULL),
o AS (SELECT p.file_id, c.dim, c.name, c.kind, c.width FROM pairs p JOIN cols c ON c.file_id = p.prev),
n AS (SELECT p.file_id, c.dim, c.name, c.kind, c.width FROM pairs p JOIN cols c ON c.file_id = p.file_id WHERE p.prev IS NOT NULL),
j AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.dim, o.dim) AS dimname, o.name AS oname, n.name AS nname, o.kind AS okind, n.kind AS nkind, o.width AS owidth, n.width AS nwidth
  FROM o FULL JOIN n ON o.file_id = n.file_id AND o.dim = n.dim)
SELECT file_id, dimname, 'added' AS change_kind FROM j WHERE oname IS NULL
UNION ALL SELECT file_id, dimname, 'removed' FROM j WHERE nname IS NULL
UNION ALL SELECT file_id, dimname, 'renamed' FROM j WHERE oname <> nname
UNION ALL SELECT file_id, dimname, 'retyped' FROM j WHERE okind <> nkind OR owidth <> nwidth
"""

P4_FOUND_SQL = r"""
WITH said AS (
  SELECT *, lower(replace(remarks, '.', '')) AS r,
    CASE WHEN regexp_matches(proj_wkt2, '(VERT_CS|VERTCRS)\s*\[') THEN regexp_extract(proj_wkt2, '(?s)^(.*?)(VERT_CS|VERTCRS)\s*\[', 1) ELSE proj_wkt2 END AS plane,
    regexp_extract(proj_wkt2, '(?s)(VERT_CS|VERTCRS)\s*\[(.*)$', 2) AS up
  FROM scan_files WHERE file_id IS NOT NULL),
texts AS (
  SELECT file_id, proj_bbox,
    coalesce(lower(nullif(regexp_extract(plane, '(?s)^.*\b(LENGTH)?UNIT\s*\[\s*"([^"]*)"', 2), '')),
      CASE WHEN proj_wkt2 IS NULL THEN nullif(regexp_extract(r, '(bbox units=|alle werte in |toutes les valeurs en |all coordinates: |extent given in |x/y in |horizontal: |planimetry |lage in )(.*)$', 2), '') END) AS h,
    coalesce(lower(nullif(regexp_extract(up, '(?s)^.*\b(LENGTH)?UNIT\s*\[\s*"([^"]*)"', 2), '')),
      nullif(regexp_extract(r, '(, z in |z values are |vertical: |heights in |/ heights |höhen in |altitudes en |elevations: )(.*)$', 2), '')) AS v0
  FROM said),
units AS (SELECT file_id, proj_bbox, h, coalesce(v0, h) AS v FROM texts),
lexicon AS (SELECT * FROM (VALUES
  (1, '^(us[ -]?survey|survey (feet|foot|ft) \(us\)|(feet|foot|ft) \(us survey\)|us-?ft|ftus|foot_us)', 1200.0::DOUBLE / 3937), (2, '^(international |intl )?(feet|foot|ft)', 0.3048),
  (3, '^(kilom|km)', 1000.0), (4, '^(centim|cm)', 0.01), (5, '^(millim|mm)', 0.001), (6, '^(m|mtr|met(re|er)(s|n)?)($|[^a-z])', 1.0)) t(rank, pattern, f)),
words AS (SELECT DISTINCT u FROM (SELECT h AS u FROM units UNION ALL SELECT v FROM units UNION ALL SELECT lower(replace(master_unit, '.', '')) FROM fbi_headers) WHERE u IS NOT NULL),
factors AS (SELECT u, arg_min(f, rank) AS f FROM words, lexicon WHERE regexp_matches(u, pattern) GROUP BY u),
item AS (
  SELECT u.file_id, q.q AS quantity, CASE WHEN q.q LIKE '%z' THEN v ELSE h END AS unit,
    CASE WHEN len(proj_bbox) >= 6 THEN proj_bbox[q.a] ELSE proj_bbox[q.b] END AS value
  FROM units u, (VALUES ('minx', 1, 1), ('miny', 2, 2), ('minz', 3, NULL), ('maxx', 4, 3), ('maxy', 5, 4), ('maxz', 6, NULL)) q(q, a, b)),
head AS (
  SELECT DISTINCT b.file_id, coalesce(lower(replace(b.master_unit, '.', '')), u.h) AS unit, x.quantity, x.steps / b.unitsxyz + x.org AS value
  FROM fbi_headers b LEFT JOIN units u ON b.file_id = u.file_id,
    LATERAL (VALUES ('minx', b.minx::DOUBLE, b.orgx), ('miny', b.miny::DOUBLE, b.orgy), ('minz', b.minz::DOUBLE, b.orgz), ('maxx', b.maxx::DOUBLE, b.orgx), ('maxy', b.maxy::DOUBLE, b.orgy), ('maxz', b.maxz::DOUBLE, b.orgz)) x(quantity, steps, org)
  WHERE b.unitsxyz <> 0)
SELECT DISTINCT file_id, 'item' AS recorded_in, quantity, CAST(floor(value * f) AS BIGINT) AS metres FROM item JOIN factors ON unit = u WHERE value IS NOT NULL AND f <> 1
UNION ALL
SELECT DISTINCT file_id, 'header', quantity, CAST(floor(value * f) AS BIGINT) FROM head JOIN factors ON unit = u WHERE value IS NOT NULL
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_unified": p2_unified, "p4_found": p4_found}
SQL = {"p1_found": P1_FOUND_SQL, "p2_found": P2_FOUND_SQL, "p4_found": P4_FOUND_SQL}
