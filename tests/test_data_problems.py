"""Problems 1, 2 and 4 against brute force and on awkward inputs."""

import json

import numpy as np
import pytest

from nubila.operators import drift, nearby, units
from nubila.plans import data_queries
from nubila.spatial.geometry import in_ring
from nubila.spatial.metrics import METRICS
from nubila.spatial.vptree import VPTree
from nubila.spatial.voronoi import Partition

POINT = "pid bigint, pointsourceid int, x double, y double, z double, cell int, home string, rep bigint, n int"
REGION = "region_id int, cls int, geom_coordinates array<array<array<array<double>>>>, cell int, radius double"


def points(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], POINT)


def pairs(rows, radius):
    p = np.array([r[2:5] for r in rows], dtype=float)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[1] != b[1] and d[i, j] < radius}


def test_near_equals_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(0, 12, (900, 3)) * (1, 1, 0.2), 2)
    rows = [(i, int(rng.integers(1, 4)), *map(float, p)) for i, p in enumerate(xyz)]
    rows += [(1000 + i, 9, *rows[i][2:]) for i in range(60)] + [(2000 + i, rows[5][1], *rows[5][2:]) for i in range(8)]
    got = nearby.near_or_within(points(spark, rows), 0.5, cell_rows=60)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == sorted(pairs(rows, 0.5))


def test_rows_that_take_no_part_and_empty_tables(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0), (2, 2, 0.1, 0.0, 0.0), (3, None, 0.1, 0.0, 0.0), (4, 3, None, 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0), (5, 5, float("nan"), 0.0, 0.0)]
    got = nearby.near_or_within(points(spark, rows), 0.3)
    assert [tuple(r) for r in got.collect()] == [("near", 1, 2)]
    assert nearby.near_or_within(points(spark, []), 0.3, spark.createDataFrame([], REGION)).count() == 0


def test_within_holes_open_rings_parts_and_bad_geometry(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    hole = [[4.0, 4.0, 7.0], [4.0, 6.0], [6.0, 6.0], [6.0, 6.0], [6.0, 4.0], [4.0, 4.0]]
    far = [[20.0, 20.0], [22.0, 20.0], [21.0, 22.0], [20.0, 20.0]]
    regions = [(1, 1, [[square, hole], [far]]), (2, 1, [[square[::-1]], [square]]), (3, None, None), (4, 1, [[[[0.0, 0.0], [1.0, 1.0]]], None]), (None, 1, [[square]])]
    regions = spark.createDataFrame([(*r, 5, 1.0) for r in regions], REGION)
    rows = [(100, 1, 5.0, 5.0, 0.0), (101, 1, 1.0, 1.0, 0.0), (102, 1, 1.0, 1.0, 0.0), (103, 1, 21.0, 20.5, 0.0), (104, 1, 30.0, 30.0, 0.0)]
    got = {tuple(r) for r in nearby.near_or_within(points(spark, rows), 0.2, regions).collect()}
    assert got == {("within", 1, 101), ("within", 1, 102), ("within", 1, 103), ("within", 2, 100), ("within", 2, 101), ("within", 2, 102)}


def test_great_circle_join(spark):
    rng = np.random.default_rng(5)
    lonlat = np.c_[rng.uniform(7, 7.02, 200), rng.uniform(47, 47.02, 200)]
    d = METRICS["great_circle"](lonlat[:, None], lonlat[None])
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if d[i, j] < 90}
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(lonlat)], "pid bigint, lon double, lat double")
    got = nearby.near_or_within(df, 90.0, tag_col=None, dims=("lon", "lat"), metric="great_circle", cell_rows=30)
    assert {(r.id_a, r.id_b) for r in got.collect()} == want and want


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_tree_and_partition(n):
    rng = np.random.default_rng(n)
    p = rng.normal(size=(n, 3))
    q, k, d = VPTree(p, METRICS["euclidean"], leaf=4).within(p, 0.7)
    full = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) < 0.7
    assert sorted(zip(q.tolist(), k.tolist())) == sorted(map(tuple, np.argwhere(full).tolist()))
    part = Partition.fit(p[:, :2], n, "euclidean", 20)
    rows, cells, home = part.assign(p[:, :2], 0.3)
    assert np.bincount(rows[home], minlength=n).tolist() == [1] * n
    there = set(zip(rows.tolist(), cells.tolist()))
    own = dict(zip(rows[home].tolist(), cells[home].tolist()))
    near = np.argwhere(np.sqrt(((p[:, None, :2] - p[None, :, :2]) ** 2).sum(axis=2)) < 0.3)
    assert all((a, own[b]) in there for a, b in near.tolist())


def test_ray_casting():
    ring = np.array([[0, 0], [4, 0], [4, 4], [2, 1], [0, 4]], dtype=float)
    assert in_ring(np.array([2.0, 2.0, 0.5]), np.array([0.5, 3.0, 1.0]), ring).tolist() == [True, False, True]


# ---- schemas ------------------------------------------------------------------

DIMS = [("X", "double", '["easting", "coord_x"]'), ("Intensity", "uint16", '"pulse power"'), ("Red", "uint16", None)]


def catalogue(spark):
    return spark.createDataFrame(DIMS, "dimname string, dtype string, alt_names string")


def changed(spark, schemas, files=((1, 7, 1), (2, 7, 4)), **kw):
    f = spark.createDataFrame(list(files), "file_id bigint, series_id bigint, series_seq int")
    s = spark.createDataFrame(schemas, "file_id bigint, dim_pos int, dim_name string, dim_type string, dim_size int")
    return {(r.file_id, r.dimname, r.change_kind) for r in drift.schema_changes(f, s, catalogue(spark), **kw).collect()}


def test_changes_by_the_naming_rule(spark):
    s = [(1, 0, "X", "double", 8), (1, 1, "Intensity", "uint16", 2), (1, 2, "Wave Gain", "float", 4), (1, 3, "Red", "unsigned", 2), (1, 3, "Red", "unsigned", 2)]
    s += [(2, 0, "easting", "float64", None), (2, 1, "pulse_power", "int32_t", None), (2, 2, "WAVE-GAIN", None, None), (2, 3, "Extra", "uint8", 1), (2, 4, None, "uint8", 1)]
    assert changed(spark, s, same_key=True) == {(2, "X", "renamed"), (2, "Intensity", "renamed"), (2, "Intensity", "retyped"), (2, "wavegain", "renamed"), (2, "Red", "removed"), (2, "Extra".lower(), "added")}


def test_changes_by_the_naming_rule_read_no_values_and_match_nothing(spark, tmp_path):
    # no raw_records here; RigTemp is like RigTemperature but no name of it; file 3 lists no columns, file 4 an alternate beside its entry
    s = [(1, 0, "X", "double", 8), (1, 1, "RigTemperature", "float", 4), (1, 2, "Red", "uint16", 2), (2, 0, "coord X", "float", None), (2, 1, "RigTemp", "float", 4), (2, 2, "RED", " ", None)]
    s += [(4, 5, "X", "int32", 4), (4, 1, "easting", "double", 8), (5, 0, "easting", "float64", None), (5, 3, "X", "uint8", 1)]
    spark.createDataFrame(s, "file_id bigint, dim_pos int, dim_name string, dim_type string, dim_size int").write.parquet(f"{tmp_path}/file_schemas.parquet")
    spark.createDataFrame([(1, 7, 1), (2, 7, 4), (3, 7, 5), (4, 7, 9), (5, 7, 10)], "file_id bigint, series_id bigint, series_seq int").write.parquet(f"{tmp_path}/scan_files.parquet")
    catalogue(spark).write.parquet(f"{tmp_path}/dimensions.parquet")
    d = data_queries.p2_found(spark, str(tmp_path))
    want = {(2, "X", "renamed"), (2, "X", "retyped"), (2, "Red", "renamed"), (2, "rigtemperature", "removed"), (2, "rigtemp", "added")}
    want |= {(3, "X", "removed"), (3, "Red", "removed"), (3, "rigtemp", "removed"), (4, "X", "added")}
    assert sorted(map(tuple, d.collect())) == sorted(want)
    assert "Pandas" not in d._jdf.queryExecution().toString()


def test_matching_finds_renames_outside_the_catalogue(spark):
    s = [(1, 0, "RigTemperature", "float", 4), (1, 1, "Foo", "uint8", 1), (2, 0, "RigTemp", "float", 4), (2, 1, "Quux", "int64", 8)]
    rec = [(f, n, json.dumps({a: 20 + n, b: n})) for f, a, b in ((1, "RigTemperature", "Foo"), (2, "RigTemp", "Quux")) for n in range(3)]
    rec = spark.createDataFrame(rec + [(1, 9, None), (1, 10, "no json")], "file_id bigint, rec_no int, payload string")
    got = changed(spark, s, records=rec, threshold=0.6)
    assert (2, "rigtemp", "renamed") in got and (2, "quux", "added") in got


def test_long_series_over_blocks_and_empty(spark):
    files = [(k, 1, k * 3) for k in range(1, 2 * drift.SEQ_BLOCK // 3 + 5)]
    got = {r.file_id: r.prev for r in drift.before(spark.createDataFrame(files, "file_id bigint, series_id bigint, series_seq int")).collect()}
    assert got == {k: k - 1 for k, *_ in files if k > 1}
    assert changed(spark, [], files=[(1, None, 1)]) == set()


def test_matching_is_the_greatest():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        s = rng.random((n, m))
        got = sum(s[i, j] for i, j in drift.greatest_matching(s))
        small, big = min(n, m), max(n, m)
        t = s if n <= m else s.T
        assert got == pytest.approx(max(sum(t[i, p[i]] for i in range(small)) for p in permutations(range(big), small)))


def test_unified_records(spark):
    rec = [(1, 1, '{"easting": "4,5", "Pulse Power": 7, "own": "a"}'), (1, 2, None), (2, 1, "broken"), (2, 2, '{"X": null}')]
    d = drift.unified(spark.createDataFrame(rec, "file_id bigint, rec_no int, payload string"), catalogue(spark))
    rows = {(r.file_id, r.rec_no): r for r in d.collect()}
    assert rows[1, 1].X == 4.5 and rows[1, 1].Intensity == 7 and rows[1, 1].extra == {"own": "a"}
    assert rows[1, 2].X is None and rows[2, 1].extra == {} and rows[2, 2].X is None


def test_unified_joins_columns_that_the_matching_pairs(spark):
    # rigtemp is rigtemperature and puls is Intensity, which the catalogue lists; gain1 and gain2 look alike but stand together in file 3
    names = {1: ("RigTemperature", "Intensity", "gain1"), 2: ("RigTemp", "Intensity", "gain2"), 3: ("RigTemp", "Intensities", "gain1", "gain2")}
    kinds = {"I": "uint16", "g": "int32", "R": "float"}
    s = [(f, k, n, kinds[n[0]], None) for f, ns in names.items() for k, n in enumerate(ns)]
    base = {"R": 20.5, "I": 900, "g": 7}
    rec = [(f, n, json.dumps({x: base[x[0]] + n for x in ns})) for f, ns in names.items() for n in range(3)]
    f = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 5)], "file_id bigint, series_id bigint, series_seq int")
    s = spark.createDataFrame(s, "file_id bigint, dim_pos int, dim_name string, dim_type string, dim_size int")
    r = spark.createDataFrame(rec, "file_id bigint, rec_no int, payload string")
    got = {(x.file_id, x.rec_no): x for x in drift.unified(r, catalogue(spark), drift.one_name(f, s, catalogue(spark), r)).collect()}
    assert len(got) == 9 and all(float(x.extra["rigtemp"]) == 20.5 + n and x.Intensity == 900 + n for (_, n), x in got.items())
    assert set(got[1, 0].extra) == {"rigtemp", "gain1"} and set(got[2, 0].extra) == {"rigtemp", "gain2"} and set(got[3, 0].extra) == {"rigtemp", "gain1", "gain2"}


# ---- units --------------------------------------------------------------------

ITEM = "file_id bigint, proj_wkt2 string, proj_bbox array<double>, remarks string, unit string"
HEAD = "file_id bigint, unitsxyz bigint, orgx double, orgy double, orgz double, minx bigint, miny bigint, minz bigint, maxx bigint, maxy bigint, maxz bigint, master_unit string, factor double"


def test_units_from_texts_and_graph(spark):
    us = 1200 / 3937
    items, heads = [], []
    for k in range(30):
        x, y, z = 1000.0 + 50 * k, 5_000_000.0 + 70 * k, 120.0 + k
        m = [x, y, z, x + 40, y + 40, z + 9]
        wkt = [f'PROJCS["a (m)",GEOGCS["g",UNIT["degree",0.0174]],UNIT["US survey foot",{us}]]', 'PROJCS["b",GEOGCS["g",UNIT["degree",0.0174]],UNIT["Meter"]]', None][k % 3]
        f = [us, 1.0, 0.01][k % 3]
        items.append((k, wkt, [v / f for v in m], "all coordinates: cm" if k % 3 == 2 else "Flown at about 900 ft.", "km"))
        heads.append((k, 100, 0.0, 0.0, 0.0, *(round(v / 2.5 * 100) for v in m), "Klafter", 1.0))
    heads += heads[:3] + [(99, 0, 0.0, 0.0, 0.0, 1, 1, 1, 1, 1, 1, "m", 1.0), (98, None, 0.0, 0.0, 0.0, 1, 1, 1, 1, 1, None, None, 1.0)]
    items += [(200, None, None, None, None), (201, None, [1.0, 2.0, 3.0, 4.0], "no unit here", None), (202, 'PROJCS["x",UNIT["foot",0.3048]]', [10.0, None, 30.0, 40.0], None, None), (None, None, [1.0] * 6, "bbox units=m", None)]
    out = units.in_metres(spark.createDataFrame(items, ITEM), spark.createDataFrame(heads, HEAD))
    rows = {(r.file_id, r.recorded_in, r.quantity): r for r in out.collect()}
    assert rows[0, "item", "minx"].metres == pytest.approx(1000) and rows[2, "item", "maxz"].metres == pytest.approx(131)
    # a unit that no table knows is found through the files it shares with others
    assert rows[1, "header", "miny"].metre_factor == pytest.approx(2.5, rel=1e-6) and rows[1, "header", "miny"].how == "graph"
    assert rows[202, "item", "maxy"].metres == pytest.approx(40 * 0.3048) and (202, "item", "miny") not in rows and (201, "item", "minx") not in rows
    assert (99, "header", "minx") not in rows and len([k for k in rows if k[1] == "header"]) == 180


def test_units_of_heights_and_words(spark):
    rows = [(1, 'PROJCS["p",UNIT["metre",1]]', [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "Höhen in survey feet (US)", None), (2, None, [1.0] * 6, "Lage in Metern, Höhen in usft", None), (3, None, [1.0] * 6, "Second delivery, swath gap of 40 m closed. altitudes en cm", None), (4, 'COMPD_CS["c",PROJCS["p",UNIT["km",1000]],VERT_CS["h",UNIT ["ft",0.30480]]]', [1.0] * 6, "Elevations: m.", None)]
    got = {r.file_id: (r.h_unit, r.v_unit, r.h_factor, r.v_factor) for r in units.item_units(spark.createDataFrame(rows, ITEM)).collect()}
    assert got[1] == ("metre", "survey feet (us)", 1.0, pytest.approx(1200 / 3937))
    assert got[2][0] == "metern" and got[2][3] == pytest.approx(1200 / 3937)
    assert got[3][0] is None and got[3][1] == "cm" and got[4] == ("km", "ft", 1000.0, 0.3048)
    empty = units.in_metres(spark.createDataFrame([], ITEM), spark.createDataFrame([], HEAD))
    assert empty.count() == 0


def test_shared_locations_of_many_rows_and_tags(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 7)
    rows = [(i, i % 3, 1.0, 1.0, 1.0) for i in range(60)] + [(100 + i, 5, 1.1, 1.0, 1.0) for i in range(20)] + [(200 + i, 9, 40.0, 1.0, 1.0) for i in range(30)] + [(300, None, 1.0, 1.0, 1.0)]
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    regions = spark.createDataFrame([(3, 1, [[square], None, []], 5, 1.0)], REGION)
    got = [tuple(r) for r in nearby.near_or_within(points(spark, rows), 0.3, regions).collect()]
    known = [r for r in rows if r[1] is not None]
    assert sorted(r[1:] for r in got if r[0] == "near") == sorted(pairs(known, 0.3))
    assert sorted(r[2] for r in got if r[0] == "within") == [r[0] for r in rows if r[0] < 120 or r[0] == 300]


def _ways(spark, rows, ranges=()):
    """source_factors of (file, source a, x, source b, y, step) in y, and of whole extents."""
    v = []
    for k, a, x, fa, b, y, fb, step in rows:
        v += [(k, "item", "miny", a, fa, x, 0.0), (k, "header", "miny", b, fb, y, step)]
    for k, a, xs, fa, b, ys, fb in ranges:
        v += [(k, "item", q, a, fa, x, 0.0) for q, x in zip(("miny", "maxy"), xs)] + [(k, "header", q, b, fb, y, 0.0) for q, y in zip(("miny", "maxy"), ys)]
    df = spark.createDataFrame(v, "file_id bigint, recorded_in string, quantity string, source string, factor double, value double, step double")
    return {r.source: r for r in units.source_factors(df).collect()}


def test_thin_evidence_leaves_the_declared_foot_and_more_overrules_it(spark):
    us = 1200 / 3937
    rows = [(1, "m", 5e6, 1.0, "foot", 5e6 / 0.3048 * (1 - 2e-6), 0.3048, 0.0)]
    rows += [(10 + k, "m", 5e6 + k, 1.0, "feet", (5e6 + k) / us, 0.3048, 1e-3) for k in range(9)]
    rows += [(30 + k, "m", 200.0 + k, 1.0, "coarse", round((200.0 + k) / us, 1), 0.3048, 0.1) for k in range(9)]
    rows += [(50, "m", 5e6, 1.0, "file:50", 5e8, None, 1.0), (51, "chain", 5e6 / 0.01, None, "file:50", 5e8, None, 1.0)]
    got = _ways(spark, rows)
    assert (got["foot"].metre_factor, got["foot"].how) == (0.3048, "declared")
    assert (got["feet"].metre_factor, got["feet"].how) == (us, "graph")  # nine sharp ratios against the text
    assert (got["coarse"].metre_factor, got["coarse"].how) == (0.3048, "graph")  # too coarse to tell: the text
    assert got["file:50"].metre_factor == 0.01 and got["chain"].metre_factor == pytest.approx(0.01)


def test_an_offset_beside_the_scale(spark):
    rows = [(k, "m", (5e6 + 900 * k, 5e6 + 900 * k + 300 + k), 1.0, "local", tuple((v - 4.2e6) / 0.3048 for v in (5e6 + 900 * k, 5e6 + 900 * k + 300 + k)), 0.3048) for k in range(12)]
    got = _ways(spark, [], rows)["local"]
    assert got.metre_factor == 0.3048 and got.y == pytest.approx(4.2e6) and got.x == got.z == 0.0
