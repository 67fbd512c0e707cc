"""Operators on small fixtures with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.functions import dims, expression
from nubila.operators import assign, features, ground, mesh, neighborhood, order, partition, register, sample, select, stats
from nubila.plans.pipeline import REGISTRY, Pipeline, PipelineError
from nubila.sources import binary, ept, tables, text
from nubila.spatial.components import components, independent
from nubila.spatial.neighbors import knn_join, radius_join
from nubila.streaming import operators as streaming


def cloud(spark, rows, names="X Y Z", **more):
    cols = ["pid", *names.split()]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ", ".join(f"{c} {'bigint' if c == 'pid' else 'double'}" for c in cols))


def column(df, name):
    return [r[name] for r in df.orderBy("pid").collect()]


# ---- expressions ----------------------------------------------------------------


@pytest.mark.parametrize("bad", ["X", "3 < 4", "X +", "X && Y", "!X", "X == 1 &&", "foo(X) > 1", "Q > 1", "X -- 1 > 0", "1 / 0 > X", "(X > 1"])
def test_bad_conditions(spark, bad):
    with pytest.raises(expression.ExpressionError):
        expression.condition(bad, ["X", "Y"])


def test_nan_and_division(spark):
    d = cloud(spark, [(1, 0, 0), (math.nan, 1, 0), (3, 2, 0)])
    ids = lambda e: [r.pid for r in select.expression(d, e).orderBy("pid").collect()]
    assert ids("X == X") == [0, 2] and ids("X != X") == [1] and ids("X > 2") == [2] and ids("!(X > 2)") == [0, 1]
    assert ids("isnan(X / Y)") == [0, 1] and ids("X / Y > 1") == [2] and ids("X > 0 || Y == 1") == [0, 1, 2]
    assert ids("-X + 2 * (Y - 1) >= -3 && X < highest()") == [0, 2]
    v = assign.assign(d, "A = log(Y)", "B = log(Y - 1)", "C = round(X + 0.5)", "D = floor(-1.5)").orderBy("pid").collect()
    assert v[0].A == -math.inf and math.isnan(v[0].B) and v[2].C == 4 and v[2].D == -2


def test_ranges_and_coercion(spark):
    d = cloud(spark, [(k, 0, 0) for k in range(6)])
    assert [r.pid for r in select.range_filter(d, "X(1:3],X[5:],Y[0:0]").orderBy("pid").collect()] == [2, 3, 5]
    assert [r.pid for r in select.range_filter(d, "X![1:4]").orderBy("pid").collect()] == [0, 5]
    c = d.withColumn("Classification", F.lit(0).cast("smallint"))
    assert column(assign.assign(c, "Classification = X + 0.5"), "Classification") == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="out of range"):
        assign.assign(c, "Classification = X + 300").collect()
    assert dims.resolve_type("uint8", "int8") == "int16" and dims.resolve_type("int32", "float") == "float" and dims.resolve_type("uint16", "uint32") == "uint32"


# ---- published small results ------------------------------------------------------


def test_moments(spark):
    s = stats.stats(cloud(spark, [(v, 0, 0) for v in (1, 5, 8, 25, 20, 17)]), ["X"], advanced=True).first()
    assert (s["count"], s.minimum, s.maximum) == (6, 1, 25) and s.average == pytest.approx(12.6667, abs=1e-4)
    assert s.variance == pytest.approx(88.2667, abs=1e-4) and s.skewness == pytest.approx(0.07653332827) and s.kurtosis == pytest.approx(-1.862062002)


def test_decimation(spark):
    d = tables.faux(spark, 30)
    assert column(select.decimation(d, 10), "pid") == [0, 10, 20]
    assert select.decimation(d, 4.2).count() == 7
    assert column(select.decimation(tables.faux(spark, 10), 3), "pid") == [0, 3, 6]


def test_grid_distances(spark):
    g = tables.faux(spark, bounds=(0, 10, 0, 10, 0, 10), mode="grid")
    assert {round(v, 6) for v in column(neighborhood.nndistance(g, 3), "NNDistance")} == {1.0}
    assert max(column(neighborhood.nndistance(g, 4), "NNDistance")) == pytest.approx(math.sqrt(2))


def test_text_variants(spark, tmp_path):
    for name, body in {"comma": "X,Y,Z\n1,2,3\n4,5,6\n", "quoted": '"X","Y","Z"\r\n1,2,3\r\n4,5,6\r\n', "space": "X Y Z\n1 2 3\n\n4 5 x\n7 8\n"}.items():
        p = tmp_path / f"{name}.txt"
        p.write_text(body)
        rows = [(r.X, r.Y, r.Z) for r in text.read_text(spark, str(p)).orderBy("pid").collect()]
        assert rows == [(1, 2, 3), (4, 5, 0 if name == "space" else 6)]
    p = tmp_path / "bare.txt"
    p.write_text("# x\n1;2;3\n")
    assert text.read_text(spark, str(p), header="X;Y;Z", skip=1).count() == 1


def test_sort_last_dimension_first(spark):
    d = cloud(spark, [(2, 1, 0), (1, 2, 0), (1, 1, 0)])
    assert [(r.X, r.Y) for r in order.sort(d, "X", "Y").orderBy("pid").collect()] == [(1, 1), (2, 1), (1, 2)]


def test_hag(spark):
    rows = [(0, 0, 0, 2), (2, 0, 4, 2), (0, 2, 2, 2), (1, 0, 10, 1), (0, 0, 7, 1)]
    d = cloud(spark, rows, "X Y Z Classification").withColumn("Classification", F.col("Classification").cast("smallint"))
    assert column(neighborhood.hag_nn(d, 2), "HeightAboveGround") == [0, 0, 0, 8, 7]
    assert column(mesh.hag_delaunay(d, 3), "HeightAboveGround") == pytest.approx([0, 0, 0, 8, 7])


def test_elm(spark):
    d = cloud(spark, [(0, 0, -9), (1, 1, -5), (2, 2, 0), (3, 3, 0.5), (4, 4, 3)]).withColumn("Classification", F.lit(1))
    assert column(ground.elm(d), "Classification") == [7, 7, 1, 1, 1]


# ---- against brute force ----------------------------------------------------------


@pytest.fixture(scope="module")
def random_cloud(spark):
    p = np.random.default_rng(11).uniform(0, 10, (400, 3)).round(2)
    return p, cloud(spark, p)


def test_joins(random_cloud):
    p, d = random_cloud
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    got = {(r.lpid, r.rpid) for r in radius_join(d, d, 1.5, ["X", "Y", "Z"]).collect()}
    assert got == set(map(tuple, np.argwhere(d2 < 2.25).tolist()))
    near = {(r.lpid, r.place): r.rpid for r in knn_join(d, d, 5, ["X", "Y", "Z"], cell_rows=30).collect()}
    order_ = np.argsort(d2, axis=1, kind="stable")
    assert all(near[i, k + 1] == order_[i, k] for i in range(400) for k in range(5))


@pytest.mark.parametrize("group", [1_000_000, 300])
def test_greedy_thinning(random_cloud, monkeypatch, group):
    monkeypatch.setattr("nubila.spatial.components.GROUP_LINKS", group)
    p, d = random_cloud
    kept = []
    for i, q in enumerate(p):
        if all(((q - p[j]) ** 2).sum() >= 4 for j in kept):
            kept.append(i)
    assert column(sample.sample(d, 2.0), "pid") == kept
    low = sorted(range(400), key=lambda i: (p[i, 2], i))
    taken = []
    for i in low:
        if all(((p[i, :2] - p[j, :2]) ** 2).sum() >= 4 for j in taken):
            taken.append(i)
    c = ground.sparsesurface(d.withColumn("Classification", F.lit(0)), 2.0)
    assert [i for i, v in enumerate(column(c, "Classification")) if v == 2] == sorted(taken)


def test_clusters(random_cloud):
    p, d = random_cloud
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) < 0.81
    label = list(range(400))
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(400)]
        changed, label = new != label, new
    sizes = {t: label.count(t) for t in set(label)}
    number = {t: k + 1 for k, t in enumerate(sorted(t for t in sizes if sizes[t] >= 2))}
    assert column(neighborhood.cluster(d, 2, tolerance=0.9), "ClusterID") == [number.get(t, 0) for t in label]
    core = near.sum(axis=1) >= 4
    top = [i if core[i] else -1 for i in range(400)]
    changed = True
    while changed:
        new = [min(top[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(400)]
        changed, top = new != top, new
    top = [t if core[i] else min((top[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i, t in enumerate(top)]
    number = {t: k for k, t in enumerate(sorted({t for t in top if t >= 0}))}
    assert column(neighborhood.dbscan(d, 4, 0.9), "ClusterID") == [number.get(t, -1) for t in top]


def test_components_and_sets_of_nothing(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none).count() == 0
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    assert {r.component for r in components(path).collect()} == {0}
    nodes = spark.createDataFrame([(k, k) for k in range(5)], "id bigint, rank bigint")
    assert independent(nodes, none).where("kept").count() == 5


def test_geometry(random_cloud):
    p, d = random_cloud
    plane = d.withColumn("Z", F.col("X") * 0.5)
    n = features.normal(plane, 12).first()
    assert abs(n.NormalX / n.NormalZ + 0.5) < 1e-6 and n.NormalZ > 0 and abs(n.Curvature) < 1e-9
    e = features.eigenvalues(d, 8).orderBy("pid").first()
    i = np.argsort(((p - p[0]) ** 2).sum(axis=1), kind="stable")[:9]
    assert [e.Eigenvalue0, e.Eigenvalue1, e.Eigenvalue2] == pytest.approx(np.linalg.eigvalsh(np.cov(p[i].T)).tolist())
    c, r = features.smallest_balls(np.array([[[0, 0, 0], [2, 0, 0], [1, 0.5, 0]], [[0, 0, 0], [0, 0, 0], [0, 0, 0]]], dtype=float))
    assert r.tolist() == pytest.approx([1.0, 0.0]) and c[0].tolist() == pytest.approx([1, 0, 0])


def test_triangles_cover_the_hull():
    p = np.random.default_rng(4).uniform(0, 1, (60, 2))
    t = mesh.triangulate(p)
    x = p[t]
    area = np.abs((x[:, 1, 0] - x[:, 0, 0]) * (x[:, 2, 1] - x[:, 0, 1]) - (x[:, 1, 1] - x[:, 0, 1]) * (x[:, 2, 0] - x[:, 0, 0])) / 2
    hull = sorted(map(tuple, p))

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(half(hull) + half(hull[::-1]))
    whole = abs((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum()) / 2
    assert area.sum() == pytest.approx(whole, rel=1e-6)
    assert len(mesh.triangulate(np.array([[0, 0], [1, 1], [2, 2.0]]))) == 0


def test_registration(random_cloud):
    _, d = random_cloud
    a = 0.02
    m = [math.cos(a), -math.sin(a), 0, 0.05, math.sin(a), math.cos(a), 0, -0.05, 0, 0, 1, 0.03, 0, 0, 0, 1]
    moved, found = register.icp(d, assign.transformation(d, m), max_iter=25)
    back = np.array(found["transform"]).reshape(4, 4) @ np.array(m).reshape(4, 4)
    assert np.abs(back - np.eye(4)).max() < 0.02


def test_ground_of_a_plain_with_blocks(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 40, (4000, 2))
    block = (np.abs(xy - 20) < 3).all(axis=1)
    d = cloud(spark, np.c_[xy, np.where(block, 8.0, 0.0) + rng.normal(0, 0.02, 4000)]).withColumn("Classification", F.lit(0))
    for f in (lambda c: ground.smrf(c), lambda c: ground.pmf(c, max_window_size=20.0), lambda c: ground.csf(c, iterations=200)):
        got = np.array(column(f(d), "Classification")) == 2
        assert (got == ~block).mean() > 0.97


# ---- formats, pipelines, streams ----------------------------------------------------


def test_binary_round_trips(spark, tmp_path):
    d = cloud(spark, [(1.25, 2.5, -3.75), (4, 5, 6)]).coalesce(1)
    for kind, opts in (("las", {"dataformat_id": 3}), ("las", {}), ("ply", {"storage_mode": "little endian"}), ("ply", {"storage_mode": "big endian"}), ("pcd", {}), ("bpf", {}), ("bpf", {"format": "byte"}), ("bpf", {"format": "point"})):
        path = str(tmp_path / f"{kind}-{len(json.dumps(opts))}-{opts.get('format', '')}")
        binary.write_points(d, kind, path, **opts)
        rows = [v for r in binary.read_points(spark, kind, path).orderBy("pid").collect() for v in (r.X, r.Y, r.Z)]
        assert rows == pytest.approx([1.25, 2.5, -3.75, 4, 5, 6]), (kind, opts)


def test_pipelines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("X,Y,Z\n1,2,3\n4,5,6\n7,8,9\n")
    p = Pipeline.from_json("""[ // comment
      {"type": "readers.text", "filename": "%s", "tag": "a"},
      {"type": "filters.assign", "value": "Z = 0", "where": "X > 3", "inputs": "a"},
      {"type": "writers.text", "filename": "%s", "precision": 1} ]""" % (tmp_path / "a.txt", tmp_path / "out"))
    assert [(r.X, r.Z) for r in p.execute(spark).orderBy("Z", "X").collect()] == [(4, 0), (7, 0), (1, 3)]
    assert text.read_text(spark, str(tmp_path / "out")).count() == 3
    assert len(Pipeline.from_json(p.to_json()).stages) == 3
    for bad in ("[]", '[{"type": "filters.nothing"}]', '[{"type": "filters.sort", "dimension": "X"}]', '[{"type": "readers.text", "filename": "x.txt", "inputs": ["q"]}]', '["x.unknown", "y.las"]'):
        with pytest.raises(PipelineError):
            Pipeline.from_json(bad)
    with pytest.raises(PipelineError):
        REGISTRY["readers.e57"].run(spark, "x")


def test_text_header_is_in_the_first_file_not_in_the_largest(spark, tmp_path):
    (tmp_path / "a 1.txt").write_text('"X","Y","Z"\n1,2,3\n')
    (tmp_path / "b.txt").write_text("".join(f"{k},5,6\n" for k in range(100)))
    assert [(r.pid, r.X, r.Y, r.Z) for r in text.read_text(spark, str(tmp_path)).orderBy("pid").collect()] == [(0, 1, 2, 3)] + [(k + 1, k, 5, 6) for k in range(100)]
    assert text.read_text(spark, str(tmp_path), header="X,Y,Z", skip=1).count() == 100  # a line of each file


def test_partition_views(spark):
    d = tables.faux(spark, 10, (0, 9, 0, 9, 0, 9), "ramp")
    assert [r["count"] for r in stats.stats(partition.divider(d, count=3), ["X"]).orderBy("view_id").collect()] == [4, 4, 2]
    assert max(r["count"] for r in partition.chipper(d, 3).groupBy("view_id").count().collect()) <= 3
    assert partition.merge(d, d.drop("OffsetTime")).count() == 20


def chips(p, capacity):
    """View of each row: all rows sorted in each box, as one process does."""
    n, view = len(p), np.zeros(len(p), int)
    views = -(-n // capacity)
    ends = [0, *(math.floor(t + 0.5) for t in np.cumsum(np.full(views, n / views)))]

    def split(rows, b, e, before):
        if e - b == 1:
            view[rows] = b
            return
        side = np.ptp(p[rows], axis=0)
        axis = before if side[before] > side[1 - before] else 1 - before
        c = (b + e) // 2
        by = sorted(rows, key=lambda i: (p[i][axis], i))
        split(by[: ends[c] - ends[b]], b, c, axis)
        split(by[ends[c] - ends[b] :], c, e, axis)

    split(list(range(n)), 0, views, 0)
    return view.tolist()


@pytest.mark.parametrize("task_rows, cut_rows", [(10**6, 10**6), (60, 40)])
def test_chipper_splits_at_exact_rows(spark, monkeypatch, task_rows, cut_rows):
    monkeypatch.setattr(partition, "TASK_ROWS", task_rows)
    monkeypatch.setattr(partition, "CUT_ROWS", cut_rows)
    monkeypatch.setattr(partition, "BINS", 64)
    rng = np.random.default_rng(2)
    p = np.r_[rng.integers(0, 30, (500, 2)), np.full((300, 2), 7), [[10**9, 3]], rng.normal(50, 1, (100, 2))].astype(float)
    rng.shuffle(p)
    d = cloud(spark, [(*q, 0) for q in p])
    got = partition.chipper(d, 20)
    assert got.columns == [*d.columns, "view_id"] and column(got, "view_id") == chips(p, 20)
    assert column(partition.chipper(d, 1000), "view_id") == [0] * len(p) and partition.chipper(d.limit(0), 20).count() == 0


def test_chipper_plan_does_not_double_with_each_round(spark):
    seen = []
    d = spark.range(4096).select(F.col("id").alias("pid"), (F.col("id") % 64).cast("double").alias("X"), F.floor(F.col("id") / 64).cast("double").alias("Y"))
    for capacity in (1024, 64):
        plan = partition.chipper(d, capacity)._jdf.queryExecution().optimizedPlan().toString()
        seen.append(plan.count("Join"))
    assert seen[1] <= seen[0] + 10


@pytest.mark.parametrize("count, darts, shuffle", [(5, 20_000, True), (40, 20_000, True), (40, 30, True), (120, 30, False), (400, 20_000, True), (500, 30, True)])
def test_dart_throwing_takes_one_row_after_the_other(spark, monkeypatch, count, darts, shuffle):
    monkeypatch.setattr(sample, "DARTS", darts, raising=False)
    monkeypatch.setattr(sample, "HELD", 60, raising=False)
    monkeypatch.setattr(sample, "radius_join", lambda *a, **k: pytest.fail("rows are paired with each other"))
    rng = np.random.default_rng(6)
    p = np.r_[rng.integers(-40, 40, (250, 3)), np.full((130, 3), 3), rng.normal(0, 2, (50, 3)), [[math.nan, 0, 0]]].astype(float)
    d = cloud(spark, p)
    order_ = [r.pid for r in d.orderBy(F.xxhash64("pid", F.lit(3)) if shuffle else "pid").collect()]
    taken, r = [], 30.0
    while len(taken) < count and r >= 2:
        for i in order_:
            if len(taken) < count and i not in taken and not (((p[taken] - p[i]) ** 2).sum(axis=1) < r * r).any():
                taken.append(i)
        r *= 0.6
    want = taken if count <= len(p) else order_
    assert sorted(column(sample.relaxationdartthrowing(d, count, 30.0, 0.6, 2.0, shuffle, 3), "pid")) == sorted(want)


def test_stream_equals_batch(spark, tmp_path):
    d = spark.range(50).selectExpr("id pid", "timestamp_seconds(id * 60) t", "cast(id % 7 as double) Z", "cast(id as double) X", "0.0D Y")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_stats(select.expression(s, "Z > 1"), "t", "Z", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = streaming.windowed_stats(select.expression(d, "Z > 1"), "t", "Z", "10 minutes")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        streaming.refuse("head")


def test_projections(spark):
    d = cloud(spark, [(9.0, 0.0, 0), (10.0, 48.0, 5), (7.2, -33.0, 1)])
    u = assign.reprojection(d, "EPSG:4326", "EPSG:32632").orderBy("pid").collect()
    assert (u[0].X, u[0].Y) == pytest.approx((500000, 0), abs=1e-6)
    assert (u[1].X, u[1].Y) == pytest.approx((574591.2, 5316782.4), abs=60)
    back = assign.reprojection(assign.reprojection(d, "EPSG:4326", "EPSG:32632"), "EPSG:32632", "EPSG:4326").orderBy("pid").collect()
    assert [v for r in back for v in (r.X, r.Y)] == pytest.approx([9, 0, 10, 48, 7.2, -33], abs=1e-9)
    m = assign.reprojection(d, "EPSG:4326", "EPSG:3857").orderBy("pid").first()
    assert (m.X, m.Y) == pytest.approx((9 * math.pi / 180 * 6378137, 0), abs=1e-6)
    with pytest.raises(ValueError):
        assign.reprojection(d, "EPSG:4326", "EPSG:9999")


def test_tracks_and_polygons(spark):
    d = cloud(spark, [(1, 2, 3), (11, 1, 0)])
    track = [(0, 0, 0, 0), (10, 0, 0, 0), (10, 10, 0, 0)]
    s = assign.straighten(d, track)
    assert [v for r in s.orderBy("pid").collect() for v in (r.X, r.Y, r.Z)] == pytest.approx([1, 2, 3, 11, -1, 0])
    again = assign.straighten(s, track, reverse=True)
    assert [v for r in again.orderBy("pid").collect() for v in (r.X, r.Y, r.Z)] == pytest.approx([1, 2, 3, 11, 1, 0])
    regions = spark.createDataFrame([(2, 7, [[[[0.0, 0.0], [5.0, 0.0], [5.0, 5.0], [0.0, 5.0]]]]), (1, None, None), (3, 9, [[[[0.0, 0.0], [20.0, 0.0], [20.0, 5.0], [0.0, 5.0]]]])], "region_id int, cls int, geom_coordinates array<array<array<array<double>>>>")
    assert column(assign.overlay(d, regions, "Zone", "cls"), "Zone") == [7, 9]
    inside = assign.geomdistance(d, "POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0))").orderBy("pid").collect()
    assert [r.distance for r in inside] == pytest.approx([0, 6])


def test_comparison_of_two_clouds(spark):
    rng = np.random.default_rng(0)
    p = np.c_[rng.uniform(0, 10, (2000, 2)), rng.normal(0, 0.01, 2000)]
    a, b = cloud(spark, p), cloud(spark, p + (0, 0, 0.5))
    r = register.m3c2(a, b, cloud(spark, [(5, 5, 0)]), 1.0, 1.0, 2.0).first()
    assert r.m3c2_distance == pytest.approx(0.5, abs=0.02) and r.m3c2_significant == 1 and r.m3c2_count1 > 20
    assert neighborhood.hausdorff(a, b).first().hausdorff <= 0.5 + 1e-9


# ---- octree folders and appending ---------------------------------------------------


@pytest.mark.parametrize("kind", ["binary", "zstandard"])
def test_ept_reads_only_what_bounds_and_resolution_ask_for(spark, tmp_path, kind):
    import zstandard

    rng = np.random.default_rng(4)
    schema = [{"name": a, "type": "signed", "size": 4, "scale": 0.01, "offset": 100.0} for a in "XYZ"] + [{"name": "Intensity", "type": "unsigned", "size": 2}]
    info = {"bounds": [0, 0, 0, 64, 64, 64], "dataType": kind, "schema": schema, "span": 16}
    (tmp_path / "ept-data").mkdir()
    (tmp_path / "ept-hierarchy").mkdir()
    (tmp_path / "ept.json").write_text(json.dumps(info))
    all_, tree, sub = [], {"0-0-0-0": 5}, {}
    keys = [(0, 0, 0, 0)] + [(1, i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)] + [(2, 3, 3, 3)]
    for key in keys:
        name, size = "-".join(map(str, key)), 64 / 2 ** key[0]
        xyz = np.round((np.array(key[1:]) + rng.uniform(0.05, 0.95, (5, 3))) * size, 2)
        rec = np.zeros(5, np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("Intensity", "<u2")]))
        for a, c in enumerate("XYZ"):
            rec[c] = np.rint((xyz[:, a] - 100) / 0.01)
        rec["Intensity"] = key[0]
        raw = rec.tobytes()
        (tmp_path / "ept-data" / f"{name}.{'bin' if kind == 'binary' else 'zst'}").write_bytes(raw if kind == "binary" else zstandard.compress(raw))
        all_ += [(*map(float, p), key[0]) for p in xyz]
        (sub if key[0] == 2 or key == (1, 1, 1, 1) else tree)[name] = 5
    tree["1-1-1-1"] = -1
    (tmp_path / "ept-hierarchy" / "0-0-0-0.json").write_text(json.dumps(tree))
    (tmp_path / "ept-hierarchy" / "1-1-1-1.json").write_text(json.dumps(sub))
    got = lambda **kw: sorted((round(r.X, 2), round(r.Y, 2), round(r.Z, 2), int(r.Intensity)) for r in ept.read_ept(spark, str(tmp_path), **kw).collect())
    assert got() == sorted(all_)
    assert got(resolution=2.0) == sorted(p for p in all_ if p[3] <= 1) and got(resolution=1e9) == sorted(p for p in all_ if p[3] == 0)
    assert got(bounds=(0, 0, 31, 31)) == sorted(p for p in all_ if p[0] <= 31 and p[1] <= 31)
    (tmp_path / "ept-data" / f"1-0-0-0.{'bin' if kind == 'binary' else 'zst'}").unlink()  # not opened
    assert got(bounds=(33, 33, 33, 64, 64, 64)) == sorted(p for p in all_ if min(p[:3]) >= 33)
    assert got(bounds=(200, 200, 300, 300)) == []


def test_appending_files_keeps_those_before(spark, tmp_path):
    d = spark.createDataFrame([(i, float(i), 2.0, 3.0, 2) for i in range(10)], "pid bigint, X double, Y double, Z double, Classification smallint")
    for _ in range(2):
        binary.write_points(d.repartition(2), "las", str(tmp_path / "out"))
    assert binary.read_points(spark, "las", str(tmp_path / "out")).count() == 20 and all(p.name.startswith("part-") for p in (tmp_path / "out").iterdir())
