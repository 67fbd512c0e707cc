"""Pipelines: JSON (or lists of stages) to one lazy DataFrame a leaf.

A stage is a reader, filter or writer with options; ``tag`` and ``inputs`` name
the edges. Nothing runs until a writer or an action does.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expression import condition
from ..operators import assign, features, ground, mesh, neighborhood, order, partition, register, sample, select, stats
from ..sources import binary, ept, tables, text


@dataclass
class Spec:
    kind: str
    run: Callable
    #: Filters that keep every row: skipped rows go back into the view; others: into a view of their own.
    keeps_rows: bool = False
    inputs: str = "one"
    names: dict = field(default_factory=dict)


REGISTRY: dict[str, Spec] = {}


class PipelineError(ValueError):
    pass


def register_stage(name: str, run: Callable, kind: str = "filter", keeps_rows: bool = False, inputs: str = "one", **names: str) -> None:
    """Make ``run`` (DataFrame -> DataFrame and options) a stage; ``names``: option of a pipeline = parameter's name."""
    REGISTRY[name] = Spec(kind, run, keeps_rows, inputs, names)


def _list(v) -> list[str]:
    return [x.strip() for x in v.split(",")] if isinstance(v, str) else list(v)


def _bounds(v) -> list[float]:
    """([a, b], [c, d] [, [e, f]]) or a flat list."""
    if isinstance(v, str):
        v = json.loads(v.replace("(", "[").replace(")", "]"))
    return [float(x) for p in v for x in (p if isinstance(p, list) else [p])]


def _crop(df, bounds=None, polygon=None, point=None, distance=0.0, outside=False):
    many = lambda v: v if isinstance(v, list) and v and not isinstance(v[0], (int, float)) else [v]
    boxes = None if bounds is None else [_bounds(b) for b in (bounds if isinstance(bounds, list) and isinstance(bounds[0], str) else [bounds])]
    pts = None if point is None else [[float(x) for x in (p.replace("POINT", "").strip(" ()").split() if isinstance(p, str) else p)] for p in many(point)]
    return select.crop(df, bounds=boxes, polygons=None if polygon is None else many(polygon), points=pts, distance=distance, outside=outside)


def _gpstime(df, conversion=None, in_time=None, out_time=None, **kw):
    if conversion:
        in_time, out_time = conversion.lower().split("2")
    return assign.gpstimeconvert(df, in_time, out_time, **kw)


def _write_raster(df, filename, resolution, output_type="all", origin_x=None, origin_y=None, nodata=-9999.0, **kw):
    outs = ["min", "max", "mean", "idw", "count", "stdev"] if output_type in ("all", ["all"]) else _list(output_type)
    if origin_x is None:
        b = df.agg(F.min("X"), F.min("Y")).first()
        origin = (b[0], b[1])
    else:
        origin = (float(origin_x), float(origin_y))
    cells = stats.raster(df, resolution, outs, origin=origin, **kw)
    for o in outs:
        tables.write_grid(cells, filename if len(outs) == 1 else f"{filename}.{o}", o, resolution, origin, nodata)


def _text_writer(df, filename, format="csv", order=None, keep_unspecified=True, write_header=True, delimiter=",", quote_header=True, precision=3):
    if format.lower() == "geojson":
        return text.write_geojson(df, filename)
    text.write_text(df, filename, write_header=write_header, order=_list(order) if order else None, keep_unspecified=keep_unspecified, delimiter=delimiter, quote_header=quote_header, precision=precision)


def _values(f):
    return lambda df, value=(), **kw: f(df, *([value] if isinstance(value, str) else value), **kw)


def _setup() -> None:
    r = register_stage
    one = {
        "expression": lambda df, expression: select.expression(df, *([expression] if isinstance(expression, str) else expression)),
        "range": lambda df, limits: select.range_filter(df, limits if isinstance(limits, str) else ",".join(limits)),
        "mongo": lambda df, expression: select.mongo(df, expression), "crop": _crop, "head": select.head, "tail": select.tail,
        "decimation": select.decimation, "returns": lambda df, groups="last": select.returns(df, _list(groups)), "locate": select.locate, "iqr": select.iqr, "mad": select.mad,
        "sample": sample.sample, "voxeldownsize": lambda df, cell=0.001, mode="center": sample.voxeldownsize(df, cell, mode.lower()),
        "voxelcenternearestneighbor": sample.voxelcenternearestneighbor, "voxelcentroidnearestneighbor": sample.voxelcentroidnearestneighbor,
        "fps": sample.fps, "relaxationdartthrowing": sample.relaxationdartthrowing, "groupby": partition.groupby, "divider": partition.divider, "splitter": partition.splitter,
        "chipper": partition.chipper, "separatescanline": partition.separatescanline, "streamcallback": assign.streamcallback,
    }
    for name, f in one.items():
        r(f"filters.{name}", f)
    keep = {
        "assign": _values(assign.assign), "ferry": lambda df, dimensions: assign.ferry(df, dimensions if isinstance(dimensions, str) else ",".join(dimensions)), "transformation": assign.transformation,
        "reprojection": assign.reprojection, "projpipeline": assign.projpipeline, "gpstimeconvert": _gpstime, "colorinterp": assign.colorinterp, "colorization": assign.colorization,
        "hag_dem": assign.hag_dem, "overlay": assign.overlay, "geomdistance": assign.geomdistance, "georeference": assign.georeference, "straighten": assign.straighten,
        "sort": lambda df, dimensions=None, dimension=None, order="ASC": order_sort(df, dimensions or dimension, order), "randomize": order.randomize, "mortonorder": order.mortonorder,
        "gridDecimation": lambda df, resolution=1.0, output_type="max", value=(): sample.griddecimation(df, resolution, output_type, *([value] if isinstance(value, str) else value)),
        "label_duplicates": lambda df, dimensions: sample.label_duplicates(df, *_list(dimensions)),
        "nndistance": neighborhood.nndistance, "radialdensity": neighborhood.radialdensity, "lof": neighborhood.lof, "reciprocity": neighborhood.reciprocity, "outlier": neighborhood.outlier,
        "cluster": neighborhood.cluster, "dbscan": neighborhood.dbscan, "lloydkmeans": neighborhood.lloydkmeans, "neighborclassifier": neighborhood.neighborclassifier,
        "radiusassign": lambda df, src_domain, reference_domain, radius, update_expression=(), **kw: neighborhood.radiusassign(df, src_domain, reference_domain, radius, *([update_expression] if isinstance(update_expression, str) else update_expression), **kw),
        "hag_nn": neighborhood.hag_nn, "hag_delaunay": mesh.hag_delaunay, "zsmooth": neighborhood.zsmooth, "normal": features.normal, "eigenvalues": features.eigenvalues,
        "covariancefeatures": features.covariancefeatures, "optimalneighborhood": features.optimalneighborhood, "planefit": features.planefit, "approximatecoplanar": features.approximatecoplanar,
        "estimaterank": features.estimaterank, "miniball": features.miniball, "elm": ground.elm, "pmf": ground.pmf, "smrf": ground.smrf, "csf": ground.csf,
        "skewnessbalancing": ground.skewnessbalancing, "sparsesurface": ground.sparsesurface, "litree": ground.litree, "supervoxel": ground.supervoxel,
    }
    for name, f in keep.items():
        r(f"filters.{name}", f, keeps_rows=True, **{"class": "class_"}, ground_class="ground_class")
    r("filters.dem", select.dem)
    # views that only report
    for name, f in {"stats": stats.stats, "info": stats.info, "hexbin": stats.hexbin, "expressionstats": lambda df, dimension, expressions: stats.expressionstats(df, dimension, *_list(expressions)), "delaunay": mesh.delaunay, "faceraster": mesh.faceraster}.items():
        r(f"filters.{name}", f, kind="report")
    r("filters.merge", partition.merge, inputs="all")
    r("filters.icp", lambda fixed, moving, **kw: register.icp(fixed, moving, **kw)[0], inputs="all")
    r("filters.m3c2", register.m3c2, inputs="all")
    r("filters.python", lambda df, function, **_: function(df))
    r("filters.matlab", lambda df, function, **_: function(df))

    src = {
        "text": text.read_text, "pts": text.read_pts, "gdal": text.read_grid, "ilvis2": text.read_ilvis2, "faux": lambda spark, filename=None, bounds=(0, 1, 0, 1, 0, 1), **kw: tables.faux(spark, bounds=tuple(_bounds(bounds)), **kw),
        "arrow": tables.read_columns, "buffer": lambda spark, filename=None, view=None: view, "memoryview": lambda spark, filename=None, data=None: tables.from_memory(spark, data), "numpy": lambda spark, filename=None, data=None: tables.from_memory(spark, data),
    }
    for name, f in src.items():
        r(f"readers.{name}", f, kind="reader")
    for k in binary.KINDS:
        r(f"readers.{k}", lambda spark, filename, _k=k, **kw: binary.read_points(spark, _k, filename, **kw), kind="reader")
    r("readers.ept", _read_ept, kind="reader")
    r("readers.tindex", _read_index, kind="reader")
    r("readers.stac", _read_stac, kind="reader")
    r("readers.pgpointcloud", lambda spark, filename=None, connection="", table="", where=None, **kw: tables.read_jdbc(spark, connection, table, where, **kw), kind="reader")
    r("writers.text", _text_writer, kind="writer")
    r("writers.ogr", lambda df, filename, **_: text.write_geojson(df, filename), kind="writer")
    r("writers.gdal", _write_raster, kind="writer")
    r("writers.raster", lambda cells, filename, value="value", resolution=1.0, origin=(0.0, 0.0), nodata=-9999.0: tables.write_grid(cells, filename, value, resolution, origin, nodata), kind="writer")
    r("writers.arrow", lambda df, filename, format="parquet", geometry=None: tables.write_feather(df, filename) if format == "feather" else tables.write_columns(df, filename, geometry), kind="writer")
    r("writers.null", lambda df, filename=None: tables.write_null(df), kind="writer")
    for k in binary.WRITERS:
        r(f"writers.{k}", lambda df, filename, _k=k, **kw: binary.write_points(df, _k, filename, **kw), kind="writer")

    why = {
        "codec or vendor library that is not installed": "readers.i3s readers.slpk readers.copc readers.draco readers.e57 readers.hdf readers.icebridge readers.matlab readers.mbio readers.nitf readers.osg readers.rdb readers.rxp readers.spz readers.tiledb readers.optech readers.fbi writers.copc writers.ept_addon writers.gltf writers.fbi writers.draco writers.e57 writers.matlab writers.nitf writers.spz writers.tiledb writers.pgpointcloud writers.fbx filters.h3",
        "method that is not data processing at scale": "filters.greedyprojection filters.poisson filters.cpd filters.teaser filters.trajectory",
        "shell command, which pipelines may not run": "filters.shell",
        "language runtime that is not installed": "filters.julia",
    }
    for reason, names in why.items():
        for name in names.split():
            r(name, _refuse(name, reason), kind=name.split(".")[0][:-1])


def _refuse(name: str, reason: str):
    def run(*_, **__):
        raise PipelineError(f"{name} needs a {reason}")

    return run


def order_sort(df, dimensions, way="ASC"):
    return order.sort(df, *_list(dimensions), order=way)


def _read_index(spark, filename, bounds=None, where=None, reader="readers.arrow", reader_args=None, location="location"):
    """Only the files that the index says can matter are read; their rows are cropped to the bounds."""
    index = spark.read.parquet(filename)
    b = _bounds(bounds) if bounds else None
    files = tables.indexed_files(index, tuple(b[:4]) if b else None, where, location)
    if not files:
        raise PipelineError("the index names no file")
    out = partition.merge(*(REGISTRY[reader].run(spark, f, **(reader_args or {})) for f in files))
    return select.crop(out, bounds=b) if b else out


def _read_ept(spark, filename, bounds=None, resolution=None, **_):
    b = _bounds(bounds) if bounds else None
    b = (b[0], b[2], *([b[4]] if len(b) > 4 else []), b[1], b[3], *([b[5]] if len(b) > 4 else [])) if b else None
    return ept.read_ept(spark, filename, b, resolution)


def _read_stac(spark, filename, reader="readers.arrow", reader_args=None, **filters):
    hrefs = sorted(r["href"] for r in tables.stac_items(spark, filename, **filters).collect())
    if not hrefs:
        raise PipelineError("no item matches")
    return partition.merge(*(REGISTRY[reader].run(spark, h, **(reader_args or {})) for h in hrefs))


# Formats of file endings.
READER_OF = {"las": "las", "laz": "las", "txt": "text", "csv": "text", "xyz": "text", "pts": "pts", "ptx": "ptx", "ply": "ply", "pcd": "pcd", "obj": "obj", "parquet": "arrow", "feather": "arrow", "sbet": "sbet", "out": "sbet", "smrmsg": "smrmsg", "qi": "qfit", "bin": "terrasolid", "bpf": "bpf", "asc": "gdal"}
WRITER_OF = {"las": "las", "laz": "las", "txt": "text", "csv": "text", "xyz": "text", "json": "text", "geojson": "ogr", "ply": "ply", "pcd": "pcd", "parquet": "arrow", "feather": "arrow", "sbet": "sbet", "bpf": "bpf", "asc": "gdal"}


def inferred(filename: str, writer: bool) -> str:
    ext = os.path.splitext(filename)[1][1:].lower()
    table = WRITER_OF if writer else READER_OF
    if ext not in table:
        raise PipelineError(f"no {'writer' if writer else 'reader'} for {filename!r}")
    return f"{'writers' if writer else 'readers'}.{table[ext]}"


_setup()


@dataclass
class Stage:
    type: str
    options: dict
    inputs: list[int]
    tag: str | None = None


class Pipeline:
    def __init__(self, stages: list[Stage]):
        self.stages = stages

    @staticmethod
    def from_json(source: str | list | dict) -> "Pipeline":
        tree = tables.load_json(source) if isinstance(source, str) else source
        if isinstance(tree, dict):
            tree = tree["pipeline"] if "pipeline" in tree else next(iter(tree.values()), None)
        if not isinstance(tree, list) or not tree:
            raise PipelineError("a pipeline is a list of stages")
        stages: list[Stage] = []
        tags: dict[str, list[int]] = {}
        waiting: list[int] = []
        for k, node in enumerate(tree):
            node = {"filename": node} if isinstance(node, str) else dict(node)
            kind, tag, inputs = node.pop("type", None), node.pop("tag", None), node.pop("inputs", None)
            if kind is None:
                if "filename" not in node:
                    raise PipelineError("a stage needs a type or a filename")
                kind = inferred(node["filename"], writer=k == len(tree) - 1 and k > 0)
            if kind not in REGISTRY:
                raise PipelineError(f"unknown stage {kind!r}")
            if tag is not None and (tag in tags or not tag[:1].isalpha()):
                raise PipelineError(f"bad or repeated tag {tag!r}")
            named = [i for t in ([inputs] if isinstance(inputs, str) else inputs or ()) for i in _tagged(tags, t)]
            made = []
            if REGISTRY[kind].kind == "reader":
                if named:
                    raise PipelineError("a reader takes no inputs")
                files = sorted(glob(node["filename"])) if any(c in str(node.get("filename", "")) for c in "*?[") else [node.get("filename")]
                for f in files or [node.get("filename")]:
                    stages.append(Stage(kind, {**node, **({"filename": f} if f is not None else {})}, [], tag))
                    made.append(len(stages) - 1)
                waiting += made
            else:
                source_ids = named or waiting
                if not source_ids:
                    raise PipelineError(f"{kind} has no input")
                stages.append(Stage(kind, node, list(source_ids), tag))
                made = [len(stages) - 1]
                waiting = list(made)
            if tag is not None:
                tags[tag] = made
        return Pipeline(stages)

    def to_json(self) -> str:
        """The stages with a tag each, so that it can be read again."""
        name = lambda k: self.stages[k].tag or f"stage{k}"
        out = [{"type": s.type, "tag": name(k), **({"inputs": [name(i) for i in s.inputs]} if s.inputs else {}), **{o: v for o, v in s.options.items() if isinstance(v, (str, int, float, bool, list, dict))}} for k, s in enumerate(self.stages)]
        return json.dumps({"pipeline": out})

    def leaves(self) -> list[int]:
        used = {i for s in self.stages for i in s.inputs}
        return [k for k in range(len(self.stages)) if k not in used]

    def build(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The lazy result of a stage (the first leaf); writers are seen through to their input."""
        made: dict[int, DataFrame] = {}

        def result(k: int) -> DataFrame:
            if k not in made:
                made[k] = self._apply(spark, k, [result(i) for i in self.stages[k].inputs])
            return made[k]

        return result(self.leaves()[0] if upto is None else upto)

    def _apply(self, spark, k, inputs):
        s = self.stages[k]
        spec = REGISTRY[s.type]
        opts = {spec.names.get(n, n): v for n, v in s.options.items() if n not in ("user_data", "log", "option_file", "spatialreference", "override_srs", "default_srs")}
        if spec.kind == "reader":
            count = opts.pop("count", None) if s.type != "readers.faux" else None
            path = opts.pop("filename", None)
            df = spec.run(spark, path, **opts) if path is not None else spec.run(spark, **opts)
            return select.head(df, int(count)) if count is not None else df
        if spec.kind == "writer":
            return partition.merge(*inputs) if len(inputs) > 1 else inputs[0]
        where, merge = opts.pop("where", None), str(opts.pop("where_merge", "auto")).lower()
        if spec.inputs == "all":
            return spec.run(*inputs, **opts)
        df = partition.merge(*inputs) if len(inputs) > 1 else inputs[0]
        if not where:
            return spec.run(df, **opts)
        hit = condition(where, df.columns)
        done, rest = spec.run(df.where(hit), **opts), df.where(~hit)
        if merge == "true" or merge == "auto" and spec.keeps_rows:
            # skipped rows come behind the others
            from ..functions.dims import drop_view

            both = done.withColumn("_skipped", F.lit(0)).unionByName(rest.withColumn("_skipped", F.lit(1)), allowMissingColumns=True)
            both = order.renumbered(both, F.asc("_skipped"), F.asc("pid")) if not drop_view(done) else both
            numeric = [c for c, t in both.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
            return both.drop("_skipped").fillna(0, subset=[c for c in numeric if c != "_skipped"])
        base = done if "view_id" in done.columns else done.withColumn("view_id", F.lit(0).cast("bigint"))
        return base.unionByName(rest.drop("view_id").withColumn("view_id", F.lit(-1).cast("bigint")), allowMissingColumns=True)

    def execute(self, spark: SparkSession) -> DataFrame:
        """Run every writer; the result of the first leaf is returned."""
        for k, s in enumerate(self.stages):
            spec = REGISTRY[s.type]
            if spec.kind == "writer":
                opts = {spec.names.get(n, n): v for n, v in s.options.items() if n not in ("where", "where_merge", "user_data", "log", "option_file")}
                df = self.build(spark, k)
                if s.options.get("where"):
                    df = df.where(condition(s.options["where"], df.columns))
                name = str(opts.get("filename", ""))
                if "#" in name and "view_id" in df.columns:
                    for r in df.select("view_id").distinct().orderBy("view_id").collect():
                        spec.run(df.where(F.col("view_id") == r[0]).drop("view_id"), **{**opts, "filename": name.replace("#", str(r[0]))})
                else:
                    spec.run(df, **opts)
        return self.build(spark)


def _tagged(tags, t):
    if t not in tags:
        raise PipelineError(f"no stage is tagged {t!r}")
    return tags[t]
