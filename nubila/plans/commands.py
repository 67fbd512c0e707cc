"""The commands: each a small plan. ``python -m nubila COMMAND ...`` runs them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ground as g
from ..operators import neighborhood, order, partition, stats
from ..sources import tables
from .pipeline import REGISTRY, Pipeline, PipelineError, inferred


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    return REGISTRY[inferred(path, writer=False)].run(spark, path, **options)


def write(df: DataFrame, path: str, **options) -> None:
    REGISTRY[inferred(path, writer=True)].run(df, filename=path, **options)


def pipeline(spark, source: str, validate: bool = False) -> DataFrame | None:
    p = Pipeline.from_json(open(source).read() if os.path.exists(source) else source)
    return p.build(spark) if validate else p.execute(spark)


def translate(spark, input: str, output: str, filters: list[dict] = ()) -> None:
    Pipeline.from_json([input, *filters, output]).execute(spark)


def info(spark, input: str) -> dict[str, DataFrame]:
    d = read(spark, input)
    return {"summary": stats.info(d), "stats": stats.stats(d), "schema": stats.schema_table(d)}


def merge(spark, inputs: list[str], output: str) -> None:
    write(partition.merge(*(read(spark, i) for i in inputs)), output)


def sort(spark, input: str, output: str) -> None:
    write(order.mortonorder(read(spark, input)), output)


def split(spark, input: str, output: str, length: float | None = None, capacity: int | None = None, **kw) -> None:
    """Parquet partitioned by tile or view."""
    d = read(spark, input)
    if length:
        tables.write_columns(partition.splitter(d, length, **kw), output, partition_by=["tile_x", "tile_y"])
    else:
        tables.write_columns(partition.chipper(d, capacity or 100_000), output, partition_by=["view_id"])


def tile(spark, inputs: list[str], output: str, length: float = 1000.0, buffer: float = 0.0, **kw) -> None:
    d = partition.merge(*(read(spark, i) for i in inputs))
    tables.write_columns(partition.splitter(d, length, buffer=buffer, **kw), output, partition_by=["tile_x", "tile_y"])


def random(spark, output: str, count: int, bounds=(0, 1, 0, 1, 0, 1), distribution: str = "uniform", **kw) -> None:
    write(tables.faux(spark, count, tuple(bounds), distribution, **kw), output)


def delta(spark, source: str, candidate: str, detail: bool = False) -> DataFrame:
    return neighborhood.delta(read(spark, source), read(spark, candidate), detail=detail)


def chamfer(spark, source: str, candidate: str) -> DataFrame:
    return neighborhood.chamfer(read(spark, source), read(spark, candidate))


def hausdorff(spark, source: str, candidate: str) -> DataFrame:
    return neighborhood.hausdorff(read(spark, source), read(spark, candidate))


def eval(spark, predicted: str, truth: str, **dims) -> DataFrame:  # noqa: A001
    return neighborhood.evaluate(read(spark, predicted), read(spark, truth), **dims)


def density(spark, input: str, edge: float, threshold: int = 15) -> DataFrame:
    return stats.hexbin(read(spark, input), edge, threshold)


def ground(spark, input: str, output: str, denoise: bool = False, extract: bool = False, reset: bool = False, **kw) -> None:
    d = read(spark, input)
    if reset or "Classification" not in d.columns:
        d = d.withColumn("Classification", F.lit(0))
    if denoise:
        d = neighborhood.outlier(d)
    d = g.smrf(g.elm(d), ignore="Classification[7:7]", **kw)
    write(d.where("Classification = 2") if extract else d, output)


def tindex(spark, inputs: list[str], output: str) -> None:
    tables.tile_index({i: read(spark, i) for i in inputs}).write.mode("overwrite").parquet(output)


def main(args: list[str]) -> None:
    commands = {f.__name__: f for f in (pipeline, translate, info, merge, sort, split, tile, random, delta, chamfer, hausdorff, eval, density, ground, tindex)}
    if not args or args[0] not in commands:
        raise SystemExit("commands: " + " ".join(commands))
    plain, named = [], {}
    for a in args[1:]:
        if a.startswith("--"):
            k, _, v = a[2:].partition("=")
            try:
                named[k] = json.loads(v) if v else True
            except json.JSONDecodeError:
                named[k] = v
        else:
            plain.append(a)
    spark = SparkSession.builder.getOrCreate()
    if args[0] in ("merge", "tile", "tindex"):
        plain = [plain[:-1], plain[-1]]
    try:
        out = commands[args[0]](spark, *plain, **named)
    except PipelineError as e:
        raise SystemExit(str(e)) from e
    for d in out.values() if isinstance(out, dict) else [out]:
        if d is not None:
            d.show(50, truncate=False)
