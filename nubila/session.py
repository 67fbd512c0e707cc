"""Session helpers shared by every operator: staging folders and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests on one machine) a temporary folder is
    made once a session and removed at exit.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.nubila.staging.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="nubila-")
        spark.conf.set("spark.nubila.staging.dir", path)
        _OWN.append(path)
        atexit.register(shutil.rmtree, path, True)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage like a checkpoint, but columnar: later readers prune
    columns and push filters, and a lost executor loses nothing. The table is
    deleted by ``discard`` or when the JVM ends, whatever file system holds it.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._nubila_stage = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more. What is not a staged table is left alone."""
    for df in tables:
        path = getattr(df, "_nubila_stage", None)
        if path is not None:
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
