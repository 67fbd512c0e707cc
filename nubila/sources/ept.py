"""Octree folders of point tiles (EPT): ept.json, a hierarchy in JSON, and one file a node.

Only nodes that the bounds and the resolution ask for are read, a few a task; tiles are plain records or
zstandard-compressed ones. Tiles in other encodings need a codec that is not installed.
"""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import canonical

#: Points that one task reads, about.
TASK_POINTS = 2_000_000
# Endings of node files by data type.
ENDINGS = {"binary": "bin", "zstandard": "zst"}


def _json(folder: str, name: str):
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        return json.load(f)


def _overlaps(key: tuple[int, int, int, int], cube: list[float], bounds: tuple[float, ...] | None) -> bool:
    if bounds is None:
        return True
    d, *xyz = key
    for a in range(len(bounds) // 2):
        size = (cube[3 + a] - cube[a]) / 2**d
        lo = cube[a] + xyz[a] * size
        if lo > bounds[len(bounds) // 2 + a] or lo + size < bounds[a]:
            return False
    return True


def nodes(folder: str, info: dict, bounds: tuple[float, ...] | None = None, resolution: float | None = None) -> list[tuple[str, int]]:
    """(name, points) of the nodes that meet ``bounds`` (least, then greatest, of x, y [, z]) down to the first level whose
    spacing is at most ``resolution``. Files of subtrees that no bound meets are not opened."""
    cube, span = info["bounds"], info.get("span", 256)
    deepest = math.inf if not resolution else max(0, math.ceil(math.log2(max(1e-300, (cube[3] - cube[0]) / span / resolution))))
    tree = _json(folder, "ept-hierarchy/0-0-0-0.json")
    out, todo = [], [(0, 0, 0, 0)]
    while todo:
        key = todo.pop()
        name = "-".join(map(str, key))
        n = tree.get(name)
        if n is None or key[0] > deepest or not _overlaps(key, cube, bounds):
            continue
        if n == -1:
            tree.update(_json(folder, f"ept-hierarchy/{name}.json"))
            n = tree[name]
        if n > 0:
            out.append((name, n))
        d, x, y, z = key
        todo += [(d + 1, 2 * x + i, 2 * y + j, 2 * z + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    return sorted(out, key=lambda e: tuple(map(int, e[0].split("-"))))


def read_ept(spark: SparkSession, path: str, bounds: tuple[float, ...] | None = None, resolution: float | None = None) -> DataFrame:
    """pid (node number * 2^40 + record) and the dimensions of the schema as doubles; points outside the bounds are left out.
    ``path``: the folder or its ept.json. An octree without a node in the bounds gives no rows."""
    folder = path.removeprefix("file://").removeprefix("ept://")
    folder = os.path.dirname(folder) if folder.endswith(".json") else folder
    info = _json(folder, "ept.json")
    kind = info["dataType"]
    if kind not in ENDINGS:
        raise ValueError(f"EPT tiles of type {kind} need a codec that is not installed")
    types = {"signed": "i", "unsigned": "u", "float": "f"}
    record = np.dtype([(d["name"], f"<{types[d['type']]}{d['size']}") for d in info["schema"]])
    scaled = {d["name"]: (d.get("scale", 1.0), d.get("offset", 0.0)) for d in info["schema"]}
    found, task, size, rows = nodes(folder, info, bounds, resolution), 0, 0, []
    for seq, (name, n) in enumerate(found):
        if size and size + n > TASK_POINTS:
            task, size = task + 1, 0
        size += n
        rows.append((task, seq, name))
    schema = T.StructType([T.StructField("pid", T.LongType()), *(T.StructField(canonical(n), T.DoubleType()) for n in record.names)])

    def load(name: str) -> np.ndarray:
        with open(os.path.join(folder, "ept-data", f"{name}.{ENDINGS[kind]}"), "rb") as f:
            data = f.read()
        if kind == "zstandard":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        return np.frombuffer(data, record)

    def run(batches):
        for pdf in batches:
            for seq, name in zip(pdf["seq"], pdf["name"]):
                r = load(name)
                cols = {canonical(c): r[c].astype(float) * scaled[c][0] + scaled[c][1] for c in record.names}
                out = pd.DataFrame({"pid": (int(seq) << 40) + np.arange(len(r)), **cols})
                if bounds is not None:
                    half = len(bounds) // 2
                    keep = np.ones(len(out), dtype=bool)
                    for a, axis in enumerate("XYZ"[:half]):
                        keep &= out[axis].between(bounds[a], bounds[half + a]).to_numpy()
                    out = out[keep]
                yield out

    listed = spark.createDataFrame(rows, "task int, seq bigint, name string")
    return listed.repartition(task + 1, F.col("task")).mapInPandas(run, schema)
