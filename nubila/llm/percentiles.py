"""Problem 5: percentiles of very large numeric columns by mergeable sketches.

A KLL sketch is a hierarchy of randomized compactors: each level sorts its
values and passes every other one, of either parity, to the next. Sketches of
parts, days or partitions merge level by level. Spark's own KLL aggregate does
this in the JVM with map-side partial sketches, so a group of any size costs a
task no more than a sketch of each input partition, and the shuffle carries at
most about 3 k values for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a sketch keeps exactly, and the size that sets its error.
K = 4096
_NUDGE = 1e-6


def rank_error(k: int = K) -> float:
    """Normalized rank error of one percentile with 99 % confidence (published fit for KLL sketches)."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, keys: list[str], values: dict[str, Column], k: int = K) -> DataFrame:
    """``keys`` and a sketch (binary) for each named value. Null and NaN values are left out;
    a group without values has an empty sketch; a null key is a group."""
    aggs = [F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k)).alias(n) for n, v in values.items()]
    return df.groupBy(*keys).agg(*aggs)


def merged(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sketches of parts, e.g. days, merged to ``keys``."""
    return parts.groupBy(*keys).agg(*(F.kll_merge_agg_double(n).alias(n) for n in names))


def percentile(sketch: Column, p: float) -> Column:
    """Element at 0-based position int(n * p / 100) of the n sorted values, exact up to K of them, else
    within ``rank_error``. Null for a null sketch and for one without values."""
    # the least element whose share of values at or below reaches p; the nudge moves a whole n * p on to the next
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, p / 100 + _NUDGE))))


def wide_groups(points: DataFrame, k: int = K) -> DataFrame:
    """Per field and group: n, p5, p50, p95. ``points`` has file_id, pointsourceid, z, intensity, returnnumber."""
    by_file = sketches(points.where("z is not null"), ["file_id"], {"z": F.col("z")}, k)
    by_line = sketches(points, ["pointsourceid"], {"intensity": F.col("intensity"), "returnnumber": F.col("returnnumber")}, k)
    return stacked(by_file, "file_id", ["z"]).unionByName(stacked(by_line, "pointsourceid", ["intensity", "returnnumber"]))


def stacked(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(field, group_id, n, p5, p50, p95) of the named sketches, read once."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("s")) for n in names)))
    d = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("group_id"), each.alias("e")).select("e.field", "group_id", "e.s").where("s is not null")
    return d.select("field", "group_id", F.kll_sketch_get_n_double("s").alias("n"), *(percentile(F.col("s"), p).alias(f"p{p}") for p in (5, 50, 95))).where("n > 0")
