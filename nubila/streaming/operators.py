"""The same row-wise operators on unbounded clouds, and windowed or keyed state where an operator needs some.

Selections and assignments of ``operators`` take streaming DataFrames as they
are. Operators over a whole ordered view (head, tail, decimation, sort) have no
meaning on an unbounded one and say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERED = ("head", "tail", "decimation", "sort", "randomize", "mortonorder", "locate", "iqr", "mad", "divider", "chipper")


def refuse(name: str) -> None:
    raise ValueError(f"{name} needs the whole ordered cloud; it has no meaning on a stream")


def windowed_stats(df: DataFrame, time: str, dimension: str, window: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """count, minimum, maximum, average of a dimension in tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    x = F.col(dimension).cast("double")
    g = df.withWatermark(time, late).groupBy(w, *keys)
    out = g.agg(F.count(F.lit(1)).alias("count"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("average"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "count", "minimum", "maximum", "average")


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Count of rows a key and session, a session ending after ``gap`` without a row."""
    g = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("count"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "count")


def hexbin_stream(df: DataFrame, edge: float, origin: tuple[float, float]) -> DataFrame:
    """Running count of each hexagon (complete or update mode)."""
    from ..operators.stats import hex_cells

    return hex_cells(df, edge, origin).groupBy("hex_i", "hex_j").agg(F.count(F.lit(1)).alias("count"))


def raster_stream(df: DataFrame, resolution: float, origin: tuple[float, float], dimension: str = "Z") -> DataFrame:
    """Running min, max, mean, count of each raster cell."""
    z = F.col(dimension).cast("double")
    d = df.withColumns({"i": F.floor((F.col("X") - origin[0]) / resolution), "j": F.floor((F.col("Y") - origin[1]) / resolution)})
    return d.groupBy("i", "j").agg(F.min(z).alias("min"), F.max(z).alias("max"), F.avg(z).alias("mean"), F.count(F.lit(1)).alias("count"))


def first_of_voxel(df: DataFrame, cell: float, time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each voxel that arrives; state of a voxel lasts as long as the watermark allows a repeat."""
    d = df.withWatermark(time, late).withColumns({f"_v{a}": F.floor(F.col(a) / cell) for a in "XYZ"})
    return d.dropDuplicatesWithinWatermark(["_vX", "_vY", "_vZ"]).drop("_vX", "_vY", "_vZ")


def unwrapped_time(df: DataFrame, key: str, time: str = "GpsTime", period: float = 604800.0, tolerance: float = 1.0) -> DataFrame:
    """``time`` of each key's rows continued over wraps, with the last value and the wraps of a key as its state."""
    def run(k, frames, state):
        last, add = state.get if state.exists else (float("-inf"), 0.0)
        for pdf in frames:
            pdf = pdf.copy()
            out = []
            for t in pdf[time]:
                while t + add + tolerance < last:
                    add += period
                last = t + add
                out.append(last)
            pdf[time] = out
            yield pdf
        state.update((last, add))

    return df.groupBy(key).applyInPandasWithState(run, df.schema, "last double, add double", "append", "NoTimeout")
