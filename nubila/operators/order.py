"""Ordering: the new order is a new dense ``pid``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import drop_view


def renumbered(df: DataFrame, *order: Column) -> DataFrame:
    """``pid`` = place in ``order``; sorted by ranges, so that no task holds all rows."""
    from .select import prefixed, ranged

    view = drop_view(df)
    r = ranged(df, *order)
    before = prefixed(r, view, {"_before": F.count(F.lit(1))})
    n = F.row_number().over(Window.partitionBy(*view, "_part").orderBy(*order))
    return r.withColumn("_n", n).join(F.broadcast(before), [*view, "_part"]).withColumn("pid", (F.col("_n") - 1 + F.col("_before")).cast("bigint")).select(*df.columns)


def sort(df: DataFrame, *dimensions: str, order: str = "ASC") -> DataFrame:
    """By the LAST dimension first, then the one before it, and so on; ties in the old order."""
    way = F.desc if order.upper() == "DESC" else F.asc
    return renumbered(df, *(way(d) for d in reversed(dimensions)), F.asc("pid"))


def randomize(df: DataFrame, seed: int = 0) -> DataFrame:
    """A fixed shuffle for each seed."""
    return renumbered(df, F.xxhash64("pid", F.lit(seed)).asc(), F.asc("pid"))


def _spread(x: Column, bits: int) -> Column:
    """The low ``bits`` (at most 31) of x with a zero bit behind each."""
    x = x.cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_code(df: DataFrame, bits: int = 31) -> DataFrame:
    """Add ``code``: bits of X and Y, brought to the bounds, interleaved (Y the higher of a pair)."""
    b = df.groupBy(*drop_view(df)).agg(F.min("X").alias("_x0"), F.max("X").alias("_x1"), F.min("Y").alias("_y0"), F.max("Y").alias("_y1"))
    d = df.join(F.broadcast(b), drop_view(df)) if drop_view(df) else df.crossJoin(F.broadcast(b))  # one row a view
    q = lambda c, lo, hi: F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * (2**bits - 1))
    code = _spread(q("X", "_x0", "_x1"), bits).bitwiseOR(F.shiftleft(_spread(q("Y", "_y0", "_y1"), bits), 1))
    return d.withColumn("code", code).drop("_x0", "_x1", "_y0", "_y1")


def mortonorder(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Z-order of X, Y. ``reverse``: by the code's bits backwards on a grid of about sqrt(N) cells a side,
    so that any leading part covers the area evenly."""
    if not reverse:
        d = morton_code(df)
        return renumbered(d, F.asc("code"), F.asc("pid")).drop("code")
    n = df.count()
    bits = max(1, min(31, max(1, int(n**0.5)).bit_length()))
    d = morton_code(df, bits)
    back = F.conv(F.reverse(F.lpad(F.bin("code"), 2 * bits, "0")), 2, 10).cast("bigint")
    return renumbered(d.withColumn("code", back), F.asc("code"), F.asc("pid")).drop("code")
