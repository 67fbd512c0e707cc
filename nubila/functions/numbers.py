"""Reading of numbers and locations from texts of several notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most 200 digits before the point and an exponent of two digits, so a number is always finite.
NUMBER = r"^[+-]?(?:\d{1,200}(?:[.]\d*)?|[.]\d+)(?:[eE][+-]?0*\d{1,2})?$"


def number(text: Column) -> Column:
    """Double of a text with padding, sign, exponent, decimal point or comma; else null.

    The text stands once in the expression: within coalesce and filters Spark evaluates each copy anew.
    """
    return F.regexp_substr(F.replace(F.trim(text), F.lit(","), F.lit(".")), F.lit(NUMBER)).try_cast("double")


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null (NaN counts as greater than any number)."""
    return F.when(F.abs(x) < F.lit(1e300), x)


def with_location(points: DataFrame, coordinates: str = "geom_coordinates", texts=("prop_x", "prop_y", "prop_z"), digits: int = 2) -> DataFrame:
    """Add x, y, z: of the coordinate array where present there, else of the property texts;
    null where neither holds a number. ``digits``: the stated precision."""
    axes, scale = {}, float(10**digits)
    for k, (axis, text) in enumerate(zip("xyz", texts)):
        value = F.coalesce(finite(F.get(coordinates, F.lit(k))), number(F.col(text)))
        axes[axis] = F.rint(value * scale) / scale  # not round(), which goes through decimals
    return points.withColumns(axes)


def located(points: DataFrame, *keep: str, **kw) -> DataFrame:
    """``keep`` and x, y, z of the rows that have a whole location."""
    return with_location(points, **kw).select(*keep, "x", "y", "z").dropna(subset=["x", "y", "z"])
