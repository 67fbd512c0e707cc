"""Dimensions: names, types, and the coercion of values to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The well-known dimensions of point clouds by type.
WELL_KNOWN = {
    "double": """X Y Z W GpsTime InternalTime PassiveX PassiveY PassiveZ XVelocity YVelocity ZVelocity Azimuth WanderAngle
        XBodyAccel YBodyAccel ZBodyAccel XBodyAngRate YBodyAngRate ZBodyAngRate EchoRange HeightAboveGround
        LongitudeCentroid LatitudeCentroid ElevationCentroid LongitudeLow LatitudeLow ElevationLow LongitudeHigh
        LatitudeHigh ElevationHigh NormalX NormalY NormalZ Curvature Density NNDistance TextureU TextureV TextureW
        Linearity Planarity Scattering Verticality Omnivariance Anisotropy Eigenentropy EigenvalueSum SurfaceVariation
        DemantkeVerticality OptimalRadius LocalReachabilityDistance LocalOutlierFactor Miniball Reciprocity Eigenvalue0
        Eigenvalue1 Eigenvalue2 PlaneFit RadialDensity BeamOriginX BeamOriginY BeamOriginZ BeamDirectionX
        BeamDirectionY BeamDirectionZ NorthPositionRMS EastPositionRMS DownPositionRMS NorthVelocityRMS
        EastVelocityRMS DownVelocityRMS RollRMS PitchRMS HeadingRMS Reliability EchoPos EchoNorm SphericalRange
        SphericalAzimuth SphericalElevation ShotTimestamp UnambiguousRange""",
    "float": "Amplitude Reflectance ScanAngleRank Pdop Pitch Roll PulseWidth Deviation BackgroundRadiation",
    "int32": "StartPulse ReflectedPulse PassiveSignal",
    "int64": "ClusterID",
    "uint16": "Intensity PointSourceId Red Green Blue Alpha Infrared Image",
    "uint32": "OffsetTime PointId OriginId",
    "uint64": "LvisLfid ShotNumber OptimalKNN H3",
    "uint8": """ReturnNumber NumberOfReturns ScanDirectionFlag EdgeOfFlightLine Classification UserData IsPpsLocked Flag
        Mark ScanChannel ClassFlags Synthetic KeyPoint Withheld Overlap Omit Coplanar Rank ImgNbr Dimension Duplicate""",
}
# Other names of dimensions.
ALTERNATES = {
    "platformheading": "Azimuth", "scanangle": "ScanAngleRank", "diffuse_red": "Red", "diffuse_green": "Green",
    "diffuse_blue": "Blue", "nearinfrared": "Infrared", "height above ground": "HeightAboveGround", "hag": "HeightAboveGround",
    "nx": "NormalX", "normal_x": "NormalX", "ny": "NormalY", "normal_y": "NormalY", "nz": "NormalZ", "normal_z": "NormalZ",
    "tu": "TextureU", "tv": "TextureV", "tw": "TextureW", "time": "OffsetTime", "class": "Classification",
    "cls": "Classification", "user_data": "UserData", "lvis_lfid": "LvisLfid",
}
TYPE_OF = {name: t for t, names in WELL_KNOWN.items() for name in names.split()}
_BY_LOWER = {n.lower(): n for n in TYPE_OF}

SPARK = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "double": T.DoubleType(),
}


def canonical(name: str) -> str:
    """The well-known spelling of a name, else the name itself."""
    low = name.strip().lower()
    return _BY_LOWER.get(low) or ALTERNATES.get(low) or name.strip()


def type_of(name: str) -> str:
    return TYPE_OF.get(canonical(name), "double")


def limits(dim_type: str) -> tuple[int, int]:
    bits = int("".join(c for c in dim_type if c.isdigit()))
    return (0, 2**bits - 1) if dim_type[0] == "u" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


def resolve_type(a: str, b: str) -> str:
    """Type of a dimension that two inputs give as ``a`` and ``b``: floats win, then the wider; mixed signs go to the
    signed type that holds both."""
    if a == b:
        return a
    if "float" in (a, b) or "double" in (a, b):
        return "double" if "double" in (a, b) or max(_bits(a), _bits(b)) > 32 else "float"
    if (a[0] == "u") == (b[0] == "u"):
        return max(a, b, key=_bits)
    signed, unsigned = (b, a) if a[0] == "u" else (a, b)
    return f"int{max(_bits(signed), min(64, 2 * _bits(unsigned)))}"


def _bits(t: str) -> int:
    return {"float": 32, "double": 64}.get(t) or int("".join(c for c in t if c.isdigit()))


def rounded(x: Column) -> Column:
    """Half away from zero, as values go into integer dimensions."""
    return F.when(x > 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def coerce(x: Column, dim_type: str) -> Column:
    """A double as a value of ``dim_type``; a NaN or a value out of range is an error for integers."""
    if dim_type in ("double", "float"):
        return x.cast(dim_type)
    lo, hi = limits(dim_type)
    ok = ~F.isnan(x) & (x > float(lo) - 0.5) & (x < float(hi) + 0.5)
    return F.when(ok, rounded(x)).otherwise(F.raise_error(F.concat(F.lit(f"value out of range of {dim_type}: "), x.cast("string")))).cast(SPARK[dim_type])


def as_cloud(df: DataFrame, pid: str | Column, **dims: str | Column) -> DataFrame:
    """A point cloud: ``pid`` (order and identity, unique) and dimensions; missing values are 0."""
    from_ = lambda c: F.expr(c) if isinstance(c, str) else c
    cols = []
    for name, c in dims.items():
        t = SPARK[type_of(name)]
        cols.append(F.coalesce(from_(c).cast(t), F.lit(0).cast(t)).alias(name, metadata={"dim_type": type_of(name)}))
    return df.select(from_(pid).cast("bigint").alias("pid"), *cols)


def drop_view(df: DataFrame) -> list[str]:
    """Columns that partition windows: the view, where there is one."""
    return ["view_id"] if "view_id" in df.columns else []
