"""Problem 4: quantities recorded in different units.

A *source* is a way of recording: items' horizontal or vertical unit, or headers'
unit, named by the conversion that its text declares, else by the text itself; a
file without any text is a source of its own. Extents of the same file in two
sources link them: the median of the logarithmic ratios is the pair's scale, that
of the ratios of ranges a second one that a constant offset leaves alone. The
factors go through the graph of sources from those that declare metres, round by
round as joins, so neither the number of sources nor that of links is bounded:
scales are snapped to known conversions within their tolerance, and where only
the ranges fit one, the median rest is the source's offset. A source that no
evidence reaches, or whose evidence is thin or leaves several conversions open,
takes the factor its own text declares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

# Metres in a unit.
CONVERSIONS = {"m": 1.0, "cm": 0.01, "mm": 0.001, "km": 1000.0, "ft": 0.3048, "us_ft": 1200 / 3937}
# How texts name the units, after lower case without dots; the longer forms first.
US_FOOT = r"us[ -]?survey (?:feet|foot|ft)|survey (?:feet|foot|ft) \(us\)|(?:feet|foot|ft) \(us survey\)|us[ -]?(?:ft|feet|foot)|(?:ft|feet|foot)[ _-]?us"
FOOT = r"(?:international |intl )?(?:feet|foot|ft)(?: \(international\)| \(intl\))?"
METRIC = r"(?:kilo|centi|milli)?m[eè]t(?:re|er)(?:s|n)?|mtr|km|cm|mm|m"
UNIT = rf"(?:{US_FOOT}|{FOOT}|{METRIC})(?![\w])"
ALL_OR_PLANE = r"(?:bbox units=|alle werte in |toutes les valeurs en |all coordinates: |extent given in |x/y in |horizontal: |planimetry |lage in )"
HEIGHTS = r"(?:\bz in |\bz values are |vertical: |\bheights in |/ heights |\bhöhen in |\baltitudes en |\belevations: )"

#: Values that evidence needs to overrule what a text declares, or to tell an offset.
LEAST_EVIDENCE = 5
QUANTITIES = ("minx", "miny", "minz", "maxx", "maxy", "maxz")


def tidy(text: Column) -> Column:
    """Lower case, without dots, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\.", ""), r"\s+", " "))


def declared(unit: Column) -> Column:
    """Metres in the unit a tidy text names, else null."""
    whole = lambda p: unit.rlike(rf"^(?:{p})$")
    metric = F.when(unit.rlike("^(?:kilo|km)"), CONVERSIONS["km"]).when(unit.rlike("^(?:centi|cm)"), CONVERSIONS["cm"]).when(unit.rlike("^(?:milli|mm)"), CONVERSIONS["mm"]).otherwise(CONVERSIONS["m"])
    return F.when(whole(US_FOOT), CONVERSIONS["us_ft"]).when(whole(FOOT), CONVERSIONS["ft"]).when(whole(METRIC), metric)


def item_units(items: DataFrame) -> DataFrame:
    """Add h_unit, h_factor, v_unit, v_factor: of the system text, else of the remarks.

    x and y: the last length unit of the horizontal system; z: that of the
    vertical system, else what remarks give for heights, else as x and y.
    """
    wkt, say = F.nullif(F.trim("proj_wkt2"), F.lit("")), tidy(F.col("remarks"))
    at = r"(?is)(?:VERT_CS|VERTCRS|VERTICALCRS)\s*\["
    plane = F.get(F.split(wkt, at, 2), F.lit(0))
    up = F.get(F.split(wkt, at, 2), F.lit(1))
    last = r'(?is)^.*\b(?:LENGTH)?UNIT\s*\[\s*"([^"]*)"\s*(?:,\s*([0-9.eE+-]+))?'
    pick = lambda t, k: F.nullif(F.regexp_extract(t, last, k), F.lit(""))
    said = lambda cue: F.nullif(F.regexp_extract(say, rf"{cue}({UNIT})", 1), F.lit(""))
    h = F.coalesce(tidy(pick(plane, 1)), F.when(wkt.isNull(), said(ALL_OR_PLANE)))
    v = F.coalesce(tidy(pick(up, 1)), said(HEIGHTS), h)
    d = items.withColumns({"h_unit": h, "v_unit": v, "h_said": pick(plane, 2).try_cast("double"), "v_said": pick(up, 2).try_cast("double")})
    d = d.withColumn("h_factor", F.coalesce("h_said", declared(F.col("h_unit"))))
    from_plane = pick(up, 1).isNull() & said(HEIGHTS).isNull()
    return d.withColumn("v_factor", F.when(from_plane, F.col("h_factor")).otherwise(F.coalesce("v_said", declared(F.col("v_unit"))))).drop("h_said", "v_said")


def _source(kind: str, unit: Column, factor: Column) -> Column:
    """Name of a way of recording: by its declared conversion, else its text, else the file itself."""
    known = F.coalesce(*(F.when(F.abs(factor / f - 1) < 1e-9, F.lit(n)) for n, f in CONVERSIONS.items()), F.when(factor.isNotNull(), F.concat(F.lit("="), factor.cast("string"))))
    return F.concat(F.lit(f"{kind}/"), F.coalesce(known, F.concat(F.lit("text:"), unit), F.concat(F.lit("file:"), F.col("file_id").cast("string"))))


def extents(items: DataFrame, headers: DataFrame) -> DataFrame:
    """One row a value: file_id, recorded_in, quantity, source, factor (as declared), value, step (of its last place, where known)."""
    u = item_units(items).where("file_id is not null").select("file_id", "proj_bbox", "h_unit", "h_factor", "v_unit", "v_factor")
    u = staged(u, "units")  # read by both sides below, and the texts are taken apart once
    u = u.withColumns({"h_source": _source("item/xy", F.col("h_unit"), F.col("h_factor")), "v_source": _source("item/z", F.col("v_unit"), F.col("v_factor"))})
    whole = F.size("proj_bbox") >= 6
    place = {"minx": (0, 0), "miny": (1, 1), "minz": (2, None), "maxx": (3, 2), "maxy": (4, 3), "maxz": (5, None)}
    values = [F.when(whole, F.get("proj_bbox", F.lit(a))).otherwise(F.lit(None) if b is None else F.get("proj_bbox", F.lit(b))) for a, b in (place[q] for q in QUANTITIES)]
    up = lambda q: "v" if q[-1] == "z" else "h"
    item = F.explode(F.array(*(F.struct(F.lit(q).alias("quantity"), F.col(f"{up(q)}_source").alias("source"), F.col(f"{up(q)}_factor").alias("factor"), v.alias("value"), F.lit(0.0).alias("step")) for q, v in zip(QUANTITIES, values))))
    a = u.select("file_id", F.lit("item").alias("recorded_in"), item.alias("e")).select("file_id", "recorded_in", "e.*")
    h = headers.select("file_id", "unitsxyz", "orgx", "orgy", "orgz", *QUANTITIES, "master_unit").where("file_id is not null").distinct()
    h = h.join(u.select("file_id", "h_unit", "h_factor"), "file_id", "left")
    own = F.nullif(tidy(F.col("master_unit")), F.lit(""))
    h = h.withColumns({"unit": F.coalesce(own, "h_unit"), "factor": F.coalesce(declared(own), F.when(own.isNull(), F.col("h_factor")))})
    step = F.try_divide(F.lit(1.0), F.col("unitsxyz").cast("double"))
    head = F.explode(F.array(*(F.struct(F.lit(q).alias("quantity"), (F.try_divide(F.col(q).cast("double"), F.col("unitsxyz").cast("double")) + F.col(f"org{q[-1]}")).alias("value"), F.abs(step).alias("step")) for q in QUANTITIES)))
    b = h.select("file_id", F.lit("header").alias("recorded_in"), _source("header", F.col("unit"), F.col("factor")).alias("source"), "factor", head.alias("e")).select("file_id", "recorded_in", "e.quantity", "source", "factor", "e.value", "e.step")
    return a.unionByName(b).where("abs(value) < 1e300").distinct()


def observations(values: DataFrame) -> DataFrame:
    """One row a file, axis and pair of sources (a of the item, b of the header): values x0, x1 and y0, y1 (least, greatest), steps."""
    v = values.withColumns({"axis": F.substring("quantity", 4, 1), "end": F.substring("quantity", 1, 3)})
    v = v.groupBy("file_id", "axis", "recorded_in", "source").agg(F.max(F.when(F.col("end") == "min", F.col("value"))).alias("lo"), F.max(F.when(F.col("end") == "max", F.col("value"))).alias("hi"), F.max("step").alias("step"))
    side = lambda kind, s, v0: v.where(F.col("recorded_in") == kind).select("file_id", "axis", F.col("source").alias(s), F.col("lo").alias(f"{v0}0"), F.col("hi").alias(f"{v0}1"), F.col("step").alias(f"{v0}_step"))
    v = v.select("file_id", "axis", "recorded_in", "source", "lo", "hi", "step")
    return side("item", "a", "x").join(side("header", "b", "y"), ["file_id", "axis"])


def source_pairs(obs: DataFrame) -> DataFrame:
    """One row a pair of sources with files in common: n, scale (median of log x / y), spread (tolerance of it),
    and range_n, range_scale, range_spread of the ranges."""
    ends = F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.col("x_step").alias("xs"), F.col("y_step").alias("ys"), F.lit(False).alias("range")) for k in (0, 1)))
    spans = F.array(F.struct((F.col("x1") - F.col("x0")).alias("x"), (F.col("y1") - F.col("y0")).alias("y"), (2 * F.col("x_step")).alias("xs"), (2 * F.col("y_step")).alias("ys"), F.lit(True).alias("range")))
    r = obs.select("a", "b", F.explode(F.concat(ends, spans)).alias("e")).select("a", "b", "e.*").where("x * y > 0")
    # half a step is what rounding alone can change
    r = r.select("a", "b", "range", F.log(F.col("x") / F.col("y")).alias("q"), (F.col("xs") / F.abs("x") / 2 + F.col("ys") / F.abs("y") / 2).alias("round"))
    keys = ["a", "b", "range"]
    m = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("q", 0.5, 10_000).alias("scale"), F.percentile_approx("round", 0.5, 10_000).alias("round"))
    mad = r.drop("round").join(m, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("scale").alias("scale"), F.first("round").alias("round"), F.percentile_approx(F.abs(F.col("q") - F.col("scale")), 0.5, 10_000).alias("mad"))
    # few values tell little of their spread
    spread = 6 * F.col("mad") / F.sqrt("n") * (1 + 5 / F.col("n")) + 2 * F.col("round") + 1e-12
    mad = mad.select(*keys, "n", "scale", spread.alias("spread"))
    ends, spans = (mad.where(F.col("range") == w).drop("range") for w in (False, True))
    spans = spans.select("a", "b", F.col("n").alias("range_n"), F.col("scale").alias("range_scale"), F.col("spread").alias("range_spread"))
    return ends.join(spans, ["a", "b"], "left")


def _decided(says: DataFrame) -> DataFrame:
    """(source, metre_factor, how, shifted) of (source, factor: declared, guess, spread, n, range_guess, range_spread, range_n):
    logarithms of metres in a unit."""
    logs = F.array(*(F.log(F.lit(f)) for f in CONVERSIONS.values()))
    fits = lambda guess, tolerance: F.array_sort(F.filter(F.transform(logs, lambda c: F.struct(F.abs(c - guess).alias("d"), c.alias("c"))), lambda x: x["d"] <= tolerance))
    own = F.log("factor")
    d = says.withColumn("fit", fits(F.col("guess"), F.col("spread"))).withColumn("ranged", fits(F.col("range_guess"), F.least("range_spread", F.lit(0.05))))
    agrees = F.coalesce(F.abs(own - F.col("guess")) <= F.col("spread"), F.lit(False))
    thin = own.isNotNull() & (F.col("n") < LEAST_EVIDENCE)
    shifted = ~agrees & ~thin & (F.size("fit") == 0) & (F.coalesce(F.size("ranged"), F.lit(0)) > 0) & (F.col("range_n") >= LEAST_EVIDENCE)
    own_range = F.coalesce(F.exists("ranged", lambda x: F.abs(x["c"] - own) < 1e-9), F.lit(False))
    factor = F.when(agrees | thin, F.col("factor")).when(F.size("fit") > 0, F.exp(F.get("fit", F.lit(0))["c"])).when(shifted & own_range, F.col("factor")).when(shifted, F.exp(F.get("ranged", F.lit(0))["c"])).otherwise(F.exp("guess"))
    # the exact conversion, not its logarithm's
    exact = F.coalesce(*(F.when(F.abs(factor / f - 1) < 1e-12, F.lit(f)) for f in CONVERSIONS.values()), factor)
    return d.select("source", exact.alias("metre_factor"), F.when(thin & ~agrees, "declared").otherwise("graph").alias("how"), shifted.alias("shifted"))


def source_factors(values: DataFrame) -> DataFrame:
    """(source, metre_factor, how, x, y, z: offsets in metres) of every source.

    Rounds: sources next to resolved ones are resolved by the sharpest of what those say (links whose spread
    is within ten times the least; of these the median, each weighted by its number of values).
    """
    own = staged(values.groupBy("source").agg(F.percentile_approx("factor", 0.5).alias("factor")), "sources")
    obs = staged(observations(values), "observed")
    pairs = source_pairs(obs)
    # value_a = e^scale * value_b, so factor_b = factor_a * e^scale
    edges = pairs.select(F.col("a").alias("of"), F.col("b").alias("source"), "n", "scale", "spread", "range_n", "range_scale", "range_spread")
    edges = staged(edges.unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("source"), "n", (-F.col("scale")).alias("scale"), "spread", "range_n", (-F.col("range_scale")).alias("range_scale"), "range_spread")), "edges")
    zero = {c: F.lit(0.0) for c in "xyz"}
    done = staged(own.where("factor = 1").select("source", F.col("factor").alias("metre_factor"), F.lit("anchor").alias("how")).withColumns(zero), "resolved")
    while True:
        says = edges.join(done.select(F.col("source").alias("of"), F.log("metre_factor").alias("f")), "of").join(done, "source", "left_anti")
        says = says.withColumns({"guess": F.col("f") + F.col("scale"), "range_guess": F.col("f") + F.col("range_scale")})
        sharp = says.groupBy("source").agg(F.min("spread").alias("least"))
        says = says.join(sharp, "source").where("spread <= 10 * least")
        m = says.groupBy("source").agg(F.percentile("guess", 0.5, F.col("n")).alias("guess"), F.max("spread").alias("spread"), F.sum("n").alias("n"), F.percentile("range_guess", 0.5, F.col("n")).alias("range_guess"), F.max("range_spread").alias("range_spread"), F.sum("range_n").alias("range_n"), F.min_by("of", F.struct(-F.col("n"), "of")).alias("of"))
        new = staged(_decided(m.join(own, "source")).join(m.select("source", "of"), "source"), "resolved")
        count, any_shifted = new.agg(F.count(F.lit(1)), F.max("shifted")).first()
        if not count:
            break
        new = _with_offsets(new, done, obs) if any_shifted else new.withColumns(zero)
        done = staged(done.unionByName(new.select(done.columns)), "resolved")
    rest = own.join(done, "source", "left_anti").select("source", F.col("factor").alias("metre_factor"), F.lit("declared").alias("how")).withColumns(zero)
    return done.unionByName(rest)


def _with_offsets(new: DataFrame, done: DataFrame, obs: DataFrame) -> DataFrame:
    """Add x, y, z to sources: for the shifted ones the median of what their values lack to the metres of the source that resolved them."""
    both = [obs.select(F.col(s).alias("source"), F.col(o).alias("of"), "axis", F.explode(F.array(*(F.struct(F.col(f"{v}{k}").alias("own"), F.col(f"{w}{k}").alias("other")) for k in (0, 1)))).alias("e")) for s, o, v, w in (("a", "b", "x", "y"), ("b", "a", "y", "x"))]
    r = both[0].unionByName(both[1]).join(new.where("shifted").select("source", "of", "metre_factor"), ["source", "of"])
    r = r.join(done.select(F.col("source").alias("of"), F.col("metre_factor").alias("of_factor"), F.create_map(*(y for c in "xyz" for y in (F.lit(c), F.col(c)))).alias("of_offset")), "of")
    lack = F.col("e.other") * F.col("of_factor") + F.element_at("of_offset", F.col("axis")) - F.col("e.own") * F.col("metre_factor")
    o = r.withColumn("lack", lack).groupBy("source").agg(*(F.percentile_approx(F.when(F.col("axis") == c, F.col("lack")), 0.5, 10_000).alias(c) for c in "xyz"))
    return new.join(o, "source", "left").fillna(0.0, list("xyz"))


def in_metres(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Every extent in metres: file_id, recorded_in, quantity, source, factor, value, step, metre_factor, how, metre_offset, metres (double).

    Values that are null or NaN, and those of files whose unit neither a text nor
    the graph tells, give no row; repeated header rows count once; boxes of four
    numbers have no heights; zero or null steps per unit give no value. A factor that a text
    states beside the unit's name holds for this text, not for its source.
    """
    values = staged(extents(items, headers), "extents")
    f = source_factors(values)
    v = values.join(f, "source", "left").where("metre_factor is not null")
    # of a declared conversion the text's own digits
    v = v.withColumn("metre_factor", F.when(F.abs(F.col("factor") / F.col("metre_factor") - 1) < 1e-9, F.col("factor")).otherwise(F.col("metre_factor")))
    offset = F.element_at(F.create_map(*(y for c in "xyz" for y in (F.lit(c), F.col(c)))), F.substring("quantity", 4, 1))
    return v.withColumn("metre_offset", offset).drop("x", "y", "z").withColumn("metres", F.col("value") * F.col("metre_factor") + F.col("metre_offset"))
