"""Problem 2: schemas that drift between files.

Every column of a file is profiled: its name, its type, and a sketch of its
values (rows, share of numbers, mean, spread, least and largest). The columns
of two versions are matched by a bipartite matching of greatest total
similarity (Kuhn-Munkres); matched columns are one column, renamed or retyped;
the rest were added or removed. The matching decides which columns ``one_name``
joins, under whose names ``unified`` reads all records. Where only columns of
one key (naming rule, catalogue) count as one, no score could change a row:
``key_changes`` joins the versions on the key and reads no values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from ..spatial.components import components

#: Files of a series that one window task sorts at a time.
SEQ_BLOCK = 4096
MARKS = r"[\s_-]+"


def plain_name(name: Column) -> Column:
    """Lower case without blanks, underscores and hyphens."""
    return F.lower(F.regexp_replace(name, MARKS, ""))


def catalogue_keys(dimensions: DataFrame) -> DataFrame:
    """(key, dimname): plain form of each catalogue name and alternate. ``alt_names``: JSON text, list or null.
    Of two entries that claim one key the one named so wins, then the first in order."""
    alts = F.when(F.trim("alt_names").startswith("["), F.col("alt_names")).otherwise(F.concat(F.lit("["), "alt_names", F.lit("]")))
    names = F.concat(F.array("dimname"), F.coalesce(F.from_json(alts, "array<string>"), F.array().cast("array<string>")))
    long = dimensions.where("dimname is not null").select("dimname", F.posexplode(names).alias("place", "name")).where("name is not null")
    return long.groupBy(plain_name(F.col("name")).alias("key")).agg(F.min(F.struct(F.least("place", F.lit(1)).alias("p"), "dimname")).alias("m")).select("key", "m.dimname")


def typed(schemas: DataFrame) -> DataFrame:
    """Add kind ('floating', 'signed', 'unsigned', or the text itself) and width (bytes); both null for a blank type."""
    t = F.regexp_replace(F.lower(F.trim("dim_type")), "_t$", "")
    digits = F.regexp_extract(t, r"(\d+)$", 1)
    kind = F.when(F.coalesce(t, F.lit("")) == "", None).when(t.rlike("^(float|floating|double|real)"), "floating").when(t.rlike("^(u|uint|unsigned)(\\d|int|nsigned|$)"), "unsigned").when(t.rlike("^(s?int|signed|long|short|byte)"), "signed").otherwise(t)
    width = F.when(digits != "", (digits.try_cast("int") / 8).cast("int")).when(t.startswith("double"), 8).when((t == "float") | (t == "real"), F.coalesce("dim_size", F.lit(4))).otherwise(F.col("dim_size"))
    return schemas.withColumns({"kind": kind, "width": F.when(kind.isNotNull(), width)})


def before(files: DataFrame, group: str = "series_id", seq: str = "series_seq", key: str = "file_id") -> DataFrame:
    """(file_id, prev): each file's predecessor in its series; the first has none.

    Two levels, so that no task sorts a whole long series: windows over blocks of
    SEQ_BLOCK numbers, and over one row a block for what crosses them.
    """
    f = files.select(F.col(group).alias("g"), F.col(seq).cast("bigint").alias("s"), F.col(key).cast("bigint").alias("file_id")).dropna().distinct()
    f = f.withColumn("block", F.floor(F.col("s") / SEQ_BLOCK))
    inner = f.withColumn("prev", F.lag("file_id").over(Window.partitionBy("g", "block").orderBy("s", "file_id")))
    ends = f.groupBy("g", "block").agg(F.max_by("file_id", F.struct("s", "file_id")).alias("last"))
    carried = ends.withColumn("carry", F.lag("last").over(Window.partitionBy("g").orderBy("block"))).select("g", "block", "carry")
    return inner.join(carried, ["g", "block"]).select("file_id", F.coalesce("prev", "carry").alias("prev")).where("prev is not null")


def value_sketches(records: DataFrame) -> DataFrame:
    """(file_id, name, rows, numbers, mean, spread, low, high) of the values in JSON payloads."""
    from ..functions.numbers import number

    kv = records.select("file_id", F.explode(F.from_json("payload", "map<string,string>")).alias("name", "value")).where("file_id is not null")
    v = number(F.col("value"))
    return kv.groupBy("file_id", "name").agg(F.count("value").alias("rows"), F.count(v).alias("numbers"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread"), F.min(v).alias("low"), F.max(v).alias("high"))


def columns_of(schemas: DataFrame, dimensions: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row a file and column: file_id, key, name, kind, width and the value sketch."""
    s = typed(schemas).where("file_id is not null and dim_name is not null").withColumn("plain", plain_name(F.col("dim_name")))
    s = s.join(catalogue_keys(dimensions), F.col("plain") == F.col("key"), "left").withColumn("key", F.coalesce("dimname", "plain"))
    first = F.min(F.struct(F.coalesce("dim_pos", F.lit(2**31 - 1)).alias("p"), F.col("dim_name").alias("name"), "kind", "width")).alias("c")
    cols = s.groupBy(F.col("file_id").cast("bigint").alias("file_id"), "key").agg(first).select("file_id", "key", "c.name", "c.kind", "c.width")
    if records is None:
        return cols.withColumns({c: F.lit(None).cast("double") for c in ("numbers", "mean", "spread", "low", "high")})
    return cols.join(value_sketches(records).drop("rows"), ["file_id", "name"], "left").withColumn("numbers", F.col("numbers").cast("double"))


def greatest_matching(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the matching of greatest total score (Kuhn-Munkres with potentials)."""
    n, m = score.shape
    if n > m:
        return [(a, b) for b, a in greatest_matching(score.T)]
    cost = -np.asarray(score, dtype=float)
    u, v, mate = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        mate[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while mate[j0]:
            used[j0] = True
            cur = cost[mate[j0] - 1] - u[mate[j0]] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[mate[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            mate[j0], j0 = mate[way[j0]], way[j0]
    return [(int(mate[j]) - 1, j - 1) for j in range(1, m + 1) if mate[j]]


def _grams(name: str) -> set[str]:
    t = f"^{name.lower()}$"
    return {t[k : k + 2] for k in range(len(t) - 1)}


def similarity(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Of columns: 3 for one key, more than the two pairs it could stand in the way of; else 0 to 1 of name, type and value sketch."""
    ga, gb = [_grams(x) for x in a["name"]], [_grams(x) for x in b["name"]]
    at = {g: k for k, g in enumerate(sorted(set().union(*ga, *gb)))}
    ma, mb = np.zeros((len(a), len(at))), np.zeros((len(b), len(at)))
    for m, grams in ((ma, ga), (mb, gb)):
        for i, g in enumerate(grams):
            m[i, [at[x] for x in g]] = 1
    name = 2 * (ma @ mb.T) / np.maximum(1, ma.sum(axis=1)[:, None] + mb.sum(axis=1))
    same = {c: a[c].to_numpy(object)[:, None] == b[c].to_numpy(object) for c in ("key", "kind", "width")}
    va, vb = (x[["mean", "spread", "low", "high"]].to_numpy(float) for x in (a, b))
    va, vb = va[:, None], vb[None]
    value = 1 - (np.abs(va - vb) / (np.abs(va) + np.abs(vb) + 1e-9)).mean(axis=2)
    out = 0.5 * name + 0.2 * (0.5 * same["kind"] + 0.5 * same["width"]) + 0.3 * np.where(np.isnan(value), 0.5, value)
    return np.where(same["key"].astype(bool), 3.0, out)


def matched(old: pd.DataFrame, new: pd.DataFrame, threshold: float) -> list[tuple[int, int, float]]:
    """Pairs of two versions' columns in the greatest matching of all columns that are one key or reach the threshold."""
    if not len(old) or not len(new):
        return []
    score, a, b = similarity(old, new), old["key"].to_numpy(), new["key"].to_numpy()
    return [(i, j, float(score[i, j])) for i, j in greatest_matching(score) if a[i] == b[j] or score[i, j] >= threshold]


def changes_of(file_id: int, old: pd.DataFrame, new: pd.DataFrame, threshold: float) -> list[tuple]:
    """(file_id, dimname, change_kind, old name, score) of one version against the one before it."""
    pairs = matched(old, new, threshold)
    o, n = ({c: x[c].tolist() for c in ("name", "key", "kind", "width")} for x in (old, new))
    out = []
    for i, j, score in pairs:
        if o["name"][i] != n["name"][j]:
            out.append((file_id, n["key"][j], "renamed", o["name"][i], score))
        if isinstance(o["kind"][i], str) and isinstance(n["kind"][j], str):
            a, b = o["width"][i], n["width"][j]
            if o["kind"][i] != n["kind"][j] or (a == a and b == b and a is not None and b is not None and a != b):
                out.append((file_id, n["key"][j], "retyped", o["name"][i], score))
    out += [(file_id, o["key"][i], "removed", o["name"][i], 0.0) for i in sorted(set(range(len(old))) - {p[0] for p in pairs})]
    out += [(file_id, n["key"][j], "added", None, 0.0) for j in sorted(set(range(len(new))) - {p[1] for p in pairs})]
    return out


def schema_changes(files: DataFrame, schemas: DataFrame, dimensions: DataFrame, records: DataFrame | None = None, *, threshold: float = 0.75, same_key: bool = False) -> DataFrame:
    """Changes of each file against the one before it: file_id, dimname, change_kind, old_name, score.

    ``same_key``: only columns that the naming rule (plain form, catalogue) makes
    one dimension are matched, so ``records`` and ``threshold`` have no part in it.
    Null file, series or name: no part. Repeated rows and several columns of one
    dimension count once, the first position. A blank type is never a change.
    Empty tables give no rows.
    """
    if same_key:
        return key_changes(files, schemas, dimensions)
    cols = columns_of(schemas, dimensions, records)
    fields = "file_id bigint, dimname string, change_kind string, old_name string, score double"
    return _versions(cols, files, lambda k, old, new: changes_of(k, old, new, threshold), fields)


def key_changes(files: DataFrame, schemas: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``schema_changes`` where columns are one only by their key: a full join of each file's columns with those of the file before it."""
    cols = columns_of(schemas, dimensions).select("file_id", "key", F.struct("name", "kind", "width").alias("c"))
    pairs = before(files)
    old = pairs.join(cols.withColumnRenamed("file_id", "prev"), "prev").select("file_id", "key", F.col("c").alias("o"))
    new = cols.join(pairs, "file_id", "left_semi").withColumnRenamed("c", "n")
    named = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(F.col("o.name") != F.col("n.name"), "renamed")
    retyped = F.when((F.col("o.kind") != F.col("n.kind")) | (F.col("o.width") != F.col("n.width")), "retyped")
    score = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), 3.0).otherwise(0.0)
    kinds = F.explode(F.array_compact(F.array(named, retyped)))
    return old.join(new, ["file_id", "key"], "full").select("file_id", F.col("key").alias("dimname"), kinds.alias("change_kind"), F.col("o.name").alias("old_name"), score.alias("score"))


def _versions(cols: DataFrame, files: DataFrame, of, fields: str) -> DataFrame:
    """Rows ``of`` (file, columns of the file before it, its columns) for each file that has one before it."""
    both = before(files).select("file_id", F.explode(F.array(F.struct(F.col("file_id").alias("of"), F.lit(True).alias("new")), F.struct(F.col("prev").alias("of"), F.lit(False).alias("new")))).alias("e")).select("file_id", "e.of", "e.new")
    rows = both.join(cols.withColumnRenamed("file_id", "of"), "of").drop("of")

    names = [c.split()[0] for c in fields.split(", ")]

    def run(batches):
        # rows come file by file, a file's old columns before its new ones; the last file of a batch may go on
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            ids = rest["file_id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if cut:
                yield pd.DataFrame(each(rest.iloc[:cut]), columns=names)
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pd.DataFrame(each(rest), columns=names)

    def each(pdf):
        ids, new = pdf["file_id"].to_numpy(), pdf["new"].to_numpy(dtype=bool)
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        found = []
        for a, b in zip(start, np.append(start[1:], len(ids))):
            m = a + int((~new[a:b]).sum())
            found += of(int(ids[a]), pdf.iloc[a:m], pdf.iloc[m:b])
        return found

    return rows.repartition("file_id").sortWithinPartitions("file_id", "new", "key").mapInPandas(run, fields)


def _renamed(old: pd.DataFrame, new: pd.DataFrame, threshold: float) -> list[tuple]:
    """(key before, key after) of matched columns of two keys, at most one of them the catalogue's."""
    pairs = [(old.iloc[i], new.iloc[j]) for i, j, _ in matched(old, new, threshold)]
    return [(o["key"], n["key"]) for o, n in pairs if o["key"] != n["key"] and not (o["listed"] and n["listed"])]


def one_name(files: DataFrame, schemas: DataFrame, dimensions: DataFrame, records: DataFrame, *, threshold: float = 0.75) -> DataFrame:
    """(file_id, names): of each file, the keys that stand under another name in all files, as a map key -> name.

    Keys that the matching pairs between versions are one dimension, in all files;
    its name is the catalogue's where one of them is listed, else the least. Never
    one are keys that stand together in a file, nor two entries of the catalogue:
    a group joined through others that holds two entries keeps its names, as do
    the keys of a group in a file that has several of them.
    """
    listed = catalogue_keys(dimensions).select(F.col("dimname").alias("key"), F.lit(True).alias("listed")).distinct()
    cols = staged(columns_of(schemas, dimensions, records).join(listed, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "columns")
    pairs = staged(_versions(cols, files, lambda k, old, new: _renamed(old, new, threshold), "a string, b string").distinct(), "renamed")
    here = cols.select("file_id", "key", "listed")
    together = pairs.join(here.select("file_id", F.col("key").alias("a")), "a").join(here.select("file_id", F.col("key").alias("b")), ["file_id", "b"]).select("a", "b")
    pairs = pairs.join(together.distinct(), ["a", "b"], "left_anti")
    keys = here.groupBy("key").agg(F.max("listed").alias("listed"))
    groups = components(pairs).select(F.col("id").alias("key"), F.col("component").alias("group"))
    name = groups.join(keys, "key").groupBy("group").agg(F.sum(F.col("listed").cast("int")).alias("entries"), F.min_by("key", F.struct(~F.col("listed"), "key")).alias("name"))
    named = groups.join(name.where("entries < 2"), "group").select("group", "key", "name")
    of = here.join(named, "key").groupBy("file_id", "group").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("name").alias("name"))
    of = of.where("n = 1 and key <> name")
    return of.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("names"))


def unified(records: DataFrame, dimensions: DataFrame, names_of: DataFrame | None = None) -> DataFrame:
    """All records under the catalogue's names: file_id, rec_no, one double a catalogue dimension, and
    ``extra``, the other values as a map of plain names. ``names_of``: those of ``one_name``, for columns
    that the matching joins. Without it no shuffle: the catalogue (a table of fixed size) becomes a literal
    map of the expression. Numbers kept as text are read; a bad payload gives nulls."""
    from ..functions.numbers import number

    keys = catalogue_keys(dimensions).collect()  # fixed: one row a catalogue name or alternate
    table = F.create_map(*(F.lit(x) for r in keys for x in (r["key"], r["dimname"]))) if keys else F.create_map().cast("map<string,string>")
    names = sorted({r["dimname"] for r in keys})
    entries = F.map_entries(F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>")))
    key = lambda e: F.coalesce(F.try_element_at(table, plain_name(e["key"])), plain_name(e["key"]))
    if names_of is None:
        plain = F.transform(entries, lambda e: F.struct(key(e).alias("k"), e["value"].alias("v")))
    else:
        records = records.join(names_of, "file_id", "left")
        plain = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at("names", key(e)), key(e)).alias("k"), e["value"].alias("v")))
    # of two values under one name, the first in order of value
    merged = F.aggregate(F.array_sort(plain), F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))
    r = records.select("file_id", "rec_no", merged.alias("m"))
    known = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    return r.select("file_id", "rec_no", *(number(F.try_element_at("m", F.lit(n))).alias(n) for n in names), F.map_filter("m", lambda k, v: ~F.array_contains(known, k)).alias("extra"))
