"""Problem 3: clusters of mutually close records by Markov clustering.

The similarity graph joins locations nearer than ``radius``. Markov clustering
alternates squaring of the sparse column-stochastic matrix, inflation and
pruning of small entries until nothing changes; the row that takes most of a
column's flow is its attractor, and the flow a row takes in all is how typical it is.
Attractor groups joined by links are one cluster.

The matrix falls into blocks of what links connect, and no step mixes blocks, so
each is worked on where it lies, with the same result wherever that is: blocks
inside a cell of the Voronoi partition in the cell's task, blocks across
cells in tasks of their own, and those of more than ``BLOCK_NODES`` nodes as joins
and aggregations of DataFrames. Blocks of fewer than ``min_size`` rows are left out.

Rows of one location are one node that stands for all of them exactly (its
entries are those of a row, sums take them as often as it has rows). Where more than
CROWD locations share a box of a quarter of the radius, that box is one node too, so
no place has more nodes around it than boxes; its links are tested exactly where
anything hangs on them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.nearby import assigned, fit_partition, locations
from ..session import discard, staged
from ..spatial.components import components
from ..spatial.metrics import METRICS
from ..spatial.voronoi import CELL_ROWS
from ..spatial.vptree import VPTree

#: Exponent of the inflation, mass below which an entry is pruned, change below which a block is done, rounds at most.
INFLATION, PRUNE, SETTLED, ROUNDS = 2.0, 1e-3, 1e-4, 100
#: Locations of a box that become one node; nodes of a block that one task takes; of those that are dense matrices.
CROWD, BLOCK_NODES = 16, 50_000
SIZES = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048)
#: kind 0: a member that is done, 1: one of a block across cells, 2: a link of such a block.
OUT = "kind tinyint, a bigint, node bigint, label bigint, n bigint, b bigint, w double, attractor bigint, flow double, pull double"


def _by_key(row, col, val, n):
    key = col * n + row
    order = np.argsort(key, kind="stable")
    key, val = key[order], val[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    key = key[first]
    return key % n, key // n, np.add.reduceat(val, first) if len(first) else val


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node the least node that links reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):  # only roots move, so what a root stood for follows it
            np.minimum.at(new, label[end], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


# ---- the matrix of a block, dense, sparse and distributed -----------------------


def _dense(m: np.ndarray, rows: np.ndarray, inflation: float, prune: float):
    """(attractor, flow, pull) within each matrix of a stack; ``rows``: of each node, 0 where it is padding."""
    k, size = rows.shape
    m = m / np.maximum((m * rows[:, :, None]).sum(axis=1, keepdims=True), 1e-30)
    attractor, flow, pull = np.empty((k, size), dtype=np.int64), np.zeros((k, size)), np.zeros((k, size))
    todo = np.arange(k)
    for turn in range(ROUNDS):
        r = rows[todo]
        x = np.matmul(m * r[:, None, :], m) ** inflation
        x /= np.maximum((x * r[:, :, None]).sum(axis=1, keepdims=True), 1e-30)
        mass = x * r[:, :, None]
        keep = (mass >= prune) | (mass >= mass.max(axis=1, keepdims=True))
        x *= keep
        x /= np.maximum((mass * keep).sum(axis=1, keepdims=True), 1e-30)
        moved = (np.abs(x - m) * r[:, :, None]).max(axis=(1, 2))
        if not turn:
            pull[todo] = r * np.matmul(x, r[:, :, None])[:, :, 0]
        done = (moved < SETTLED) | (turn == ROUNDS - 1)
        if done.any():
            x_, r_ = x[done], r[done]
            attractor[todo[done]] = np.round(x_ * r_[:, :, None], 4).argmax(axis=1)
            flow[todo[done]] = r_ * np.matmul(x_, r_[:, :, None])[:, :, 0]
            todo, x = todo[~done], x[~done]
        m = x
        if not len(todo):
            break
    return attractor, flow, pull


def _square(row, col, val, rows, n):
    """Of a matrix sorted by column."""
    start = np.searchsorted(col, np.arange(n + 1))
    count = start[row + 1] - start[row]
    ends = np.cumsum(count)
    parts, step = [], 8_000_000
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        c = count[lo:hi]
        of = np.repeat(np.arange(lo, hi), c)
        at = start[row[of]] + np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
        # entry (row[at], row[of]) times entry (row[of], col[of])
        parts.append(_by_key(row[at], col[of], val[at] * rows[row[of]] * val[of], n))
        lo = hi
    return parts[0] if len(parts) == 1 else _by_key(*(np.concatenate(x) for x in zip(*parts)), n)


def _normal(row, col, val, rows, n):
    total = np.bincount(col, val * rows[row], n)
    return row, col, val / total[col]


def own_weight(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    own = np.zeros(n)
    np.maximum.at(own, a, w)
    np.maximum.at(own, b, w)
    return np.where((rows > 1) | (own == 0), 1.0, own)


def sparse_flow(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rows: np.ndarray, inflation: float = INFLATION, prune: float = PRUNE):
    """``block_flow`` of one block by sparse matrices."""
    each = np.arange(n)
    row, col, val = _by_key(np.concatenate((a, b, each)), np.concatenate((b, a, each)), np.concatenate((w, w, own_weight(n, a, b, w, rows))), n)
    row, col, val = _normal(row, col, val, rows, n)
    pull = None
    for _ in range(ROUNDS):
        old = (col * n + row, val)
        row, col, val = _square(row, col, val, rows, n)
        row, col, val = _normal(row, col, val**inflation, rows, n)
        mass, top = val * rows[row], np.zeros(n)
        np.maximum.at(top, col, mass)
        keep = (mass >= prune) | (mass >= top[col])
        row, col, val = _normal(row[keep], col[keep], val[keep], rows, n)
        if pull is None:
            pull = rows * np.bincount(row, val * rows[col], n)
        r, c, moved = _by_key(np.concatenate((row, old[0] % n)), np.concatenate((col, old[0] // n)), np.concatenate((val, -old[1])), n)
        if (np.abs(moved) * rows[r]).max() < SETTLED:
            break
    order = np.lexsort((row, -np.round(val * rows[row], 4), col))
    first = order[np.r_[True, col[order][1:] != col[order][:-1]]]
    attractor = np.empty(n, dtype=np.int64)
    attractor[col[first]] = row[first]
    return attractor, rows * np.bincount(row, val * rows[col], n), pull


def block_flow(block: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, rows: np.ndarray, inflation: float = INFLATION, prune: float = PRUNE):
    """(attractor, flow, pull) of nodes in blocks, after Markov clustering to convergence.

    ``block``: of each node; ``a``, ``b``, ``w``: links within blocks, once each; ``rows`` of each
    node. ``flow``: rows whose flow ends in the node, ``pull``: after the first round. Ties go to the
    lower node. A row's link to itself has the weight of its strongest link (1 between rows of one location).
    """
    n = len(block)
    attractor, flow, pull = np.arange(n), rows.astype(float), rows.astype(float)
    own = own_weight(n, a, b, w, rows)
    order = np.argsort(block, kind="stable")
    name, start = np.unique(block[order], return_index=True)
    of = np.searchsorted(name, block)
    size = np.diff(np.append(start, n))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n) - start[of[order]]
    la = np.argsort(of[a], kind="stable")
    a, b, w = a[la], b[la], w[la]
    begin = np.searchsorted(of[a], np.arange(len(name) + 1))
    grade = np.searchsorted(SIZES, size)
    for g in np.unique(grade[size > 1]):
        which = np.flatnonzero((grade == g) & (size > 1))
        if g == len(SIZES):
            for c in which:
                nodes, lo, hi = order[start[c] : start[c] + size[c]], begin[c], begin[c + 1]
                t, f, p = sparse_flow(size[c], place[a[lo:hi]], place[b[lo:hi]], w[lo:hi], rows[nodes].astype(float), inflation, prune)
                attractor[nodes], flow[nodes], pull[nodes] = nodes[t], f, p
            continue
        m, step = SIZES[g], max(1, 2_000_000 // SIZES[g] ** 2)
        for k in range(0, len(which), step):
            part = which[k : k + step]
            count = begin[part + 1] - begin[part]
            stack = np.zeros((len(part), m, m))
            at = np.repeat(begin[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i = np.repeat(np.arange(len(part)), count)
            stack[i, place[a[at]], place[b[at]]] = stack[i, place[b[at]], place[a[at]]] = w[at]
            i2 = np.repeat(np.arange(len(part)), size[part])
            nodes = order[np.repeat(start[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])]
            stack[i2, place[nodes], place[nodes]] = own[nodes]
            r = np.zeros((len(part), m))
            r[i2, place[nodes]] = rows[nodes]
            t, f, p = _dense(stack, r, inflation, prune)
            attractor[nodes] = order[start[part][i2] + t[i2, place[nodes]]]
            flow[nodes], pull[nodes] = f[i2, place[nodes]], p[i2, place[nodes]]
    return attractor, flow, pull


def _stochastic(m: DataFrame, inflation: float | None, prune: float | None) -> DataFrame:
    """Of (row, col, val, n: rows of ``row``): columns of sum 1."""
    column = Window.partitionBy("col")
    mass = F.col("val") * F.col("n")
    m = m.withColumn("val", F.pow("val", F.lit(inflation))) if inflation else m
    m = m.withColumns({"total": F.sum(mass).over(column), "top": F.max(mass).over(column)})
    if prune is not None:
        m = m.where((mass >= prune * F.col("total")) | (mass >= F.col("top"))).withColumn("total", F.sum(mass).over(column))
    return m.select("row", "col", (F.col("val") / F.col("total")).alias("val"), "n")


def distributed_flow(nodes: DataFrame, links: DataFrame, inflation: float = INFLATION, prune: float = PRUNE) -> DataFrame:
    """(node, attractor, flow, pull) of (node, n) and links (a, b, w), once each: ``block_flow`` as joins. Only one number a
    round comes to the driver."""
    both = links.selectExpr("a row", "b col", "w val").union(links.selectExpr("b", "a", "w"))
    most = both.groupBy(F.col("row").alias("node")).agg(F.max("val").alias("most"))
    both = both.union(nodes.join(most, "node", "left").select("node", "node", F.when((F.col("n") > 1) | F.col("most").isNull(), 1.0).otherwise(F.col("most"))))
    n = nodes.selectExpr("node row", "n")
    matrix, pull = staged(_stochastic(both.join(n, "row"), None, None), "matrix"), None
    for _ in range(ROUNDS):
        left, right = matrix.selectExpr("row", "col k", "val lv"), matrix.selectExpr("row k", "col", "val * n rv")
        square = left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("lv") * F.col("rv")).alias("val")).join(n, "row")
        new = staged(_stochastic(square, inflation, prune), "matrix")
        moved = new.select("row", "col", "n", "val").join(matrix.selectExpr("row", "col", "n m", "val old"), ["row", "col"], "full").agg(F.max(F.abs(F.coalesce("val", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))) * F.coalesce("n", "m"))).first()[0]
        discard(matrix)
        matrix = new
        if pull is None:
            pull = staged(_taken(matrix, n, "pull"), "pull")
        if moved is None or moved < SETTLED:
            break
    best = F.min_by("row", F.struct((-F.round(F.col("val") * F.col("n"), 4)).alias("v"), "row"))
    top = matrix.groupBy(F.col("col").alias("node")).agg(best.alias("attractor"))
    return top.join(_taken(matrix, n, "flow"), "node", "left").join(pull, "node", "left").fillna(0.0, ["flow", "pull"])


def _taken(matrix: DataFrame, n: DataFrame, name: str) -> DataFrame:
    m = matrix.join(n.selectExpr("row col", "n of_col"), "col")
    return m.groupBy(F.col("row").alias("node")).agg(F.sum(F.col("val") * F.col("n") * F.col("of_col")).alias(name))


# ---- cells ---------------------------------------------------------------------


def _nodes(xyz: np.ndarray, home: np.ndarray, radius: float, metric: str) -> np.ndarray:
    """Of each location the first one of its node: itself, or its box where that is crowded."""
    n = len(xyz)
    node = np.arange(n)
    if metric != "euclidean" or n <= CROWD:
        return node
    box = np.floor(xyz / (radius / 4)).astype(np.int64)
    _, first, at, count = np.unique(np.c_[home, box], axis=0, return_index=True, return_inverse=True, return_counts=True)
    at = at.ravel()
    return np.where(count[at] > CROWD, first[at], node)


def _links(xyz: np.ndarray, home: np.ndarray, node: np.ndarray, radius: float, metric: str):
    """(a, b, w) of linked nodes, a at home; b at home with a < b, or not at home."""
    dist, n = METRICS[metric], len(xyz)
    heads, of, count = np.unique(node, return_inverse=True, return_counts=True)
    mid = np.stack([np.bincount(of, xyz[:, k], len(heads)) for k in range(xyz.shape[1])], axis=1) / count[:, None]
    alone = count == 1
    mid[alone] = xyz[heads[alone]]
    reach = np.zeros(len(heads))
    np.maximum.at(reach, of, np.where(alone[of], 0.0, np.sqrt(((xyz - mid[of]) ** 2).sum(axis=1)) if metric == "euclidean" else 0.0))
    own = np.flatnonzero(home[heads])
    slack = 2 * reach.max() if len(heads) else 0.0
    tree, found = VPTree(mid, dist), []
    for k in range(0, len(own), 4096):
        q, b, d = tree.within(mid[own[k : k + 4096]], radius + slack)
        a = own[k : k + 4096][q]
        keep = ((home[heads[b]] & (a < b)) | ~home[heads[b]]) & (d - reach[a] - reach[b] < radius)
        found.append((a[keep], b[keep], d[keep]))
    a, b, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
    far = d + reach[a] + reach[b]
    sure = (far < radius) | (alone[a] & alone[b])
    # boxes near the limit: within one group nothing hangs on their link, else the nearest two locations decide
    if not sure.all():
        label = linked(len(heads), a[sure], b[sure])
        members = np.argsort(of, kind="stable")
        start = np.concatenate(([0], np.cumsum(count)))
        for k in np.flatnonzero(~sure):
            i, j = a[k], b[k]
            if label[i] == label[j] and home[heads[j]]:
                sure[k] = d[k] < radius
                continue
            p, q = (xyz[members[start[x] : start[x + 1]]] for x in (i, j))
            sure[k] = any((dist(p[s : s + 256, None, :], q[None]) < radius).any() for s in range(0, len(p), 256))
            if sure[k] and label[i] != label[j]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    a, b, d = a[sure], b[sure], d[sure]
    return heads[a], heads[b], 1 - 0.9 * np.minimum(d, radius) / radius


def _members(kind: int, rep, node, label, n, attractor=None, flow=None, pull=None) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.int8(kind), "a": rep, "node": node, "label": label, "n": n, "b": 0, "w": 0.0, "attractor": 0 if attractor is None else attractor, "flow": 0.0 if flow is None else flow, "pull": 0.0 if pull is None else pull})


def cell_groups(pts: pd.DataFrame, dims: list[str], radius: float, metric: str, min_size: int) -> pd.DataFrame:
    """Rows of ``OUT`` of the locations at home in a cell."""
    pts = pts.sort_values("rep", kind="stable")  # ties go to the lower id
    rep, rows, home = pts["rep"].to_numpy(), pts["n"].to_numpy(), pts["home"].to_numpy()
    xyz = pts[dims].to_numpy(dtype=float)
    m = len(pts)
    node = _nodes(xyz, home, radius, metric)
    a, b, w = _links(xyz, home, node, radius, metric)
    inside = home[b]
    label = linked(m, a[inside], b[inside])
    size = np.bincount(label[node], rows * home, m)
    crosses = np.zeros(m, dtype=bool)
    crosses[label[a[~inside]]] = True
    whole = home & ~crosses[label[node]] & (size[label[node]] >= min_size)
    out = []
    if whole.any():
        heads = np.unique(node[whole])
        at = np.zeros(m, dtype=np.int64)
        at[heads] = np.arange(len(heads))
        of = np.bincount(node[whole], rows[whole], m)[heads]
        keep = inside & whole[a]
        la, lb = at[a[keep]], at[b[keep]]
        attractor, flow, pull = block_flow(label[heads], la, lb, w[keep], of)
        # attractor groups joined by links
        group = linked(len(heads), np.concatenate((attractor[la], np.arange(len(heads)))), np.concatenate((attractor[lb], attractor)))
        least = rep[heads[group]]
        k = at[node[whole]]
        out.append(_members(0, rep[whole], rep[node[whole]], least[k], rows[whole], rep[heads[attractor[k]]], flow[k], pull[k]))
    open_ = home & crosses[label[node]]
    if open_.any():
        out.append(_members(1, rep[open_], rep[node[open_]], rep[label[node[open_]]], rows[open_]))
        keep = crosses[label[a]]
        link = pd.DataFrame({"kind": np.int8(2), "a": rep[a[keep]], "node": 0, "label": rep[label[a[keep]]], "n": inside[keep].astype(int), "b": rep[b[keep]], "w": w[keep], "attractor": 0, "flow": 0.0, "pull": 0.0})
        out.append(link)
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])


def _across(out: DataFrame, min_size: int, block_nodes: int) -> DataFrame | None:
    """(cluster, rep, n, attractor, flow, pull) of the blocks that reach into several cells; None without any."""
    open_ = out.where("kind = 1").select(F.col("a").alias("rep"), "node", "label", "n")
    if open_.isEmpty():
        return None
    links = out.where("kind = 2").select("a", "b", "w", "label", (F.col("n") == 1).alias("inside"))
    # the node and the block in its own cell of what a link reaches elsewhere
    there = links.where("not inside").join(open_.select(F.col("rep").alias("b"), F.col("node").alias("b_node"), F.col("label").alias("b_label")), "b")
    links = staged(links.where("inside").drop("inside").unionByName(there.select("a", F.col("b_node").alias("b"), "w", "label")), "links")
    tops = components(there.select(F.col("label").alias("a"), F.col("b_label").alias("b"))).select(F.col("id").alias("label"), F.col("component").alias("block"))
    tops = staged(tops, "tops")
    member = open_.join(tops, "label").drop("label")
    size = member.groupBy("block").agg(F.sum("n").alias("size"), F.count_distinct("node").alias("nodes")).where(F.col("size") >= min_size)
    member = staged(member.join(size, "block"), "open")
    nodes = member.groupBy("block", "node").agg(F.sum("n").alias("n"), F.first("nodes").alias("nodes"))
    links = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"), F.first("label").alias("label")).where("a < b").join(tops, "label").join(size.select("block", "nodes"), "block").select("block", "a", "b", "w", "nodes")
    rows = nodes.select("block", "node", F.lit(False).alias("link"), F.lit(0).cast("bigint").alias("b"), F.col("n").cast("double").alias("w"), "nodes")
    rows = rows.unionByName(links.select("block", F.col("a").alias("node"), F.lit(True).alias("link"), "b", "w", "nodes"))
    rows = staged(rows, "blocks")
    total = nodes.agg(F.sum(F.when(F.col("nodes") <= block_nodes, 1))).first()[0] or 0
    bundles = max(1, -(-total // CELL_ROWS))

    def run(pdf):
        link = pdf["link"].to_numpy(dtype=bool)
        name, block, n = (pdf[c].to_numpy()[~link] for c in ("node", "block", "w"))
        order = np.lexsort((name, block))
        name, block, n = name[order], block[order], n[order]
        by = np.argsort(name)
        at = lambda x: by[np.searchsorted(name[by], x)]
        a, b, w = at(pdf["node"].to_numpy()[link]), at(pdf["b"].to_numpy()[link]), pdf["w"].to_numpy()[link]
        attractor, flow, pull = block_flow(block, a, b, w, n)
        group = linked(len(name), np.concatenate((attractor[a], np.arange(len(name)))), np.concatenate((attractor[b], attractor)))
        return pd.DataFrame({"node": name, "group": name[group], "attractor": name[attractor], "flow": flow, "pull": pull})

    small = rows.where(F.col("nodes") <= block_nodes).withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)))
    done = small.groupBy("bundle").applyInPandas(run, "node bigint, group bigint, attractor bigint, flow double, pull double")
    large = rows.where(F.col("nodes") > block_nodes)
    if not large.isEmpty():
        edge = large.where("link").select(F.col("node").alias("a"), "b", "w")
        flows = staged(distributed_flow(large.where("not link").select("node", F.col("w").alias("n")), edge), "flows")
        top = lambda c: flows.select(F.col("node").alias(c), F.col("attractor").alias(f"{c}_top"))
        joined = edge.join(top("a"), "a").join(top("b"), "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
        group = components(joined.unionByName(flows.select(F.col("node").alias("a"), F.col("attractor").alias("b")))).select(F.col("id").alias("node"), F.col("component").alias("group"))
        done = done.unionByName(flows.join(group, "node").select("node", "group", "attractor", "flow", "pull"))
    return member.select("node", "rep", "n").join(done, "node").select(F.col("group").alias("label"), "rep", "n", "attractor", "flow", "pull")


def markov_clusters(points: DataFrame, radius: float, min_size: int = 1, *, id_col: str = "pid", dims: tuple[str, ...] = ("x", "y", "z"), metric: str = "euclidean", cell_rows: int = CELL_ROWS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Clusters of at least ``min_size`` rows: cluster (its least id), id, attractor, flow, pull.

    ``attractor``: the least id of the location whose row takes most of the flow of this one at the
    end of Markov clustering; ``flow``: how many rows' flow ends in this one's location, ``pull``: after the first
    round. Neither depends on the cells. Rows with a null id, a null or NaN dimension are in no cluster;
    rows at one location are together; an empty table gives none. Ids are unique.
    """
    dims = list(dims)
    p = points.select(F.col(id_col).cast("bigint").alias("id"), *(F.col(d).cast("double").alias(d) for d in dims)).dropna()
    p = p.where(" and ".join(f"not isnan(`{d}`)" for d in dims))
    locs = staged(locations(p, "id", None, dims), "locations")
    part = fit_partition(locs, dims, metric, cell_rows)
    cells = assigned(locs.select("rep", "n", *dims), dims, part, radius).groupBy("cell")
    out = staged(cells.applyInPandas(lambda pts: cell_groups(pts, dims, radius, metric, min_size), OUT), "groups")
    member = out.where("kind = 0").select("label", F.col("a").alias("rep"), "n", "attractor", "flow", "pull")
    across = _across(out, min_size, block_nodes)
    if across is not None:
        member = member.unionByName(across)
    member = staged(member.withColumnRenamed("label", "cluster"), "members")
    told = ["attractor", "flow", "pull"]
    shared = p.join(member.where("n > 1").join(locs.drop("n"), "rep").select(*dims, "cluster", *told), dims).select("cluster", "id", *told)
    return member.where("n = 1").select("cluster", F.col("rep").alias("id"), *told).unionByName(shared)


def describe(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """One row a cluster: size, groups (of one attractor) and the ids of its ``typical`` members of most flow (ties: most pull, lower id)."""
    # a rank that is cut off lets each task keep only its own first few of a cluster
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("flow", 2)), F.desc(F.round("pull", 4)), "id")
    top = clusters.withColumn("place", F.row_number().over(w)).where(F.col("place") <= typical)
    top = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("typical"))
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("attractor").alias("groups")).join(top, "cluster")
