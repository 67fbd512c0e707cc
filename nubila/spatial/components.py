"""Connected components and lexicographic independent sets over link tables, as DataFrame loops with staged rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the least id that links reach.

    Each round every node takes the least label around it (large star), then
    labels are followed to their own label (small star), so chains shorten by
    powers; a label's many links are gathered map-side first.
    """
    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = staged(e, "links")
    while True:
        # large star: the larger neighbours of a node go to the least of all its neighbours
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        # small star: a node and its smaller neighbours go to the least of them
        small_low = large.groupBy("x").agg(F.min("m").alias("least"))
        small = large.join(small_low, "x").select(F.explode(F.array(F.struct(F.col("x").alias("b"), F.col("least").alias("a")), F.struct(F.col("m").alias("b"), F.col("least").alias("a")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        new = staged(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
        same = new.groupBy().agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        old = e.groupBy().agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        e = new
        if same == old:
            break
    stars = e.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


#: Links that one task of ``independent`` holds.
GROUP_LINKS = 1_000_000


def settle(high: np.ndarray, low: np.ndarray, low_state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, state) of what can be decided of the upper ends: 2 (gone) beside a taken lower one, 1 (taken) where all are gone.

    ``low_state``: 1, 2, or 0 where it is open; lower ends that are upper ends here are decided on the way.
    """
    ids, at = np.unique(np.concatenate((high, low)), return_inverse=True)
    h, lo = at[: len(high)], at[len(high) :]
    state = np.zeros(len(ids), dtype=np.int64)
    np.maximum.at(state, lo, low_state)
    own = np.zeros(len(ids), dtype=bool)
    own[h] = True
    while True:
        taken, open_ = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
        taken[h[state[lo] == 1]] = True
        open_[h[state[lo] == 0]] = True
        new = np.where(own & (state == 0), np.where(taken, 2, np.where(open_, 0, 1)), state)
        if (new == state).all():
            break
        state = new
    done = own & (state > 0)
    return ids[done], state[done]


def independent(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kept): what taking nodes in order of ``rank`` gives, each unless linked to one taken before.

    ``nodes`` (id, rank: unique [, tile]), ``links`` (a, b), both ways or one.
    Nodes of one tile are decided together in a task (tiles of many links are
    split; any split gives the same result), tiles tell each other what is
    decided, round by round; rounds are few, as only chains from tile to tile wait.
    """
    tile = F.xxhash64("tile") if "tile" in nodes.columns else F.lit(0).cast("bigint")
    r = nodes.select("id", "rank", tile.alias("tile"))
    e = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    e = e.join(r.select(F.col("id").alias("a"), F.col("rank").alias("ra"), "tile"), "a").join(r.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    e = staged(e.where("rb < ra").select(F.col("a").alias("high"), F.col("b").alias("low"), "tile"), "falls")
    parts = e.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / GROUP_LINKS).alias("parts"))
    e = e.join(parts, "tile").select("high", "low", F.xxhash64("tile", F.pmod(F.xxhash64("high"), "parts")).alias("tile"))
    e = staged(e, "falls")
    # without a lower neighbour: taken
    state = staged(e.select(F.col("low").alias("id")).distinct().join(e.select(F.col("high").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(1).cast("bigint").alias("state")), "state")

    def run(pdf):
        ids, s = settle(pdf["high"].to_numpy(), pdf["low"].to_numpy(), pdf["state"].fillna(0).to_numpy(dtype=np.int64))
        return pd.DataFrame({"id": ids, "state": s})

    while e.count():
        known = e.join(state.withColumnRenamed("id", "low"), "low", "left")
        new = staged(known.groupBy("tile").applyInPandas(run, "id bigint, state bigint"), "state")
        state = state.unionByName(new)
        e = staged(e.join(new.select(F.col("id").alias("high")), "high", "left_anti"), "falls")
    gone = state.where("state = 2").select("id", F.lit(True).alias("_gone"))
    return r.select("id").join(gone, "id", "left").select("id", F.col("_gone").isNull().alias("kept"))
