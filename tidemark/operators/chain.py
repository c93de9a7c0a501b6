"""Greedy selection of non-overlapping intervals, one chain per key.

The first candidate is taken; after each taken one, the next is the first whose
position is at or past the position it frees. The chain is sequential, but what
a block of positions does to the free position entering it depends only on few
candidates: those within one block length of the block's start, and those on
which an interval longer than a block lands. So blocks are reduced to small
tables (entry position -> free position on leaving), tables of 16 blocks are
combined into one, level by level, and the entering positions are handed back
down. A task never holds more than one block of candidates or the tables of 16
blocks, however long the series of one key or one of its intervals is; only the
landings of long intervals add rows to the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
BLOCK = 4096
NEVER = 2**62  # freed past the end of the series


def take_in_turn(cands: DataFrame, keys: Sequence[str], *, pos: str = "pos", free: str = "free", block: int = BLOCK) -> DataFrame:
    """Rows of ``cands`` that the chain takes. ``pos`` is unique per key and
    ``free`` is above it; ``NEVER`` ends the chain."""
    keys = list(keys)
    top = cands.agg(F.max(pos)).first()[0]
    if top is None:
        return cands
    nodes = cands.select(*keys, F.col(pos).cast("long").alias("p"), F.col(free).cast("long").alias("f"))
    nodes = nodes.withColumn("b", F.expr(f"p div {block}"))
    taken = _walked(nodes, keys, _entering(nodes, keys, block, int(top)))
    return cands.join(taken.select(*keys, F.col("p").alias(pos)), [*keys, pos], "left_semi")


def _head(nodes: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _walked(nodes: DataFrame, keys: list[str], entering: DataFrame) -> DataFrame:
    """Taken positions, block by block, from each block's entering position."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("p")
        p, f, taken = g["p"].to_numpy(), g["f"].to_numpy(), []
        after, at = np.searchsorted(p, f), int(np.searchsorted(p, g["x"].iat[0]))
        while at < len(p):
            taken.append(at)
            at = int(after[at])
        return g.iloc[taken][[*keys, "p"]]

    return nodes.join(entering, [*keys, "b"]).groupBy(*keys, "b").applyInPandas(walk, f"{_head(nodes, keys)}, p bigint")


def _entering(nodes: DataFrame, keys: list[str], block: int, top: int) -> DataFrame:
    """(keys, b, x): the free position with which the chain enters each block."""
    head = _head(nodes, keys)
    table_schema = f"{head}, b bigint, p bigint, o bigint, land boolean"
    sizes = [block]
    while top >= sizes[-1]:
        sizes.append(sizes[-1] * FAN)
    far = (F.col("f") - F.col("p") > block) & (F.col("f") < NEVER)
    landings = nodes.where(far).select(*keys, F.col("f").alias("p"), F.lit(0).cast("long").alias("f"), F.expr(f"f div {block}").alias("b"), F.lit(True).alias("land")).distinct()
    marked = nodes.withColumn("land", F.lit(False)).unionByName(landings)

    def kept(g: pd.DataFrame, base: int) -> pd.DataFrame:
        """Rows on which a chain can enter: up to the first one a block length from the start, and landings."""
        near = np.arange(len(g)) <= np.searchsorted(g["p"].to_numpy(), base + block)
        return g[near | g["land"].to_numpy()]

    def reduce_block(group: pd.DataFrame) -> pd.DataFrame:
        g = group[~group["land"]].sort_values("p")
        p, f = g["p"].to_numpy(), g["f"].to_numpy()
        after = np.searchsorted(p, f)
        last = np.where(after < len(p), after, np.arange(len(p)))
        while (last != (ahead := last[last])).any():
            last = ahead
        hit = np.searchsorted(p, group.loc[group["land"], "p"].to_numpy())
        land = np.zeros(len(p), bool)
        land[hit[hit < len(p)]] = True
        g = g.assign(o=f[last], land=land)[[*keys, "b", "p", "o", "land"]]
        # A landing past the last candidate passes on as it is to the block after.
        through = group[group["land"]].loc[hit == len(p)]
        g = pd.concat([g, through.assign(o=through["p"])[list(g.columns)]]).sort_values("p", kind="stable")
        return kept(g, int(group["b"].iat[0]) * block)

    def combine(size: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            g = group.sort_values("p")
            rows = kept(g, int(g["sb"].iat[0]) * size)
            x = rows["p"].to_numpy().copy()
            for _, c in g.groupby("b"):
                p, o = c["p"].to_numpy(), c["o"].to_numpy()
                j = np.searchsorted(p, x)
                inside = j < len(p)
                x[inside] = o[j[inside]]
            return rows.assign(b=rows["sb"], o=x)[[*keys, "b", "p", "o", "land"]]

        return run

    tables = [marked.groupBy(*keys, "b").applyInPandas(reduce_block, table_schema)]
    for size in sizes[1:-1]:
        lifted = tables[-1].withColumn("sb", F.expr(f"b div {FAN}"))
        tables.append(lifted.groupBy(*keys, "sb").applyInPandas(combine(size), table_schema))

    entry_schema = f"{head}, b bigint, x bigint"

    def hand_down(group: pd.DataFrame) -> pd.DataFrame:
        x, rows = int(group["x"].iat[0]), []
        for b, c in group.sort_values(["b", "p"]).groupby("b"):
            rows.append((b, x))
            p, o = c["p"].to_numpy(), c["o"].to_numpy()
            j = int(np.searchsorted(p, x))
            if j < len(p):
                x = int(o[j])
        out = pd.DataFrame(rows, columns=["b", "x"])
        for k in keys:
            out[k] = group[k].iat[0]
        return out[[*keys, "b", "x"]]

    entering = None
    for table in reversed(tables):
        wide = table.withColumn("sb", F.expr(f"b div {FAN}"))
        if entering is None:
            wide = wide.withColumn("x", F.lit(-1).cast("long"))
        else:
            wide = wide.join(entering.withColumnRenamed("b", "sb"), [*keys, "sb"])
        entering = wide.groupBy(*keys, "sb").applyInPandas(hand_down, entry_schema)
    return entering
