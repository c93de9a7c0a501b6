"""Chart structure: equal highs and lows, internal breaks and character changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import patterns as pat
from tidemark.operators.bars import numbered, rising
from tidemark.operators.blocks import BLOCK, block_window, halo_blocks, own_rows, running, with_seq
from tidemark.session import stage

KEYS = ["symbol"]


def equal_levels(bars: DataFrame, tf: str, *, block: int = 4096) -> DataFrame:
    """Confirmed pivots with the number of recent pivots at the same level.

    Pivots are numbered anew (they are far fewer than bars) and compared with the
    19 before them inside padded blocks.
    """
    w = block_window(KEYS)
    top, low = pat.pivot_marks(w)
    df = halo_blocks(numbered(bars, tf), KEYS, block=block, halo=2 * pat.PIVOT_BARS + 1).select("*", top.alias("high_p"), low.alias("low_p"))
    rows = own_rows(df).where("high_p is not null or low_p is not null")
    sides = F.explode(F.array(
        F.struct(F.lit("high").alias("side"), F.col("high_p").alias("level")),
        F.struct(F.lit("low").alias("side"), F.col("low_p").alias("level")),
    ))
    pivots = rows.select("symbol", "ts", F.col("seq").alias("bar"), sides.alias("p")).select(
        "symbol", "ts", "bar", "p.side", "p.level"
    ).where("level is not null")
    pivots, keys = stage(pivots, "pivots"), [*KEYS, "side"]
    ranked = with_seq(pivots, keys, ["bar"], {"_chunk": F.expr(f"bar div {BLOCK}")})
    wide = halo_blocks(ranked, keys, block=block, halo=pat.PIVOT_MEMORY)
    past = F.collect_list("level").over(block_window(keys).rowsBetween(1 - pat.PIVOT_MEMORY, -1))
    wide = wide.select("*", past.alias("_past"))
    return own_rows(wide).select(
        "symbol", "ts", "side", "level", pat.touches(F.col("_past"), F.col("level")).alias("touches")
    )


def internal_structure(bars: DataFrame, tf: str) -> DataFrame:
    """New internal breaks, told apart by the bias the last break left behind."""
    w = block_window(KEYS)
    up, down = pat.break_of_structure(w, pat.INTERNAL_LOOKBACK, pat.INTERNAL_CONFIRM)
    df = halo_blocks(numbered(bars, tf), KEYS, block=4096, halo=pat.INTERNAL_LOOKBACK + pat.INTERNAL_CONFIRM + 2).select("*", up.alias("_up"), down.alias("_down"))
    df = df.select("*", rising(F.col("_up"), w).alias("new_bull"), rising(F.col("_down"), w).alias("new_bear"))
    rows = stage(own_rows(df), "breaks")
    mark = F.when(F.col("new_bear"), "BEARISH").when(F.col("new_bull"), "BULLISH")
    rows = running(rows, KEYS, {"_chunk": F.expr(f"seq div {BLOCK}")}, ["seq"], {"bias": (mark, "last")}, exclusive=True)
    bias = F.coalesce(F.col("bias"), F.lit("NEUTRAL"))
    return rows.select(
        "symbol", "ts", "seq", bias.alias("bias"),
        (F.col("new_bull") & (bias == "BEARISH")).alias("choch_bull"),
        (F.col("new_bear") & (bias == "BULLISH")).alias("choch_bear"),
        (F.col("new_bull") & (bias != "BEARISH")).alias("bos_bull"),
        (F.col("new_bear") & (bias != "BULLISH")).alias("bos_bear"),
    )
