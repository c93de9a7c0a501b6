"""Labelled corpus: context series, replay over all symbols, idempotent backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import patterns as pat
from tidemark.operators.asof import multi_context
from tidemark.operators.bars import numbered
from tidemark.operators.blocks import block_window, halo_blocks, own_rows
from tidemark.operators.ledger import tagged_backfill, with_backfill
from tidemark.sources import store

DEF_VERSION = 1


def trend_series(bars: DataFrame, tf: str, symbol: str) -> DataFrame:
    """Structure trend of one reference symbol as a series without a key."""
    w = block_window(["symbol"])
    one = bars.where(F.col("symbol") == symbol)
    df = halo_blocks(numbered(one, tf), ["symbol"], block=4096, halo=pat.BOS_LOOKBACK + pat.BOS_CONFIRM + 2).select("*", pat.structure_trend(w).alias("value"))
    return own_rows(df).select("ts", F.col("value").cast("double").alias("value"))


def context_enricher(funding: DataFrame, oi: DataFrame, trend: DataFrame, sentiment: DataFrame, form: DataFrame | None = None):
    """A function that attaches the context snapshot to candidate rows.

    Keyed series share one union and window; series without a key are looked up
    on distinct times. The spread cannot be known in history and stays null.
    """

    def attach(rows: DataFrame) -> DataFrame:
        keyed = {"_funding": funding, "_oi": oi} | ({"_form": form} if form is not None else {})
        out = multi_context(rows, keyed, {"_trend": trend, "_fng": sentiment}, ["symbol"])
        out = out.select(
            "*", F.col("_funding.value").alias("funding_rate"), F.col("_oi.value").alias("oi_change_pct"),
            F.col("_trend.value").alias("btc_trend"), F.col("_fng.value").alias("fng"),
            F.lit(None).cast("double").alias("spread_pct"),
        )
        if form is not None:
            out = out.withColumn("symbol_win_rate", F.coalesce(F.col("_form.symbol_win_rate"), F.lit(0.5)))
        return out.drop("_funding", "_oi", "_trend", "_fng", "_form")

    return attach


def build_corpus(trades: DataFrame, path: str, version: int = DEF_VERSION) -> DataFrame:
    """Store replayed trades by symbol and version and read the version back."""
    marked = tagged_backfill(trades, None)
    store.write_corpus(marked, path, version)
    return store.read_corpus(marked.sparkSession, path, version)


def backfill(ledger: DataFrame, trades: DataFrame, max_trades: int = 150, *, replace: bool = False) -> DataFrame:
    """Ledger with the newest simulated trades in front; a second run adds nothing."""
    return with_backfill(ledger, tagged_backfill(trades, max_trades), replace=replace)
