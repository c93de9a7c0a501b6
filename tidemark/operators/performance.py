"""Equity, drawdown and performance metrics of a set of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.economics import tidy
from tidemark.operators.blocks import BLOCK, running


def compounded(trades: DataFrame, keys: Sequence[str], order: str, rho: str, start: float) -> DataFrame:
    """Equity before and after each trade when every trade returns ``rho`` of it."""
    chunk = {"_chunk": F.floor(F.col(order) / BLOCK)}
    grown = running(trades, list(keys), chunk, [order], {"_growth": (F.log1p(F.col(rho)), "sum")})
    after = start * F.exp("_growth")
    return grown.withColumn("equity", after).withColumn("equity_before", after / (1 + F.col(rho))).drop("_growth")


def drawdowns(points: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: dict[str, Column], equity: str,
              start: float) -> DataFrame:
    """Fraction below the running peak, which starts at the opening balance."""
    peaks = running(points, list(keys), chunk, list(order), {"_peak": (F.col(equity), "max")})
    peak = F.greatest(F.col("_peak"), F.lit(start))
    return peaks.withColumn("drawdown", (peak - F.col(equity)) / F.when(peak == 0, 1.0).otherwise(peak)).drop("_peak")


def metrics(trades: DataFrame, keys: Sequence[str], order: Sequence[str], start: float) -> DataFrame:
    """One row per key: needs pnl, realized_r, bars_held, equity and drawdown.

    Wins have pnl above zero. The profit factor is infinite without losses.
    """
    n = F.count(F.lit(1))
    pnl = F.col("pnl")
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), -F.sum(F.when(pnl <= 0, pnl).otherwise(0.0))
    last = F.max_by("equity", F.struct(*order))
    spread = F.stddev_samp("pnl")
    return trades.groupBy(*keys).agg(
        n.alias("n_trades"),
        tidy(F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), 3).alias("win_rate"),
        tidy((last / start - 1) * 100, 2).alias("total_return_pct"),
        tidy(last, 2).alias("final_equity"),
        F.when(loss > 0, tidy(gain / F.nullif(loss, F.lit(0.0)), 2)).otherwise(float("inf")).alias("profit_factor"),
        tidy(F.avg("pnl"), 4).alias("expectancy"),
        tidy(F.avg("realized_r"), 3).alias("avg_r"),
        tidy(F.max("drawdown") * 100, 2).alias("max_drawdown_pct"),
        F.when(spread > 0, tidy(F.avg("pnl") / F.nullif(spread, F.lit(0.0)) * F.sqrt(n), 2)).otherwise(0.0).alias("sharpe"),
        tidy(F.avg(F.col("bars_held").cast("double")), 1).alias("avg_bars_held"),
    )
