"""Volatility, trend, volume and regime columns of numbered bars.

All functions take the window ``w`` of ``block_window`` (or any window ordered
by ``seq`` that starts early enough) and return plain columns, so one shuffle
and one sort serve every feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import BLOCK, HALO, smoothed, with_smoothed

# Periods and multipliers of the feature definitions.
ATR_PERIOD = 14
VOLUME_PERIOD = 20
EMA_FAST, EMA_SLOW = 20, 50
ATR_MEAN_ROWS = 30
ATR_RANK_ROWS = 50
SPIKE = {False: {"elevated": 1.15, "calm": 1.30, "young": 1.25}, True: {"elevated": 1.35, "calm": 1.50, "young": 1.50}}
SPIKE_ELEVATED, SPIKE_MIN_ATRS = 1.3, 5
DISPLACEMENT = {False: 0.50, True: 0.70}
REGIME_ROWS, REGIME_VOLATILE, REGIME_TREND = 30, 1.4, 0.04


def true_range(w) -> Column:
    prior = F.lag("close").over(w)
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior)
    )


def wilder_atr(w, tr: str = "tr", *, halo: int = HALO, rows: int = BLOCK + HALO) -> Column:
    value = smoothed(F.col(tr), 1.0 / ATR_PERIOD, w, halo=halo, rows=rows)
    return F.when(F.col("seq") >= ATR_PERIOD - 1, value)


def range_sma(w) -> Column:
    """Simple mean of candle ranges, the charting variant of ATR."""
    frame = w.rowsBetween(1 - ATR_PERIOD, 0)
    return F.when(F.col("seq") >= ATR_PERIOD - 1, F.avg(F.col("high") - F.col("low")).over(frame))


def ema(w, span: int, col: str = "close", *, halo: int = HALO, rows: int = BLOCK + HALO) -> Column:
    """Over padded blocks; spans that do not fit them are refused, see ``with_emas``."""
    return smoothed(F.col(col), 2.0 / (span + 1), w, halo=halo, rows=rows)


def with_emas(df: DataFrame, keys: Sequence[str], spans: dict[str, int], col: str = "close", *, block: int | None = None) -> DataFrame:
    """Exponential means of any spans over numbered bars, one column per name."""
    return with_smoothed(df, keys, {n: (F.col(col), 2.0 / (s + 1)) for n, s in spans.items()}, block=block)


def volume_mean(w) -> Column:
    return F.when(F.col("seq") >= VOLUME_PERIOD - 1, F.avg("volume").over(w.rowsBetween(1 - VOLUME_PERIOD, 0)))


def typical_value() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")


def trailing_sum(value: Column, w, rows: int) -> Column:
    """Sum over the last ``rows`` rows as the difference of two running sums.

    A wide sliding frame would add its rows up anew for every row. The running
    sums restart per block, so little precision is lost in the difference.
    """
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left_out = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -rows))
    return total - F.coalesce(left_out, F.lit(0.0))


def vwap(w, rows: int, *, halo: int = HALO) -> Column:
    """Volume-weighted typical price of the last ``rows`` bars, null without volume.

    ``halo`` says how far the window's blocks reach back; a wider request is refused.
    """
    if rows > halo:
        raise ValueError(f"a mean of {rows} rows needs blocks with as many lead-in rows, these have {halo}")
    traded = trailing_sum(F.col("volume"), w, rows)
    return trailing_sum(typical_value(), w, rows) / F.nullif(traded, F.lit(0.0))


def atr_mean(w) -> Column:
    return F.avg("atr").over(w.rowsBetween(1 - ATR_MEAN_ROWS, 0))


def spike_multiplier(ai: bool = False) -> Column:
    """Volume multiple that counts as a spike; stricter while ATR is calm."""
    level = SPIKE[ai]
    known = F.col("seq") >= ATR_PERIOD - 1 + SPIKE_MIN_ATRS - 1
    usable = known & F.col("atr").isNotNull() & (F.col("atr_avg") > 0)
    return (
        F.when(usable & (F.col("atr") > F.col("atr_avg") * SPIKE_ELEVATED), level["elevated"])
        .when(usable, level["calm"])
        .otherwise(level["young"])
    )


def flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def volume_spike(ai: bool = False) -> Column:
    return flag(F.col("volume") > F.col("volume_ma") * spike_multiplier(ai))


def body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def displacement(ai: bool = False) -> Column:
    return flag(body() > F.col("atr") * DISPLACEMENT[ai])


def atr_percentile(w) -> Column:
    """Share of the last 50 ATRs below the current one, 50 until there are 50."""
    recent = F.collect_list("atr").over(w.rowsBetween(1 - ATR_RANK_ROWS, 0))
    below = F.size(F.filter(recent, lambda a: a < F.col("atr")))
    full = F.col("seq") >= ATR_PERIOD - 1 + ATR_RANK_ROWS - 1
    return F.when(full, below * (100.0 / ATR_RANK_ROWS)).otherwise(50.0)


def market_regime(w) -> Column:
    base = F.lag("close", REGIME_ROWS - 1).over(w)
    moved = F.abs(F.col("close") - base) / F.nullif(base, F.lit(0.0))
    return (
        F.when(F.col("seq") < REGIME_ROWS - 1, "ranging")
        .when(F.col("atr") > F.col("atr_avg") * REGIME_VOLATILE, "volatile")
        .when(moved > REGIME_TREND, "trending")
        .otherwise("ranging")
    )


def pct_change(w, col: str) -> Column:
    prior = F.lag(col).over(w)
    return F.when(prior > 0, (F.col(col) - prior) / prior * 100)


def pct_change_rows(w, col: str, rows: int = 13) -> Column:
    """First-to-last change over the last ``rows`` positive points, null below 2."""
    frame = w.rowsBetween(1 - rows, 0)
    good = F.when(F.col(col) > 0, F.col(col))
    head = F.first(good, ignorenulls=True).over(frame)
    tail = F.last(good, ignorenulls=True).over(frame)
    return F.when(F.count(good).over(frame) >= 2, (tail - head) / head * 100)
