"""Price patterns as window columns over numbered bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.times import tf_minutes

# Look-backs, tolerances and tick rules of the pattern definitions.
BOS_LOOKBACK, BOS_CONFIRM = 10, 2
SWEEP_ROWS, SWEEP_SLACK = 9, 0.0002
RECENT_SWEEP_LOOKBACK, RECENT_SWEEP_SWING = 8, 12
CRT_MIN_ROWS = 15
OB_LOOKBACK, OB_IMPULSE = 15, 0.55
SWING_ROWS = 20
INTERNAL_LOOKBACK, INTERNAL_CONFIRM = 5, 1
PD_ROWS = 50
PIVOT_BARS, PIVOT_MEMORY, PIVOT_TOLERANCE = 3, 20, 0.0005

LONG, SHORT = "LONG", "SHORT"


def _no(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def break_of_structure(w, lookback: int = BOS_LOOKBACK, confirm: int = BOS_CONFIRM, min_rows: int | None = None):
    """(bull, bear): the last ``confirm`` closes all beyond the swing before them."""
    need = lookback + confirm + 2 if min_rows is None else min_rows
    frame = w.rowsBetween(-(lookback + confirm - 1), -confirm)
    top, floor = F.max("high").over(frame), F.min("low").over(frame)
    up = down = F.col("seq") >= need - 1
    for back in range(confirm):
        close = F.lag("close", back).over(w) if back else F.col("close")
        up, down = up & (close > top), down & (close < floor)
    return _no(up), _no(down)


def structure_trend(w, lookback: int = BOS_LOOKBACK, confirm: int = BOS_CONFIRM) -> Column:
    """+1, -1 or 0 per bar, from the first bar that has a full swing."""
    up, down = break_of_structure(w, lookback, confirm, min_rows=lookback + confirm)
    return F.when(down, -1).when(up, 1).otherwise(0)


def swing_low(w, rows: int) -> Column:
    return F.min("low").over(w.rowsBetween(-rows, -1))


def swing_high(w, rows: int) -> Column:
    return F.max("high").over(w.rowsBetween(-rows, -1))


def green() -> Column:
    return F.col("close") > F.col("open")


def red() -> Column:
    return F.col("close") < F.col("open")


def bar_sweep(ai: bool = False, low: str = "swing_low", high: str = "swing_high"):
    """(bull, bear) on the bar itself; needs the two swing columns."""
    if ai:
        bull, bear = F.col("low") < F.col(low), F.col("high") > F.col(high)
    else:
        bull = F.col("low") <= F.col(low) * (1 + SWEEP_SLACK)
        bear = F.col("high") >= F.col(high) * (1 - SWEEP_SLACK)
    return _no(bull & green()), _no(bear & red())


def sweep_marks(w):
    """(bull, bear) 0/1 marks per bar against its own previous swing."""
    rows = RECENT_SWEEP_SWING
    bull = _no((F.col("low") < swing_low(w, rows)) & green())
    bear = _no((F.col("high") > swing_high(w, rows)) & red())
    whole = F.col("seq") >= rows
    return (bull & whole).cast("int"), (bear & whole).cast("int")


def recent_sweep(w, mark: str) -> Column:
    need = RECENT_SWEEP_SWING + RECENT_SWEEP_LOOKBACK + 2
    seen = F.max(mark).over(w.rowsBetween(1 - RECENT_SWEEP_LOOKBACK, 0))
    return _no((F.col("seq") >= need - 1) & (seen == 1))


def fair_value_gap(w):
    """(bull, bear): a gap on this bar or one of the last three still open."""
    def back(col, n):
        return F.lag(col, n).over(w) if n else F.col(col)

    bull = _no(F.col("low") > back("high", 2))
    bear = _no(F.col("high") < back("low", 2))
    long_enough = F.col("seq") >= 4
    for age in (1, 2, 3):
        ceiling, floor = back("high", age + 2), back("low", age + 2)
        bull = bull | _no(long_enough & (back("low", age) > ceiling) & (F.col("close") > ceiling))
        bear = bear | _no(long_enough & (back("high", age) < floor) & (F.col("close") < floor))
    return bull, bear


def gap_mid(w, side: str) -> Column:
    """Middle of the three-bar geometry of the current bar."""
    if side == LONG:
        return (F.lag("high", 2).over(w) + F.col("low")) / 2.0
    return (F.lag("low", 2).over(w) + F.col("high")) / 2.0


def order_block_mark(w, side: str) -> Column:
    """Middle of the opposing candle right before an impulse candle, else null."""
    size = F.abs(F.col("close") - F.col("open"))
    impulse = size > F.coalesce(F.col("atr"), size) * OB_IMPULSE
    prior_open, prior_close = F.lag("open").over(w), F.lag("close").over(w)
    if side == LONG:
        hit = green() & impulse & (prior_close < prior_open)
        return F.when(hit, (prior_open + F.lag("low").over(w)) / 2.0)
    hit = red() & impulse & (prior_close > prior_open)
    return F.when(hit, (prior_open + F.lag("high").over(w)) / 2.0)


def order_block(w, mark: str) -> Column:
    """Latest mark among the 14 bars before this one."""
    seen = F.last(mark, ignorenulls=True).over(w.rowsBetween(1 - OB_LOOKBACK, -1))
    return F.when(F.col("seq") >= OB_LOOKBACK + 2, seen)


def hour_rows(tf: str) -> int:
    """Bars of two hours, which the hour ranges look back at most while the hour before has bars."""
    return 2 * max(1, -(-60 // tf_minutes(tf))) + 1


def with_hour_range(df, w, keys):
    """Hour-to-date range and the range of the previous hour that has bars.

    The previous hour is read from the row before the hour's first bar, so no
    join is needed; the block lead-in must span ``hour_rows`` bars.
    """
    from pyspark.sql import Window

    hour = F.date_trunc("hour", F.col("ts"))
    in_hour = (
        Window.partitionBy(*keys, "_blk", "_hour").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_hour", hour)
    df = df.select(
        "*",
        F.min("low").over(in_hour).alias("hour_low"),
        F.max("high").over(in_hour).alias("hour_high"),
    )
    opens = F.lag("_hour").over(w) != F.col("_hour")
    df = df.select(
        "*",
        F.when(opens, F.lag("hour_low").over(w)).alias("_pl"),
        F.when(opens, F.lag("hour_high").over(w)).alias("_ph"),
    )
    return df.select(
        "*",
        F.last("_pl", ignorenulls=True).over(to_here).alias("prev_hour_low"),
        F.last("_ph", ignorenulls=True).over(to_here).alias("prev_hour_high"),
    ).drop("_hour", "_pl", "_ph")


def candle_range():
    """(bull, bear): the previous hour's edge was taken and price is back inside."""
    ok = F.col("seq") >= CRT_MIN_ROWS - 1
    bull = (F.col("hour_low") < F.col("prev_hour_low")) & (F.col("close") > F.col("prev_hour_low"))
    bear = (F.col("hour_high") > F.col("prev_hour_high")) & (F.col("close") < F.col("prev_hour_high"))
    return _no(ok & bull), _no(ok & bear)


def structure_swings(w, rows: int = SWING_ROWS):
    """(low, high) of the ``rows`` bars before this one.

    A young series has no full swing: with 7 to ``rows`` + 1 bars the first bar
    stays out, below that every earlier bar counts, and a lone bar is its own.
    """
    frame = w.rowsBetween(-rows, -1)
    young = F.col("seq").between(6, rows)

    def over(agg, col):
        later = agg(F.when(F.col("seq") > 0, F.col(col))).over(frame)
        return F.coalesce(F.when(young, later).otherwise(agg(col).over(frame)), F.col(col))

    return over(F.min, "low"), over(F.max, "high")


def pivot_marks(w):
    """(pivot high, pivot low) confirmed on this bar for the bar 3 rows earlier.

    The centre must beat the rows before it strictly and match or beat the rows
    after it, so the first of equal extremes is the pivot.
    """
    n = PIVOT_BARS
    mid_high, mid_low = F.lag("high", n).over(w), F.lag("low", n).over(w)
    older, newer = w.rowsBetween(-2 * n, -n - 1), w.rowsBetween(1 - n, 0)
    ok = F.col("seq") >= 2 * n
    top = ok & (mid_high > F.max("high").over(older)) & (mid_high >= F.max("high").over(newer))
    low = ok & (mid_low < F.min("low").over(older)) & (mid_low <= F.min("low").over(newer))
    return F.when(top, mid_high), F.when(low, mid_low)


def touches(pivots: Column, value: Column, tolerance: float = PIVOT_TOLERANCE) -> Column:
    """How many earlier pivots lie within the tolerance of the newest one."""
    return F.size(F.filter(pivots, lambda p: F.abs(value - p) <= value * tolerance))


def range_half(w, rows: int = PD_ROWS):
    """(high, low, middle) of the last ``rows`` bars, null until there are enough."""
    frame = w.rowsBetween(1 - rows, 0)
    ok = F.col("seq") >= rows - 1
    top, low = F.when(ok, F.max("high").over(frame)), F.when(ok, F.min("low").over(frame))
    return top, low, (top + low) / 2
