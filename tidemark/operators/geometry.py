"""Entry, stop and target placement as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.economics import is_long
from tidemark.params import Geometry

# Distance from entry, in ATRs, that a structure stop keeps at the very least.
SANITY_ATR = 0.10


def zone_stop(direction, ref: Column, atr: Column, g: Geometry = Geometry()) -> Column:
    """Stop a fixed number of ATRs beyond the entry zone."""
    gap = atr * (g.min_stop_atr + g.buffer_atr)
    return F.when(is_long(direction), ref - gap).otherwise(ref + gap)


def structure_stop(direction, entry: Column, atr: Column, low: Column, high: Column, g: Geometry = Geometry()) -> Column:
    """Stop beyond the swing plus a buffer, never nearer than the ATR floor."""
    below = F.least(low - atr * g.buffer_atr, entry - atr * g.min_stop_atr, entry - atr * SANITY_ATR)
    above = F.greatest(high + atr * g.buffer_atr, entry + atr * g.min_stop_atr, entry + atr * SANITY_ATR)
    return F.when(is_long(direction), below).otherwise(above)


def structure_stop_wide(direction, entry, atr, entry_swing, bias_swing, bias_rows, g: Geometry = Geometry()):
    """(stop, raw swing), the wider of two timeframes.

    ``entry_swing`` and ``bias_swing`` are (low, high) column pairs; the bias
    pair counts once it has 5 bars. The wider stop follows from the deeper swing,
    because floor and buffer are the same on both sides.
    """
    use = F.coalesce(bias_rows >= 5, F.lit(False))
    low = F.least(entry_swing[0], F.when(use, bias_swing[0]))
    high = F.greatest(entry_swing[1], F.when(use, bias_swing[1]))
    swing = F.when(is_long(direction), low).otherwise(high)
    return structure_stop(direction, entry, atr, low, high, g), swing


def target(direction, entry: Column, stop: Column, rr: Column) -> Column:
    return F.when(is_long(direction), entry + (entry - stop) * rr).otherwise(entry - (stop - entry) * rr)


def atr_barriers(direction, entry: Column, atr: Column, profit: float, stop: float):
    """(profit price, stop price); null where ATR is not positive."""
    ok = atr > 0
    up, down = entry + atr * profit, entry - atr * profit
    lower, upper = entry - atr * stop, entry + atr * stop
    long = is_long(direction)
    return F.when(ok, F.when(long, up).otherwise(down)), F.when(ok, F.when(long, lower).otherwise(upper))


def limit_zone(direction, entry: Column, stop: Column, atr: Column, gap: Column, block: Column, g: Geometry = Geometry()):
    """Struct (price, zone): the deepest resting level inside the allowed band.

    Candidates are gap middle, order block and ATR pullback (null = absent). The
    band runs from entry to 30 % of the risk distance short of the stop. Depth is
    signed so that one array_min serves both sides; equal depths keep the earlier
    candidate through its rank.
    """
    side = F.when(is_long(direction), 1.0).otherwise(-1.0)
    pullback = entry - side * atr * g.retrace_atr
    room = stop + g.min_room * (entry - stop)
    ranked = F.array(
        *[
            F.struct((side * price).alias("depth"), F.lit(rank).alias("rank"), F.lit(zone).alias("zone"), price.alias("price"))
            for rank, (zone, price) in enumerate((("fvg", gap), ("order_block", block), ("atr_pullback", pullback)))
        ]
    )
    inside = F.filter(ranked, lambda c: (c["depth"] >= side * room) & (c["depth"] <= side * entry))
    best = F.array_min(inside)
    spare = entry - side * atr * g.fallback_retrace_atr
    spare = F.when(side > 0, F.greatest(room, F.least(entry, spare))).otherwise(F.least(room, F.greatest(entry, spare)))
    return F.struct(
        F.coalesce(best["price"], spare).alias("price"),
        F.coalesce(best["zone"], F.lit("atr_pullback")).alias("zone"),
    )
