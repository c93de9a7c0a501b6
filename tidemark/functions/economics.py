"""Sizing, fees, profit and policy columns of a position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import Execution, Gates

LONG = "LONG"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def is_long(direction="direction") -> Column:
    return F.upper(_c(direction)) == LONG


def signed_move(direction, start, end) -> Column:
    """Price move in the trade's favour."""
    return F.when(is_long(direction), _c(end) - _c(start)).otherwise(_c(start) - _c(end))


def tidy(x: Column, digits: int) -> Column:
    """Round half up on the binary value, alike on any engine."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def or_default(x, default) -> Column:
    """Null and zero both read as the default."""
    return F.coalesce(F.nullif(_c(x), F.lit(0.0)), F.lit(default))


def realized_r(direction, entry, sl, exit_price, digits: int = 4) -> Column:
    """Move in multiples of the planned risk; 0 without risk or without an exit."""
    entry, sl = or_default(entry, 1.0), F.coalesce(_c(sl), F.lit(0.0))
    risk = F.abs(entry - sl)
    out = F.coalesce(F.nullif(_c(exit_price), F.lit(0.0)), entry)
    return F.when(risk > 0, tidy(signed_move(direction, entry, out) / risk, digits)).otherwise(0.0)


def label_r(barrier_r, managed_r):
    """(R, kind): the barrier outcome when there is one, else the managed exit."""
    kind = F.when(_c(barrier_r).isNotNull(), "triple_barrier").otherwise("realized")
    return F.coalesce(tidy(_c(barrier_r), 4), _c(managed_r)), kind


def risk_amount(balance, risk_pct: float = Execution.risk_pct) -> Column:
    return tidy(_c(balance) * risk_pct / 100, 2)


def position_qty(entry, sl, balance, x: Execution = Execution(), fee_rate: float | None = None) -> Column:
    """Quantity that loses the risk amount at the stop, capped by leverage.

    The fee that is set aside is the maker fee, since entries rest as limits.
    """
    entry, sl = _c(entry), _c(sl)
    by_risk = risk_amount(balance, x.risk_pct) / (1 + (x.maker_fee if fee_rate is None else fee_rate)) / F.nullif(F.abs(entry - sl), F.lit(0.0))
    by_margin = _c(balance) * x.leverage / F.nullif(entry, F.lit(0.0))
    return F.when((entry == sl) | (entry == 0), 0.0).otherwise(tidy(F.least(by_risk, by_margin), 6))


def ai_risk_pct(prob, drawdown, regime, fix_order: bool = False) -> Column:
    """Risk percent from model probability, drawdown and regime, within 0.2-2.5.

    The source tests drawdown > 5 before > 10, so the deeper cut never applies;
    ``fix_order`` tests the deeper one first.
    """
    prob, dd = _c(prob), _c(drawdown)
    base = F.when(prob >= 80, 0.5 * 2.0).when(prob >= 70, 0.5 * 1.6).when(prob >= 60, 0.5 * 1.2).otherwise(0.5 * 0.6)
    deep = F.when(dd > 10, 0.4) if fix_order else None
    brake = (deep.when(dd > 5, 0.6) if deep is not None else F.when(dd > 5, 0.6)).otherwise(1.0)
    mood = F.when(_c(regime) == "volatile", 0.75).when(_c(regime) == "trending", 1.15).otherwise(1.0)
    return tidy(F.greatest(F.lit(0.2), F.least(F.lit(2.5), base * brake * mood)), 2)


def scaled_qty(entry, sl, balance, prob, drawdown, regime, step, min_qty, max_qty, x: Execution = Execution()):
    """Confidence-scaled quantity on the market's step; null below the minimum."""
    per_unit = F.nullif(F.abs(_c(entry) - _c(sl)), F.lit(0.0))
    base = risk_amount(balance, x.risk_pct)
    wanted = base * (ai_risk_pct(prob, drawdown, regime) / 0.5)
    capped = F.least(wanted, base * (x.max_risk_pct / x.risk_pct))
    qty = F.floor(capped / per_unit / _c(step) + 0.5) * _c(step)
    return F.when(qty >= _c(min_qty), tidy(F.least(qty, _c(max_qty)), 6))


def fee(price, qty, rate: float) -> Column:
    return tidy(_c(price) * _c(qty) * rate, 2)


def closed_pnl(direction, entry, exit_price, qty, *, entry_fee=None, rate: float = Execution.taker_fee) -> Column:
    """Net profit after the exit fee, and after the entry fee when it is given."""
    net = signed_move(direction, entry, exit_price) * _c(qty) - fee(exit_price, qty, rate)
    return net - _c(entry_fee) if entry_fee is not None else net


def outcome(pnl) -> Column:
    return F.when(_c(pnl) > 0, "WIN").otherwise("LOSS")


def approx_pnl(direction, entry, exit_price, qty) -> Column:
    return tidy(signed_move(direction, F.coalesce(_c(entry), F.lit(0.0)), exit_price) * F.coalesce(_c(qty), F.lit(0.0)), 4)


def trail_distance(ref, atr, pct: float = Execution.trail_pct, mult: float = Execution.trail_atr) -> Column:
    return F.greatest(_c(ref) * (pct / 100.0), F.coalesce(_c(atr), F.lit(0.0)) * mult)


def target_progress(direction, entry, tp, price) -> Column:
    span = signed_move(direction, entry, tp)
    return F.when(span > 0, signed_move(direction, entry, price) / span).otherwise(0.0)


def invalidated(direction, price, invalidation, swing, sl, entry) -> Column:
    """Price is through the level the setup rests on.

    The level is the stored one, else the swing, else a stop on the safe side.
    """
    safe = F.when(is_long(direction), _c(sl) < _c(entry)).otherwise(_c(sl) > _c(entry))
    level = F.coalesce(_c(invalidation), _c(swing), F.when(safe, _c(sl)))
    through = F.when(is_long(direction), _c(price) < level).otherwise(_c(price) > level)
    return F.coalesce(through, F.lit(False))


def roi_pct(direction, entry, qty, leverage, exit_price) -> Column:
    lev = F.greatest(or_default(leverage, 1.0), F.lit(1.0))
    margin = _c(entry) * _c(qty) / lev
    gain = signed_move(direction, entry, exit_price) * _c(qty)
    return F.when((_c(entry) > 0) & (_c(qty) > 0) & (margin > 0), gain / margin * 100).otherwise(0.0)


def tick_price(price, tick) -> Column:
    """Price on the tick grid; a tick of 1 or more means decimal places."""
    price, tick = _c(price), _c(tick)
    on_grid = tidy(F.floor(price / tick + 0.5) * tick, 10)
    places = F.pow(F.lit(10.0), F.floor(tick))
    return (
        F.when((tick > 0) & (tick < 1), on_grid)
        .when(tick >= 1, F.floor(price * places + 0.5) / places)
        .otherwise(tidy(price, 6))
    )


def model_weight(n_closed, g: Gates = Gates()) -> Column:
    """Say of the model: none up to 30 closed trades, full at 150."""
    ramp = F.least(F.lit(1.0), (_c(n_closed) - g.ai_ramp_start) / float(g.ai_ramp_full - g.ai_ramp_start))
    return F.when(_c(n_closed) <= g.ai_ramp_start, 0.0).otherwise(tidy(g.ai_max_weight * ramp, 4))


# Confidence bar per entry mode.
THRESHOLDS = {
    "limit": {"base": 32, "trending": -5, "volatile": 8, "ranging": 4, "hot": -5, "cold": 10, "high": 5, "low": -3,
              "floor": 22},
    "market": {"base": 45, "trending": -5, "volatile": 10, "ranging": 6, "hot": -6, "cold": 12, "high": 6, "low": -4,
               "floor": 30},
}
THRESHOLD_TOP = 75


def confidence_bar(regime, atr_percentile, win_rate, mode: str = "limit") -> Column:
    t = THRESHOLDS[mode]
    regime, rank, rate = _c(regime), _c(atr_percentile), _c(win_rate)
    bar = F.lit(t["base"])
    for name in ("trending", "volatile", "ranging"):
        bar = bar + F.when(regime == name, t[name]).otherwise(0)
    bar = bar + F.when(rate > 0.55, t["hot"]).when(rate < 0.40, t["cold"]).otherwise(0)
    bar = bar + F.when(rank > 80, t["high"]).when(rank < 20, t["low"]).otherwise(0)
    return F.greatest(F.lit(t["floor"]), F.least(F.lit(THRESHOLD_TOP), bar))


REPAIR_FEE = 0.0004  # fixed value: rate the ledger correction charges


def repaired(df, rate: float = REPAIR_FEE):
    """Recompute profit, fee and status of ledger rows, marking changes and skips."""
    usable = (
        F.col("entry").isNotNull()
        & F.col("exit_price").isNotNull()
        & F.col("qty").isNotNull()
        & F.coalesce(F.col("direction").isin("LONG", "SHORT"), F.lit(False))
    )
    new_fee = fee("exit_price", "qty", rate)
    new_pnl = tidy(signed_move("direction", "entry", "exit_price") * F.col("qty") - new_fee, 2)
    changed = ~(F.col("status").eqNullSafe(outcome(new_pnl)) & F.col("pnl").eqNullSafe(new_pnl))
    replaced = {
        "pnl": F.when(usable, new_pnl).otherwise(F.col("pnl")),
        "exit_fee": F.when(usable, new_fee).otherwise(F.col("exit_fee")),
        "status": F.when(usable, outcome(new_pnl)).otherwise(F.col("status")),
        "entry_fee": F.when(usable, F.coalesce(F.col("entry_fee"), fee("entry", "qty", rate))).otherwise(
            F.col("entry_fee")
        ),
    }
    keep = [c for c in df.columns if c not in replaced]
    return df.select(
        *keep,
        *[v.alias(k) for k, v in replaced.items()],
        (usable & changed).alias("changed"),
        F.when(~usable, "incomplete").alias("skipped"),
        F.col("status").alias("old_status"),
    )
