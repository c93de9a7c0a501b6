"""Strategy, risk and replay parameters, grouped by the step that reads them.

Fixed values: the defaults below must keep these numbers for results to agree
with the published strategy settings (scalp and swing presets).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Geometry:
    """Stops, targets and resting-limit placement."""

    stop_style: str = "structure"  # structure | zone
    rr_low: float = 1.5
    rr_mid: float = 1.75
    rr_high: float = 2.0
    min_stop_atr: float = 1.15
    buffer_atr: float = 0.25
    swing_lookback: int = 20
    retrace_atr: float = 0.45
    min_room: float = 0.30
    fallback_retrace_atr: float = 0.25
    reanchor_floor: float = 0.85


@dataclass(frozen=True)
class Gates:
    """Confidence and history gates of the signal engine."""

    entry_mode: str = "limit"  # limit | market
    ai: bool = False
    required_market: int = 40
    required_limit: int = 28
    min_setup_score: int = 20
    min_confidence: float = 65.0
    min_bars: int = 30
    min_bias_bars: int = 30
    warmup: int = 60
    min_expected_r: float = 0.0
    veto_min_real: int = 60
    ai_max_weight: float = 0.40
    ai_ramp_start: int = 30
    ai_ramp_full: int = 150


@dataclass(frozen=True)
class Execution:
    """Fills, exits, costs and labels of a replay."""

    ttl_bars: int = 36
    ttl_minutes: float = 180.0
    invalidate: bool = True
    trail_pct: float = 0.3
    trail_atr: float = 1.5
    trail_by_atr: bool = True
    activation: float = 0.90
    slippage_pct: float = 0.02
    maker_fee: float = 0.0002
    taker_fee: float = 0.00055
    risk_pct: float = 0.5
    max_risk_pct: float = 2.5
    start_balance: float = 100.0
    leverage: float = 10.0
    label_bars: int = 288
    win_label_r: float = 0.5
    unfilled_blocks_ttl: bool = False


@dataclass(frozen=True)
class Portfolio:
    """Limits that apply across positions."""

    heat_pct: float = 5.0
    per_direction: int = 6
    alts: int = 8
    top_signals: int = 3
    daily_loss_limit: float = 15.0
    cooldown_minutes: float = 120.0
    spread_fraction: float = 0.15


SCALP = (Geometry(), Gates(), Execution(), Portfolio())
SWING = (
    Geometry(stop_style="zone", rr_low=3.0, rr_mid=3.5, rr_high=4.0, min_stop_atr=0.60),
    replace(Gates(), min_confidence=0.0),
    replace(Execution(), ttl_bars=6),
    replace(Portfolio(), cooldown_minutes=0.0),
)

# Grid of the two-phase parameter search.
GRID = {
    "confidence": [35, 40, 45, 50],
    "retrace": [0.25, 0.35, 0.50],
    "trail_pct": [0.3, 0.5, 0.8],
    "activation": [0.90, 0.97],
}
