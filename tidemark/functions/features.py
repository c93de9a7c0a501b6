"""Model features of a trade or signal row, one projection for training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.economics import or_default

# The feature vocabulary, its order, and the duplicate left out of fitting.
FEATURES = """volume_spike displacement trend_bull sweep fvg risk_reward risk_pct reward_pct adversity_ratio body_ratio
volume_strength atr_expansion atr_percentile is_high_volatility is_low_volatility regime_trending regime_ranging
regime_volatile distance_to_prev_high distance_to_prev_low distance_to_ema20 distance_to_ema50 distance_to_vwap
confluence_count confluence_strength hour day_of_week is_london_open is_ny_open is_asian is_overlap is_quiet_time
is_monday is_friday is_scalp is_swing recent_win_rate streak_count is_hot_streak cumulative_pnl current_dd_pct
funding_rate oi_change_pct btc_trend spread_pct symbol_win_rate btc_aligned funding_vs_direction fng is_extreme_fear
is_extreme_greed crt crt_x_sweep volume_x_displacement sweep_x_fvg volatility_x_risk atr_x_confluence atr_x_session
fvg_x_sweep rr_x_atr""".split()
DUPLICATES = ("fvg_x_sweep",)
META = ("target", "realized_r", "label_kind", "sample_source", "entry_ms", "exit_ms")
MODEL_FEATURES = [f for f in FEATURES if f not in DUPLICATES]

# What an absent field reads as.
ABSENT = {
    "entry": 1.0, "volume_ma": 1.0, "atr_percentile": 50.0, "hour": 12.0, "day_of_week": 2.0, "recent_win_rate": 0.5,
}
# Context fields for which a stored zero also reads as absent.
ZERO_IS_ABSENT = {"funding_rate": 0.0, "oi_change_pct": 0.0, "btc_trend": 0.0, "spread_pct": 0.0,
                  "symbol_win_rate": 0.5, "fng": 50.0}
TINY = 0.0001


def with_features(df: DataFrame, *, zero_is_absent: bool = True) -> DataFrame:
    """Add all features as doubles; columns of the same name are replaced.

    Three projections: raw fields with their defaults, ratios, then flags and
    products of those.
    """
    have = set(df.columns)

    def raw(name: str) -> Column:
        if name in ZERO_IS_ABSENT:
            if name not in have:
                return F.lit(ZERO_IS_ABSENT[name])
            col = F.col(name).cast("double")
            return or_default(col, ZERO_IS_ABSENT[name]) if zero_is_absent else F.coalesce(col, F.lit(ZERO_IS_ABSENT[name]))
        base = F.col(name).cast("double") if name in have else F.lit(None).cast("double")
        return F.coalesce(base, F.lit(ABSENT.get(name, 0.0)))

    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    carried = [
        "volume_spike", "displacement", "sweep", "fvg", "crt", "atr_percentile", "hour", "day_of_week", "recent_win_rate",
        "streak_count", "cumulative_pnl", "current_dd_pct", "distance_to_prev_high", "distance_to_prev_low",
        "distance_to_ema20", "distance_to_ema50", "distance_to_vwap", *ZERO_IS_ABSENT,
    ]
    regime = F.coalesce(F.col("market_regime"), F.lit("ranging")) if "market_regime" in have else F.lit("ranging")
    keep = [c for c in df.columns if c not in FEATURES]
    risk, reward = F.abs(raw("entry") - raw("sl")), F.abs(raw("tp") - raw("entry"))
    first = df.select(
        *keep,
        *[raw(c).alias(c) for c in carried],
        F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0).alias("_side"),
        risk.alias("_risk"), reward.alias("_reward"), raw("entry").alias("_entry"), raw("atr").alias("_atr"),
        raw("body").alias("_body"), raw("volume").alias("_volume"), raw("volume_ma").alias("_volume_ma"),
        regime.alias("_regime"),
    )
    floor = lambda c: F.greatest(F.col(c), F.lit(TINY))
    second = first.select(
        "*",
        one(F.col("_side") > 0).alias("trend_bull"),
        (F.col("_reward") / floor("_risk")).alias("risk_reward"),
        (F.col("_risk") / floor("_entry")).alias("risk_pct"),
        (F.col("_reward") / floor("_entry")).alias("reward_pct"),
        (F.col("_risk") / floor("_reward")).alias("adversity_ratio"),
        (F.col("_body") / floor("_atr")).alias("body_ratio"),
        (F.col("_volume") / floor("_volume_ma")).alias("volume_strength"),
        F.col("_atr").alias("atr_expansion"),
        (F.col("volume_spike") + F.col("displacement") + F.col("sweep") + F.col("fvg")).alias("confluence_count"),
    )
    hour, day, rr = F.col("hour"), F.col("day_of_week"), F.col("risk_reward")
    derived = {
        "is_high_volatility": one(F.col("atr_percentile") > 70),
        "is_low_volatility": one(F.col("atr_percentile") < 30),
        **{f"regime_{name}": one(F.col("_regime") == name) for name in ("trending", "ranging", "volatile")},
        "confluence_strength": F.col("confluence_count") / 4,
        "is_london_open": one(hour.between(7, 11)),
        "is_ny_open": one(hour.between(12, 16)),
        "is_asian": one((hour >= 22) | (hour <= 6)),
        "is_overlap": one(hour.between(8, 11)),
        "is_quiet_time": one(hour.between(17, 21)),
        "is_monday": one(day == 0),
        "is_friday": one(day == 4),
        "is_scalp": one(rr < 1.8),
        "is_swing": one(rr >= 2.0),
        "is_hot_streak": one(F.col("streak_count") > 0),
        "btc_aligned": one(F.col("btc_trend") * F.col("_side") > 0),
        "funding_vs_direction": F.col("funding_rate") * F.col("_side"),
        "is_extreme_fear": one(F.col("fng") <= 20),
        "is_extreme_greed": one(F.col("fng") >= 80),
        "crt_x_sweep": F.col("crt") * F.col("sweep"),
        "volume_x_displacement": F.col("volume_spike") * F.col("displacement"),
        "sweep_x_fvg": F.col("sweep") * F.col("fvg"),
        "volatility_x_risk": F.col("_atr") * F.col("risk_pct"),
        "atr_x_confluence": F.col("_atr") * (F.col("confluence_count") / 4),
        "atr_x_session": F.col("_atr") * one(hour.between(7, 16)),
        "fvg_x_sweep": F.col("fvg") * F.col("sweep"),
        "rr_x_atr": rr * F.col("_atr"),
    }
    third = second.select("*", *[v.alias(k) for k, v in derived.items()])
    return third.select(*keep, *FEATURES)
