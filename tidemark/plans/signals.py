"""Signal engine: every symbol and every bar in one job.

Entry bars and bias bars each become features in one shuffle of padded blocks;
the bias state is looked up as of the entry bar's close; rows that cannot signal
are dropped before any context is attached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.economics import confidence_bar, model_weight
from tidemark.functions.times import tf_minutes
from tidemark.operators import indicators as ind
from tidemark.operators import patterns as pat
from tidemark.operators.asof import asof_join
from tidemark.operators.bars import numbered
from tidemark.operators.blocks import BLOCK, HALO, block_window, halo_blocks, own_rows
from tidemark.operators.geometry import limit_zone, structure_stop_wide, target, zone_stop
from tidemark.params import Gates, Geometry
from tidemark.session import stage

KEYS = ["symbol"]
VWAP_ROWS = 251  # the look-back slice a replay hands to the engine

# Points per edge of the setup score and confidence bonuses.
POINTS = {"trend": 20, "sweep": 20, "fvg": 15, "crt": 15, "volume": 15, "displacement": 15, "order_block": 10}
BONUS = {"sweep_fvg": 5, "volume_displacement": 5, "crt_sweep": 4, "zone": 3}
TIER_SCORES = (70, 45)
TIER_ATR = (1.30, 0.70)
CONTEXT_MIN_SCORE = 30
CONTEXT_COLUMNS = ("funding_rate", "oi_change_pct", "btc_trend", "spread_pct", "fng")


def feature_blocks(look_back: int, block: int | None = None) -> dict[str, int]:
    """Block and lead-in for windows of ``look_back`` rows next to the fixed indicators; wide look-backs get shorter blocks."""
    halo = max(HALO, look_back)
    return {"block": block or max(HALO, BLOCK + HALO - halo), "halo": halo}


def bar_features(bars: DataFrame, tf: str, *, ai: bool = False, vwap_rows: int = VWAP_ROWS, block: int | None = None) -> DataFrame:
    """Indicator columns for every bar, exact from the first bar of a series."""
    size = feature_blocks(vwap_rows, block)
    return own_rows(_indicators(halo_blocks(numbered(bars, tf), KEYS, **size), ai, vwap_rows, size))


def _indicators(df: DataFrame, ai: bool, vwap_rows: int, size: dict[str, int]) -> DataFrame:
    w, fit = block_window(KEYS), {"halo": size["halo"], "rows": size["block"] + size["halo"]}
    df = df.select("*", ind.true_range(w).alias("tr"))
    df = df.select(
        "*",
        ind.wilder_atr(w, **fit).alias("atr"),
        ind.volume_mean(w).alias("volume_ma"),
        ind.ema(w, ind.EMA_FAST, **fit).alias("ema20"),
        ind.ema(w, ind.EMA_SLOW, **fit).alias("ema50"),
        ind.vwap(w, vwap_rows, halo=size["halo"]).alias("vwap"),
        ind.body().alias("body"),
    )
    df = df.select("*", ind.atr_mean(w).alias("atr_avg"))
    return df.select(
        "*",
        ind.volume_spike(ai).alias("volume_spike"),
        ind.displacement(ai).alias("displacement"),
        ind.atr_percentile(w).alias("atr_percentile"),
        ind.market_regime(w).alias("market_regime"),
    )


def entry_features(
    bars: DataFrame, tf: str, *, ai: bool = False, vwap_rows: int = VWAP_ROWS, swing_rows: int = pat.SWING_ROWS, block: int | None = None
) -> DataFrame:
    """Indicators and patterns of the entry timeframe, one pass over blocks."""
    w, size = block_window(KEYS), feature_blocks(max(vwap_rows, swing_rows, pat.hour_rows(tf)), block)
    df = _indicators(halo_blocks(numbered(bars, tf), KEYS, **size), ai, vwap_rows, size)
    df = pat.with_hour_range(df, w, KEYS)
    bull_mark, bear_mark = pat.sweep_marks(w)
    lows, highs = pat.structure_swings(w, swing_rows)
    gap_up, gap_down = pat.fair_value_gap(w)
    df = df.select(
        "*",
        pat.swing_low(w, pat.SWEEP_ROWS).alias("swing_low"),
        pat.swing_high(w, pat.SWEEP_ROWS).alias("swing_high"),
        bull_mark.alias("_bull_mark"),
        bear_mark.alias("_bear_mark"),
        lows.alias("stop_low"),
        highs.alias("stop_high"),
        gap_up.alias("bull_fvg"),
        gap_down.alias("bear_fvg"),
        pat.gap_mid(w, pat.LONG).alias("gap_long"),
        pat.gap_mid(w, pat.SHORT).alias("gap_short"),
        pat.order_block_mark(w, pat.LONG).alias("_ob_long"),
        pat.order_block_mark(w, pat.SHORT).alias("_ob_short"),
    )
    now_bull, now_bear = pat.bar_sweep(ai)
    crt_bull, crt_bear = pat.candle_range()
    df = df.select(
        "*",
        (now_bull | pat.recent_sweep(w, "_bull_mark")).alias("bull_sweep"),
        (now_bear | pat.recent_sweep(w, "_bear_mark")).alias("bear_sweep"),
        pat.order_block(w, "_ob_long").alias("ob_long"),
        pat.order_block(w, "_ob_short").alias("ob_short"),
        crt_bull.alias("bull_crt"),
        crt_bear.alias("bear_crt"),
    )
    return own_rows(df).drop("_bull_mark", "_bear_mark", "_ob_long", "_ob_short")


def bias_features(bars: DataFrame, tf: str, *, swing_rows: int = pat.SWING_ROWS) -> DataFrame:
    """Trend flags and stop swings of the bias timeframe."""
    w = block_window(KEYS)
    df = halo_blocks(numbered(bars, tf), KEYS, block=4096, halo=max(64, swing_rows))
    up, down = pat.break_of_structure(w)
    low, high = pat.structure_swings(w, swing_rows)
    df = df.select("*", up.alias("trend_bull"), down.alias("trend_bear"), low.alias("low20"), high.alias("high20"))
    return own_rows(df).select(
        "symbol", "ts", "trend_bull", "trend_bear", "low20", "high20", (F.col("seq") + 1).alias("rows")
    )


def with_bias(entry: DataFrame, bias: DataFrame, entry_tf: str, bias_tf: str, align: str = "close") -> DataFrame:
    """Bias state visible at each entry bar.

    ``close`` sees a bias bar only once both it and the entry bar are closed;
    ``open`` compares open times, as the published replay does.
    """
    if align not in ("close", "open"):
        raise ValueError("align must be close or open")
    plus = {"close": (tf_minutes(entry_tf), tf_minutes(bias_tf)), "open": (0, 0)}[align]
    left = entry.withColumn("_at", F.col("ts") + F.make_dt_interval(mins=F.lit(plus[0])))
    right = bias.withColumn("_at", F.col("ts") + F.make_dt_interval(mins=F.lit(plus[1]))).drop("ts")
    return asof_join(left, {"bias": right}, KEYS, left_ts="_at", right_ts="_at").drop("_at")


def setup_score() -> Column:
    either = lambda a, b: F.col(a) | F.col(b)
    zone = (F.col("trend_bull") & F.col("ob_long").isNotNull()) | (F.col("trend_bear") & F.col("ob_short").isNotNull())
    parts = {
        "trend": either("trend_bull", "trend_bear"),
        "sweep": either("bull_sweep", "bear_sweep"),
        "fvg": either("bull_fvg", "bear_fvg"),
        "crt": either("bull_crt", "bear_crt"),
        "volume": F.col("volume_spike") == 1,
        "displacement": F.col("displacement") == 1,
        "order_block": zone,
    }
    total = F.lit(0)
    for name, cond in parts.items():
        total = total + F.when(cond, POINTS[name]).otherwise(0)
    return total


def rr_tier(g: Geometry, ai: bool) -> Column:
    if ai:
        mean = F.coalesce(F.col("atr_avg"), F.col("atr"))
        return (
            F.when(F.col("atr") > mean * TIER_ATR[0], g.rr_high)
            .when(F.col("atr") < mean * TIER_ATR[1], g.rr_low)
            .otherwise(g.rr_mid)
        )
    score = F.col("setup_score")
    return F.when(score >= TIER_SCORES[0], g.rr_high).when(score >= TIER_SCORES[1], g.rr_mid).otherwise(g.rr_low)


def candidates(entry: DataFrame, gates: Gates = Gates(), g: Geometry = Geometry()) -> DataFrame:
    """Rows with a trend, enough history and a minimal score, with geometry."""
    bias = F.col("bias")
    df = entry.where(
        (F.col("seq") >= max(gates.warmup, gates.min_bars - 1))
        & (F.col("atr") > 0)
        & (bias["rows"] >= gates.min_bias_bars)
        & (bias["trend_bull"] | bias["trend_bear"])
    )
    df = df.select("*", bias["trend_bull"].alias("trend_bull"), bias["trend_bear"].alias("trend_bear"))
    df = df.select("*", setup_score().alias("setup_score"))
    if gates.entry_mode == "limit":
        df = df.where(F.col("setup_score") >= gates.min_setup_score)
    df = df.select(
        "*",
        F.when(F.col("trend_bull"), pat.LONG).otherwise(pat.SHORT).alias("direction"),
        F.col("close").alias("entry"),
        rr_tier(g, gates.ai).alias("rr_multiplier"),
    )
    return with_geometry(df, gates.entry_mode, g)


def with_geometry(df: DataFrame, mode: str, g: Geometry) -> DataFrame:
    long = F.col("direction") == pat.LONG
    entry, atr = F.col("entry"), F.col("atr")
    swings = (F.col("stop_low"), F.col("stop_high"))
    bias = (F.col("bias.low20"), F.col("bias.high20"))

    def stop_at(price):
        if g.stop_style == "zone":
            stop = zone_stop("direction", price, atr, g)
            return stop, stop
        return structure_stop_wide("direction", price, atr, swings, bias, F.col("bias.rows"), g)

    stop, swing = stop_at(entry)
    gap = F.when(long & F.col("bull_fvg"), F.col("gap_long")).when(~long & F.col("bear_fvg"), F.col("gap_short"))
    block = F.when(long, F.col("ob_long")).otherwise(F.col("ob_short"))
    df = df.select("*", stop.alias("_sl"), swing.alias("_swing"))
    df = df.select("*", limit_zone("direction", entry, F.col("_sl"), atr, gap, block, g).alias("_zone"))
    df = df.select("*", F.col("_zone.price").alias("limit_price"), F.col("_zone.zone").alias("zone_type"))
    if mode == "limit":
        price = F.col("limit_price")
        stop, swing = stop_at(price)
        if g.stop_style != "zone":
            gap_floor = atr * g.min_stop_atr * g.reanchor_floor
            stop = F.when(long, F.least(stop, price - gap_floor)).otherwise(F.greatest(stop, price + gap_floor))
    else:
        price, stop, swing = entry, F.col("_sl"), F.col("_swing")
    df = df.select("*", price.alias("trade_entry"), stop.alias("sl"), swing.alias("structure_swing"))
    df = df.select("*", target("direction", F.col("trade_entry"), F.col("sl"), F.col("rr_multiplier")).alias("tp"))
    return df.select("*", *risk_columns()).drop("_sl", "_swing", "_zone")


def risk_columns() -> list[Column]:
    tiny = F.lit(0.0001)
    at, risk = F.col("trade_entry"), F.abs(F.col("trade_entry") - F.col("sl"))
    reward = F.abs(F.col("tp") - F.col("trade_entry"))
    risk_pct, reward_pct = risk / F.greatest(at, tiny), reward / F.greatest(at, tiny)
    return [
        risk_pct.alias("risk_pct"),
        reward_pct.alias("reward_pct"),
        (risk_pct / F.greatest(reward_pct, tiny)).alias("adversity_ratio"),
        (reward / F.greatest(risk, tiny)).alias("risk_reward"),
        F.col("structure_swing").alias("invalidation_price"),
    ]


def relative(a: Column, b: Column, fallback: Column) -> Column:
    """(a - b) / b, measured from the fallback when b is unknown, 0 when b is 0."""
    base = F.coalesce(b, fallback)
    return F.coalesce((a - base) / F.nullif(base, F.lit(0.0)), F.lit(0.0))


def confidence(gates: Gates) -> Column:
    score = F.col("setup_score")
    if gates.ai:
        weight = model_weight(F.coalesce(F.col("n_real_closed"), F.lit(0)), gates)
        prob = F.coalesce(F.col("ai_prob"), F.lit(50.0))
        base = F.floor(score * (1 - weight) + prob * weight).cast("int")
    else:
        base = score
    sweep_fvg = (F.col("bull_sweep") & F.col("bull_fvg")) | (F.col("bear_sweep") & F.col("bear_fvg"))
    crt_sweep = (F.col("bull_crt") & F.col("bull_sweep")) | (F.col("bear_crt") & F.col("bear_sweep"))
    extras = [
        (sweep_fvg, "sweep_fvg"),
        ((F.col("volume_spike") == 1) & (F.col("displacement") == 1), "volume_displacement"),
        (crt_sweep, "crt_sweep"),
        (F.col("zone_type").isin("order_block", "fvg"), "zone"),
    ]
    for cond, name in extras:
        base = base + F.when(cond, BONUS[name]).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base))


def required_confidence(gates: Gates) -> Column:
    if gates.ai:
        rate = F.coalesce(F.col("recent_win_rate"), F.lit(0.5))
        bar = confidence_bar("market_regime", "atr_percentile", rate, gates.entry_mode)
    else:
        bar = F.lit(gates.required_limit if gates.entry_mode == "limit" else gates.required_market)
    return F.greatest(bar.cast("double"), F.lit(gates.min_confidence))


def finish(df: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Confidence, gates and the canonical signal record."""
    df = df.select("*", confidence(gates).alias("confidence")).where(F.col("confidence") >= required_confidence(gates))
    if gates.ai:
        vetoed = (
            F.col("expected_r").isNotNull()
            & (F.coalesce(F.col("n_real_closed"), F.lit(0)) >= gates.veto_min_real)
            & (F.col("expected_r") < gates.min_expected_r)
        )
        df = df.where(~vetoed)
    long = F.col("direction") == pat.LONG
    pick = lambda a, b: F.when(long, F.col(a)).otherwise(F.col(b)).cast("int")
    mark = lambda cond, ch: F.when(cond, ch).otherwise("-")
    entry = F.col("entry")
    extras = [c for c in ("funding_rate", "oi_change_pct", "btc_trend", "spread_pct", "fng", "symbol_win_rate",
                          "recent_win_rate", "streak_count", "ai_prob", "expected_r") if c in df.columns]
    return df.select(
        "symbol", "ts", "seq", "direction", "entry",
        F.col("entry").alias("signal_close"),
        "trade_entry", "sl", "tp", "structure_swing", "invalidation_price", "zone_type", "setup_score",
        "volume_spike", "displacement",
        pick("bull_sweep", "bear_sweep").alias("sweep"),
        pick("bull_fvg", "bear_fvg").alias("fvg"),
        pick("bull_crt", "bear_crt").alias("crt"),
        "atr", "body", "volume",
        F.coalesce(F.col("volume_ma"), F.lit(0.0)).alias("volume_ma"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("day_of_week"),
        "market_regime", "atr_percentile",
        relative(entry, F.col("ema20"), entry).alias("distance_to_ema20"),
        relative(entry, F.col("ema50"), entry).alias("distance_to_ema50"),
        relative(entry, F.col("vwap"), entry).alias("distance_to_vwap"),
        relative(F.col("swing_high"), entry, entry).alias("distance_to_prev_high"),
        relative(F.col("swing_low"), entry, entry).alias("distance_to_prev_low"),
        "risk_pct", "reward_pct", "adversity_ratio", "risk_reward", "rr_multiplier", "limit_price", "confidence",
        F.concat(
            mark(F.col("volume_spike") == 1, "V"),
            mark(F.col("displacement") == 1, "D"),
            mark(F.col("bull_sweep") | F.col("bear_sweep"), "S"),
            mark(F.col("bull_fvg") | F.col("bear_fvg"), "F"),
            mark(F.col("bull_crt") | F.col("bear_crt"), "C"),
        ).alias("confluences"),
        F.concat_ws("_", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ssxxx"), "direction").alias("signal_hash"),
        *extras,
    )


def signals(
    entry_bars: DataFrame,
    bias_bars: DataFrame,
    entry_tf: str,
    bias_tf: str,
    gates: Gates = Gates(),
    g: Geometry = Geometry(),
    *,
    align: str = "close",
    enrich=None,
) -> DataFrame:
    """All signals of all symbols.

    The bias lookup runs on the narrow bars, before features widen them.
    ``enrich`` takes and returns the candidate rows; it is where context, ledger
    form and model scores are attached, after the cheap gates have run.
    """
    bias = bias_features(bias_bars, bias_tf, swing_rows=g.swing_lookback)
    seen = with_bias(entry_bars, bias, entry_tf, bias_tf, align)
    found = candidates(entry_features(seen, entry_tf, ai=gates.ai, swing_rows=g.swing_lookback), gates, g)
    if enrich is not None:
        found = gated_context(enrich(stage(found, "candidates")))
    return finish(found, gates)


def gated_context(rows: DataFrame) -> DataFrame:
    """Market context is looked up only for rows with a score worth it; below, it is unknown."""
    known = F.col("setup_score") >= CONTEXT_MIN_SCORE
    return rows.withColumns({c: F.when(known, F.col(c)) for c in CONTEXT_COLUMNS if c in rows.columns})
