"""Shared SQL text of the checks: bars, indicators, patterns and signals."""

from __future__ import annotations

from tidemark.catalog.data import DAILY_SQL, WALK_SQL, bars_sql


def rd(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({expr}) * {scale} + 0.5) / {scale}"


WALK_1H = f"{WALK_SQL},{bars_sql('bars', 3600)}"
WALK_PAIR = f"{WALK_1H},{bars_sql('bias', 14400)}"
SWING_PAIR = f"{WALK_SQL},{bars_sql('bars', 1800)},{bars_sql('bias', 14400)}"


def indicators_sql(bars: str = "bars", out: str = "ind", ai: bool = False, vwap_rows: int = 251) -> str:
    hi, lo, young = (1.35, 1.50, 1.50) if ai else (1.15, 1.30, 1.25)
    disp = 0.70 if ai else 0.50
    w = "PARTITION BY symbol ORDER BY seq"
    return f"""
{out}_tr AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM {bars} WINDOW w AS ({w})),
{out}_rec AS (
  SELECT symbol, seq, tr AS y, close AS e20, close AS e50 FROM {out}_tr WHERE seq = 0
  UNION ALL
  SELECT b.symbol, b.seq, r.y * (13.0::DOUBLE / 14) + b.tr / 14, r.e20 * (19.0::DOUBLE / 21) + b.close * (2.0::DOUBLE / 21),
         r.e50 * (49.0::DOUBLE / 51) + b.close * (2.0::DOUBLE / 51)
  FROM {out}_rec r JOIN {out}_tr b ON b.symbol = r.symbol AND b.seq = r.seq + 1),
{out}_a AS (
  SELECT b.*, CASE WHEN b.seq >= 13 THEN r.y END AS atr, r.e20 AS ema20, r.e50 AS ema50, abs(close - open) AS body,
         CASE WHEN b.seq >= 19 THEN avg(volume) OVER (PARTITION BY b.symbol ORDER BY b.seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS volume_ma,
         sum((high + low + close) / 3 * volume) OVER v / nullif(sum(volume) OVER v, 0) AS vwap
  FROM {out}_tr b JOIN {out}_rec r USING (symbol, seq)
  WINDOW v AS (PARTITION BY b.symbol ORDER BY b.seq ROWS BETWEEN {vwap_rows - 1} PRECEDING AND CURRENT ROW)),
{out}_b AS (
  SELECT *, avg(atr) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS atr_avg,
         list(atr) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS atrs,
         lag(close, 29) OVER (PARTITION BY symbol ORDER BY seq) AS c29
  FROM {out}_a),
{out} AS (
  SELECT *,
    CASE WHEN volume > volume_ma * (CASE WHEN seq >= 17 AND atr_avg > 0 THEN CASE WHEN atr > atr_avg * 1.3 THEN {hi} ELSE {lo} END ELSE {young} END)
         THEN 1 ELSE 0 END AS volume_spike,
    CASE WHEN body > atr * {disp} THEN 1 ELSE 0 END AS displacement,
    CASE WHEN seq >= 62 THEN len(list_filter(atrs, lambda a: a < atr)) * 2.0::DOUBLE ELSE 50.0::DOUBLE END AS atr_percentile,
    CASE WHEN seq < 29 THEN 'ranging' WHEN atr > atr_avg * 1.4 THEN 'volatile'
         WHEN abs(close - c29) / nullif(c29, 0) > 0.04 THEN 'trending' ELSE 'ranging' END AS market_regime
  FROM {out}_b)"""


def patterns_sql(src: str = "ind", out: str = "pat", ai: bool = False) -> str:
    w = "PARTITION BY symbol ORDER BY seq"

    def lag(col, n):
        return f"lag({col}, {n}) OVER w"

    bull_gap = " OR ".join(
        [f"low > {lag('high', 2)}"]
        + [f"(seq >= 4 AND {lag('low', j)} > {lag('high', j + 2)} AND close > {lag('high', j + 2)})" for j in (1, 2, 3)]
    )
    bear_gap = " OR ".join(
        [f"high < {lag('low', 2)}"]
        + [f"(seq >= 4 AND {lag('high', j)} < {lag('low', j + 2)} AND close < {lag('low', j + 2)})" for j in (1, 2, 3)]
    )
    return f"""
{out}_hours AS (
  SELECT symbol, CAST(floor(t / 3600) AS BIGINT) AS h, min(low) AS hl, max(high) AS hh FROM {src} GROUP BY 1, 2),
{out}_prev AS (
  SELECT *, lag(hl) OVER (PARTITION BY symbol ORDER BY h) AS prev_low, lag(hh) OVER (PARTITION BY symbol ORDER BY h) AS prev_high
  FROM {out}_hours),
{out}_a AS (
  SELECT b.*,
    min(low) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS swing_low,
    max(high) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS swing_high,
    min(low) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS low12,
    max(high) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS high12,
    min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS stop_low,
    max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS stop_high,
    coalesce({bull_gap}, false) AS bull_fvg,
    coalesce({bear_gap}, false) AS bear_fvg,
    ({lag('high', 2)} + low) / 2.0 AS gap_long,
    ({lag('low', 2)} + high) / 2.0 AS gap_short,
    CASE WHEN close > open AND body > coalesce(atr, body) * 0.55 AND {lag('close', 1)} < {lag('open', 1)}
         THEN ({lag('open', 1)} + {lag('low', 1)}) / 2.0 END AS mark_long,
    CASE WHEN close < open AND body > coalesce(atr, body) * 0.55 AND {lag('close', 1)} > {lag('open', 1)}
         THEN ({lag('open', 1)} + {lag('high', 1)}) / 2.0 END AS mark_short,
    min(low) OVER (PARTITION BY b.symbol, CAST(floor(t / 3600) AS BIGINT) ORDER BY seq) AS hour_low,
    max(high) OVER (PARTITION BY b.symbol, CAST(floor(t / 3600) AS BIGINT) ORDER BY seq) AS hour_high,
    p.prev_low, p.prev_high
  FROM {src} b JOIN {out}_prev p ON p.symbol = b.symbol AND p.h = CAST(floor(b.t / 3600) AS BIGINT)
  WINDOW w AS (PARTITION BY b.symbol ORDER BY seq)),
{out} AS (
  SELECT *,
    coalesce({'low < swing_low' if ai else 'low <= swing_low * 1.0002'} AND close > open, false) AS now_bull,
    coalesce({'high > swing_high' if ai else 'high >= swing_high * 0.9998'} AND close < open, false) AS now_bear,
    coalesce(seq >= 21 AND max(CASE WHEN low < low12 AND close > open THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1, false) AS recent_bull,
    coalesce(seq >= 21 AND max(CASE WHEN high > high12 AND close < open THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1, false) AS recent_bear,
    CASE WHEN seq >= 17 THEN last_value(mark_long IGNORE NULLS) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS ob_long,
    CASE WHEN seq >= 17 THEN last_value(mark_short IGNORE NULLS) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS ob_short,
    coalesce(seq >= 14 AND hour_low < prev_low AND close > prev_low, false) AS bull_crt,
    coalesce(seq >= 14 AND hour_high > prev_high AND close < prev_high, false) AS bear_crt
  FROM {out}_a WINDOW w AS ({w}))"""


def bos_sql(src: str, out: str, lookback: int = 10, confirm: int = 2, need: int | None = None) -> str:
    need = lookback + confirm + 2 if need is None else need
    closes = ["close"] + [f"lag(close, {i}) OVER w" for i in range(1, confirm)]
    frame = f"(w ROWS BETWEEN {lookback + confirm - 1} PRECEDING AND {confirm} PRECEDING)"
    swing = "(w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    up = " AND ".join(f"{c} > max(high) OVER {frame}" for c in closes)
    down = " AND ".join(f"{c} < min(low) OVER {frame}" for c in closes)
    return f"""
{out} AS (
  SELECT *, coalesce(seq >= {need - 1} AND {up}, false) AS trend_bull, coalesce(seq >= {need - 1} AND {down}, false) AS trend_bear,
         coalesce(CASE WHEN seq BETWEEN 6 AND 20 THEN min(CASE WHEN seq > 0 THEN low END) OVER {swing} ELSE min(low) OVER {swing} END, low) AS low20,
         coalesce(CASE WHEN seq BETWEEN 6 AND 20 THEN max(CASE WHEN seq > 0 THEN high END) OVER {swing} ELSE max(high) OVER {swing} END, high) AS high20
  FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""


# A stand-in model: probability and expected R from the bar's place, trades from the ledger.
MODEL_SQL = """, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 <> 0) AS n_real,
    CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 <> 0) <= 30 THEN 0 ELSE floor(0.4::DOUBLE * least(1.0::DOUBLE,
      ((SELECT count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 <> 0) - 30) / 120.0::DOUBLE) * 1e4 + 0.5) / 1e4 END AS weight,
    (seq * 7 % 91 + 5)::DOUBLE AS prob, (seq % 7 - 2) * 0.1::DOUBLE AS exp_r"""


def signals_sql(min_confidence: float = 0, src: str = "pat", out: str = "sig", mode: str = "limit", swing: bool = False, ai: bool = False) -> str:
    """Score-only confidence; structure stops on 1h bars, or zone stops on 30m bars."""
    width = 1800 if swing else 3600
    tiers = (4.0, 3.5, 3.0) if swing else (2.0, 1.75, 1.5)
    side = "CASE WHEN trend_bull THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"

    rr = f"CASE WHEN setup_score >= 70 THEN {tiers[0]}::DOUBLE WHEN setup_score >= 45 THEN {tiers[1]}::DOUBLE ELSE {tiers[2]}::DOUBLE END"
    base, required = "setup_score", "28" if mode == "limit" else "40"
    if ai:
        rr = "CASE WHEN atr > atr_avg * 1.3 THEN 2.0::DOUBLE WHEN atr < atr_avg * 0.7 THEN 1.5::DOUBLE ELSE 1.75::DOUBLE END"
        base = "CAST(floor(setup_score * (1 - weight) + prob * weight) AS INT)"
        required = (
            "greatest(22, least(75, 32 + CASE market_regime WHEN 'trending' THEN -5 WHEN 'volatile' THEN 8 ELSE 4 END - 5"
            " + CASE WHEN atr_percentile > 80 THEN 5 WHEN atr_percentile < 20 THEN -3 ELSE 0 END))"
        )

    def stop(price: str) -> str:
        if swing:
            return f"{price} - {side} * (atr * (0.6::DOUBLE + 0.25::DOUBLE))"
        return (
            f"CASE WHEN trend_bull THEN least(least(stop_low, low20) - atr * 0.25, {price} - atr * 1.15, {price} - atr * 0.1)"
            f" ELSE greatest(greatest(stop_high, high20) + atr * 0.25, {price} + atr * 1.15, {price} + atr * 0.1) END"
        )

    return f"""
{out}_j AS (
  SELECT e.*, b.trend_bull, b.trend_bear, b.low20, b.high20, b.seq + 1 AS bias_rows
  FROM {src} e ASOF LEFT JOIN biasx b ON b.symbol = e.symbol AND e.t + {width} >= b.t + 14400),
{out}_s AS (
  SELECT *, (now_bull OR recent_bull) AS bull_sweep, (now_bear OR recent_bear) AS bear_sweep, close AS entry,
    20 + CASE WHEN now_bull OR recent_bull OR now_bear OR recent_bear THEN 20 ELSE 0 END
    + CASE WHEN bull_fvg OR bear_fvg THEN 15 ELSE 0 END + CASE WHEN bull_crt OR bear_crt THEN 15 ELSE 0 END
    + volume_spike * 15 + displacement * 15
    + CASE WHEN (trend_bull AND ob_long IS NOT NULL) OR (trend_bear AND ob_short IS NOT NULL) THEN 10 ELSE 0 END AS setup_score
  FROM {out}_j WHERE seq >= 60 AND atr > 0 AND bias_rows >= 30 AND (trend_bull OR trend_bear)),
{out}_r AS (
  SELECT *, {rr} AS rr,
    {stop('entry')} AS sl0, {side} AS side{MODEL_SQL if ai else ''} FROM {out}_s WHERE {'setup_score >= 20' if mode == 'limit' else 'true'}),
{out}_z AS (
  SELECT *, sl0 + 0.3 * (entry - sl0) AS room, entry - side * atr * 0.45 AS pull,
    CASE WHEN trend_bull AND bull_fvg THEN gap_long WHEN trend_bear AND bear_fvg THEN gap_short END AS gap,
    CASE WHEN trend_bull THEN ob_long ELSE ob_short END AS ob FROM {out}_r),
{out}_c AS (
  SELECT *, list_min(list_filter([
      {{'d': side * gap, 'k': 0, 'z': 'fvg', 'p': gap}}, {{'d': side * ob, 'k': 1, 'z': 'order_block', 'p': ob}},
      {{'d': side * pull, 'k': 2, 'z': 'atr_pullback', 'p': pull}}], lambda c: c.d >= side * room AND c.d <= side * entry)) AS best
  FROM {out}_z),
{out}_l AS (
  SELECT *, coalesce(best.p, CASE WHEN trend_bull THEN greatest(room, least(entry, entry - atr * 0.25))
                               ELSE least(room, greatest(entry, entry + atr * 0.25)) END) AS limit_price,
    coalesce(best.z, 'atr_pullback') AS zone_type FROM {out}_c),
{out}_t AS (
  SELECT *, {'limit_price' if mode == 'limit' else 'entry'} AS trade_entry,
    {stop('limit_price') if swing else f'''CASE WHEN trend_bull THEN least({stop('limit_price')}, limit_price - atr * 1.15 * 0.85)
         ELSE greatest({stop('limit_price')}, limit_price + atr * 1.15 * 0.85) END''' if mode == 'limit' else 'sl0'} AS sl,
    {stop('limit_price') if swing else 'CASE WHEN trend_bull THEN least(stop_low, low20) ELSE greatest(stop_high, high20) END'} AS structure_swing
  FROM {out}_l),
{out}_f AS (
  SELECT *, CASE WHEN trend_bull THEN 'LONG' ELSE 'SHORT' END AS direction,
    CASE WHEN trend_bull THEN trade_entry + (trade_entry - sl) * rr ELSE trade_entry - (sl - trade_entry) * rr END AS tp,
    least(100, {base} + CASE WHEN (bull_sweep AND bull_fvg) OR (bear_sweep AND bear_fvg) THEN 5 ELSE 0 END
      + CASE WHEN volume_spike = 1 AND displacement = 1 THEN 5 ELSE 0 END
      + CASE WHEN (bull_crt AND bull_sweep) OR (bear_crt AND bear_sweep) THEN 4 ELSE 0 END
      + CASE WHEN zone_type IN ('order_block', 'fvg') THEN 3 ELSE 0 END) AS confidence
  FROM {out}_t),
{out} AS (SELECT * FROM {out}_f WHERE confidence >= greatest({required}, {min_confidence}){' AND NOT (n_real >= 60 AND exp_r < 0)' if ai else ''})"""


def full_signals(min_confidence: float = 0, mode: str = "limit", swing: bool = False, ai: bool = False) -> str:
    return (
        f"WITH RECURSIVE {SWING_PAIR if swing else WALK_PAIR},{indicators_sql(ai=ai)},{patterns_sql(ai=ai)},{bos_sql('bias', 'biasx')},"
        f"{signals_sql(min_confidence, mode=mode, swing=swing, ai=ai)}"
    )


DAILY = DAILY_SQL
