"""Queries over bars: scans, indicators, patterns, context, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import data
from tidemark.catalog.base import flag, query, rd, t
from tidemark.catalog.sqltext import (
    DAILY, WALK_1H, WALK_PAIR, bos_sql, full_signals, indicators_sql, patterns_sql,
)
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.functions import symbols as sym
from tidemark.functions import times
from tidemark.operators import indicators as ind
from tidemark.operators import patterns as pat
from tidemark.operators.asof import asof_join, multi_context
from tidemark.operators.context import open_interest_changes, spread_ok, spread_pct
from tidemark.operators.bars import closed_bars, merge_pages, numbered, resample, rising, to_bars
from tidemark.operators.blocks import block_window, halo_blocks, own_rows
from tidemark.operators.geometry import limit_zone, structure_stop, structure_stop_wide, zone_stop
from tidemark.params import Gates, Geometry
from tidemark.plans import signals as sig
from tidemark.plans.structure import equal_levels, internal_structure
from tidemark.session import stage

KEYS = ["symbol"]

# ---------------------------------------------------------------- scans

RAW_5M = data.bars_sql("bars", 300, "(SELECT event_type AS symbol, ts, event_id AS id, value AS price FROM events)")


@query("bars_ohlcv", f"WITH {RAW_5M} SELECT symbol, t, open, high, low, close, volume FROM bars")
def bars_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    return to_bars(data.raw_ticks(spark, sf), "5m").select("symbol", t(), "open", "high", "low", "close", "volume")


@query(
    "bars_resample",
    f"""WITH {RAW_5M} SELECT symbol, CAST(floor(t / 3600) AS BIGINT) * 3600 AS t, min_by(open, t) AS open, max(high) AS high,
    min(low) AS low, max_by(close, t) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""",
)
def bars_resample(spark, sf):
    fine = to_bars(data.raw_ticks(spark, sf), "5m")
    return resample(fine, "1h").select("symbol", t(), "open", "high", "low", "close", "volume")


@query(
    "bars_closed_valid",
    f"""WITH {data.bars_sql("bars", 3600, "(SELECT event_type AS symbol, ts, event_id AS id, value AS price FROM events)")},
    ok AS (SELECT * FROM bars WHERE t + 3600 <= 1705276800 AND volume > 0 AND close > 0)
    SELECT symbol, t, close, volume FROM ok WHERE symbol IN (SELECT symbol FROM ok GROUP BY 1 HAVING count(*) >= 0.8 * 280)""",
)
def bars_closed_valid(spark, sf):
    bars = to_bars(data.raw_ticks(spark, sf), "1h")
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return closed_bars(bars, "1h", as_of, expected=280).select("symbol", t(), "close", "volume")


@query(
    "page_merge",
    """WITH p AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_id, value FROM events)
    SELECT user_id, h, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM p GROUP BY 1, 2""",
)
def page_merge(spark, sf):
    rows = data.raw_ticks(spark, sf).select(
        "user_id", F.floor(F.unix_seconds("ts") / 3600).alias("h"), "id", "price"
    )
    first = merge_pages(rows, ["user_id", "h"], arrival="id", keep="first")
    last = merge_pages(rows, ["user_id", "h"], arrival="id", keep="last")
    return first.select("user_id", "h", F.col("price").alias("first_value")).join(
        last.select("user_id", "h", F.col("price").alias("last_value")), ["user_id", "h"]
    )


# ---------------------------------------------------------------- names and clocks

BASES = "'BTC','ETH','SOL','XRP','USDC','DAI','CL','XAU','CLV','XAI','DOGE','LINK','SPX','FDUSD','AVAX','1000PEPE','NG'"
FORMS = "'USDT','USDC','/USDT:USDT','/USDC','FDUSD','-USDT'"
PAIR_SQL = f"""pairs AS (SELECT p_partkey, (list_value({BASES}))[p_partkey % 17 + 1] || (list_value({FORMS}))[(p_partkey // 17) % 6 + 1]
  AS symbol, p_retailprice, p_size FROM part)"""


def pair_names(spark, sf) -> DataFrame:
    """A market per part: a base and a quote form picked by its key."""
    k = F.col("p_partkey")
    base = F.expr(f"element_at(array({BASES}), cast(p_partkey % 17 + 1 as int))")
    form = F.expr(f"element_at(array({FORMS}), cast((p_partkey div 17) % 6 + 1 as int))")
    return data.table(spark, sf, "part").select(k, F.concat(base, form).alias("symbol"), "p_retailprice", "p_size")


@query(
    "symbol_filters",
    f"""WITH {PAIR_SQL}, n AS (SELECT *, replace(replace(replace(upper(symbol), '/', ''), ':', ''), '-', '') AS flat,
      replace(replace(split_part(upper(symbol), ':', 1), '/', ''), '-', '') AS plain,
      replace(replace(replace(replace(symbol, 'USDT', ''), 'BUSD', ''), 'USDC', ''), 'FDUSD', '') AS mbase FROM pairs),
    m AS (SELECT *, CASE WHEN contains(symbol, '/') THEN split_part(upper(symbol), '/', 1)
      ELSE regexp_replace(split_part(upper(symbol), ':', 1), '(USDT|USDC|USD|FDUSD|BUSD)$', '') END AS base FROM n)
    SELECT p_partkey, symbol, plain AS exchange_symbol, base,
      CASE WHEN regexp_full_match(flat, '(USDC|USDT|FDUSD|USDE|TUSD|BUSD|DAI|PYUSD|GUSD|USDM)(USDC|USDT|FDUSD|USDE|TUSD|BUSD|DAI|PYUSD|GUSD|USDM)') THEN 1 ELSE 0 END AS stable,
      CASE WHEN regexp_full_match(plain, '(CL|NG|XAU|XAG|WTI|BRENT|SPX|NDX|DJI|GLD)(USDT|USDC|BUSD|FDUSD)') THEN 1 ELSE 0 END AS commodity,
      CASE WHEN regexp_matches(mbase, 'BABY|SAFE|MOON|LUNC|INU|COIN|TOKEN|1000|ELON|DOGE|SHIB|PEPE|FLOKI|X|V2|OLD|CUMROCKET|PUSSY|CUMMIES|RIBBIT') THEN 1 ELSE 0 END AS meme,
      CASE WHEN base IN ('BTC','ETH','BNB','SOL') THEN 1 ELSE 0 END AS major FROM m""".replace(
        "regexp_replace(split_part(upper(symbol), ':', 1), '(USDT|USDC|USD|FDUSD|BUSD)$', '')",
        "CASE WHEN plain0 LIKE '%USDT' OR plain0 LIKE '%USDC' THEN plain0[:-5] WHEN plain0 LIKE '%USD' THEN plain0[:-4] ELSE plain0 END",
    ).replace("AS mbase FROM pairs", "AS mbase, split_part(upper(symbol), ':', 1) AS plain0 FROM pairs"),
)
def symbol_filters(spark, sf):
    s = F.col("symbol")
    return pair_names(spark, sf).select(
        "p_partkey", "symbol", sym.exchange_symbol(s).alias("exchange_symbol"), sym.base_asset(s).alias("base"),
        flag(sym.is_stable_pair(s)).alias("stable"), flag(sym.is_commodity_pair(s)).alias("commodity"),
        flag(sym.is_meme(s)).alias("meme"), flag(sym.is_major(s)).alias("major"),
    )


@query(
    "universe_top",
    f"""WITH names AS (SELECT (list_value('BTC','ETH','SOL','XRP','ADA','LINK','AVAX','NEAR','ATOM','ALGO','FIL','CL','USDC'))[c_custkey % 13 + 1] AS base,
        c_acctbal, c_nationkey FROM customer),
      tickers AS (SELECT base || 'USDT' AS symbol, sum(greatest(c_acctbal, 0)) * CASE WHEN base = 'BTC' THEN 1 ELSE 1000 END AS volume FROM names GROUP BY base),
      pool AS (SELECT * FROM tickers WHERE volume >= 500000 AND base_ok(symbol)),
      top AS (SELECT *, 0 AS forced FROM pool ORDER BY volume DESC, symbol LIMIT 6),
      forced AS (SELECT *, 1 AS forced FROM pool WHERE symbol IN ('BTCUSDT','ETHUSDT','BNBUSDT','XRPUSDT','ADAUSDT','SOLUSDT','DOTUSDT','LINKUSDT')
        AND symbol NOT IN (SELECT symbol FROM top))
    SELECT symbol, {sql_rd('volume', 2)} AS volume FROM (SELECT * FROM top UNION ALL SELECT * FROM forced) ORDER BY forced DESC, volume DESC, symbol LIMIT 6""".replace(
        "base_ok(symbol)", "symbol NOT IN ('CLUSDT', 'USDCUSDT') AND NOT contains(replace(symbol, 'USDT', ''), 'X')"
    ),
)
def universe_top(spark, sf):
    base = F.expr(
        "element_at(array('BTC','ETH','SOL','XRP','ADA','LINK','AVAX','NEAR','ATOM','ALGO','FIL','CL','USDC'), cast(c_custkey % 13 + 1 as int))"
    )
    tickers = (
        data.table(spark, sf, "customer").withColumn("base", base).groupBy("base")
        .agg(F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("v"))
        .select(F.concat("base", F.lit("USDT")).alias("symbol"), (F.col("v") * F.when(F.col("base") == "BTC", 1).otherwise(1000)).alias("volume"))
    )
    return sym.universe(tickers, 6).select("symbol", rd("volume", 2).alias("volume"))


SPREAD_SQL = "p_retailprice AS bid, p_retailprice * (1 + (p_size - 3) * 0.0001::DOUBLE) AS ask"


@query(
    "ticker_spread",
    f"""WITH {PAIR_SQL}, k AS (SELECT p_partkey, symbol, {SPREAD_SQL}, p_retailprice * 600 AS volume FROM pairs),
    s AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN (ask - bid) / ((bid + ask) / 2) * 100 END AS spread_pct FROM k)
    SELECT p_partkey, symbol, {sql_rd('spread_pct')} AS spread_pct,
      CASE WHEN spread_pct IS NULL OR spread_pct / 100 * ask <= 0.15::DOUBLE * abs(ask - ask * 0.99::DOUBLE) THEN 1 ELSE 0 END AS passes FROM s WHERE volume >= 500000""",
)
def ticker_spread(spark, sf):
    k = pair_names(spark, sf).select(
        "p_partkey", "symbol", F.col("p_retailprice").alias("bid"),
        (F.col("p_retailprice") * (1 + (F.col("p_size") - 3) * 0.0001)).alias("ask"),
        (F.col("p_retailprice") * 600).alias("volume"),
    ).where(F.col("volume") >= sym.MIN_QUOTE_VOLUME)
    k = k.select("*", spread_pct("bid", "ask").alias("spread_pct"))
    ok = spread_ok("spread_pct", "ask", F.col("ask") * 0.99)
    return k.select("p_partkey", "symbol", rd("spread_pct").alias("spread_pct"), flag(ok).alias("passes"))


@query(
    "session_buckets",
    """SELECT event_type AS symbol, CASE WHEN h BETWEEN 7 AND 11 THEN 'london' WHEN h BETWEEN 12 AND 16 THEN 'ny'
      WHEN h BETWEEN 17 AND 21 THEN 'quiet' ELSE 'asian' END AS session, isodow(ts) - 1 AS weekday, count(*) AS n
    FROM (SELECT *, hour(ts) AS h FROM events) GROUP BY 1, 2, 3""".replace("isodow(ts) - 1", "CAST(isodow(ts) - 1 AS INT)"),
)
def session_buckets(spark, sf):
    ticks = data.raw_ticks(spark, sf)
    return ticks.groupBy(
        "symbol", times.session_of(F.hour("ts")).alias("session"), F.weekday("ts").alias("weekday")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_filter",
    """SELECT event_type AS symbol, count(*) AS n FROM events WHERE hour(ts) BETWEEN 7 AND 16 GROUP BY 1""",
)
def session_filter(spark, sf):
    kept = times.allowed_sessions(data.raw_ticks(spark, sf), "ts", ["asian", "quiet"])
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "candle_bucket",
    """SELECT event_id AS id, CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS b5, CAST(epoch(time_bucket(INTERVAL '30 minutes', ts)) AS BIGINT) AS b30,
      CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 30 WHEN 'error' THEN 240 ELSE 1440 END AS tf_min FROM events""",
)
def candle_bucket(spark, sf):
    ticks = data.raw_ticks(spark, sf)
    tf = F.when(F.col("symbol") == "click", "5m").when(F.col("symbol") == "view", " 30M").when(F.col("symbol") == "error", "4h").otherwise("1d")
    return ticks.select(
        "id", F.unix_seconds(times.bucket_start(F.col("ts"), 5)).alias("b5"),
        F.unix_seconds(times.bucket_start(F.col("ts"), 30)).alias("b30"), times.tf_minutes_col(tf).alias("tf_min"),
    )


@query(
    "news_window",
    """WITH cal(wd, hr) AS (VALUES (1, 13), (3, 12), (4, 12), (2, 14))
    SELECT event_id AS id, value FROM events e WHERE NOT EXISTS (SELECT 1 FROM cal WHERE isodow(e.ts) - 1 = wd
      AND e.ts BETWEEN date_trunc('day', e.ts) + to_hours(hr) - INTERVAL 30 MINUTE AND date_trunc('day', e.ts) + to_hours(hr) + INTERVAL 30 MINUTE)""",
)
def news_window(spark, sf):
    kept = times.outside_events(data.raw_ticks(spark, sf), "ts")
    return kept.select("id", F.col("price").alias("value"))


# ---------------------------------------------------------------- indicators on daily bars


def daily_blocks(spark, sf, **size) -> DataFrame:
    return halo_blocks(numbered(data.daily_bars(spark, sf), "1d"), KEYS, **size)


def daily_features(spark, sf, **kw) -> DataFrame:
    return sig.bar_features(data.daily_bars(spark, sf), "1d", **kw)


DAILY_IND = f"WITH RECURSIVE {DAILY},{indicators_sql()}"


@query("true_range", f"{DAILY_IND} SELECT symbol, t, {sql_rd('tr')} AS tr FROM ind_tr")
def true_range(spark, sf):
    w = block_window(KEYS)
    df = daily_blocks(spark, sf).select("*", ind.true_range(w).alias("tr"))
    return own_rows(df).select("symbol", t(), rd("tr").alias("tr"))


@query("volume_ma", f"{DAILY_IND} SELECT symbol, t, {sql_rd('volume_ma', 4)} AS volume_ma FROM ind_a")
def volume_ma(spark, sf):
    w = block_window(KEYS)
    df = daily_blocks(spark, sf).select("*", ind.volume_mean(w).alias("volume_ma"))
    return own_rows(df).select("symbol", t(), rd("volume_ma", 4).alias("volume_ma"))


@query("vwap_roll", f"{DAILY_IND} SELECT symbol, t, {sql_rd('vwap', 4)} AS vwap FROM ind_a")
def vwap_roll(spark, sf):
    w = block_window(KEYS)
    df = daily_blocks(spark, sf).select("*", ind.vwap(w, 251).alias("vwap"))
    return own_rows(df).select("symbol", t(), rd("vwap", 4).alias("vwap"))


@query(
    "vwap_cum",
    f"""WITH {DAILY} SELECT symbol, t, {sql_rd("sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0)", 4)} AS vwap
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def vwap_cum(spark, sf):
    carry = {"pv": (ind.typical_value(), "sum"), "v": (F.col("volume"), "sum")}
    df = numbered(data.daily_bars(spark, sf), "1d", carry=carry)
    return df.select("symbol", t(), rd(F.col("pv") / F.nullif(F.col("v"), F.lit(0.0)), 4).alias("vwap"))


@query("ewm_atr", f"{DAILY_IND} SELECT symbol, t, {sql_rd('atr', 4)} AS atr FROM ind_a")
def ewm_atr(spark, sf):
    w = block_window(KEYS)
    df = daily_blocks(spark, sf).select("*", ind.true_range(w).alias("tr"))
    df = df.select("*", ind.wilder_atr(w).alias("atr"))
    return own_rows(df).select("symbol", t(), rd("atr", 4).alias("atr"))


@query("ewm_atr_blocks", f"{DAILY_IND} SELECT symbol, t, {sql_rd('atr', 4)} AS atr FROM ind_a")
def ewm_atr_blocks(spark, sf):
    """The same over blocks far shorter than a series."""
    size = {"block": 300, "halo": 512}
    df = daily_blocks(spark, sf, **size).select("*", ind.true_range(block_window(KEYS)).alias("tr"))
    df = df.select("*", ind.wilder_atr(block_window(KEYS), halo=size["halo"], rows=sum(size.values())).alias("atr"))
    return own_rows(df).select("symbol", t(), rd("atr", 4).alias("atr"))


EMA_SPANS = (2, 9, 200, 500)


@query(
    "ema_spans",
    f"WITH RECURSIVE {DAILY}, e AS (SELECT symbol, t, seq, close, {', '.join(f'close AS e{s}' for s in EMA_SPANS)} FROM bars WHERE seq = 0 UNION ALL "
    f"SELECT b.symbol, b.t, b.seq, b.close, {', '.join(f'e.e{s} * (1 - 2.0::DOUBLE / {s + 1}) + b.close * (2.0::DOUBLE / {s + 1})' for s in EMA_SPANS)} FROM e JOIN bars b ON b.symbol = e.symbol AND b.seq = e.seq + 1) "
    f"SELECT symbol, t, {', '.join(f'{sql_rd(f"e{s}", 4)} AS ema{s}' for s in EMA_SPANS)} FROM e",
)
def ema_spans(spark, sf):
    """Spans below and above those of the signal engine, over blocks of some hundred rows."""
    df = ind.with_emas(numbered(data.daily_bars(spark, sf), "1d"), KEYS, {f"ema{s}": s for s in EMA_SPANS}, block=700)
    return df.select("symbol", t(), *[rd(f"ema{s}", 4).alias(f"ema{s}") for s in EMA_SPANS])


@query(
    "vwap_wide",
    f"""WITH {DAILY} SELECT symbol, t, {sql_rd("sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0)", 4)} AS vwap
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)""",
)
def vwap_wide(spark, sf):
    df = daily_blocks(spark, sf, block=400, halo=2000).select("*", ind.vwap(block_window(KEYS), 2000, halo=2000).alias("vwap"))
    return own_rows(df).select("symbol", t(), rd("vwap", 4).alias("vwap"))


@query(
    "range_sma",
    f"""WITH {DAILY} SELECT symbol, t, CASE WHEN seq >= 13 THEN {sql_rd("avg(high - low) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)", 4)} END AS atr FROM bars""",
)
def range_sma(spark, sf):
    w = block_window(KEYS)
    df = daily_blocks(spark, sf).select("*", ind.range_sma(w).alias("atr"))
    return own_rows(df).select("symbol", t(), rd("atr", 4).alias("atr"))


@query("ema_pair", f"{DAILY_IND} SELECT symbol, t, {sql_rd('ema20', 4)} AS ema20, {sql_rd('ema50', 4)} AS ema50 FROM ind_a")
def ema_pair(spark, sf):
    w = block_window(KEYS)
    df = daily_blocks(spark, sf).select("*", ind.ema(w, 20).alias("ema20"), ind.ema(w, 50).alias("ema50"))
    return own_rows(df).select("symbol", t(), rd("ema20", 4).alias("ema20"), rd("ema50", 4).alias("ema50"))


for _ai in (False, True):

    @query(
        "volume_spike_displacement" + ("_ai" if _ai else ""),
        f"WITH RECURSIVE {DAILY},{indicators_sql(ai=_ai)} SELECT symbol, t, volume_spike, displacement, {sql_rd('body', 4)} AS body FROM ind",
    )
    def volume_spike_displacement(spark, sf, ai=_ai):
        df = daily_features(spark, sf, ai=ai)
        return df.select("symbol", t(), "volume_spike", "displacement", rd("body", 4).alias("body"))


@query("atr_percentile", f"{DAILY_IND} SELECT symbol, t, atr_percentile FROM ind")
def atr_percentile(spark, sf):
    return daily_features(spark, sf).select("symbol", t(), "atr_percentile")


@query("market_regime", f"WITH RECURSIVE {WALK_1H},{indicators_sql()} SELECT symbol, t, market_regime FROM ind")
def market_regime(spark, sf):
    return sig.bar_features(data.walk_bars(spark, sf, "1h"), "1h").select("symbol", t(), "market_regime")


# ---------------------------------------------------------------- patterns on hourly bars

PATTERNS = f"WITH RECURSIVE {WALK_1H},{indicators_sql()},{patterns_sql()}"


def hourly_features(spark, sf) -> DataFrame:
    return sig.entry_features(data.walk_bars(spark, sf, "1h"), "1h")


def hourly_blocks(spark, sf) -> DataFrame:
    return halo_blocks(numbered(data.walk_bars(spark, sf, "1h"), "1h"), KEYS, block=4096, halo=64)


@query(
    "bos_flags",
    f"WITH {WALK_1H},{bos_sql('bars', 'x')} SELECT symbol, t, trend_bull::INT AS bull, trend_bear::INT AS bear FROM x",
)
def bos_flags(spark, sf):
    w = block_window(KEYS)
    up, down = pat.break_of_structure(w)
    df = hourly_blocks(spark, sf).select("*", flag(up).alias("bull"), flag(down).alias("bear"))
    return own_rows(df).select("symbol", t(), "bull", "bear")


@query(
    "bos_series",
    f"""WITH {WALK_1H},{bos_sql('bars', 'x', need=12)}
    SELECT symbol, t, CASE WHEN trend_bear THEN -1 WHEN trend_bull THEN 1 ELSE 0 END AS trend FROM x""",
)
def bos_series(spark, sf):
    w = block_window(KEYS)
    df = hourly_blocks(spark, sf).select("*", pat.structure_trend(w).alias("trend"))
    return own_rows(df).select("symbol", t(), "trend")


@query(
    "liquidity_sweep",
    f"{PATTERNS} SELECT symbol, t, now_bull::INT AS bull, now_bear::INT AS bear, {sql_rd('swing_low')} AS swing_low, {sql_rd('swing_high')} AS swing_high FROM pat",
)
def liquidity_sweep(spark, sf):
    w = block_window(KEYS)
    df = hourly_blocks(spark, sf).select("*", pat.swing_low(w, 9).alias("swing_low"), pat.swing_high(w, 9).alias("swing_high"))
    bull, bear = pat.bar_sweep()
    return own_rows(df).select(
        "symbol", t(), flag(bull).alias("bull"), flag(bear).alias("bear"), rd("swing_low").alias("swing_low"),
        rd("swing_high").alias("swing_high"),
    )


@query("recent_sweep", f"{PATTERNS} SELECT symbol, t, recent_bull::INT AS bull, recent_bear::INT AS bear FROM pat")
def recent_sweep(spark, sf):
    w = block_window(KEYS)
    up, down = pat.sweep_marks(w)
    df = hourly_blocks(spark, sf).select("*", up.alias("_u"), down.alias("_d"))
    df = df.select("*", flag(pat.recent_sweep(w, "_u")).alias("bull"), flag(pat.recent_sweep(w, "_d")).alias("bear"))
    return own_rows(df).select("symbol", t(), "bull", "bear")


@query(
    "fair_value_gap",
    f"{PATTERNS} SELECT symbol, t, bull_fvg::INT AS bull, bear_fvg::INT AS bear, {sql_rd('gap_long')} AS gap_long, {sql_rd('gap_short')} AS gap_short FROM pat",
)
def fair_value_gap(spark, sf):
    w = block_window(KEYS)
    up, down = pat.fair_value_gap(w)
    df = hourly_blocks(spark, sf).select(
        "*", flag(up).alias("bull"), flag(down).alias("bear"), rd(pat.gap_mid(w, "LONG")).alias("gap_long"),
        rd(pat.gap_mid(w, "SHORT")).alias("gap_short"),
    )
    return own_rows(df).select("symbol", t(), "bull", "bear", "gap_long", "gap_short")


@query("order_block", f"{PATTERNS} SELECT symbol, t, {sql_rd('ob_long')} AS ob_long, {sql_rd('ob_short')} AS ob_short FROM pat")
def order_block(spark, sf):
    return hourly_features(spark, sf).select("symbol", t(), rd("ob_long").alias("ob_long"), rd("ob_short").alias("ob_short"))


CRT_5M = f"WITH RECURSIVE {data.WALK_SQL},{data.bars_sql('bars', 300)},{indicators_sql()},{patterns_sql()}"


@query("crt", f"{CRT_5M} SELECT symbol, t, bull_crt::INT AS bull, bear_crt::INT AS bear, {sql_rd('prev_low')} AS prev_low, {sql_rd('prev_high')} AS prev_high FROM pat")
def crt(spark, sf):
    return hour_sweeps(spark, sf, 4096)


@query("crt_blocks", f"{CRT_5M} SELECT symbol, t, bull_crt::INT AS bull, bear_crt::INT AS bear, {sql_rd('prev_low')} AS prev_low, {sql_rd('prev_high')} AS prev_high FROM pat")
def crt_blocks(spark, sf):
    return hour_sweeps(spark, sf, 50)


def hour_sweeps(spark, sf, block: int) -> DataFrame:
    w = block_window(KEYS)
    df = halo_blocks(numbered(data.walk_bars(spark, sf, "5m"), "5m"), KEYS, block=block, halo=pat.hour_rows("5m"))
    df = pat.with_hour_range(df, w, KEYS)
    up, down = pat.candle_range()
    return own_rows(df).select(
        "symbol", t(), flag(up).alias("bull"), flag(down).alias("bear"), rd("prev_hour_low").alias("prev_low"),
        rd("prev_hour_high").alias("prev_high"),
    )


STOPS = f"{PATTERNS}, s AS (SELECT * FROM pat WHERE seq >= 29)"


@query(
    "structure_stop",
    f"""{STOPS} SELECT symbol, t, {sql_rd('least(stop_low - atr * 0.25, close - atr * 1.15, close - atr * 0.1)')} AS sl_long,
      {sql_rd('greatest(stop_high + atr * 0.25, close + atr * 1.15, close + atr * 0.1)')} AS sl_short,
      {sql_rd('stop_low')} AS swing_low, {sql_rd('stop_high')} AS swing_high, {sql_rd('close - atr * 0.85')} AS zone_long FROM s""",
)
def structure_stop_q(spark, sf):
    df = hourly_features(spark, sf).where(F.col("seq") >= 29)
    args = (F.col("close"), F.col("atr"), F.col("stop_low"), F.col("stop_high"))
    swing = Geometry(stop_style="zone", min_stop_atr=0.60)
    return df.select(
        "symbol", t(), rd(structure_stop(F.lit("LONG"), *args)).alias("sl_long"),
        rd(structure_stop(F.lit("SHORT"), *args)).alias("sl_short"), rd("stop_low").alias("swing_low"),
        rd("stop_high").alias("swing_high"),
        rd(zone_stop(F.lit("LONG"), F.col("close"), F.col("atr"), swing)).alias("zone_long"),
    )


BIASED = f"{PATTERNS.replace(WALK_1H, WALK_PAIR)},{bos_sql('bias', 'biasx')}"
JOINED = f"""{BIASED}, j AS (SELECT e.*, b.low20, b.high20, b.seq + 1 AS bias_rows, b.trend_bull, b.trend_bear FROM pat e ASOF LEFT JOIN biasx b
  ON b.symbol = e.symbol AND e.t + 3600 >= b.t + 14400 WHERE e.seq >= 29)"""


def hourly_with_bias(spark, sf, align="close") -> DataFrame:
    entry, bias = data.bar_pair(spark, sf)
    states = sig.bias_features(bias, "4h")
    return sig.entry_features(sig.with_bias(entry, states, "1h", "4h", align), "1h").where(F.col("seq") >= 29)


@query(
    "structure_stop_htf",
    f"""{JOINED}, k AS (SELECT *, least(stop_low, CASE WHEN bias_rows >= 5 THEN low20 END) AS lo, greatest(stop_high, CASE WHEN bias_rows >= 5 THEN high20 END) AS hi FROM j)
    SELECT symbol, t, {sql_rd('least(lo - atr * 0.25, close - atr * 1.15, close - atr * 0.1)')} AS sl_long,
      {sql_rd('greatest(hi + atr * 0.25, close + atr * 1.15, close + atr * 0.1)')} AS sl_short,
      {sql_rd('lo')} AS swing_long, {sql_rd('hi')} AS swing_short FROM k""",
)
def structure_stop_htf(spark, sf):
    df = hourly_with_bias(spark, sf)
    swings = ((F.col("stop_low"), F.col("stop_high")), (F.col("bias.low20"), F.col("bias.high20")), F.col("bias.rows"))
    long = structure_stop_wide(F.lit("LONG"), F.col("close"), F.col("atr"), *swings)
    short = structure_stop_wide(F.lit("SHORT"), F.col("close"), F.col("atr"), *swings)
    return df.select(
        "symbol", t(), rd(long[0]).alias("sl_long"), rd(short[0]).alias("sl_short"), rd(long[1]).alias("swing_long"),
        rd(short[1]).alias("swing_short"),
    )


@query(
    "asof_mtf",
    f"SELECT symbol, t, bias_rows::DOUBLE AS bias_rows, coalesce(trend_bull, false)::INT AS bull, coalesce(trend_bear, false)::INT AS bear, {sql_rd('low20')} AS low20 FROM ({JOINED} SELECT * FROM j)",
)
def asof_mtf(spark, sf):
    df = hourly_with_bias(spark, sf)
    return df.select(
        "symbol", t(), F.col("bias.rows").cast("double").alias("bias_rows"),
        flag(F.coalesce(F.col("bias.trend_bull"), F.lit(False))).alias("bull"),
        flag(F.coalesce(F.col("bias.trend_bear"), F.lit(False))).alias("bear"), rd("bias.low20").alias("low20"),
    )


ASOF_OPEN_SQL = f"""WITH {WALK_PAIR} SELECT e.symbol, e.t, b.t::DOUBLE AS bias_t, {sql_rd('b.close')} AS bias_close
    FROM bars e ASOF LEFT JOIN bias b ON b.symbol = e.symbol AND e.t >= b.t"""


def bias_at_open(spark, sf, **how) -> DataFrame:
    entry, bias = data.bar_pair(spark, sf)
    right = bias.select("symbol", "ts", "close", F.unix_seconds("ts").alias("bt"))
    df = asof_join(entry, {"b": right}, KEYS, **how)
    return df.select("symbol", t(), F.col("b.bt").cast("double").alias("bias_t"), rd("b.close").alias("bias_close"))


@query("asof_mtf_open", ASOF_OPEN_SQL)
def asof_mtf_open(spark, sf):
    return bias_at_open(spark, sf)


@query("asof_mtf_pieces", ASOF_OPEN_SQL)
def asof_mtf_pieces(spark, sf):
    """The same over many more pieces than symbols."""
    return bias_at_open(spark, sf, pieces=37)


LIMIT_SQL = f"""{STOPS}, d AS (SELECT *, unnest([1.0::DOUBLE, -1.0::DOUBLE]) AS side FROM s),
  e AS (SELECT *, CASE WHEN side > 0 THEN least(stop_low - atr * 0.25, close - atr * 1.15, close - atr * 0.1) ELSE greatest(stop_high + atr * 0.25, close + atr * 1.15, close + atr * 0.1) END AS sl,
    CASE WHEN side > 0 AND bull_fvg THEN gap_long WHEN side < 0 AND bear_fvg THEN gap_short END AS gap, CASE WHEN side > 0 THEN ob_long ELSE ob_short END AS ob,
    close - side * atr * 0.45 AS pull FROM d),
  f AS (SELECT *, sl + 0.3 * (close - sl) AS room FROM e),
  g AS (SELECT *, list_min(list_filter([{{'d': side * gap, 'k': 0, 'z': 'fvg', 'p': gap}}, {{'d': side * ob, 'k': 1, 'z': 'order_block', 'p': ob}}, {{'d': side * pull, 'k': 2, 'z': 'atr_pullback', 'p': pull}}],
    lambda c: c.d >= side * room AND c.d <= side * close)) AS best FROM f)"""


@query(
    "limit_zone",
    f"""{LIMIT_SQL} SELECT symbol, t, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, coalesce(best.z, 'atr_pullback') AS zone,
    {sql_rd("coalesce(best.p, CASE WHEN side > 0 THEN greatest(room, least(close, close - atr * 0.25)) ELSE least(room, greatest(close, close + atr * 0.25)) END)")} AS price FROM g""",
)
def limit_zone_q(spark, sf):
    df = hourly_features(spark, sf).where(F.col("seq") >= 29)
    df = df.select("*", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("direction"))
    long = F.col("direction") == "LONG"
    stop = structure_stop("direction", F.col("close"), F.col("atr"), F.col("stop_low"), F.col("stop_high"))
    gap = F.when(long & F.col("bull_fvg"), F.col("gap_long")).when(~long & F.col("bear_fvg"), F.col("gap_short"))
    block = F.when(long, F.col("ob_long")).otherwise(F.col("ob_short"))
    df = df.select("*", limit_zone("direction", F.col("close"), stop, F.col("atr"), gap, block).alias("z"))
    return df.select("symbol", t(), "direction", F.col("z.zone").alias("zone"), rd("z.price").alias("price"))


# ---------------------------------------------------------------- chart structure


@query(
    "pivots_eq_levels",
    f"""WITH {WALK_1H}, m AS (SELECT *, lag(high, 3) OVER w AS mh, lag(low, 3) OVER w AS ml,
      max(high) OVER (w ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AS oh, max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS nh,
      min(low) OVER (w ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AS ol, min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS nl
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
    p AS (SELECT symbol, t, 'high' AS side, mh AS level FROM m WHERE seq >= 6 AND mh > oh AND mh >= nh
      UNION ALL SELECT symbol, t, 'low', ml FROM m WHERE seq >= 6 AND ml < ol AND ml <= nl),
    q AS (SELECT *, list(level) OVER (PARTITION BY symbol, side ORDER BY t ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS past FROM p)
    SELECT symbol, t, side, {sql_rd('level')} AS level, CAST(coalesce(len(list_filter(past, lambda x: abs(level - x) <= level * 0.0005)), 0) AS INT) AS touches FROM q""",
)
def pivots_eq_levels(spark, sf):
    df = equal_levels(data.walk_bars(spark, sf, "1h"), "1h")
    return df.select("symbol", t(), "side", rd("level").alias("level"), "touches")


@query(
    "premium_discount",
    f"""WITH {WALK_1H}, m AS (SELECT *, CASE WHEN seq >= 49 THEN max(high) OVER w END AS hi, CASE WHEN seq >= 49 THEN min(low) OVER w END AS lo FROM bars
      WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT symbol, t, {sql_rd('hi')} AS range_high, {sql_rd('lo')} AS range_low, {sql_rd('(hi + lo) / 2')} AS middle FROM m""",
)
def premium_discount(spark, sf):
    w = block_window(KEYS)
    top, low, mid = pat.range_half(w)
    df = hourly_blocks(spark, sf).select(
        "*", rd(top).alias("range_high"), rd(low).alias("range_low"), rd(mid).alias("middle")
    )
    return own_rows(df).select("symbol", t(), "range_high", "range_low", "middle")


CHOCH_SQL = f"""WITH {WALK_1H},{bos_sql('bars', 'x', 5, 1)},
  e AS (SELECT *, trend_bull AND NOT coalesce(lag(trend_bull) OVER w, false) AS nb, trend_bear AND NOT coalesce(lag(trend_bear) OVER w, false) AS ns
    FROM x WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
  f AS (SELECT *, coalesce(last_value(CASE WHEN ns THEN 'BEARISH' WHEN nb THEN 'BULLISH' END IGNORE NULLS)
    OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'NEUTRAL') AS bias FROM e)"""


@query(
    "choch",
    f"""{CHOCH_SQL} SELECT symbol, t, bias, (nb AND bias = 'BEARISH')::INT AS choch_bull, (ns AND bias = 'BULLISH')::INT AS choch_bear,
    (nb AND bias <> 'BEARISH')::INT AS bos_bull, (ns AND bias <> 'BULLISH')::INT AS bos_bear FROM f""",
)
def choch(spark, sf):
    df = internal_structure(data.walk_bars(spark, sf, "1h"), "1h")
    return df.select("symbol", t(), "bias", *[flag(F.col(c)).alias(c) for c in ("choch_bull", "choch_bear", "bos_bull", "bos_bear")])


@query(
    "edge_trigger",
    f"""WITH {WALK_1H},{bos_sql('bars', 'x')} SELECT symbol, t, (trend_bull AND NOT coalesce(lag(trend_bull) OVER w, false))::INT AS new_bull,
      (trend_bear AND NOT coalesce(lag(trend_bear) OVER w, false))::INT AS new_bear FROM x WINDOW w AS (PARTITION BY symbol ORDER BY seq)""",
)
def edge_trigger(spark, sf):
    w = block_window(KEYS)
    up, down = pat.break_of_structure(w)
    df = hourly_blocks(spark, sf).select("*", up.alias("up"), down.alias("down"))
    df = df.select("*", flag(rising(F.col("up"), w)).alias("new_bull"), flag(rising(F.col("down"), w)).alias("new_bear"))
    return own_rows(df).select("symbol", t(), "new_bull", "new_bear")


# ---------------------------------------------------------------- context series


ASOF_CONTEXT_SQL = """WITH f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup'), o AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
      g AS (SELECT ts, value FROM events WHERE event_type = 'error')
    SELECT c.event_id AS id, f.value AS funding, o.value AS oi, g.value AS btc FROM (SELECT * FROM events WHERE event_type IN ('click', 'purchase')) c
      ASOF LEFT JOIN f ON f.user_id = c.user_id AND c.ts >= f.ts ASOF LEFT JOIN o ON o.user_id = c.user_id AND c.ts >= o.ts ASOF LEFT JOIN g ON c.ts >= g.ts"""


def with_context_series(spark, sf, **how) -> DataFrame:
    ticks = data.raw_ticks(spark, sf)
    only = lambda kind, *cols: ticks.where(F.col("symbol") == kind).select(*cols, "ts", F.col("price").alias("value"))
    left = ticks.where(F.col("symbol").isin("click", "purchase")).select("id", "user_id", "ts")
    out = multi_context(
        left, {"funding": only("signup", "user_id"), "oi": only("view", "user_id")}, {"btc": only("error")}, ["user_id"], **how
    )
    return out.select("id", *[F.col(f"{c}.value").alias(c) for c in ("funding", "oi", "btc")])


@query("asof_context", ASOF_CONTEXT_SQL)
def asof_context(spark, sf):
    return with_context_series(spark, sf)


@query("asof_context_pieces", ASOF_CONTEXT_SQL)
def asof_context_pieces(spark, sf):
    """The same with all rows in one ordered table, as for series of any size."""
    return with_context_series(spark, sf, small=0)


@query(
    "oi_change",
    f"""WITH p AS (SELECT user_id, event_id, ts, CASE WHEN value > 2 THEN value END AS v FROM events),
      s AS (SELECT *, lag(v) OVER w AS prior, count(CASE WHEN v > 0 THEN 1 END) OVER r AS n,
        first_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER r AS a, last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER r AS b FROM p
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
    SELECT event_id AS id, {sql_rd('CASE WHEN prior > 0 THEN (v - prior) / prior * 100 END', 4)} AS step_pct,
      {sql_rd('CASE WHEN n >= 2 THEN (b - a) / a * 100 END', 4)} AS hour_pct FROM s""",
)
def oi_change(spark, sf):
    ticks = data.raw_ticks(spark, sf).select(
        F.col("user_id").alias("symbol"), "ts", "id", F.when(F.col("price") > 2, F.col("price")).alias("oi")
    )
    df = open_interest_changes(ticks, "oi", order=["ts", "id"])
    return df.select("id", rd("step_pct", 4).alias("step_pct"), rd("hour_pct", 4).alias("hour_pct"))


# ---------------------------------------------------------------- signals

SIGNAL_COLUMNS = f"""symbol, t, direction, zone_type, market_regime, setup_score, confidence, {sql_rd('entry')} AS entry, {sql_rd('limit_price')} AS limit_price,
  {sql_rd('sl', 4)} AS sl, {sql_rd('tp', 4)} AS tp, {sql_rd('structure_swing')} AS swing, rr AS rr, volume_spike, displacement,
  (CASE WHEN trend_bull THEN bull_sweep ELSE bear_sweep END)::INT AS sweep, (CASE WHEN trend_bull THEN bull_fvg ELSE bear_fvg END)::INT AS fvg,
  (CASE WHEN trend_bull THEN bull_crt ELSE bear_crt END)::INT AS crt, {sql_rd('atr', 4)} AS atr, atr_percentile,
  {sql_rd('(entry - ema20) / ema20', 4)} AS d_ema20, {sql_rd('(entry - vwap) / vwap', 4)} AS d_vwap, {sql_rd('(swing_high - entry) / entry')} AS d_high,
  {sql_rd('abs(tp - trade_entry) / greatest(abs(trade_entry - sl), 0.0001)', 4)} AS risk_reward"""


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol", t(), "direction", "zone_type", "market_regime", "setup_score", "confidence", rd("entry").alias("entry"),
        rd("limit_price").alias("limit_price"), rd("sl", 4).alias("sl"), rd("tp", 4).alias("tp"),
        rd("structure_swing").alias("swing"), F.col("rr_multiplier").alias("rr"), "volume_spike", "displacement", "sweep",
        "fvg", "crt", rd("atr", 4).alias("atr"), "atr_percentile", rd("distance_to_ema20", 4).alias("d_ema20"),
        rd("distance_to_vwap", 4).alias("d_vwap"), rd("distance_to_prev_high").alias("d_high"),
        rd("risk_reward", 4).alias("risk_reward"),
    )


def all_signals(spark, sf, min_confidence: float = 65.0, enrich=None, **kw) -> DataFrame:
    entry, bias = data.bar_pair(spark, sf)
    return sig.signals(entry, bias, "1h", "4h", Gates(min_confidence=min_confidence, **kw), enrich=enrich)


@query("signals", f"{full_signals(65)} SELECT {SIGNAL_COLUMNS} FROM sig")
def signals_q(spark, sf):
    return shown(all_signals(spark, sf))


@query(
    "signal_ids",
    f"""{full_signals(65)} SELECT symbol, t, symbol || '_' || strftime(epoch_ms(t * 1000), '%Y-%m-%d %H:%M:%S') || '+00:00_' || direction AS signal_hash,
      CASE WHEN volume_spike = 1 THEN 'V' ELSE '-' END || CASE WHEN displacement = 1 THEN 'D' ELSE '-' END || CASE WHEN bull_sweep OR bear_sweep THEN 'S' ELSE '-' END
      || CASE WHEN bull_fvg OR bear_fvg THEN 'F' ELSE '-' END || CASE WHEN bull_crt OR bear_crt THEN 'C' ELSE '-' END AS confluences FROM sig""",
)
def signal_ids(spark, sf):
    return all_signals(spark, sf).select("symbol", t(), "signal_hash", "confluences")


@query("signals_market", f"{full_signals(0, 'market')} SELECT {SIGNAL_COLUMNS} FROM sig")
def signals_market(spark, sf):
    return shown(all_signals(spark, sf, 0.0, entry_mode="market"))


@query("signals_ai", f"{full_signals(0, ai=True)} SELECT {SIGNAL_COLUMNS} FROM sig")
def signals_ai(spark, sf):
    """Model-blended confidence; a stand-in model scores the candidates."""
    orders = data.table(spark, sf, "orders")
    n_real = orders.where((F.col("o_orderstatus") != "O") & (F.col("o_orderkey") % 3 != 0)).count()

    def enrich(df: DataFrame) -> DataFrame:
        return df.select(
            "*", F.lit(n_real).alias("n_real_closed"), (F.col("seq") * 7 % 91 + 5).cast("double").alias("ai_prob"),
            ((F.col("seq") % 7 - 2) * 0.1).alias("expected_r"), F.lit(0.6).alias("recent_win_rate"),
        )

    return shown(all_signals(spark, sf, 0.0, enrich, ai=True))
