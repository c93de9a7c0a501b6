"""Queries over features, splits, evaluation and training."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import data
from tidemark.catalog.base import flag, query, rd, t
from tidemark.catalog.ledger import CLOSED_SQL, closed
from tidemark.catalog.replay import BARRIER, FILLED, replayed
from tidemark.catalog.sqltext import bos_sql
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.operators import evaluation as ev
from tidemark.operators import splits as sp
from tidemark.operators.context import open_interest_changes
from tidemark.operators.ledger import with_symbol_form
from tidemark.plans import corpus as cp
from tidemark.plans import registry as rg
from tidemark.plans import training as tr
from tidemark.session import stage, staging_root
from tidemark.sources.store import missing_symbols

# ------------------------------------------------------------------ corpus with context

CONTEXT_SQL = f"""{FILLED}, {BARRIER},
fu AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 28800) + 1 AS BIGINT) * 28800 AS t, avg(value) / 1000 - 0.01::DOUBLE AS value FROM events GROUP BY 1, 2),
oh AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) + 1 AS BIGINT) * 3600 AS t, sum(floor(value * 100 + 0.5)) AS oi FROM events GROUP BY 1, 2),
oi AS (SELECT symbol, t, CASE WHEN lag(oi) OVER w > 0 THEN (oi - lag(oi) OVER w) / lag(oi) OVER w * 100 END AS value FROM oh WHERE oi > 0 WINDOW w AS (PARTITION BY symbol ORDER BY t)),
bt AS (SELECT t, CASE WHEN trend_bear THEN -1.0::DOUBLE WHEN trend_bull THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM bt0),
fg AS (SELECT CAST(floor(epoch(ts) / 86400) + 1 AS BIGINT) * 86400 AS t, floor(avg(value) * 5) AS value FROM events GROUP BY 1),
cx AS (SELECT f.*, CASE WHEN count(*) OVER form >= 3 THEN avg((equity / (1 + rho) * rho > 0)::INT::DOUBLE) OVER form ELSE 0.5::DOUBLE END AS form, fu.value AS funding, oi.value AS oi, bt.value AS btc, fg.value AS fng FROM fin f ASOF LEFT JOIN fu ON fu.symbol = f.symbol AND f.t >= fu.t
  ASOF LEFT JOIN oi ON oi.symbol = f.symbol AND f.t >= oi.t ASOF LEFT JOIN bt ON f.t >= bt.t ASOF LEFT JOIN fg ON f.t >= fg.t
  WINDOW form AS (PARTITION BY f.symbol ORDER BY f.seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
CONTEXT_SQL = CONTEXT_SQL.replace("bt AS (SELECT t, CASE", bos_sql("(SELECT * FROM bars WHERE symbol = 'click')", "bt0", need=12).strip() + ",\nbt AS (SELECT t, CASE")


def enricher(spark, sf, bars):
    """Funding (8h), open-interest change (1h), reference trend and daily sentiment.

    A value of a span is known from the span's end on, so a trade never sees later ticks.
    """
    ticks = data.raw_ticks(spark, sf)
    at = lambda width: F.timestamp_seconds((F.floor(F.unix_seconds("ts") / width) + 1) * width).alias("ts")
    funding = ticks.groupBy("symbol", at(28800)).agg((F.avg("price") / 1000 - 0.01).alias("value"))
    hourly = ticks.groupBy("symbol", at(3600)).agg(F.sum(F.floor(F.col("price") * 100 + 0.5)).cast("double").alias("oi")).where("oi > 0")
    oi = open_interest_changes(hourly, "oi").select("symbol", "ts", F.col("step_pct").alias("value"))
    trend = cp.trend_series(bars, "30m", "click")
    sentiment = ticks.groupBy(at(86400)).agg(F.floor(F.avg("price") * 5).cast("double").alias("value"))
    return cp.context_enricher(funding, oi, trend, sentiment)


def corpus(spark, sf) -> DataFrame:
    """Replayed trades with their context and the form of their symbol before them."""
    return with_symbol_form(stage(replayed(spark, sf, context=enricher), "corpus"))


@query(
    "corpus_trades",
    f"""{CONTEXT_SQL} SELECT symbol, t, direction, 'backtest' AS source, {sql_rd('realized_r', 3)} AS realized_r, {sql_rd('tb_r', 3)} AS tb_r, {sql_rd('funding')} AS funding,
      {sql_rd('oi', 4)} AS oi, btc, fng, {sql_rd('form')} AS form FROM cx""",
)
def corpus_trades(spark, sf):
    return corpus(spark, sf).select(
        "symbol", t(), "direction", "source", rd("realized_r", 3).alias("realized_r"), rd("tb_realized_r", 3).alias("tb_r"),
        rd("funding_rate").alias("funding"), rd("oi_change_pct", 4).alias("oi"), F.col("btc_trend").alias("btc"), "fng",
        rd("symbol_win_rate").alias("form"),
    )


FRAME_SQL = f"""{CONTEXT_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY t, symbol) - 1 AS n, (equity / (1 + rho) * rho > 0) AS won FROM cx),
  h AS (SELECT *, CASE WHEN n < 5 THEN 0.5::DOUBLE ELSE avg(won::INT::DOUBLE) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS rate,
    CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE sum(pnl) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS cum, list(pnl) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS l,
    n - row_number() OVER (PARTITION BY won ORDER BY n) AS island FROM o WINDOW w AS (ORDER BY n)),
  g AS (SELECT *, row_number() OVER (PARTITION BY won, island ORDER BY n) * CASE WHEN won THEN 1 ELSE -1 END AS run FROM h),
  z AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE lag(run) OVER (ORDER BY n) END AS streak, abs(entry - sl) AS risk, abs(tp - entry) AS reward, (t // 3600) % 24 AS hr, (t // 86400 + 3) % 7 AS dow FROM g),
  m AS (SELECT z.*, p.volume_spike AS vs, p.displacement AS dp, p.body AS bd, p.volume AS vol, p.volume_ma AS vma, p.atr_percentile AS ap, p.market_regime AS mr,
      (CASE WHEN z.side > 0 THEN p.now_bull OR p.recent_bull ELSE p.now_bear OR p.recent_bear END)::INT AS sw, (CASE WHEN z.side > 0 THEN p.bull_fvg ELSE p.bear_fvg END)::INT AS fv,
      (CASE WHEN z.side > 0 THEN p.bull_crt ELSE p.bear_crt END)::INT AS cr,
      p.close AS px, coalesce(p.ema20, p.close) AS m20, coalesce(p.ema50, p.close) AS m50, coalesce(p.vwap, p.close) AS vw, coalesce(p.swing_high, p.close) AS sh, coalesce(p.swing_low, p.close) AS slo FROM z JOIN pat p ON p.symbol = z.symbol AND p.seq = z.seq)"""


@query("corpus_cache", f"{CONTEXT_SQL} SELECT symbol, t, direction, {sql_rd('realized_r', 3)} AS realized_r, CAST(1 AS INT) AS version FROM cx")
def corpus_cache(spark, sf):
    """The corpus stored symbol by symbol; a second run replays only symbols that have no finished part."""
    path, trades = f"{staging_root(spark)}/corpus-{uuid.uuid4().hex}", stage(replayed(spark, sf), "trades")
    cp.build_corpus(trades.where("symbol < 'm'"), path)
    todo = missing_symbols(trades, spark, path, cp.DEF_VERSION)
    stored = cp.build_corpus(trades.join(todo, "symbol", "left_semi"), path)
    return stored.select("symbol", t(), "direction", rd("realized_r", 3).alias("realized_r"), F.col("def_version").alias("version"))


_yes = lambda cond: f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
MORE_FEATURES = {
    "volume_spike": "vs::DOUBLE", "displacement": "dp::DOUBLE", "sweep": "sw::DOUBLE", "fvg": "fv::DOUBLE", "crt": "cr::DOUBLE",
    "reward_pct": sql_rd("reward / greatest(entry, 0.0001)"), "atr_expansion": sql_rd("atr", 4),
    "is_high_volatility": _yes("ap > 70"), "is_low_volatility": _yes("ap < 30"), "regime_trending": _yes("mr = 'trending'"), "regime_volatile": _yes("mr = 'volatile'"),
    "distance_to_prev_high": sql_rd("(sh - px) / px"), "distance_to_prev_low": sql_rd("(slo - px) / px"), "distance_to_ema20": sql_rd("(px - m20) / m20", 4),
    "distance_to_ema50": sql_rd("(px - m50) / m50", 4), "distance_to_vwap": sql_rd("(px - vw) / vw", 4), "confluence_strength": "(vs + dp + sw + fv) / 4.0::DOUBLE",
    "is_london_open": _yes("hr BETWEEN 7 AND 11"), "is_ny_open": _yes("hr BETWEEN 12 AND 16"), "is_overlap": _yes("hr BETWEEN 8 AND 11"), "is_quiet_time": _yes("hr BETWEEN 17 AND 21"),
    "is_monday": _yes("dow = 0"), "is_friday": _yes("dow = 4"), "is_scalp": _yes("reward / greatest(risk, 0.0001) < 1.8"), "is_swing": _yes("reward / greatest(risk, 0.0001) >= 2.0"),
    "is_hot_streak": _yes("streak > 0"), "btc_trend": "coalesce(btc, 0.0::DOUBLE)", "spread_pct": "0.0::DOUBLE", "symbol_win_rate": sql_rd("coalesce(nullif(form, 0), 0.5::DOUBLE)"),
    "current_dd_pct": f"CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE {sql_rd('list_max(list_transform(range(1, len(l) + 1), lambda j: -coalesce(list_sum(l[j+1:]), 0)))', 4)} END",
    "funding_vs_direction": sql_rd("coalesce(funding, 0) * side"), "is_extreme_fear": _yes("coalesce(nullif(fng, 0), 50) <= 20"), "is_extreme_greed": _yes("coalesce(nullif(fng, 0), 50) >= 80"),
    "sweep_x_fvg": "(sw * fv)::DOUBLE", "atr_x_confluence": sql_rd("atr * ((vs + dp + sw + fv) / 4.0::DOUBLE)", 4), "atr_x_session": sql_rd(f"atr * {_yes('hr BETWEEN 7 AND 16')}", 4),
}
MORE_FEATURES_SQL = ", ".join(f"{v} AS {k}" for k, v in MORE_FEATURES.items())
#: Digits that are compared; the rest are whole numbers or flags.
FEATURE_DIGITS = {
    "reward_pct": 6, "atr_expansion": 4, "distance_to_prev_high": 6, "distance_to_prev_low": 6, "distance_to_ema20": 4, "distance_to_ema50": 4, "distance_to_vwap": 4,
    "symbol_win_rate": 6, "current_dd_pct": 4, "funding_vs_direction": 6, "atr_x_confluence": 4, "atr_x_session": 4,
}


@query(
    "feature_frame",
    f"""{FRAME_SQL} SELECT n AS seq, symbol, t AS entry_t, tb_t AS exit_t, CASE WHEN tb_r >= 0.5 THEN 1 ELSE 0 END AS target, {sql_rd('tb_r', 3)} AS realized_r,
      CASE WHEN side > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS trend_bull, {sql_rd('reward / greatest(risk, 0.0001)', 4)} AS risk_reward, {sql_rd('risk / greatest(entry, 0.0001)')} AS risk_pct,
      {sql_rd('risk / greatest(reward, 0.0001)', 4)} AS adversity_ratio, {sql_rd('bd / greatest(atr, 0.0001)', 4)} AS body_ratio, {sql_rd('vol / greatest(vma, 0.0001)', 4)} AS volume_strength,
      ap AS atr_percentile, CASE WHEN mr = 'ranging' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime_ranging, (vs + dp + sw + fv)::DOUBLE AS confluence_count, hr::DOUBLE AS hour, dow::DOUBLE AS day_of_week,
      CASE WHEN hr >= 22 OR hr <= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_asian, {sql_rd('rate')} AS recent_win_rate, streak::DOUBLE AS streak_count, {sql_rd('cum', 3)} AS cumulative_pnl,
      {sql_rd('coalesce(funding, 0)')} AS funding_rate, {sql_rd('coalesce(oi, 0)', 4)} AS oi_change_pct, CASE WHEN coalesce(btc, 0) * side > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS btc_aligned,
      coalesce(nullif(fng, 0), 50.0::DOUBLE) AS fng, (cr * sw)::DOUBLE AS crt_x_sweep, (vs * dp)::DOUBLE AS volume_x_displacement, {sql_rd('atr * risk / greatest(entry, 0.0001)', 4)} AS volatility_x_risk,
      {sql_rd('reward / greatest(risk, 0.0001) * atr', 3)} AS rr_x_atr, {MORE_FEATURES_SQL} FROM m""",
)
def feature_frame(spark, sf):
    frame = tr.feature_frame(tr.in_ledger_order(corpus(spark, sf)), 30)
    r4, r6 = lambda c: rd(c, 4).alias(c), lambda c: rd(c).alias(c)
    return frame.select(
        "seq", "symbol", (F.col("entry_ms") / 1000).cast("long").alias("entry_t"), (F.col("exit_ms") / 1000).cast("long").alias("exit_t"),
        "target", rd("realized_r", 3).alias("realized_r"), "trend_bull", r4("risk_reward"), r6("risk_pct"), r4("adversity_ratio"),
        r4("body_ratio"), r4("volume_strength"), "atr_percentile", "regime_ranging", "confluence_count", "hour", "day_of_week",
        "is_asian", r6("recent_win_rate"), "streak_count", rd("cumulative_pnl", 3).alias("cumulative_pnl"), r6("funding_rate"),
        r4("oi_change_pct"), "btc_aligned", "fng", "crt_x_sweep", "volume_x_displacement", r4("volatility_x_risk"),
        rd("rr_x_atr", 3).alias("rr_x_atr"), *[rd(c, FEATURE_DIGITS[c]).alias(c) if c in FEATURE_DIGITS else c for c in MORE_FEATURES],
    )


@query("label_sources", f"{FILLED}, {BARRIER} SELECT 'triple_barrier' AS label_kind, count(*) AS n FROM fin HAVING count(*) > 0")
def label_sources(spark, sf):
    frame = tr.feature_frame(tr.in_ledger_order(stage(replayed(spark, sf), "trades")), 30)
    return frame.groupBy("label_kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ splits

SPLIT_SQL = f"""{CLOSED_SQL}, i AS (SELECT seq AS id, epoch_ms(ts) AS entry_ms, CASE WHEN seq % 97 <> 0 THEN epoch_ms(ts) + (seq % 72 + 1) * 3600000 END AS exit_ms,
    CASE WHEN ts < TIMESTAMP '2001-06-15' AND won THEN 1 ELSE 0 END AS target, source, row_number() OVER (ORDER BY ts, seq) - 1 AS idx, count(*) OVER () AS n FROM cl)"""
EMBARGO = 86_400_000


def split_rows(spark, sf) -> DataFrame:
    ms = F.unix_millis("ts")
    rows = closed(spark, sf).select(
        F.col("seq").alias("id"), ms.alias("entry_ms"), F.when(F.col("seq") % 97 != 0, ms + (F.col("seq") % 72 + 1) * 3_600_000).alias("exit_ms"),
        F.when((F.col("ts") < F.lit("2001-06-15").cast("timestamp")) & (F.col("status") == "WIN"), 1).otherwise(0).alias("target"),
        F.col("source").alias("sample_source"),
    )
    return stage(sp.with_index(rows), "indexed")


@query(
    "purged_folds",
    f"""WITH {SPLIT_SQL}, b AS (SELECT k, CAST(floor(n * k / 6.0) AS BIGINT) AS lo, CAST(floor(n * (k + 1) / 6.0) AS BIGINT) AS hi FROM (SELECT DISTINCT n FROM i), range(1, 6) r(k)),
      s AS (SELECT b.*, i.entry_ms - {EMBARGO} AS cutoff FROM b JOIN i ON i.idx = b.lo)
    SELECT CAST(k AS INT) AS fold, CASE WHEN idx < lo THEN 'train' ELSE 'test' END AS split, idx FROM s JOIN i ON (idx < lo AND exit_ms <= cutoff) OR (idx >= lo AND idx < hi)""",
)
def purged_folds(spark, sf):
    return sp.purged_folds(split_rows(spark, sf), 5, EMBARGO).select("fold", "split", "idx")


@query(
    "purged_holdout",
    f"""WITH {SPLIT_SQL}, z AS (SELECT s.idx AS split_at, s.entry_ms - {EMBARGO} AS cutoff FROM i s WHERE s.n - s.idx BETWEEN 15 AND greatest(15, s.n // 2) AND s.idx >= 15),
      v AS (SELECT split_at, cutoff FROM z JOIN i ON true GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN idx >= split_at THEN target END) = 2
        AND count(DISTINCT CASE WHEN idx < split_at AND (exit_ms IS NULL OR exit_ms <= cutoff) THEN target END) = 2
        AND count(CASE WHEN idx < split_at AND (exit_ms IS NULL OR exit_ms <= cutoff) THEN 1 END) >= 15),
      w AS (SELECT max_by(split_at, split_at) AS split_at, max_by(cutoff, split_at) AS cutoff FROM v)
    SELECT id, idx, CASE WHEN idx >= split_at THEN 'test' ELSE 'train' END AS split FROM i, w WHERE idx >= split_at OR exit_ms IS NULL OR exit_ms <= cutoff""",
)
def purged_holdout(spark, sf):
    out = sp.purged_holdout(split_rows(spark, sf), 15, EMBARGO)
    return out.select("id", "idx", "split")


@query(
    "sample_weights",
    f"WITH {SPLIT_SQL} SELECT id, floor(pow(0.5, (n - 1 - idx) / 60.0) * CASE WHEN source = 'backtest' THEN 0.5 ELSE 1 END * 1e6 + 0.5) / 1e6 AS weight FROM i",
)
def sample_weights(spark, sf):
    rows = split_rows(spark, sf)
    return tr.weighted(rows, 60).select("id", rd("weight").alias("weight"))


# ------------------------------------------------------------------ evaluation

PRED_SQL = f"{CLOSED_SQL}, pr AS (SELECT seq, o_custkey % 4 AS model, won::INT AS y, (seq * 37 % 997) / 1000.0::DOUBLE AS p, (seq % 9 - 4) * 0.5::DOUBLE AS r FROM cl)"
METRICS_SQL = f"""{PRED_SQL},
  k AS (SELECT *, count(*) OVER (PARTITION BY model) AS n, rank() OVER (PARTITION BY model ORDER BY p DESC) AS top,
    rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS ar FROM pr),
  s AS (SELECT *, top <= least(n, greatest(5, ceil(n * 0.3))) AS picked FROM k),
  e AS (SELECT model, count(*) AS n_test, sum(y) AS n1, count(*) - sum(y) AS n0, sum(CASE WHEN y = 1 THEN ar END) AS ranks,
    avg(-(CASE WHEN y = 1 THEN ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) ELSE ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) END)) AS log_loss,
    avg((p - y) * (p - y)) AS brier, avg(y::DOUBLE) AS base, count_if(picked)::BIGINT AS n_selected, avg(CASE WHEN picked THEN y::DOUBLE END) AS precision, avg(CASE WHEN picked THEN r END) AS ev, min(CASE WHEN picked THEN p END) AS cut
    FROM s GROUP BY 1)"""


def predictions(spark, sf) -> DataFrame:
    k = F.col("seq")
    return closed(spark, sf).select(
        "seq", (F.col("o_custkey") % 4).alias("model"), flag(F.col("status") == "WIN").alias("y"),
        ((k * 37 % 997) / 1000.0).alias("p"), ((k % 9 - 4) * 0.5).alias("r"),
    )


@query(
    "classification_metrics",
    f"""WITH {METRICS_SQL} SELECT model, {sql_rd('(ranks - n1 * (n1 + 1) / 2.0) / (n1 * n0)')} AS auc, {sql_rd('log_loss')} AS log_loss, {sql_rd('brier')} AS brier, n_test, n_selected,
      {sql_rd('cut', 4)} AS threshold, {sql_rd('base', 4)} AS base_rate, {sql_rd('precision', 4)} AS precision, {sql_rd('precision - base', 4)} AS precision_lift, {sql_rd('ev', 4)} AS ev_r FROM e""",
)
def classification_metrics(spark, sf):
    out = ev.evaluate(predictions(spark, sf), ["model"])
    return out.withColumn("auc", rd("auc")).withColumn("log_loss", rd("log_loss")).withColumn("brier", rd("brier"))


@query(
    "topk_select",
    f"WITH {PRED_SQL}, k AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p DESC) AS top FROM pr) SELECT seq, p FROM k WHERE top <= least(n, greatest(5, ceil(n * 0.3)))",
)
def topk_select(spark, sf):
    return ev.top_fraction(predictions(spark, sf)).select("seq", "p")


@query(
    "promotion",
    f"""WITH {METRICS_SQL}, c AS (SELECT a.model AS chal, b.model AS champ, floor(a.ev * 1e4 + 0.5) / 1e4 AS ev1, floor(b.ev * 1e4 + 0.5) / 1e4 AS ev2 FROM e a LEFT JOIN e b ON b.model = a.model + 1)
    SELECT chal, CASE WHEN ev1 <= 0 THEN 'below_bar' WHEN ev2 IS NULL THEN 'first' WHEN ev1 >= ev2 + 0.02 THEN 'ev_win' ELSE 'ev_loss' END AS reason,
      CASE WHEN ev1 > 0 AND (ev2 IS NULL OR ev1 >= ev2 + 0.02) THEN 1 ELSE 0 END AS promote FROM c""",
)
def promotion(spark, sf):
    m = stage(ev.evaluate(predictions(spark, sf), ["model"]), "metrics")
    pick = lambda side: [F.col(a).alias(f"{side}_{b}") for a, b in (("ev_r", "ev"), ("precision_lift", "lift"), ("auc", "auc"))]
    chal = m.select(F.col("model").alias("chal"), *pick("chal"))
    champ = m.select((F.col("model") - 1).alias("chal"), *pick("champ"))
    out = ev.promotion(chal.join(champ, "chal", "left"))
    return out.select("chal", "reason", flag(F.col("promote")).alias("promote"))


IMPORTANCE_SQL = """im AS (SELECT 'f' || (l_suppkey % 20) AS feature, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS run_seq, avg(l_tax) * 0.25 AS importance FROM lineitem GROUP BY 1, 2),
  av AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY run_seq) AS k, avg(importance) OVER (PARTITION BY feature ORDER BY run_seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM im),
  rc AS (SELECT feature, 0::BIGINT AS k, 1.0::DOUBLE AS m FROM (SELECT DISTINCT feature FROM av)
    UNION ALL SELECT a.feature, a.k, CASE WHEN a.mean < 0.01 THEN greatest(0.3::DOUBLE, r.m * 0.85) ELSE least(1.0::DOUBLE, r.m / 0.85) END FROM rc r JOIN av a ON a.feature = r.feature AND a.k = r.k + 1)"""


@query("importance_decay", f"WITH RECURSIVE {IMPORTANCE_SQL} SELECT feature, {sql_rd('max_by(m, k)')} AS multiplier, CASE WHEN max_by(m, k) < 0.4 THEN 1 ELSE 0 END AS dropped FROM rc GROUP BY 1")
def importance_decay(spark, sf):
    li = data.table(spark, sf, "lineitem")
    runs = li.groupBy(
        F.concat(F.lit("f"), F.col("l_suppkey") % 20).alias("feature"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("run_seq"),
    ).agg((F.avg("l_tax") * 0.25).alias("importance"))
    return ev.decay(runs).select("feature", rd("multiplier").alias("multiplier"), flag(F.col("dropped")).alias("dropped"))


# ------------------------------------------------------------------ training

LEDGER_SQL = f"{CONTEXT_SQL}, o AS (SELECT row_number() OVER (ORDER BY t, symbol) - 1 AS n, symbol, t * 1000 AS e, tb_t * 1000 AS x, (tb_r >= 0.5)::INT AS y FROM cx)"


@query(
    "train_score",
    f"""{LEDGER_SQL} SELECT n AS seq, symbol, y AS target, CAST((row_number() OVER (PARTITION BY y ORDER BY n) - 1) % CASE WHEN count(*) OVER () >= 60 THEN 3 ELSE 2 END AS INTEGER) AS fold,
      1 AS in_bounds FROM o""",
)
def train_score(spark, sf):
    """Every corpus row with the fold that its out-of-fold probability comes from; models of the other folds score it."""
    frame = stage(tr.feature_frame(tr.in_ledger_order(corpus(spark, sf)), 30), "frame")
    ready = tr.weighted(frame.withColumn("idx", F.col("seq")), None)
    scored = tr.fit_with_scores(ready, rounds=10)[1]
    prob = tr.bounded_percent(F.col("p"))
    return frame.join(scored, "seq").select("seq", "symbol", "target", "fold", flag(prob.between(5, 95)).alias("in_bounds"))


@query(
    "retrain_flow",
    f"""{LEDGER_SQL},
      p AS (SELECT k AS run, CASE k WHEN 1 THEN 10 WHEN 2 THEN c * 3 // 5 ELSE c END AS p FROM (SELECT count(*) AS c FROM o), range(1, 4) r(k)),
      w AS (SELECT run, p, o.*, n - greatest(0, p - 220) AS idx, count(*) OVER (PARTITION BY run) AS size, sum(y) OVER (PARTITION BY run) AS pos FROM p JOIN o ON n < p AND n >= p - 220),
      h AS (SELECT *, least(15, greatest(5, size // 5)) AS least_test FROM w),
      s AS (SELECT run, idx AS split_at, e - {EMBARGO} AS cutoff FROM h WHERE size - idx BETWEEN least_test AND greatest(least_test, size // 2) AND idx >= 15),
      v AS (SELECT s.run, split_at, count(CASE WHEN idx >= split_at THEN 1 END) AS n_test, count(CASE WHEN idx < split_at AND x <= cutoff THEN 1 END) AS n_train FROM s JOIN w ON s.run = w.run GROUP BY 1, 2
        HAVING count(DISTINCT CASE WHEN idx >= split_at THEN y END) = 2 AND count(DISTINCT CASE WHEN idx < split_at AND x <= cutoff THEN y END) = 2 AND count(CASE WHEN idx < split_at AND x <= cutoff THEN 1 END) >= 15),
      b AS (SELECT run, max_by(n_train, split_at) AS n_train, max_by(n_test, split_at) AS n_test FROM v GROUP BY 1),
      g AS (SELECT p.run, p.p, max(w.size) AS size, CAST(max(w.pos) AS BIGINT) AS pos, max(b.n_train) AS n_train, max(b.n_test) AS n_test,
        CASE WHEN p.p < 30 THEN 'few_rows' WHEN max(w.size) < 20 THEN 'few_labels' WHEN max(w.pos) IN (0, max(w.size)) THEN 'one_class' WHEN max(b.n_train) IS NULL THEN 'no_split' ELSE 'trained' END AS gate
        FROM p LEFT JOIN w ON p.run = w.run LEFT JOIN b ON b.run = p.run GROUP BY 1, 2),
      d AS (SELECT *, gate = 'trained' AND p - coalesce((SELECT max(p) FROM g f WHERE f.run < g.run AND f.gate = 'trained' AND f.p >= 100), 0) >= 100 AS diagnosed FROM g)
    SELECT run, gate, p AS n_ledger, CASE WHEN gate <> 'few_rows' THEN size END AS n_window, CASE WHEN gate <> 'few_rows' THEN pos END AS n_positive, CASE WHEN gate <> 'few_rows' THEN size END AS n_backtest,
      CASE WHEN gate = 'trained' THEN n_train END AS n_train, CASE WHEN gate = 'trained' THEN n_test END AS n_test, diagnosed::INT AS diagnosed, 1 AS decided, 1 AS pointed FROM d""",
)
def retrain_flow(spark, sf):
    """Three runs over growing prefixes of the ledger into one registry: what each run logged, and whether its decision and the champion follow from the log."""
    ledger = stage(tr.in_ledger_order(corpus(spark, sf)), "ledger")
    n = ledger.count()
    registry = rg.Registry(spark, f"{staging_root(spark)}/registry-{uuid.uuid4().hex}")
    pointed = []
    for rows in (10, n * 3 // 5, n):
        rg.retrain_flow(ledger.where(F.col("seq") < rows), registry, 30, rounds=5)
        at = registry.pointer()
        pointed.append((len(pointed) + 1, at["run"] if at else None))
    runs = registry.runs()
    side = lambda name, c: F.col(f"{name}.{c}")
    pairs = runs.select("run", "promoted", *[side(m, a).alias(f"{s}_{b}") for m, s in (("challenger", "chal"), ("champion", "champ")) for a, b in (("ev_r", "ev"), ("precision_lift", "lift"), ("auc", "auc"))])
    right = ev.promotion(pairs).select("run", flag((F.col("promote") & F.col("chal_auc").isNotNull()) == F.col("promoted")).alias("decided"))
    upto = runs.select("run", "promoted").alias("a").join(runs.select(F.col("run").alias("was"), F.col("promoted").alias("won")), F.expr("won AND was <= run"), "left").groupBy("run").agg(F.max("was").alias("best"))
    seen = spark.createDataFrame(pointed, "run bigint, champion_run bigint").join(upto, "run").select("run", flag(F.col("champion_run").eqNullSafe(F.col("best"))).alias("pointed"))
    return runs.join(right, "run").join(seen, "run").select(
        "run", "gate", "n_ledger", "n_window", "n_positive", "n_backtest", "n_train", "n_test", flag(F.col("diagnosed")).alias("diagnosed"), "decided", "pointed"
    )


@query("walk_forward_metrics")
def walk_forward_metrics(spark, sf):
    """Purged walk-forward metrics per fold."""
    frame = stage(tr.feature_frame(tr.in_ledger_order(corpus(spark, sf)), 30), "frame")
    return tr.cross_validate(frame, folds=3, rounds=10).select("fold", "auc", "brier", "n_test")
