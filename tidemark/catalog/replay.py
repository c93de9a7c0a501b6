"""Queries over replayed signals: trades, metrics, parameter grid."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import data
from tidemark.catalog.base import query, rd, t
from tidemark.catalog.sqltext import full_signals
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.operators.bars import numbered
from tidemark.params import SWING
from tidemark.plans import replay
from tidemark.plans import signals as sig
from tidemark.session import stage


def exits_sql(src: str, out: str, dist: str) -> str:
    """Exit of every row of ``src`` (id, symbol, start, side, entry, sl, tp, act_ratio, atr, pct)."""
    return f"""
{out}_a AS (SELECT *, entry + (tp - entry) * act_ratio AS act FROM {src}),
{out}_k AS (SELECT a.id, min(CASE WHEN CASE WHEN side > 0 THEN b.low <= sl ELSE b.high >= sl END THEN b.seq END) AS k_sl,
    min(CASE WHEN CASE WHEN side > 0 THEN b.high >= act ELSE b.low <= act END THEN b.seq END) AS k_act, max(b.seq) AS k_end, max_by(b.close, b.seq) AS c_end
  FROM {out}_a a JOIN bars b ON b.symbol = a.symbol AND b.seq >= a.start GROUP BY ALL),
{out}_m AS (SELECT a.*, k_sl, k_act, k_end, c_end, (k_act IS NOT NULL AND (k_sl IS NULL OR k_act < k_sl)) AS trails FROM {out}_a a JOIN {out}_k USING (id)),
{out}_w AS (SELECT m.id, m.side, m.pct, m.atr, m.entry, b.seq AS s, b.high, b.low, CASE WHEN m.side > 0 THEN max(b.high) OVER (PARTITION BY m.id ORDER BY b.seq)
    ELSE min(b.low) OVER (PARTITION BY m.id ORDER BY b.seq) END AS anchor FROM {out}_m m JOIN bars b ON b.symbol = m.symbol AND b.seq >= m.k_act WHERE m.trails),
{out}_x AS (SELECT id, min(s) AS k_tr, min_by(anchor - side * ({dist}), s) AS p_tr FROM {out}_w
  WHERE CASE WHEN side > 0 THEN low <= anchor - side * ({dist}) ELSE high >= anchor - side * ({dist}) END GROUP BY ALL),
{out}_y AS (SELECT m.*, CASE WHEN trails AND k_tr IS NOT NULL THEN 'Trailing Stop Hit' WHEN NOT trails AND k_sl IS NOT NULL THEN 'Stop Loss Hit' ELSE 'Open at data end' END AS reason,
    CASE WHEN trails AND k_tr IS NOT NULL THEN k_tr WHEN NOT trails AND k_sl IS NOT NULL THEN k_sl ELSE k_end END AS k_exit,
    (CASE WHEN trails AND k_tr IS NOT NULL THEN p_tr WHEN NOT trails AND k_sl IS NOT NULL THEN sl ELSE c_end END) * (1 - side * 0.0002::DOUBLE) AS exit_price
  FROM {out}_m m LEFT JOIN {out}_x x USING (id)),
{out} AS (SELECT *, (side * (exit_price - entry) - (entry * maker + exit_price * 0.00055::DOUBLE)) / abs(entry - sl) * 0.005::DOUBLE AS rho,
    floor(side * (exit_price - entry) / abs(entry - sl) * 1e4 + 0.5) / 1e4 AS realized_r, k_exit - start + 1 AS walk_bars FROM {out}_y WHERE abs(entry - sl) > 0)"""


def chain_sql(src: str, out: str, keys: str) -> str:
    """Rows of ``src`` (keys, pos, free) in greedy order; recursive."""
    return f"""
{out}_n AS MATERIALIZED (SELECT a.*, b.pos AS nxt FROM {src} a ASOF LEFT JOIN {src} b ON {' AND '.join(f'b.{k} = a.{k}' for k in keys.split(', '))} AND b.pos >= a.free),
{out}_c AS (
  SELECT * FROM (SELECT {keys}, min(pos) AS pos FROM {src} GROUP BY ALL)
  UNION ALL
  SELECT {', '.join('c.' + k for k in keys.split(', '))}, n.nxt FROM {out}_c c JOIN {out}_n n ON {' AND '.join(f'n.{k} = c.{k}' for k in keys.split(', '))} AND n.pos = c.pos WHERE n.nxt IS NOT NULL),
{out} AS (SELECT s.* FROM {src} s JOIN {out}_c USING ({keys}, pos))"""


FILLED = f"""{full_signals(0, swing=True)},
f0 AS (SELECT symbol || '|' || seq AS id, symbol, t, seq, seq + 1 AS start0, CASE WHEN trend_bull THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side, direction, sl, tp, limit_price, structure_swing, atr, zone_type, confidence FROM sig),
f1 AS (SELECT f.id, min(CASE WHEN CASE WHEN side > 0 THEN b.low <= limit_price ELSE b.high >= limit_price END THEN b.seq - start0 END) AS fill,
    min(CASE WHEN CASE WHEN side > 0 THEN b.low < structure_swing ELSE b.high > structure_swing END THEN b.seq - start0 END) AS broken
  FROM f0 f JOIN bars b ON b.symbol = f.symbol AND b.seq BETWEEN start0 AND start0 + 5 GROUP BY ALL),
f2 AS (SELECT f0.*, limit_price AS entry, fill, start0 + fill AS start, 0.9::DOUBLE AS act_ratio, 0.3::DOUBLE AS pct, 0.0002::DOUBLE AS maker FROM f0 JOIN f1 USING (id) WHERE fill IS NOT NULL AND (broken IS NULL OR fill < broken)),
{exits_sql('f2', 'ex', 'greatest(entry * pct / 100, atr * 1.5)')},
cd AS (SELECT *, seq AS pos, CASE WHEN reason = 'Open at data end' THEN 4611686018427387904 ELSE seq + greatest(1, walk_bars + fill) + 1 END AS free FROM ex),
{chain_sql('cd', 'tk', 'symbol')},
eq AS (SELECT *, 100 * product(1 + rho) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS equity FROM tk),
tr AS (SELECT *, floor(equity / (1 + rho) * rho * 1e4 + 0.5) / 1e4 AS pnl,
  (greatest(100, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)) - equity) / greatest(100, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS dd FROM eq)"""


GEOMETRY, GATES, EXECUTION, _ = SWING


def replay_inputs(spark, sf, min_confidence: float = 0.0, context=None) -> tuple[DataFrame, DataFrame]:
    """Signals of the swing preset (30m entries, 4h bias) and the numbered bars."""
    entry, bias = data.bar_pair(spark, sf, "30m")
    enrich = None if context is None else context(spark, sf, entry)
    gates = dc.replace(GATES, min_confidence=min_confidence)
    found = stage(sig.signals(entry, bias, "30m", "4h", gates, GEOMETRY, enrich=enrich), "signals")
    bars = stage(replay.bar_clock(numbered(entry, "30m")), "clock")
    return found, bars


def replayed(spark, sf, context=None, **how) -> DataFrame:
    found, bars = replay_inputs(spark, sf, context=context)
    return replay.simulate(found, bars, EXECUTION, **how)


BARRIER = """lb AS (SELECT x.id, min(CASE WHEN CASE WHEN side > 0 THEN b.high >= tp ELSE b.low <= tp END THEN b.seq - start END) AS won,
    min(CASE WHEN CASE WHEN side > 0 THEN b.low <= sl ELSE b.high >= sl END THEN b.seq - start END) AS lost, max(b.seq - start) AS last_k, max_by(b.close, b.seq) AS mark
  FROM tr x JOIN bars b ON b.symbol = x.symbol AND b.seq BETWEEN start AND start + 287 GROUP BY ALL),
ol AS (SELECT *, CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN -1 WHEN won IS NOT NULL THEN 1 ELSE 0 END AS label FROM lb),
lt AS (SELECT *, CASE label WHEN -1 THEN lost + 1 WHEN 1 THEN won + 1 ELSE last_k + 1 END AS touch FROM ol),
mx AS (SELECT symbol, max(seq) AS last_seq FROM bars GROUP BY 1),
fin AS (SELECT tr.*, label, touch, b.t AS tb_t, floor(side * (CASE label WHEN -1 THEN sl WHEN 1 THEN tp ELSE mark END - entry) / abs(entry - sl) * 1e4 + 0.5) / 1e4 AS tb_r
  FROM tr JOIN lt USING (id) JOIN mx USING (symbol) JOIN bars b ON b.symbol = tr.symbol AND b.seq = least(start + touch, last_seq))"""


REPLAY_TRADES_SQL = f"""{FILLED}, {BARRIER} SELECT symbol, t, direction, zone_type, confidence, CAST(fill AS INT) AS fill, reason, CAST(walk_bars + fill AS INT) AS bars_held, {sql_rd('entry', 4)} AS entry,
      {sql_rd('exit_price', 4)} AS exit_price, {sql_rd('realized_r', 3)} AS realized_r, {sql_rd('pnl', 3)} AS pnl, {sql_rd('equity', 4)} AS equity,
      {sql_rd('equity / (1 + rho) * 0.005 / abs(entry - sl)', 4)} AS qty, CASE WHEN equity / (1 + rho) * rho > 0 THEN 'WIN' ELSE 'LOSS' END AS status,
      label AS tb_label, CAST(touch AS INT) AS tb_bars, {sql_rd('tb_r', 3)} AS tb_r, tb_t FROM fin"""


def shown_trades(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol", t(), "direction", "zone_type", "confidence", F.col("fill").cast("int").alias("fill"),
        F.col("exit_reason").alias("reason"), F.col("bars_held").cast("int").alias("bars_held"), rd("entry", 4).alias("entry"),
        rd("exit_price", 4).alias("exit_price"), rd("realized_r", 3).alias("realized_r"), rd("pnl", 3).alias("pnl"),
        rd("equity", 4).alias("equity"), rd("qty", 4).alias("qty"), "status", F.col("tb_label"),
        F.col("tb_bars_to_touch").alias("tb_bars"), rd("tb_realized_r", 3).alias("tb_r"),
        F.unix_seconds("tb_exit_time").alias("tb_t"),
    )


@query("replay_trades", REPLAY_TRADES_SQL)
def replay_trades(spark, sf):
    return shown_trades(replayed(spark, sf))


@query("replay_trades_blocks", REPLAY_TRADES_SQL)
def replay_trades_blocks(spark, sf):
    """The same with chains cut into short blocks."""
    return shown_trades(replayed(spark, sf, block=32))


METRIC_SQL = f"""count(*) AS n_trades, {sql_rd('avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)', 3)} AS win_rate,
  {sql_rd('(final / 100 - 1) * 100', 2)} AS total_return_pct, {sql_rd('final', 2)} AS final_equity,
  CASE WHEN -sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END) > 0 THEN {sql_rd('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)', 2)} ELSE 'inf'::DOUBLE END AS profit_factor,
  {sql_rd('avg(pnl)', 4)} AS expectancy, {sql_rd('avg(realized_r)', 3)} AS avg_r, {sql_rd('max(dd) * 100', 2)} AS max_drawdown_pct,
  coalesce(CASE WHEN stddev_samp(pnl) > 0 THEN {sql_rd('avg(pnl) / stddev_samp(pnl) * sqrt(count(*))', 2)} END, 0.0::DOUBLE) AS sharpe, {sql_rd('avg(bars_held::DOUBLE)', 1)} AS avg_bars_held"""


@query(
    "replay_metrics",
    f"""{FILLED} SELECT symbol, {METRIC_SQL.replace('final', 'max_by(equity, seq)').replace('AS max_by(equity, seq)_equity', 'AS final_equity').replace('bars_held::DOUBLE', '(walk_bars + fill)::DOUBLE')}, any_value(coalesce(u.n, 0)) AS unfilled_limit_orders
    FROM tr LEFT JOIN (SELECT f0.symbol AS sym, count(*) AS n FROM f0 WHERE f0.id NOT IN (SELECT id FROM f2)
      AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.symbol = f0.symbol AND f0.seq >= tk.seq AND f0.seq < tk.free) GROUP BY 1) u ON u.sym = tr.symbol GROUP BY symbol""",
)
def replay_metrics(spark, sf):
    found, bars = replay_inputs(spark, sf)
    trades, unfilled = replay.simulate_counted(found, bars, EXECUTION, label=False)
    return replay.replay_metrics(trades, EXECUTION, unfilled)


GRID_SQL = f"""{full_signals(35, swing=True)},
s0 AS (SELECT symbol, seq, seq + 1 AS start0, CASE WHEN trend_bull THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side, entry AS close0, sl, tp, limit_price, atr, rr, confidence,
    (CASE WHEN trend_bull THEN bull_fvg ELSE bear_fvg END) AS fvg FROM sig),
s1 AS (SELECT *, unnest([0.25::DOUBLE, 0.35::DOUBLE, 0.5::DOUBLE]) AS retrace FROM s0),
s2 AS (SELECT *, CASE WHEN fvg THEN limit_price WHEN side > 0 THEN greatest(least(close0 - atr * retrace, close0), sl + 0.25 * (close0 - sl))
    ELSE least(greatest(close0 + atr * retrace, close0), sl + 0.25 * (close0 - sl)) END AS entry FROM s1),
s3 AS (SELECT a.symbol, a.seq, a.retrace, min(CASE WHEN CASE WHEN side > 0 THEN b.low <= entry ELSE b.high >= entry END THEN b.seq - start0 END) AS fill
  FROM s2 a LEFT JOIN bars b ON b.symbol = a.symbol AND b.seq BETWEEN start0 AND start0 + 35 GROUP BY ALL),
s4 AS (SELECT 'limit' AS entry_mode, symbol, seq, side, confidence, retrace, entry, sl, entry + (entry - sl) * rr AS tp, fill, start0, 0.0002::DOUBLE AS maker FROM s2 JOIN s3 USING (symbol, seq, retrace)
  UNION ALL SELECT 'market', symbol, seq, side, confidence, retrace, close0 * (1 + side * 0.0002::DOUBLE), sl, tp, 0, start0, 0.00055::DOUBLE FROM s2),
s5 AS (SELECT *, unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS pct FROM s4),
s6 AS (SELECT *, unnest([0.9::DOUBLE, 0.97::DOUBLE]) AS act_ratio FROM s5),
s7 AS (SELECT *, concat_ws('|', entry_mode, symbol, seq, retrace, pct, act_ratio) AS id, start0 + fill AS start, 0.0::DOUBLE AS atr FROM s6 WHERE fill IS NOT NULL),
{exits_sql('s7', 'ge', 'anchor * pct / 100')},
g0 AS (SELECT entry_mode, symbol, seq, retrace, pct, act_ratio, confidence, rho, realized_r, walk_bars + fill AS bars_held,
    CASE WHEN reason = 'Open at data end' THEN 4611686018427387904 ELSE start + greatest(1, walk_bars) + 1 END AS free FROM ge
  UNION ALL SELECT entry_mode, symbol, seq, retrace, pct, act_ratio, confidence, NULL, NULL, NULL, seq + 36 FROM s6 WHERE fill IS NULL),
g1 AS (SELECT *, seq AS pos, unnest([35, 40, 45, 50]) AS min_confidence FROM g0),
g2 AS (SELECT * FROM g1 WHERE confidence >= min_confidence),
{chain_sql('g2', 'gk', 'entry_mode, min_confidence, retrace, pct, act_ratio, symbol')},
g3 AS (SELECT *, 100 * product(1 + rho) OVER (PARTITION BY entry_mode, min_confidence, retrace, pct, act_ratio, symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS eq FROM gk WHERE rho IS NOT NULL),
g4 AS (SELECT *, floor(eq / (1 + rho) * rho * 1e6 + 0.5) / 1e6 AS pnl FROM g3),
g5 AS (SELECT *, 100 + sum(pnl) OVER (PARTITION BY entry_mode, min_confidence, retrace, pct, act_ratio ORDER BY symbol, seq ROWS UNBOUNDED PRECEDING) AS equity FROM g4),
g6 AS (SELECT *, (greatest(100, max(equity) OVER w) - equity) / greatest(100, max(equity) OVER w) AS dd FROM g5
  WINDOW w AS (PARTITION BY entry_mode, min_confidence, retrace, pct, act_ratio ORDER BY symbol, seq ROWS UNBOUNDED PRECEDING))"""


@query(
    "grid_rank",
    f"""{GRID_SQL} SELECT entry_mode, min_confidence, retrace, pct AS trail_pct, act_ratio AS activation,
      {METRIC_SQL.replace('final', 'max_by(equity, (symbol, seq))').replace('AS max_by(equity, (symbol, seq))_equity', 'AS final_equity')}
    FROM g6 GROUP BY ALL HAVING count(*) >= 20 ORDER BY profit_factor DESC, expectancy DESC, 1, 2, 3, 4, 5""",
)
def grid_rank(spark, sf):
    found, bars = replay_inputs(spark, sf, 35.0)
    return replay.grid_ranking(replay.grid_trades(found, bars), 20)
