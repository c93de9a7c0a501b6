"""Queries over forward searches from every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import flag, query, rd, t
from tidemark.catalog.market import PATTERNS, hourly_features
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.operators.forward import first_touch, label_geometry, limit_fills, longest_series, trailing_exits
from tidemark.session import stage

# Every bar with an ATR, on both sides: entry at the close, stop and target in ATRs.
TRY_SQL = f"""{PATTERNS}, d AS (SELECT symbol, t, seq, seq + 1 AS start, close AS entry, atr, unnest([1.0::DOUBLE, -1.0::DOUBLE]) AS side FROM pat WHERE atr > 0),
  sg AS (SELECT *, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, entry - side * atr * 1.5 AS sl, entry + side * atr * 2.5 AS tp,
    entry - side * atr * 0.5 AS lim, entry - side * atr * 1.25 AS inv FROM d)"""


def tries(spark, sf) -> tuple[DataFrame, DataFrame]:
    feats = stage(hourly_features(spark, sf).select("symbol", "ts", "seq", "high", "low", "close", "atr"), "hourly")
    side = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    rows = feats.where("atr > 0").select(
        "symbol", "ts", "seq", (F.col("seq") + 1).alias("start"), F.col("close").alias("entry"), "atr",
        F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("direction"),
    )
    rows = rows.select(
        "*", F.concat_ws("_", "symbol", "seq", "direction").alias("sid"),
        (F.col("entry") - side * F.col("atr") * 1.5).alias("sl"), (F.col("entry") + side * F.col("atr") * 2.5).alias("tp"),
        (F.col("entry") - side * F.col("atr") * 0.5).alias("limit_price"),
        (F.col("entry") - side * F.col("atr") * 1.25).alias("invalidation_price"),
    )
    return rows, feats.select("symbol", "seq", "high", "low", "close")


FILL_SQL = f"""{TRY_SQL}, p AS (SELECT g.symbol, g.t, g.direction,
    min(CASE WHEN CASE WHEN side > 0 THEN b.low <= lim ELSE b.high >= lim END THEN b.seq - start END) AS fill,
    min(CASE WHEN CASE WHEN side > 0 THEN b.low < inv ELSE b.high > inv END THEN b.seq - start END) AS broken
  FROM sg g JOIN bars b ON b.symbol = g.symbol AND b.seq BETWEEN g.start AND g.start + 35 GROUP BY ALL)"""


@query("limit_fill", f"{FILL_SQL} SELECT symbol, t, direction, CAST(fill AS INT) AS fill FROM p WHERE fill IS NOT NULL AND (broken IS NULL OR fill < broken)")
def limit_fill(spark, sf):
    rows, bars = tries(spark, sf)
    return rows.join(limit_fills(rows, bars, 36), "sid").select("symbol", t(), "direction", "fill")


@query("limit_fill_plain", f"{FILL_SQL} SELECT symbol, t, direction, CAST(fill AS INT) AS fill FROM p WHERE fill IS NOT NULL")
def limit_fill_plain(spark, sf):
    rows, bars = tries(spark, sf)
    return rows.join(limit_fills(rows, bars, 36, invalidate=False), "sid").select("symbol", t(), "direction", "fill")


def barrier_sql(horizon: int, profit: str, stop: str) -> str:
    return f"""{TRY_SQL}, q AS (SELECT *, {profit} AS pp, {stop} AS sp FROM sg),
  p AS (SELECT g.symbol, g.t, g.direction, g.side, g.entry, g.pp, g.sp,
      min(CASE WHEN CASE WHEN side > 0 THEN b.high >= pp ELSE b.low <= pp END THEN b.seq - start END) AS won,
      min(CASE WHEN CASE WHEN side > 0 THEN b.low <= sp ELSE b.high >= sp END THEN b.seq - start END) AS lost,
      max(b.seq - start) AS last_k, max_by(b.close, b.seq) AS mark
    FROM q g LEFT JOIN bars b ON b.symbol = g.symbol AND b.seq BETWEEN g.start AND g.start + {horizon - 1} GROUP BY ALL),
  o AS (SELECT *, CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN -1 WHEN won IS NOT NULL THEN 1 ELSE 0 END AS label FROM p),
  r AS (SELECT *, CASE label WHEN -1 THEN sp WHEN 1 THEN pp ELSE coalesce(mark, entry) END AS price FROM o)
  SELECT symbol, t, direction, label, CASE label WHEN -1 THEN 'stop' WHEN 1 THEN 'profit' ELSE 'vertical' END AS barrier,
    CAST(CASE label WHEN -1 THEN lost + 1 WHEN 1 THEN won + 1 ELSE coalesce(last_k + 1, 0) END AS INT) AS bars,
    {sql_rd('price', 4)} AS price, {sql_rd('side * (price - entry) / abs(entry - sp)', 3)} AS r,
    CASE WHEN label = -1 AND won = lost THEN 1 ELSE 0 END AS ambiguous FROM r"""


def barrier_rows(rows, bars, horizon):
    out = rows.join(first_touch(rows, bars, horizon), "sid")
    return out.select(
        "symbol", t(), "direction", F.col("tb_label").alias("label"), F.col("tb_barrier").alias("barrier"),
        F.col("tb_bars_to_touch").alias("bars"), rd("tb_touch_price", 4).alias("price"), rd("tb_realized_r", 3).alias("r"),
        flag(F.col("tb_ambiguous")).alias("ambiguous"),
    )


def unrounded_r(sql: str) -> str:
    """The operator rounds R to four places first; so does the check."""
    return sql.replace("side * (price - entry) / abs(entry - sp)", "floor(side * (price - entry) / abs(entry - sp) * 1e4 + 0.5) / 1e4")


@query("triple_barrier", unrounded_r(barrier_sql(48, "tp", "sl")))
def triple_barrier(spark, sf):
    rows, bars = tries(spark, sf)
    return barrier_rows(label_geometry(rows), bars, 48)


@query("triple_barrier_atr", unrounded_r(barrier_sql(24, "entry + side * atr * 3", "entry - side * atr * 1")))
def triple_barrier_atr(spark, sf):
    rows, bars = tries(spark, sf)
    return barrier_rows(label_geometry(rows, 3.0, 1.0), bars, 24)


def exit_sql(dist: str) -> str:
    return f"""{TRY_SQL},
  a AS (SELECT *, entry + (tp - entry) * 0.9 AS act FROM sg),
  k AS (SELECT a.symbol, a.seq, a.side, min(CASE WHEN CASE WHEN side > 0 THEN b.low <= sl ELSE b.high >= sl END THEN b.seq END) AS k_sl,
      min(CASE WHEN CASE WHEN side > 0 THEN b.high >= act ELSE b.low <= act END THEN b.seq END) AS k_act, max(b.seq) AS k_end, max_by(b.close, b.seq) AS c_end
    FROM a JOIN bars b ON b.symbol = a.symbol AND b.seq >= a.start GROUP BY ALL),
  m AS (SELECT a.*, k.k_sl, k.k_act, k.k_end, k.c_end, (k_act IS NOT NULL AND (k_sl IS NULL OR k_act < k_sl)) AS trails FROM a JOIN k USING (symbol, seq, side)),
  w AS (SELECT m.symbol, m.seq, m.side, b.seq AS s, b.high, b.low, m.atr, CASE WHEN m.side > 0
      THEN max(b.high) OVER (PARTITION BY m.symbol, m.seq, m.side ORDER BY b.seq) ELSE min(b.low) OVER (PARTITION BY m.symbol, m.seq, m.side ORDER BY b.seq) END AS anchor
    FROM m JOIN bars b ON b.symbol = m.symbol AND b.seq >= m.k_act WHERE m.trails),
  x AS (SELECT symbol, seq, side, min(s) AS k_tr, min_by(anchor - side * ({dist}), s) AS p_tr FROM w
    WHERE CASE WHEN side > 0 THEN low <= anchor - side * ({dist}) ELSE high >= anchor - side * ({dist}) END GROUP BY ALL)
  SELECT m.symbol, m.t, m.direction, CASE WHEN trails AND k_tr IS NOT NULL THEN 'Trailing Stop Hit' WHEN NOT trails AND k_sl IS NOT NULL THEN 'Stop Loss Hit' ELSE 'Open at data end' END AS reason,
    CAST(CASE WHEN trails AND k_tr IS NOT NULL THEN k_tr WHEN NOT trails AND k_sl IS NOT NULL THEN k_sl ELSE k_end END - start + 1 AS INT) AS bars_held,
    {sql_rd('CASE WHEN trails AND k_tr IS NOT NULL THEN p_tr WHEN NOT trails AND k_sl IS NOT NULL THEN sl ELSE c_end END', 4)} AS exit_price
  FROM m LEFT JOIN x USING (symbol, seq, side)"""


def exits(spark, sf, dist, **buckets) -> DataFrame:
    rows, bars = tries(spark, sf)
    rows = rows.select("*", F.lit(0.3).alias("trail_pct"), F.lit(0.9).alias("activation"), dist.alias("trail_dist"))
    out = rows.join(trailing_exits(rows, bars, longest_series(bars), **buckets), "sid")
    return out.select(
        "symbol", t(), "direction", F.col("exit_reason").alias("reason"), "bars_held", rd("exit_price", 4).alias("exit_price")
    )


@query("exit_trailing", exit_sql("anchor * 0.3 / 100"))
def exit_trailing(spark, sf):
    return exits(spark, sf, F.lit(None).cast("double"))


@query("exit_trailing_atr", exit_sql("atr * 1.5"))
def exit_trailing_atr(spark, sf):
    return exits(spark, sf, F.col("atr") * 1.5)


@query("exit_trailing_far", exit_sql("anchor * 0.3 / 100"))
def exit_trailing_far(spark, sf):
    """The same over short buckets, so that late exits are found by skipping ahead."""
    return exits(spark, sf, F.lit(None).cast("double"), first_bucket=8, largest_bucket=32)
