"""Queries over the trade ledger that ``orders`` stands in for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import data
from tidemark.catalog.base import flag, query, rd
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.functions import economics as eco
from tidemark.functions.symbols import fresh_symbols
from tidemark.operators import ledger as led
from tidemark.params import Portfolio
from tidemark.plans.admission import admit, admit_in_turn
from tidemark.plans.corpus import backfill
from tidemark.sources.store import latest_values

BASES = "'BTC','ETH','SOL','XRP','ADA','LINK','AVAX','NEAR','ATOM','ALGO'"

LEDGER_SQL = f"""led AS (SELECT o_orderkey AS seq, o_custkey, (list_value({BASES}))[o_custkey % 10 + 1] || (o_custkey // 10) || 'USDT' AS symbol,
    CASE o_orderstatus WHEN 'F' THEN 'WIN' WHEN 'P' THEN 'LOSS' ELSE 'OPEN' END AS status,
    CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, o_totalprice / 1000 AS entry,
    o_totalprice / 1000 * (1 - (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * 0.02::DOUBLE) AS sl,
    o_totalprice / 1000 * (1 + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * 0.035::DOUBLE) AS tp,
    (1 + o_orderkey % 5)::DOUBLE AS qty,
    CASE WHEN o_orderkey % 50 <> 7 THEN floor(o_totalprice / 10000) * CASE o_orderstatus WHEN 'F' THEN 0.25::DOUBLE WHEN 'P' THEN -0.125::DOUBLE ELSE 0 END END AS pnl,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS ts, o_totalprice, o_orderpriority,
    CASE WHEN o_orderkey % 3 = 0 THEN 'backtest' ELSE 'live' END AS source,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'volatile' WHEN '2-HIGH' THEN 'trending' ELSE 'ranging' END AS market_regime,
    (o_orderkey * 37 % 101)::DOUBLE AS prob, (60 + o_orderkey % 41) AS confidence FROM orders)"""
CLOSED_SQL = f"{LEDGER_SQL}, cl AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n, (status = 'WIN') AS won FROM led WHERE status IN ('WIN', 'LOSS'))"


def ledger(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    side = F.when(k % 2 == 0, 1).otherwise(-1)
    entry = F.col("o_totalprice") / 1000
    scale = F.when(F.col("o_orderstatus") == "F", 0.25).when(F.col("o_orderstatus") == "P", -0.125).otherwise(0.0)
    ts = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 24) * 3600)
    return data.table(spark, sf, "orders").select(
        k.alias("seq"), "o_custkey",
        F.expr(f"concat(element_at(array({BASES}), cast(o_custkey % 10 + 1 as int)), o_custkey div 10, 'USDT')").alias("symbol"),
        F.expr("case o_orderstatus when 'F' then 'WIN' when 'P' then 'LOSS' else 'OPEN' end").alias("status"),
        F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), entry.alias("entry"),
        (entry * (1 - side * 0.02)).alias("sl"), (entry * (1 + side * 0.035)).alias("tp"),
        (1 + k % 5).cast("double").alias("qty"),
        F.when(k % 50 != 7, F.floor(F.col("o_totalprice") / 10000) * scale).alias("pnl"),
        ts.alias("ts"), ts.alias("exit_time"), F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"), "o_totalprice",
        "o_orderpriority", F.when(k % 3 == 0, "backtest").otherwise("live").alias("source"),
        F.expr("case o_orderpriority when '1-URGENT' then 'volatile' when '2-HIGH' then 'trending' else 'ranging' end").alias("market_regime"),
        (k * 37 % 101).cast("double").alias("prob"), (60 + k % 41).alias("confidence"),
    )


def closed(spark, sf) -> DataFrame:
    return ledger(spark, sf).where(led.is_closed())


# ------------------------------------------------------------------ form


@query(
    "ledger_context",
    f"""WITH {CLOSED_SQL}, a AS (SELECT *, avg(won::INT::DOUBLE) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rate,
      sum(coalesce(pnl, 0)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS cum, list(coalesce(pnl, 0)) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS l
      FROM cl WINDOW w AS (ORDER BY seq))
    SELECT seq, CASE WHEN n < 5 THEN 0.5::DOUBLE ELSE {sql_rd('rate')} END AS recent_win_rate, CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE {sql_rd('cum')} END AS cumulative_pnl,
      CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE {sql_rd('list_max(list_transform(range(1, len(l) + 1), lambda j: -coalesce(list_sum(l[j+1:]), 0)))')} END AS current_dd FROM a""",
)
def ledger_context(spark, sf):
    df = led.with_context(closed(spark, sf))
    return df.select("seq", rd("recent_win_rate").alias("recent_win_rate"), rd("cumulative_pnl").alias("cumulative_pnl"), rd("current_dd_abs").alias("current_dd"))


@query(
    "streaks",
    f"""WITH {CLOSED_SQL}, g AS (SELECT *, n - row_number() OVER (PARTITION BY won ORDER BY seq) AS island FROM cl),
      r AS (SELECT seq, n, won, row_number() OVER (PARTITION BY won, island ORDER BY seq) AS run FROM g),
      p AS (SELECT seq, n, lag(CASE WHEN won THEN run ELSE -run END) OVER (ORDER BY seq) AS streak FROM r)
    SELECT seq, CAST(CASE WHEN n < 5 THEN 0 ELSE streak END AS INT) AS streak_count FROM p""",
)
def streaks(spark, sf):
    return led.with_context(closed(spark, sf)).select("seq", "streak_count")


@query(
    "symbol_form",
    f"""WITH {CLOSED_SQL} SELECT seq, symbol, CASE WHEN count(*) OVER w >= 3 THEN {sql_rd('avg(won::INT::DOUBLE) OVER w')} ELSE 0.5::DOUBLE END AS win_rate FROM cl
    WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def symbol_form(spark, sf):
    return led.with_symbol_form(closed(spark, sf)).select("seq", "symbol", rd("symbol_win_rate").alias("win_rate"))


@query(
    "drawdown",
    f"""WITH {CLOSED_SQL}, e AS (SELECT seq, 1000 + sum(coalesce(pnl, 0)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS equity FROM cl),
      d AS (SELECT *, greatest(1000, max(equity) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
    SELECT seq, {sql_rd('equity', 4)} AS equity, {sql_rd('(peak - equity) / peak')} AS drawdown FROM d""",
)
def drawdown(spark, sf):
    from tidemark.operators.blocks import running
    from tidemark.operators.performance import drawdowns

    chunk = {"_chunk": F.expr(f"seq div {led.LEDGER_CHUNK}")}
    rows = running(closed(spark, sf), [], chunk, ["seq"], {"s": (F.coalesce("pnl", F.lit(0.0)), "sum")})
    rows = rows.withColumn("equity", F.col("s") + 1000)
    return drawdowns(rows, [], ["seq"], chunk, "equity", 1000.0).select("seq", rd("equity", 4).alias("equity"), rd("drawdown").alias("drawdown"))


# ------------------------------------------------------------------ diagnostics

CUBE_SQL = f"""WITH {CLOSED_SQL}, s AS (SELECT *, CASE WHEN hour(ts) BETWEEN 7 AND 11 THEN 'london' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'ny'
    WHEN hour(ts) BETWEEN 17 AND 21 THEN 'quiet' ELSE 'asian' END AS session, CAST(isodow(ts) - 1 AS VARCHAR) AS dow FROM cl),
  c AS (SELECT CASE WHEN grouping(session) = 0 THEN 'session' WHEN grouping(dow) = 0 THEN 'day_of_week' WHEN grouping(market_regime) = 0 THEN 'market_regime'
      WHEN grouping(symbol) = 0 THEN 'symbol' ELSE 'overall' END AS dimension, coalesce(session, dow, market_regime, symbol, 'all') AS bucket,
    {sql_rd('avg(won::INT::DOUBLE)', 3)} AS win_rate, count(*) AS n FROM s GROUP BY GROUPING SETS ((session), (dow), (market_regime), (symbol), ())
    HAVING count(*) >= 3 OR (grouping(session) + grouping(dow) + grouping(market_regime) + grouping(symbol) = 4))"""


@query("diagnostics_cube", f"{CUBE_SQL} SELECT dimension, bucket, win_rate, n FROM c")
def diagnostics_cube(spark, sf):
    return led.diagnostics(closed(spark, sf)).select("dimension", "bucket", "win_rate", "n")


@query(
    "best_worst",
    f"{CUBE_SQL} SELECT dimension, max_by(bucket, (win_rate, bucket)) AS best, min_by(bucket, (win_rate, bucket)) AS worst FROM c WHERE dimension <> 'overall' GROUP BY 1",
)
def best_worst(spark, sf):
    return led.best_and_worst(led.diagnostics(closed(spark, sf)))


@query(
    "symbol_extremes",
    f"""{CUBE_SQL}, y AS (SELECT * FROM c WHERE dimension = 'symbol') SELECT * FROM (SELECT bucket, win_rate, 'top' AS side FROM y ORDER BY win_rate DESC, bucket LIMIT 5)
    UNION ALL SELECT * FROM (SELECT bucket, win_rate, 'bottom' AS side FROM y ORDER BY win_rate, bucket DESC LIMIT 5)""",
)
def symbol_extremes(spark, sf):
    stats = led.diagnostics(closed(spark, sf)).where(F.col("dimension") == "symbol")
    return led.extremes(stats, "win_rate", "bucket", 5).select("bucket", "win_rate", "side")


# ------------------------------------------------------------------ exposure, balance, gates

MAJOR_SQL = "symbol IN ('BTCUSDT', 'ETHUSDT', 'SOLUSDT', 'BNBUSDT')"


@query(
    "portfolio_heat",
    f"""WITH {LEDGER_SQL} SELECT o_custkey % 25 AS account, {sql_rd('sum(abs(entry - sl) * qty)', 3)} AS heat, count_if(direction = 'LONG')::BIGINT AS longs,
      count_if(direction = 'SHORT')::BIGINT AS shorts, count_if(NOT ({MAJOR_SQL}))::BIGINT AS alts, count(*) AS active FROM led WHERE status = 'OPEN' GROUP BY 1""",
)
def portfolio_heat(spark, sf):
    df = ledger(spark, sf).withColumn("account", F.col("o_custkey") % 25)
    return led.exposure(df, ["account"]).withColumn("heat", rd("heat", 3))


ADMIT_SQL = f"""WITH RECURSIVE {LEDGER_SQL}, d AS (SELECT *, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS scan FROM led),
  cand AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY confidence DESC, seq) AS place, NOT ({MAJOR_SQL}) AS alt, abs(entry - sl) * qty AS risk FROM d WHERE status = 'OPEN'),
  top AS (SELECT * FROM cand WHERE place <= 3),
  book AS (SELECT scan, symbol, direction, abs(entry - sl) * qty AS risk, NOT ({MAJOR_SQL}) AS alt FROM d WHERE status = 'LOSS'),
  st AS (SELECT scan, count_if(direction = 'LONG') AS longs, count_if(direction = 'SHORT') AS shorts, count_if(alt) AS alts, count(*) AS active, sum(risk) AS heat, list(symbol) AS names FROM book GROUP BY 1),
  f AS (SELECT t.scan, 0::BIGINT AS place, NULL::BIGINT AS seq, NULL::VARCHAR AS verdict, coalesce(longs, 0)::BIGINT AS longs, coalesce(shorts, 0)::BIGINT AS shorts, coalesce(alts, 0)::BIGINT AS alts,
      coalesce(active, 0)::BIGINT AS active, coalesce(heat, 0) AS heat, coalesce(names, []::VARCHAR[]) AS names FROM (SELECT DISTINCT scan FROM top) t LEFT JOIN st USING (scan)
    UNION ALL
    SELECT scan, place, seq, v, longs + CASE WHEN v = 'ok' AND direction = 'LONG' THEN 1 ELSE 0 END, shorts + CASE WHEN v = 'ok' AND direction = 'SHORT' THEN 1 ELSE 0 END,
      alts + CASE WHEN v = 'ok' AND alt THEN 1 ELSE 0 END, active + CASE WHEN v = 'ok' THEN 1 ELSE 0 END, heat + CASE WHEN v = 'ok' THEN risk ELSE 0 END,
      CASE WHEN v = 'ok' THEN list_append(names, symbol) ELSE names END
    FROM (SELECT f.scan, t.place, t.seq, t.direction, t.alt, t.risk, t.symbol, f.longs, f.shorts, f.alts, f.active, f.heat, f.names,
        CASE WHEN f.active >= 10 THEN 'max open' WHEN list_contains(f.names, t.symbol) THEN 'symbol' WHEN CASE WHEN t.direction = 'LONG' THEN f.longs ELSE f.shorts END >= 2 THEN 'direction'
          WHEN t.alt AND f.alts >= 4 THEN 'alts' WHEN f.heat + t.risk > 5000 * 5.0 / 100 THEN 'heat' ELSE 'ok' END AS v
      FROM f JOIN top t ON t.scan = f.scan AND t.place = f.place + 1))"""


@query("admission", f"{ADMIT_SQL} SELECT scan, seq, CAST(place AS INT) AS place, verdict FROM f WHERE place > 0")
def admission(spark, sf):
    df = ledger(spark, sf).withColumn("scan", F.unix_seconds(F.date_trunc("day", "ts"))).withColumn("rank", F.col("seq"))
    book = df.where(F.col("status") == "LOSS").withColumn("status", F.lit("OPEN"))
    out = admit(df.where(F.col("status") == "OPEN"), book, "scan", 5000.0, Portfolio(per_direction=2, alts=4))
    return out.select("scan", "seq", "place", "verdict")


_BOOK = Portfolio(per_direction=4, alts=6)
EVOLVING_SQL = f"""WITH RECURSIVE {LEDGER_SQL}, d AS (SELECT *, o_custkey % 2 AS account, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS scan FROM led),
  r AS (SELECT *, row_number() OVER (PARTITION BY account, scan ORDER BY confidence DESC, seq) AS place FROM d),
  n AS MATERIALIZED (SELECT account, scan, place, seq, symbol, direction, scan + (1 + seq % 5) * 86400 AS until, abs(entry - sl) * qty AS risk, NOT ({MAJOR_SQL}) AS alt,
      row_number() OVER (PARTITION BY account ORDER BY scan, place) AS k FROM r WHERE place <= 3),
  f AS (SELECT account, 0::BIGINT AS k, NULL::BIGINT AS scan, NULL::BIGINT AS seq, 0::BIGINT AS place, NULL::VARCHAR AS verdict,
      []::STRUCT(until BIGINT, symbol VARCHAR, direction VARCHAR, risk DOUBLE, alt BOOLEAN)[] AS book FROM (SELECT DISTINCT account FROM n)
    UNION ALL
    SELECT account, k, scan, seq, place, v, CASE WHEN v = 'ok' THEN list_append(held, {{'until': until, 'symbol': symbol, 'direction': direction, 'risk': risk, 'alt': alt}}) ELSE held END
    FROM (SELECT *, CASE WHEN len(held) >= 6 THEN 'max open' WHEN len(list_filter(held, lambda x: x.symbol = h.symbol)) > 0 THEN 'symbol'
        WHEN len(list_filter(held, lambda x: x.direction = h.direction)) >= {_BOOK.per_direction} THEN 'direction' WHEN alt AND len(list_filter(held, lambda x: x.alt)) >= {_BOOK.alts} THEN 'alts'
        WHEN coalesce(list_sum(list_transform(held, lambda x: x.risk)), 0) + risk > 1000 * 5.0 / 100 THEN 'heat' ELSE 'ok' END AS v
      FROM (SELECT n.*, list_filter(f.book, lambda x: x.until > n.scan) AS held FROM f JOIN n ON n.account = f.account AND n.k = f.k + 1) h))"""


@query("admission_book", f"{EVOLVING_SQL} SELECT account, scan, seq, CAST(place AS INT) AS place, verdict FROM f WHERE k > 0")
def admission_book(spark, sf):
    """Two accounts over all days, positions held one to five days: what a scan accepts counts in the next ones."""
    df = ledger(spark, sf).withColumn("scan", F.unix_seconds(F.date_trunc("day", "ts"))).withColumn("rank", F.col("seq"))
    df = df.withColumn("until", F.col("scan") + (1 + F.col("seq") % 5) * 86400).withColumn("account", F.col("o_custkey") % 2)
    out = admit_in_turn(df, "scan", "until", 1000.0, _BOOK, 6, by=["account"], span=128 * 86400)
    return out.select("account", "scan", "seq", "place", "verdict")


@query(
    "daily_pnl",
    f"WITH {CLOSED_SQL} SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, {sql_rd('sum(pnl)', 4)} AS pnl, count(*) AS trades FROM cl GROUP BY 1",
)
def daily_pnl(spark, sf):
    df = led.daily_pnl(closed(spark, sf))
    return df.select((F.unix_date("day").cast("long") * 86400).alias("day"), rd("pnl", 4).alias("pnl"), "trades")


@query("balance", f"WITH {CLOSED_SQL} SELECT {sql_rd('100 + sum(pnl)', 3)} AS balance FROM cl")
def balance(spark, sf):
    return led.balance(closed(spark, sf), 100.0).select(rd("balance", 3).alias("balance"))


@query(
    "daily_breaker",
    f"""WITH {CLOSED_SQL}, p AS (SELECT seq, coalesce(sum(pnl) OVER (PARTITION BY date_trunc('day', ts) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM cl)
    SELECT seq, {sql_rd('d', 4)} AS day_pnl, CASE WHEN d > -15 THEN 1 ELSE 0 END AS allowed FROM p""",
)
def daily_breaker(spark, sf):
    df = led.trading_allowed(closed(spark, sf), "seq", "ts")
    return df.select("seq", rd("day_pnl", 4).alias("day_pnl"), flag(F.col("allowed")).alias("allowed"))


@query(
    "trade_counts",
    f"""WITH {LEDGER_SQL} SELECT count_if(status <> 'OPEN' AND source <> 'backtest') + count_if(status = 'OPEN') + 1 AS next_no,
      count_if(status <> 'OPEN' AND source <> 'backtest') AS n_real, count_if(status <> 'OPEN' AND source = 'backtest') AS n_backtest FROM led""".replace(
        "count_if(status <> 'OPEN' AND source <> 'backtest') + count_if(status = 'OPEN') + 1",
        "(count_if(status <> 'OPEN' AND source <> 'backtest') + count_if(status = 'OPEN') + 1)::BIGINT",
    ).replace("'backtest') AS n_real", "'backtest')::BIGINT AS n_real").replace("'backtest') AS n_backtest", "'backtest')::BIGINT AS n_backtest"),
)
def trade_counts(spark, sf):
    whole = ledger(spark, sf)
    return led.trade_counts(whole.where(led.is_closed()), whole.where(led.is_active()))


# ------------------------------------------------------------------ joins

NOW = "2001-07-20 00:00:00"


@query(
    "cooldown",
    f"""WITH {CLOSED_SQL}, u AS (SELECT symbol, max(ts) + INTERVAL 120 MINUTE AS until FROM cl GROUP BY 1)
    SELECT symbol, CAST(epoch(until) AS BIGINT) AS until, CASE WHEN until > TIMESTAMP '{NOW}' THEN 1 ELSE 0 END AS cooling FROM u""",
)
def cooldown(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    df = led.cooldowns(closed(spark, sf))
    return df.select("symbol", F.unix_seconds("until").alias("until"), flag(F.col("until") > now).alias("cooling"))


@query(
    "eligible_symbols",
    f"""WITH {LEDGER_SQL}, u AS (SELECT symbol, sum(o_totalprice) AS v FROM led GROUP BY 1)
    SELECT symbol, {sql_rd('v', 2)} AS volume FROM u WHERE symbol NOT IN (SELECT symbol FROM led WHERE status = 'OPEN' AND ts >= TIMESTAMP '2001-01-01')
      AND symbol NOT IN (SELECT symbol FROM led WHERE status <> 'OPEN' GROUP BY 1 HAVING max(ts) + INTERVAL 10 DAY > TIMESTAMP '2001-07-30') ORDER BY v DESC, symbol LIMIT 30""",
)
def eligible_symbols(spark, sf):
    whole = ledger(spark, sf)
    names = whole.groupBy("symbol").agg(F.sum("o_totalprice").alias("volume"))
    active = whole.where(led.is_active() & (F.col("ts") >= F.lit("2001-01-01").cast("timestamp")))
    cooling = led.cooling_at(whole.where(led.is_closed()), F.lit("2001-07-30").cast("timestamp"), minutes=14400)
    out = fresh_symbols(names, active, cooling, [F.desc("volume"), "symbol"], 30)
    return out.select("symbol", rd("volume", 2).alias("volume"))


@query(
    "dup_signals",
    f"""WITH {LEDGER_SQL}, h AS (SELECT seq, symbol || '_' || CAST(CAST(epoch(ts) AS BIGINT) // 86400 AS VARCHAR) || '_' || direction AS signal_hash, status FROM led)
    SELECT seq, signal_hash FROM h WHERE status = 'OPEN' AND signal_hash NOT IN (SELECT signal_hash FROM h WHERE status <> 'OPEN')""",
)
def dup_signals(spark, sf):
    day = F.expr("unix_seconds(ts) div 86400")
    rows = ledger(spark, sf).withColumn("signal_hash", F.concat_ws("_", "symbol", day, "direction"))
    fresh = led.new_signals(rows.where(led.is_active()), rows.where(led.is_closed()))
    return fresh.select("seq", "signal_hash")


@query(
    "trade_exists",
    f"WITH {LEDGER_SQL} SELECT DISTINCT symbol FROM led a WHERE EXISTS (SELECT 1 FROM led b WHERE b.symbol = a.symbol AND b.status = 'OPEN')",
)
def trade_exists(spark, sf):
    rows = ledger(spark, sf)
    return led.symbols_with_open(rows.select("symbol").distinct(), rows)


@query(
    "reconcile",
    f"""WITH {LEDGER_SQL}, o AS (SELECT * FROM led WHERE status = 'OPEN'), pos AS (SELECT symbol FROM led WHERE status = 'OPEN' GROUP BY 1 HAVING sum(qty) > 20),
      rec AS (SELECT symbol, max_by(entry, seq) AS exit_price, max_by(CASE WHEN seq % 4 <> 0 THEN o_totalprice / 5000 - 40 END, seq) AS realized FROM led WHERE status = 'WIN' AND o_custkey % 3 <> 0 GROUP BY 1),
      j AS (SELECT o.*, coalesce(nullif(rec.exit_price, 0), tp, entry) AS px, rec.realized FROM o LEFT JOIN rec USING (symbol) WHERE o.symbol NOT IN (SELECT symbol FROM pos)),
      k AS (SELECT *, coalesce(realized, floor(CASE WHEN direction = 'LONG' THEN px - entry ELSE entry - px END * qty * 1e4 + 0.5) / 1e4) AS p FROM j)
    SELECT seq, symbol, {sql_rd('px', 4)} AS exit_price, {sql_rd('p', 2)} AS pnl, CASE WHEN p > 0 THEN 'WIN' ELSE 'LOSS' END AS status, CASE WHEN realized IS NULL THEN 1 ELSE 0 END AS approx FROM k""".replace(
        "max_by(CASE WHEN seq % 4 <> 0 THEN o_totalprice / 5000 - 40 END, seq) AS realized",
        "(max_by({'v': CASE WHEN seq % 4 <> 0 THEN o_totalprice / 5000 - 40 END}, seq)).v AS realized",
    ),
)
def reconcile(spark, sf):
    rows = ledger(spark, sf)
    open_rows = rows.where(led.is_active())
    positions = open_rows.groupBy("symbol").agg(F.sum("qty").alias("q")).select("symbol", F.when(F.col("q") > 20, F.col("q")).otherwise(0.0).alias("size"))
    records = rows.where((F.col("status") == "WIN") & (F.col("o_custkey") % 3 != 0)).select(
        "symbol", F.col("entry").alias("exit_price"),
        F.when(F.col("seq") % 4 != 0, F.col("o_totalprice") / 5000 - 40).alias("realized_pnl"), F.col("seq").alias("closed_at"),
    )
    out = led.reconcile(rows, positions, records)
    return out.select("seq", "symbol", rd("exit_price", 4).alias("exit_price"), "pnl", "status", flag(F.col("approx")).alias("approx"))


# ------------------------------------------------------------------ tails, top-k, unions


@query(
    "topk_signals",
    f"""WITH {LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY confidence DESC, seq) AS place FROM led WHERE status = 'OPEN')
    SELECT seq, symbol, confidence, CAST(place AS INT) AS place FROM r WHERE place <= 3""",
)
def topk_signals(spark, sf):
    rows = ledger(spark, sf).where(led.is_active()).withColumn("scan", F.to_date("ts"))
    return led.top_signals(rows, "scan", "seq").select("seq", "symbol", "confidence", "place")


@query("rolling_tail", f"WITH {LEDGER_SQL} SELECT seq, symbol, status FROM led WHERE status <> 'OPEN' ORDER BY seq DESC LIMIT 220")
def rolling_tail(spark, sf):
    return led.last_rows(closed(spark, sf), 220).select("seq", "symbol", "status")


@query(
    "backfill_union",
    f"""WITH {CLOSED_SQL}, b AS (SELECT seq, symbol, ts, 'backtest' AS source, 0 AS place FROM cl WHERE source = 'backtest' ORDER BY ts DESC, seq DESC LIMIT 150)
    SELECT seq, symbol, source, place FROM b UNION ALL SELECT seq, symbol, source, 1 FROM cl WHERE source <> 'backtest'""",
)
def backfill_union(spark, sf):
    rows = closed(spark, sf)
    simulated = led.tagged_backfill(rows.where(F.col("source") == "backtest"), 150, "ts")
    return led.with_backfill(rows, simulated, replace=True).select("seq", "symbol", "source", "place")


@query(
    "backfill_twice",
    f"""WITH {CLOSED_SQL}, b AS (SELECT seq, symbol, ts, 'backtest' AS source, 0 AS place FROM cl WHERE source = 'backtest' ORDER BY ts DESC, seq DESC LIMIT 150)
    SELECT seq, symbol, source, place FROM b UNION ALL SELECT seq, symbol, source, 1 FROM cl WHERE source <> 'backtest'""",
)
def backfill_twice(spark, sf):
    """A ledger without simulated rows gets them once; the second run adds nothing."""
    rows = closed(spark, sf).withColumn("entry_time", F.col("ts"))
    simulated = rows.where(F.col("source") == "backtest")
    once = backfill(rows.where(F.col("source") != "backtest"), simulated)
    return backfill(once.drop("place"), simulated).select("seq", "symbol", "source", "place")


@query(
    "latest_values",
    f"WITH {LEDGER_SQL} SELECT symbol, max_by(status, seq) AS status, {sql_rd('max_by(entry, seq)', 4)} AS entry, max(seq) AS seq FROM led GROUP BY 1",
)
def latest(spark, sf):
    out = latest_values(ledger(spark, sf).select("symbol", "status", "entry", "seq"), ["symbol"], "seq")
    return out.select("symbol", "status", rd("entry", 4).alias("entry"), "seq")


# ------------------------------------------------------------------ economics


@query(
    "realized_r",
    f"""WITH {LEDGER_SQL}, e AS (SELECT *, entry * (1 + (seq % 9 - 4) * 0.01::DOUBLE) AS px FROM led)
    SELECT seq, CASE WHEN abs(entry - sl) > 0 THEN {sql_rd("(CASE WHEN direction = 'LONG' THEN px - entry ELSE entry - px END) / abs(entry - sl)", 4)} ELSE 0 END AS r FROM e""",
)
def realized_r(spark, sf):
    df = ledger(spark, sf).withColumn("px", F.col("entry") * (1 + (F.col("seq") % 9 - 4) * 0.01))
    return df.select("seq", eco.realized_r("direction", "entry", "sl", "px").alias("r"))


@query(
    "position_sizing",
    f"""WITH {LEDGER_SQL}, q AS (SELECT *, CASE WHEN prob >= 80 THEN 1.0::DOUBLE WHEN prob >= 70 THEN 0.5::DOUBLE * 1.6::DOUBLE WHEN prob >= 60 THEN 0.5::DOUBLE * 1.2::DOUBLE ELSE 0.5::DOUBLE * 0.6::DOUBLE END
        * CASE WHEN seq % 13 > 5 THEN 0.6::DOUBLE ELSE 1 END * CASE market_regime WHEN 'volatile' THEN 0.75::DOUBLE WHEN 'trending' THEN 1.15::DOUBLE ELSE 1 END AS raw FROM led),
      p AS (SELECT *, {sql_rd('greatest(0.2::DOUBLE, least(2.5::DOUBLE, raw))', 2)} AS risk_pct, {sql_rd('1000.0::DOUBLE * 0.5 / 100', 2)} AS amount FROM q),
      s AS (SELECT *, floor(least(amount * (risk_pct / 0.5), amount * (2.5::DOUBLE / 0.5)) / abs(entry - sl) / 0.001::DOUBLE + 0.5) * 0.001::DOUBLE AS sq FROM p)
    SELECT seq, risk_pct, {sql_rd('least(amount / (1 + 0.0002::DOUBLE) / abs(entry - sl), 10000.0::DOUBLE / entry)', 6)} AS paper_qty,
      CASE WHEN sq >= 0.5 THEN {sql_rd('least(sq, 3.0::DOUBLE)', 6)} END AS scaled_qty FROM s""",
)
def position_sizing(spark, sf):
    dd = (F.col("seq") % 13).cast("double")
    return ledger(spark, sf).select(
        "seq", eco.ai_risk_pct("prob", dd, "market_regime").alias("risk_pct"),
        eco.position_qty("entry", "sl", F.lit(1000.0)).alias("paper_qty"),
        eco.scaled_qty("entry", "sl", F.lit(1000.0), "prob", dd, "market_regime", F.lit(0.001), F.lit(0.5), F.lit(3.0)).alias("scaled_qty"),
    )


@query(
    "fees_pnl",
    f"""WITH {LEDGER_SQL}, e AS (SELECT *, entry * (1 + (seq % 9 - 4) * 0.01::DOUBLE) AS px FROM led),
      f AS (SELECT *, {sql_rd('entry * qty * 0.0002::DOUBLE', 2)} AS entry_fee, {sql_rd('px * qty * 0.00055::DOUBLE', 2)} AS exit_fee, CASE WHEN direction = 'LONG' THEN px - entry ELSE entry - px END AS move FROM e)
    SELECT seq, entry_fee, exit_fee, {sql_rd('move * qty - exit_fee', 3)} AS pnl, CASE WHEN move * qty - exit_fee > 0 THEN 'WIN' ELSE 'LOSS' END AS status,
      {sql_rd('move * qty / (entry * qty / 10) * 100', 3)} AS roi FROM f""",
)
def fees_pnl(spark, sf):
    df = ledger(spark, sf).withColumn("px", F.col("entry") * (1 + (F.col("seq") % 9 - 4) * 0.01))
    pnl = eco.closed_pnl("direction", "entry", "px", "qty")
    return df.select(
        "seq", eco.fee("entry", "qty", 0.0002).alias("entry_fee"), eco.fee("px", "qty", 0.00055).alias("exit_fee"),
        rd(pnl, 3).alias("pnl"), eco.outcome(pnl).alias("status"),
        rd(eco.roi_pct("direction", "entry", "qty", F.lit(10.0), "px"), 3).alias("roi"),
    )


@query(
    "trail_and_progress",
    f"""WITH {LEDGER_SQL}, e AS (SELECT *, entry * (1 + (seq % 9 - 4) * 0.01::DOUBLE) AS px, o_totalprice / 200000 AS atr, CASE WHEN seq % 5 = 0 THEN NULL ELSE sl * 1.001::DOUBLE END AS inv FROM led)
    SELECT seq, {sql_rd('greatest(px * (0.3::DOUBLE / 100), atr * 1.5)', 5)} AS trail, {sql_rd("(CASE WHEN direction = 'LONG' THEN px - entry ELSE entry - px END) / abs(tp - entry)", 5)} AS progress,
      CASE WHEN CASE WHEN direction = 'LONG' THEN px < coalesce(inv, sl) ELSE px > coalesce(inv, sl) END THEN 1 ELSE 0 END AS invalidated,
      {sql_rd('floor(px / 0.0005::DOUBLE + 0.5) * 0.0005::DOUBLE', 6)} AS tick FROM e""",
)
def trail_and_progress(spark, sf):
    df = ledger(spark, sf).select(
        "*", (F.col("entry") * (1 + (F.col("seq") % 9 - 4) * 0.01)).alias("px"), (F.col("o_totalprice") / 200000).alias("atr"),
        F.when(F.col("seq") % 5 != 0, F.col("sl") * 1.001).alias("inv"),
    )
    bad = eco.invalidated("direction", "px", "inv", F.lit(None).cast("double"), "sl", "entry")
    return df.select(
        "seq", rd(eco.trail_distance("px", "atr"), 5).alias("trail"),
        rd(eco.target_progress("direction", "entry", "tp", "px"), 5).alias("progress"), flag(bad).alias("invalidated"),
        rd(eco.tick_price("px", F.lit(0.0005)), 6).alias("tick"),
    )


REPAIR_SQL = f"""{LEDGER_SQL}, e AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN NULL ELSE entry END AS entry, entry * (1 + (seq % 9 - 4) * 0.01::DOUBLE) AS exit_price, qty, direction, status, pnl,
      CASE WHEN seq % 4 = 0 THEN NULL ELSE 1.0::DOUBLE END AS entry_fee FROM led WHERE status <> 'OPEN'),
    f AS (SELECT *, {sql_rd('exit_price * qty * 0.0004::DOUBLE', 2)} AS fee, entry IS NOT NULL AS ok FROM e),
    g AS (SELECT *, {sql_rd("CASE WHEN direction = 'LONG' THEN exit_price - entry ELSE entry - exit_price END * qty - fee", 2)} AS np FROM f)"""


def repaired(spark, sf):
    k = F.col("seq")
    rows = closed(spark, sf).select(
        "seq", F.when(k % 11 != 0, F.col("entry")).alias("entry"), (F.col("entry") * (1 + (k % 9 - 4) * 0.01)).alias("exit_price"),
        "qty", "direction", "status", "pnl", F.when(k % 4 != 0, 1.0).alias("entry_fee"), F.lit(None).cast("double").alias("exit_fee"),
    )
    return eco.repaired(rows)


@query(
    "ledger_repair",
    f"""WITH {REPAIR_SQL} SELECT seq, CASE WHEN ok THEN np ELSE pnl END AS pnl, CASE WHEN ok THEN fee END AS exit_fee, CASE WHEN ok THEN CASE WHEN np > 0 THEN 'WIN' ELSE 'LOSS' END ELSE status END AS status,
      CASE WHEN ok THEN coalesce(entry_fee, {sql_rd('entry * qty * 0.0004::DOUBLE', 2)}) ELSE entry_fee END AS entry_fee,
      CASE WHEN ok AND (status <> CASE WHEN np > 0 THEN 'WIN' ELSE 'LOSS' END OR pnl IS DISTINCT FROM np) THEN 1 ELSE 0 END AS changed, CASE WHEN ok THEN 0 ELSE 1 END AS skipped FROM g""",
)
def ledger_repair(spark, sf):
    return repaired(spark, sf).select(
        "seq", "pnl", "exit_fee", "status", "entry_fee", flag(F.col("changed")).alias("changed"), flag(F.col("skipped").isNotNull()).alias("skipped")
    )


@query(
    "repair_report",
    f"""WITH {REPAIR_SQL}, h AS (SELECT *, CASE WHEN ok THEN CASE WHEN np > 0 THEN 'WIN' ELSE 'LOSS' END ELSE status END AS s2 FROM g)
    SELECT count_if(status = 'WIN')::BIGINT AS win_before, count_if(status = 'LOSS')::BIGINT AS loss_before, count_if(s2 = 'WIN')::BIGINT AS win_after, count_if(s2 = 'LOSS')::BIGINT AS loss_after FROM h""",
)
def repair_report(spark, sf):
    one = lambda c, v: F.count_if(F.col(c) == v)
    return repaired(spark, sf).agg(
        one("old_status", "WIN").alias("win_before"), one("old_status", "LOSS").alias("loss_before"),
        one("status", "WIN").alias("win_after"), one("status", "LOSS").alias("loss_after"),
    )


@query(
    "policy_thresholds",
    f"""WITH {LEDGER_SQL}, e AS (SELECT *, (seq % 100)::DOUBLE AS rank, (seq % 10) / 10.0::DOUBLE AS rate FROM led),
      l AS (SELECT *, 32 + CASE market_regime WHEN 'trending' THEN -5 WHEN 'volatile' THEN 8 ELSE 4 END + CASE WHEN rate > 0.55 THEN -5 WHEN rate < 0.4 THEN 10 ELSE 0 END + CASE WHEN rank > 80 THEN 5 WHEN rank < 20 THEN -3 ELSE 0 END AS a,
        45 + CASE market_regime WHEN 'trending' THEN -5 WHEN 'volatile' THEN 10 ELSE 6 END + CASE WHEN rate > 0.55 THEN -6 WHEN rate < 0.4 THEN 12 ELSE 0 END + CASE WHEN rank > 80 THEN 6 WHEN rank < 20 THEN -4 ELSE 0 END AS b FROM e)
    SELECT seq, greatest(22, least(75, a)) AS bar_limit, greatest(30, least(75, b)) AS bar_market,
      CASE WHEN seq % 200 <= 30 THEN 0.0::DOUBLE ELSE {sql_rd('0.4::DOUBLE * least(1.0::DOUBLE, (seq % 200 - 30) / 120.0::DOUBLE)', 4)} END AS weight FROM l""",
)
def policy_thresholds(spark, sf):
    k = F.col("seq")
    rank, rate = (k % 100).cast("double"), (k % 10) / F.lit(10.0)
    return ledger(spark, sf).select(
        "seq", eco.confidence_bar("market_regime", rank, rate, "limit").alias("bar_limit"),
        eco.confidence_bar("market_regime", rank, rate, "market").alias("bar_market"), eco.model_weight(k % 200).alias("weight"),
    )
