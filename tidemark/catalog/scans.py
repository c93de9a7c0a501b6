"""Queries over raw context feeds, ledger documents and small logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog import data
from tidemark.catalog.base import flag, query, rd, t
from tidemark.catalog.learning import METRICS_SQL, predictions
from tidemark.catalog.ledger import CLOSED_SQL, LEDGER_SQL, ledger
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.functions import symbols as sym
from tidemark.operators import context as cx
from tidemark.operators.asof import asof_join
from tidemark.operators.bars import bar_scan
from tidemark.operators import evaluation as ev
from tidemark.operators import ledger as led
from tidemark.session import stage, staging_root
from tidemark.sources import store
from tidemark.streaming.bars import fresh_context


@query(
    "bars_scan",
    """SELECT event_type AS symbol, CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 AS t, min_by(value, event_id) AS close FROM events GROUP BY 1, 2""",
)
def bars_scan(spark, sf):
    """Pages that overlap: several rows per bar, numbered by arrival."""
    ms = (F.floor(F.unix_seconds("ts") / 900) * 900_000).alias("ms")
    pages = data.raw_ticks(spark, sf).select("symbol", F.lit("15m").alias("tf"), ms, F.col("price").alias("close"), "id")
    return bar_scan(pages, arrival="id").select("symbol", t(), "close")


@query(
    "form_as_of",
    f"""WITH {CLOSED_SQL}, f AS (SELECT symbol, ts, seq, CASE WHEN count(*) OVER w >= 3 THEN avg(won::INT::DOUBLE) OVER w ELSE 0.5::DOUBLE END AS rate FROM cl
        WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
      u AS (SELECT symbol, ts, max_by(rate, seq) AS rate FROM f GROUP BY 1, 2)
    SELECT o.seq, {sql_rd('coalesce(u.rate, 0.5::DOUBLE)')} AS win_rate FROM (SELECT * FROM led WHERE status = 'OPEN') o ASOF LEFT JOIN u ON u.symbol = o.symbol AND o.ts >= u.ts""",
)
def form_as_of(spark, sf):
    """Symbol form known when an order is placed."""
    rows = ledger(spark, sf)
    series = led.form_as_of(rows.where(led.is_closed()))
    asked = rows.where(led.is_active()).select("seq", "symbol", "ts")
    out = asof_join(asked, {"form": series}, ["symbol"], tie="n")
    return out.select("seq", rd(F.coalesce("form.symbol_win_rate", F.lit(0.5))).alias("win_rate"))


@query(
    "funding_scan",
    """SELECT event_type AS symbol, epoch_us(ts) AS us, value AS rate FROM events
    WHERE event_id % 11 <> 0 AND ts BETWEEN TIMESTAMP '2024-01-05' - INTERVAL 8 HOUR AND TIMESTAMP '2024-01-20'""",
)
def funding_scan(spark, sf):
    raw = data.raw_ticks(spark, sf).select("symbol", "ts", F.when(F.col("id") % 11 != 0, F.col("price")).alias("rate"))
    day = lambda s: F.lit(s).cast("timestamp")
    out = cx.funding_series(raw, day("2024-01-05"), day("2024-01-20"))
    return out.select("symbol", F.unix_micros("ts").alias("us"), F.col("value").alias("rate"))


@query(
    "open_interest_scan",
    """WITH p AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t, event_id,
      coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END, 0), nullif(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value * 2 END, 0)) AS oi FROM events)
    SELECT symbol, t, max_by(oi, event_id) AS oi FROM p WHERE oi IS NOT NULL GROUP BY 1, 2""",
)
def open_interest_scan(spark, sf):
    k = F.col("id")
    raw = data.raw_ticks(spark, sf).select(
        "symbol", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("ts"), k.alias("arrival"),
        F.when(k % 3 == 0, 0.0).otherwise(F.col("price")).alias("oi_value"), F.when(k % 5 == 0, 0.0).otherwise(F.col("price") * 2).alias("oi_amount"),
    )
    return cx.open_interest(raw).select("symbol", t(), "oi")


@query(
    "sentiment_scan",
    """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(props->>'$.k' AS DOUBLE) AS value FROM events WHERE event_id % 7 <> 0""",
)
def sentiment_scan(spark, sf):
    """Index payloads as a feed serves them: seconds and values as text."""
    rows = data.raw_ticks(spark, sf)
    point = F.struct(
        F.when(F.col("id") % 7 != 0, F.unix_seconds("ts").cast("string")).alias("timestamp"), F.get_json_object("props", "$.k").alias("value")
    )
    payloads = rows.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.to_json(F.struct(F.collect_list(point).alias("data"))).alias("payload"))
    return cx.sentiment_series(payloads).select(t(), "value")


@query(
    "ticker_snapshot",
    f"""WITH k AS (SELECT c_custkey, c_name || 'USDT' AS symbol, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS price, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal * 200 END AS volume,
      CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS bid, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal * 1.001::DOUBLE END AS ask FROM customer)
    SELECT symbol, coalesce(price, 0) AS price, {sql_rd('coalesce(volume, 0)', 2)} AS volume, CASE WHEN coalesce(volume, 0) >= 500000 AND coalesce(bid, 0) > 0 AND coalesce(ask, 0) > 0 THEN 1 ELSE 0 END AS tradable FROM k""",
)
def ticker_snapshot(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    raw = data.table(spark, sf, "customer").select(
        F.concat("c_name", F.lit("USDT")).alias("symbol"), F.when(k % 6 != 0, bal).alias("price"), F.when(k % 4 != 0, bal * 200).alias("volume"),
        F.when(k % 5 != 0, bal).alias("bid"), F.when(k % 7 != 0, bal * 1.001).alias("ask"), F.lit(None).cast("double").alias("change"),
    )
    snap = sym.ticker_snapshot(raw)
    good = sym.tradable(snap).select("symbol", F.lit(1).alias("ok"))
    return snap.join(good, "symbol", "left").select("symbol", "price", rd("volume", 2).alias("volume"), F.coalesce("ok", F.lit(0)).alias("tradable"))


@query(
    "ledger_documents",
    f"WITH {LEDGER_SQL} SELECT seq, symbol, direction, status, {sql_rd('entry')} AS entry, {sql_rd('qty')} AS qty, pnl FROM led",
)
def ledger_documents(spark, sf):
    """The ledger written as JSON documents and read back with its typed core."""
    path = f"{staging_root(spark)}/documents-{uuid.uuid4().hex}"
    rows = ledger(spark, sf).select("seq", "symbol", "direction", "status", "entry", "qty", "pnl", "market_regime")
    store.write_ledger(store.to_documents(rows), path)
    return store.read_ledger(spark, path).select(
        "seq", "symbol", "direction", "status", rd("entry").alias("entry"), rd("qty").alias("qty"), "pnl"
    )


def fresh_folder(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("ledger_append", f"WITH {LEDGER_SQL} SELECT seq, symbol, status FROM led")
def ledger_append(spark, sf):
    """Closed rows written first, active ones appended, all read back."""
    path, rows = fresh_folder(spark, "documents"), ledger(spark, sf).select("seq", "symbol", "status")
    store.write_ledger(store.to_documents(rows.where(led.is_closed())), path)
    store.write_ledger(store.to_documents(rows.where(~led.is_closed())), path, append=True)
    return store.read_ledger(spark, path).select("seq", "symbol", "status")


@query(
    "upserted_values",
    f"WITH {LEDGER_SQL}, u AS (SELECT seq * 2 AS step, symbol, direction, status FROM led UNION ALL SELECT seq * 2 + 1, symbol, direction, 'CHECKED' FROM led WHERE seq % 3 = 0) "
    "SELECT symbol, direction, max_by(status, step) AS status, max(step) AS step FROM u GROUP BY ALL",
)
def upserted_values(spark, sf):
    """Changes laid over a table of current values; the newest per key stays."""
    rows = ledger(spark, sf).select((F.col("seq") * 2).alias("step"), "symbol", "direction", "status")
    changes = ledger(spark, sf).where("seq % 3 = 0").select((F.col("seq") * 2 + 1).alias("step"), "symbol", "direction", F.lit("CHECKED").alias("status"))
    return store.upsert(rows, changes, ["symbol", "direction"], "step").select("symbol", "direction", "status", "step")


@query("migrated_ledger", f"WITH {LEDGER_SQL} SELECT symbol, direction, status, {sql_rd('entry')} AS entry FROM led")
def migrated_ledger(spark, sf):
    """Legacy files, each one JSON array of up to 1000 trades, taken over once; a second run changes nothing."""
    source, target = fresh_folder(spark, "legacy"), fresh_folder(spark, "documents")
    trade = F.struct("symbol", "direction", "status", "entry")
    arrays = ledger(spark, sf).groupBy(F.expr("seq div 1000").alias("file")).agg(F.to_json(F.collect_list(trade)).alias("value"))
    arrays.write.partitionBy("file").text(source)
    done = [store.migrate_json(spark, source, target) for _ in range(2)]
    return store.read_ledger(spark, target).where(F.lit(done == [True, False])).select("symbol", "direction", "status", rd("entry").alias("entry"))


@query(
    "trade_csv",
    f"WITH {LEDGER_SQL} SELECT CAST(epoch(ts) AS VARCHAR) AS timestamp, symbol, direction, {sql_rd('entry', 4)} AS entry, status AS result, {sql_rd('pnl', 2)} AS pnl FROM led WHERE status <> 'OPEN'".replace("CAST(epoch(ts) AS VARCHAR)", "CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)"),
)
def trade_csv(spark, sf):
    """Closed trades through the CSV ledger and back."""
    path = fresh_folder(spark, "csv")
    none = F.lit(None).cast("double")
    rows = ledger(spark, sf).where(led.is_closed()).select(
        F.unix_seconds("ts").cast("string").alias("timestamp"), "symbol", "direction", rd("entry", 4).alias("entry"), none.alias("tp"), none.alias("sl"),
        F.col("status").alias("result"), rd("pnl", 2).alias("pnl"),
    )
    store.write_csv(rows, path)
    return store.read_csv(spark, path, store.TRADE_CSV).drop("tp", "sl")


@query("hash_tail", f"WITH {LEDGER_SQL} SELECT seq, symbol || '_' || direction AS signal_hash FROM led ORDER BY seq DESC LIMIT 500")
def hash_tail(spark, sf):
    rows = ledger(spark, sf).select("seq", F.concat_ws("_", "symbol", "direction").alias("signal_hash"))
    return led.last_rows(rows, 500)


@query(
    "metrics_log",
    f"WITH {LEDGER_SQL} SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n_trades, {sql_rd('avg((status = $$WIN$$)::INT::DOUBLE)', 4)} AS win_rate FROM led WHERE status <> 'OPEN' GROUP BY 1 ORDER BY 1 DESC LIMIT 200".replace("$$WIN$$", "'WIN'"),
)
def metrics_log(spark, sf):
    day = F.unix_seconds(F.date_trunc("day", "ts"))
    runs = ledger(spark, sf).where(led.is_closed()).groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_trades"), rd(F.avg(F.when(F.col("status") == "WIN", 1.0).otherwise(0.0)), 4).alias("win_rate")
    )
    return store.recent_metrics(runs, "day")


@query(
    "context_freshness",
    """WITH c AS (SELECT user_id, max_by(value, ts) AS f, max(ts) AS f_ts FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id AS id, CASE WHEN epoch_us(e.ts) - epoch_us(c.f_ts) <= 86400000000 THEN c.f END AS funding FROM events e LEFT JOIN c USING (user_id) WHERE event_type = 'click'""",
)
def context_freshness(spark, sf):
    ticks = data.raw_ticks(spark, sf)
    ctx = ticks.where("symbol = 'signup'").groupBy("user_id").agg(F.max_by("price", "ts").alias("funding"), F.max("ts").alias("funding_ts"))
    out = fresh_context(ticks.where("symbol = 'click'").select("id", "user_id", "ts"), ctx, ["user_id"], {"funding": 86400.0})
    return out.select("id", "funding")


@query(
    "overfit_gap",
    f"""WITH {METRICS_SQL}, a AS (SELECT model, (ranks - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM e)
    SELECT a.model, {sql_rd('a.auc - b.auc')} AS gap, CASE WHEN a.auc - b.auc > 0.2 THEN 1 ELSE 0 END AS overfit FROM a JOIN a b ON b.model = 3 - a.model""",
)
def overfit_gap(spark, sf):
    m = stage(ev.evaluate(predictions(spark, sf), ["model"]), "metrics")
    out = ev.overfit(m, m.withColumn("model", 3 - F.col("model")), ["model"])
    return out.select("model", rd("gap").alias("gap"), flag(F.col("overfit")).alias("overfit"))


IMPORTANCE_SQL = f"""p AS (SELECT l_returnflag || l_linestatus AS model, 'f' || (l_suppkey % 60) AS feature, avg(l_tax) AS v FROM lineitem GROUP BY 1, 2),
  m AS (SELECT feature, {sql_rd('avg(v)')} AS importance FROM p GROUP BY 1)"""


def feature_importances(spark, sf, features: int) -> DataFrame:
    per = data.table(spark, sf, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("model"), F.concat(F.lit("f"), F.col("l_suppkey") % features).alias("feature")
    ).agg(F.avg("l_tax").alias("v"))
    models = per.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("feature", "v"))).alias("importances"))
    return ev.mean_importance(models).select("feature", rd("importance").alias("importance"))


@query("mean_importance", f"WITH {IMPORTANCE_SQL.replace('% 60', '% 20')} SELECT * FROM m")
def mean_importance(spark, sf):
    return feature_importances(spark, sf, 20)


@query(
    "feature_extremes",
    f"""WITH {IMPORTANCE_SQL} SELECT * FROM (SELECT feature, importance, 'top' AS side FROM m ORDER BY importance DESC, feature LIMIT 10)
    UNION ALL SELECT * FROM (SELECT feature, importance, 'bottom' AS side FROM m ORDER BY importance, feature DESC LIMIT 10)""",
)
def feature_extremes(spark, sf):
    """The ten features of highest and of lowest mean importance."""
    return led.extremes(feature_importances(spark, sf, 60), "importance", "feature", 10).select("feature", "importance", "side")


@query(
    "aligned_columns",
    f"WITH {LEDGER_SQL} SELECT 0.0::DOUBLE AS absent, qty, coalesce(pnl, 0) AS pnl, seq::DOUBLE AS seq FROM led",
)
def aligned_columns(spark, sf):
    return store.aligned(ledger(spark, sf).select("seq", "qty", "pnl"), ["absent", "qty", "pnl", "seq"])
