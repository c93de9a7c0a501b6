"""Queries that run as Structured Streaming over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import data
from tidemark.catalog.base import flag, query, rd, t
from tidemark.catalog.market import PATTERNS
from tidemark.catalog.sqltext import rd as sql_rd
from tidemark.params import SCALP, Portfolio
from tidemark.plans import signals as sig
from tidemark.session import staging_root
from tidemark.streaming import bars as sb
from tidemark.streaming import cooling
from tidemark.streaming import lifecycle as lc


#: Bytes of the source that one micro-batch takes, so that state held for the watermark stays small.
PER_TRIGGER = 256 << 20


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = data.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(PER_TRIGGER)).parquet(sf)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
        F.col("value").alias("price"), "user_id",
    )


@query(
    "stream_bars",
    """WITH b AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t, min_by(value, (ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
    SELECT * FROM b WHERE t + 3600 <= (SELECT floor(epoch_ms(max(ts)) / 1000.0) - 600 FROM events)""",
)
def stream_bars(spark, sf):
    return sb.drain(sb.stream_bars(event_stream(spark, sf), "1h", "10 minutes"), "bars").select(
        "symbol", t(), "open", "high", "low", "close", "volume"
    )


@query(
    "stream_unique_signals",
    """SELECT signal_hash, count(*) AS n FROM (SELECT DISTINCT event_type || '_' || CAST(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS VARCHAR) AS signal_hash FROM events) GROUP BY 1""",
)
def stream_unique_signals(spark, sf):
    bucket = (F.floor(F.unix_seconds("ts") / 300) * 300).cast("string")
    signals = event_stream(spark, sf).withColumn("signal_hash", F.concat_ws("_", "symbol", bucket))
    out = sb.drain(sb.unique_signals(signals, "1 hour"), "unique")
    return out.groupBy("signal_hash").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_daily_pnl",
    f"""WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS day, sum(value - 10) AS pnl, count(*) AS trades FROM events GROUP BY 1)
    SELECT day, {sql_rd('pnl', 4)} AS pnl, trades FROM d WHERE day + 86400 <= (SELECT floor(epoch_ms(max(ts)) / 1000.0) - 600 FROM events)""",
)
def stream_daily_pnl(spark, sf):
    closed = event_stream(spark, sf).select(F.col("ts").alias("exit_time"), (F.col("price") - 10).alias("pnl"))
    out = sb.drain(sb.stream_daily_pnl(closed, "10 minutes"), "daily")
    return out.select(F.unix_seconds("day").alias("day"), rd("pnl", 4).alias("pnl"), "trades")


def order_rows(ticks: DataFrame) -> DataFrame:
    """Orders and prices from ticks: every 25th tick also places an order."""
    k = F.col("id")
    side = F.when(k % 2 == 0, 1.0).otherwise(-1.0)
    orders = ticks.where(k % 25 == 0).select(
        "symbol", "ts", (k * 2).alias("id"), F.concat(F.lit("o"), k).alias("sid"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        (F.lit(10.0) - side).alias("entry"), (F.lit(10.0) - side * 8).alias("sl"), (F.lit(10.0) + side * 6).alias("tp"),
        F.lit(1.0).alias("atr"), (F.lit(10.0) - side * 7).alias("level"),
    )
    prices = ticks.select("symbol", "ts", (k * 2 + 1).alias("id"), "price")
    return lc.orders_and_prices(orders, prices)


_X, _COOL, _SLICE = SCALP[2], Portfolio.cooldown_minutes, 60
_TTL, _WIDTH = int(_X.ttl_minutes * lc.MINUTE), _SLICE * lc.MINUTE
LIFECYCLE_SQL = f"""WITH RECURSIVE raw AS (SELECT event_type AS symbol, epoch_us(ts) AS u, event_id AS id, value AS v, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side FROM events),
  z AS (SELECT CAST(floor((max(u) - {lc.MINUTE}) / {_WIDTH}.0) AS BIGINT) * {_WIDTH} AS over FROM raw),
  every AS (SELECT symbol, u, id * 2 AS id, 'order' AS kind, NULL::DOUBLE AS price, 'o' || id AS sid, side, 10 - side AS entry, 10 - side * 8 AS sl, 10 + side * 6 AS tp, 10 - side * 7 AS lvl FROM raw WHERE id % 25 = 0
    UNION ALL SELECT symbol, u, id * 2 + 1, 'price', v, NULL, NULL, NULL, NULL, NULL, NULL FROM raw
    UNION ALL SELECT DISTINCT symbol, over, NULL::BIGINT, 'end', NULL::DOUBLE, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM raw, z),
  n AS MATERIALIZED (SELECT every.*, row_number() OVER (PARTITION BY symbol ORDER BY u, id NULLS LAST) AS k FROM every, z WHERE u < over OR kind = 'end'),
  r AS (SELECT symbol, 0::BIGINT AS k, 0::BIGINT AS u, 0 AS status, NULL::VARCHAR AS sid, NULL::DOUBLE AS side, NULL::DOUBLE AS entry, NULL::DOUBLE AS sl, NULL::DOUBLE AS tp, NULL::DOUBLE AS lvl, 0::BIGINT AS placed,
      NULL::DOUBLE AS anchor, 0::BIGINT AS cool, NULL::VARCHAR AS gone, 0::BIGINT AS gone_u, NULL::VARCHAR AS act, NULL::DOUBLE AS px, NULL::VARCHAR AS act_sid FROM (SELECT DISTINCT symbol FROM raw)
    UNION ALL
    SELECT symbol, k, u, CASE act WHEN 'placed' THEN 1 WHEN 'filled' THEN 2 WHEN 'armed' THEN 3 WHEN 'structure' THEN 0 WHEN 'expired' THEN 0 WHEN 'stop' THEN 0 WHEN 'trail' THEN 0 ELSE st END,
      CASE act WHEN 'placed' THEN nsid ELSE sid END, CASE act WHEN 'placed' THEN nside ELSE side END, CASE act WHEN 'placed' THEN nentry ELSE entry END, CASE act WHEN 'placed' THEN nsl ELSE sl END,
      CASE act WHEN 'placed' THEN ntp ELSE tp END, CASE act WHEN 'placed' THEN nlvl ELSE lvl END, CASE act WHEN 'placed' THEN u ELSE placed END,
      CASE act WHEN 'armed' THEN price WHEN 'ratchet' THEN best ELSE anchor END, CASE WHEN act IN ('stop', 'trail') THEN u + {int(_COOL * lc.MINUTE)} ELSE cool END, gone, gone_u,
      act, CASE act WHEN 'placed' THEN nentry WHEN 'busy' THEN nentry WHEN 'cooldown' THEN nentry WHEN 'filled' THEN entry WHEN 'stop' THEN sl WHEN 'trail' THEN stop ELSE price END,
      CASE WHEN act IN ('placed', 'busy', 'cooldown') THEN nsid ELSE sid END
    FROM (SELECT *, CASE WHEN kind = 'order' THEN CASE WHEN st <> 0 THEN 'busy' WHEN u < cool THEN 'cooldown' ELSE 'placed' END WHEN kind = 'price' THEN CASE st
          WHEN 1 THEN CASE WHEN side * price < side * lvl THEN 'structure' WHEN side * price <= side * entry THEN 'filled' WHEN u - placed > {_TTL} THEN 'expired' END
          WHEN 2 THEN CASE WHEN side * price <= side * sl THEN 'stop' WHEN side * (tp - entry) > 0 AND side * (price - entry) / (side * (tp - entry)) >= {_X.activation} THEN 'armed' END
          WHEN 3 THEN CASE WHEN side * price <= side * stop THEN 'trail' ELSE 'ratchet' END END END AS act
      FROM (SELECT *, best - side * greatest(best * {_X.trail_pct} / 100, 1.0 * {_X.trail_atr}) AS stop
        FROM (SELECT r.symbol, n.k, n.u, n.kind, n.price, n.sid AS nsid, n.side AS nside, n.entry AS nentry, n.sl AS nsl, n.tp AS ntp, n.lvl AS nlvl, r.sid, r.side, r.entry, r.sl, r.tp, r.lvl, r.placed, r.anchor, r.cool,
            CASE WHEN r.status = 1 AND n.u // {_WIDTH} * {_WIDTH} >= r.placed + {_TTL} THEN 0 ELSE r.status END AS st,
            CASE WHEN r.status = 1 AND n.u // {_WIDTH} * {_WIDTH} >= r.placed + {_TTL} THEN r.sid END AS gone, r.placed + {_TTL} AS gone_u,
            CASE WHEN r.side > 0 THEN greatest(r.anchor, n.price) ELSE least(r.anchor, n.price) END AS best FROM r JOIN n ON n.symbol = r.symbol AND n.k = r.k + 1))))
  SELECT symbol, gone_u // 1000000 AS t, gone AS sid, 'CANCELLED' AS event, NULL::DOUBLE AS price, 'expired' AS reason FROM r WHERE gone IS NOT NULL
  UNION ALL SELECT symbol, u // 1000000, act_sid, CASE act WHEN 'placed' THEN 'PLACED' WHEN 'busy' THEN 'REFUSED' WHEN 'cooldown' THEN 'REFUSED' WHEN 'filled' THEN 'FILLED' WHEN 'armed' THEN 'ARMED'
      WHEN 'structure' THEN 'CANCELLED' WHEN 'expired' THEN 'CANCELLED' ELSE 'CLOSED' END, px,
    CASE act WHEN 'busy' THEN 'busy' WHEN 'cooldown' THEN 'cooldown' WHEN 'structure' THEN 'structure' WHEN 'expired' THEN 'expired' WHEN 'stop' THEN 'Stop Loss Hit' WHEN 'trail' THEN 'Trailing Stop Hit' END
  FROM r WHERE act IS NOT NULL AND act <> 'ratchet'"""


@query("stream_lifecycle", LIFECYCLE_SQL)
def stream_lifecycle(spark, sf):
    """Lifecycle events of all slices that the watermark has passed."""
    rows = order_rows(event_stream(spark, sf))
    out = sb.drain(lc.lifecycle(rows, _X, _COOL, slice_minutes=_SLICE), "lifecycle")
    return out.select("symbol", t(), "sid", "event", "price", "reason")


# ------------------------------------------------------------------ late rows and incremental signals


def in_files(parts: list[DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """A stream that takes one part after the other, each as a micro-batch."""
    folder = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    for part in parts:  # a handful of parts; files are taken in the order of their times
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


COUNTS_SQL = """WITH e AS (SELECT event_type AS symbol, epoch_ms(ts) AS m, event_id AS id FROM events), top AS (SELECT max(m) AS m, count(*) AS n FROM e),
  late AS (SELECT * FROM e WHERE id % 50 = 0 AND m < (SELECT m FROM top) - 86400000),
  bars AS (SELECT symbol, m // 3600000 AS h FROM e GROUP BY 1, 2), hashes AS (SELECT DISTINCT symbol, m // 300000 AS f FROM e)
SELECT 'bars' AS stream, top.n + 1 + (SELECT count(*) FROM late) AS rows_in, (SELECT count(*) FROM bars WHERE (h + 1) * 3600000 <= top.m - 600000) AS rows_out,
  (SELECT count(*) FROM (SELECT DISTINCT symbol, m // 3600000 FROM late)) AS rows_late, 0::BIGINT AS rows_duplicate FROM top
UNION ALL SELECT 'signals', top.n + 1 + (SELECT count(*) FROM late), (SELECT count(*) FROM hashes), (SELECT count(*) FROM late), top.n + 1 - (SELECT count(*) FROM hashes) FROM top"""


@query("stream_counts", COUNTS_SQL)
def stream_counts(spark, sf):
    """Rows in, out, dropped as late and as duplicates, of two streams to which old ticks come again after the watermark has passed them."""
    ticks = data.raw_ticks(spark, sf).select("symbol", "ts", "id", "price")
    newest = ticks.agg(F.max("ts").alias("ts")).first()["ts"]
    again = ticks.orderBy(F.desc("ts"), F.desc("id")).limit(1)
    old = ticks.where((F.col("id") % 50 == 0) & (F.unix_millis("ts") < F.unix_millis(F.lit(newest)) - 86_400_000))
    bucket = (F.floor(F.unix_seconds("ts") / 300) * 300).cast("string")
    counts = []
    for name in ("bars", "signals"):
        stream = in_files([ticks, again, old], name, spark)
        if name == "bars":
            out = sb.stream_bars(stream, "1h", "10 minutes")
        else:
            out = sb.unique_signals(stream.withColumn("signal_hash", F.concat_ws("_", "symbol", bucket)), "1 hour")
        counts.append((name, *sb.counted_drain(out, name)[1].values()))
    return spark.createDataFrame(counts, "stream string, rows_in long, rows_out long, rows_late long, rows_duplicate long")


@query(
    "stream_signals",
    f"""{PATTERNS} SELECT symbol, t, volume_spike, displacement, bull_fvg::INT AS bull_fvg, bear_fvg::INT AS bear_fvg, market_regime, 1::BIGINT AS times FROM pat
      WHERE volume_spike + displacement + bull_fvg::INT + bear_fvg::INT >= 2""",
)
def stream_signals(spark, sf):
    """Bars with two confluences or more, found batch by batch as bars come in; one batch comes a second time and adds nothing."""
    bars = data.walk_bars(spark, sf, "1h")
    first, last = (x.timestamp() for x in bars.agg(F.min("ts"), F.max("ts")).first())
    cuts = [first - 1] + [first + (last - first) * k / 4 for k in (2, 3)] + [last]
    seconds = F.unix_seconds("ts")
    parts = [bars.where((seconds > int(a)) & (seconds <= int(b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    base = f"{staging_root(spark)}/signals-{uuid.uuid4().hex}"

    def setups(slice_: DataFrame) -> DataFrame:
        found = sig.entry_features(slice_, "1h")
        flags = {c: flag(F.col(c)) for c in ("bull_fvg", "bear_fvg")}
        found = found.withColumns(flags).select("symbol", "ts", "volume_spike", "displacement", *flags, "market_regime")
        return found.where("volume_spike + displacement + bull_fvg + bear_fvg >= 2")

    run = sb.signal_batches(spark, f"{base}/history", sb.batch_sink(f"{base}/found"), setups, "1h", rows=420)
    sb.drain_batches(in_files(parts, "bars", spark), "signals", run)
    run(parts[1], 1)
    found = spark.read.parquet(f"{base}/found").drop("batch")
    return found.groupBy(*[c for c in found.columns]).agg(F.count("*").alias("times")).withColumn("t", F.unix_seconds("ts")).drop("ts")


@query(
    "stream_freshness",
    """WITH e AS (SELECT *, epoch_us(ts) AS u FROM events), cut AS (SELECT (min(u) + max(u)) // 2 AS m FROM e),
      c AS (SELECT user_id, max_by(value, u) FILTER (u < m) AS f0, max(u) FILTER (u < m) AS t0, max_by(value, u) AS f1, max(u) AS t1 FROM e, cut WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id AS id, CASE WHEN u < m THEN CASE WHEN u - t0 <= 86400000000 THEN f0 END WHEN u - t1 <= 86400000000 THEN f1 END AS funding
    FROM e CROSS JOIN cut LEFT JOIN c USING (user_id) WHERE event_type = 'click'""",
)
def stream_freshness(spark, sf):
    """Clicks that come in two halves and meet the signups stored by then."""
    ticks = data.raw_ticks(spark, sf)
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = sum(ticks.agg(F.min(u), F.max(u)).first()) // 2
    base = f"{staging_root(spark)}/freshness-{uuid.uuid4().hex}"
    points = ticks.where("symbol = 'signup'").select("user_id", F.lit("funding").alias("series"), "ts", F.col("price").alias("value"))
    clicks = ticks.where("symbol = 'click'").select("id", "user_id", "ts")
    run = sb.context_batches(lambda: spark.read.schema(points.schema).parquet(f"{base}/context"), ["user_id"], {"funding": 86400.0}, sb.batch_sink(f"{base}/found"))
    for half in (u < middle, u >= middle):
        points.where(half).write.mode("append").parquet(f"{base}/context")
        clicks.where(half).write.mode("append").parquet(f"{base}/clicks")
        stream = spark.readStream.schema(clicks.schema).option("maxBytesPerTrigger", str(PER_TRIGGER)).parquet(f"{base}/clicks")
        sb.drain_batches(stream, "freshness", run, checkpoint=f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/found").select("id", "funding")


@query(
    "stream_cooldown",
    f"""WITH e AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts) AS u FROM events),
      seen AS (SELECT least(max(u) FILTER (event_type = 'click'), max(u) FILTER (event_type = 'purchase')) - 3600000000 AS upto FROM e),
      n AS (SELECT id, user_id, u FROM e, seen WHERE event_type = 'click' AND u <= upto)
    SELECT id, CASE WHEN EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'purchase' AND x.user_id = n.user_id AND x.u <= n.u AND x.u > n.u - {int(_COOL * lc.MINUTE)}) THEN 1 ELSE 0 END AS refused FROM n""",
)
def stream_cooldown(spark, sf):
    """Which clicks a purchase of the user in the cooldown before them refuses, of those that the watermark has surely passed."""
    ticks = data.raw_ticks(spark, sf)
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    upto = min(ticks.where(F.col("symbol") == kind).agg(F.max(u)).first()[0] for kind in ("click", "purchase")) - 3600 * 1_000_000
    out = None
    for refused in (False, True):
        stream = event_stream(spark, sf)
        entries = stream.where("symbol = 'click'").select(F.col("user_id").alias("symbol"), "ts", "id")
        exits = event_stream(spark, sf).where("symbol = 'purchase'").select(F.col("user_id").alias("symbol"), F.col("ts").alias("exit_time"))
        rows = sb.drain(cooling.decided_entries(entries, exits, "10 minutes", refused=refused, minutes=_COOL), "cooldown")
        rows = rows.where(F.unix_micros("ts") <= upto).select("id", flag(F.lit(refused)).alias("refused"))
        out = rows if out is None else out.unionByName(rows)
    return out
