"""Market data derived from the given tables, in Spark and in SQL.

Ticks come from ``events``: a symbol is an event type and its price follows a
walk made of every event's value, signed by the parity of the ``k`` property, so
patterns and trades occur. Daily bars come from ``lineitem``. The ledger comes
from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators.bars import to_bars
from tidemark.operators.blocks import running
from tidemark.session import stage

ENTRY_TF, BIAS_TF = "1h", "4h"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"), F.col("value").alias("price"), "user_id", "props",
    )


def walk_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks whose price is a bounded walk: 100 + 50 * w / (100 + |w|)."""
    k = F.from_json("props", "k INT")["k"]
    cents = F.floor(F.col("price") * 100 + 0.5).cast("long")
    steps = raw_ticks(spark, sf).select(
        "symbol", "ts", "id", F.when(k % 2 == 0, cents).otherwise(-cents).alias("step"), "user_id"
    )
    hour = {"_h": F.floor(micros(F.col("ts")) / 3_600_000_000)}
    walked = running(steps, ["symbol"], hour, ["ts", "id"], {"cents": (F.col("step"), "sum")})
    w = F.col("cents") * 0.0005
    return walked.select("symbol", "ts", "id", "user_id", (100.0 + 50.0 * w / (100.0 + F.abs(w))).alias("price"))


WALK_SQL = """
steps AS (
  SELECT event_type AS symbol, ts, event_id AS id, user_id,
         CASE WHEN CAST(props->>'$.k' AS INT) % 2 = 0 THEN 1 ELSE -1 END * CAST(floor(value * 100 + 0.5) AS BIGINT) AS step
  FROM events),
walk AS (
  SELECT symbol, ts, id, user_id,
         CAST(sum(step) OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) * 0.0005::DOUBLE AS w
  FROM steps),
ticks AS (SELECT symbol, ts, id, user_id, 100.0::DOUBLE + 50.0::DOUBLE * w / (100.0::DOUBLE + abs(w)) AS price FROM walk)"""


def bars_sql(name: str, seconds: int, source: str = "ticks") -> str:
    return f"""
{name}_raw AS (
  SELECT symbol, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds} AS t,
         min_by(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, max_by(price, (ts, id)) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM {source} GROUP BY 1, 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS seq FROM {name}_raw)"""


def walk_bars(spark: SparkSession, sf: str, tf: str, staged: bool = True) -> DataFrame:
    bars = to_bars(walk_ticks(spark, sf), tf)
    return stage(bars, f"bars-{tf}") if staged else bars


def bar_pair(spark: SparkSession, sf: str, entry_tf: str = ENTRY_TF) -> tuple[DataFrame, DataFrame]:
    """Entry and bias bars; the bias bars are resampled from the staged entry bars."""
    from tidemark.operators.bars import resample

    entry = walk_bars(spark, sf, entry_tf)
    return entry, resample(entry, BIAS_TF)


def daily_ticks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]
    return stage(to_bars(daily_ticks(spark, sf), "1d", qty=F.col("qty"), tie=tie), "bars-1d")


DAILY_SQL = """
dticks AS (
  SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS qty,
         (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS k FROM lineitem),
bars_raw AS (
  SELECT symbol, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS t, min_by(price, k) AS open, max(price) AS high,
         min(price) AS low, max_by(price, k) AS close, sum(qty) AS volume
  FROM dticks GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS seq FROM bars_raw)"""


def seconds(ts: str = "ts"):
    return F.unix_seconds(ts).alias("t")
