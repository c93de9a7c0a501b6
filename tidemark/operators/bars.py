"""Ticks to bars, coarser bars, closed-bar scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import bucket_micros, micros, tf_minutes
from tidemark.operators.blocks import with_seq

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
BARS_PER_CHUNK = 4096


def tick_order(ticks: DataFrame, ts: str, tie: Sequence[str]) -> Column:
    """Orders ticks by time, then by the tie columns.

    With one integral tie column the order is a single number (time in steps wider
    than the tie's range), so open and close keep a hash aggregate; a struct would
    make Spark sort all ticks first.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if len(tie) == 1 and dict(ticks.dtypes)[tie[0]] in whole:
        steps = "cast(20000000000000000000 AS DECIMAL(20, 0))"
        return F.expr(f"cast(unix_micros({ts}) AS DECIMAL(18, 0)) * {steps} + cast({tie[0]} AS DECIMAL(19, 0))")
    return F.struct(F.col(ts), *[F.col(c) for c in tie])


def to_bars(
    ticks: DataFrame, tf: str, *, key: str = "symbol", ts: str = "ts", price: str = "price",
    qty: Column | None = None, tie: Sequence[str] = ("id",),
) -> DataFrame:
    """OHLCV bars keyed by bar open time; one partially aggregated shuffle.

    ``tie`` columns order ticks that share a timestamp. Empty buckets give no bar.
    """
    minutes = tf_minutes(tf)
    at = tick_order(ticks, ts, tie)
    return (
        ticks.withColumn("_b", bucket_micros(F.col(ts), minutes))
        .groupBy(F.col(key).alias("symbol"), "_b")
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            (F.count(F.lit(1)).cast("double") if qty is None else F.sum(qty)).alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.timestamp_micros("_b").alias("ts"), *BAR_COLUMNS)
    )


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Coarser bars from finer ones."""
    minutes = tf_minutes(tf)
    return (
        bars.withColumn("_b", bucket_micros(F.col("ts"), minutes))
        .groupBy("symbol", "_b")
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.timestamp_micros("_b").alias("ts"), *BAR_COLUMNS)
    )


def closed_bars(bars: DataFrame, tf: str, as_of: Column, expected: int, share: float = 0.8) -> DataFrame:
    """Bars closed by ``as_of`` with trade and price; thin series are left out.

    A series stays when it keeps at least ``share * expected`` bars. The count is
    a partial aggregate and the filter a semi join, so no series is windowed.
    """
    minutes = tf_minutes(tf)
    done = bars.where(
        (micros(F.col("ts")) + F.lit(minutes * 60_000_000).cast("long") <= micros(as_of))
        & (F.col("volume") > 0)
        & (F.col("close") > 0)
    )
    enough = done.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * expected)
    return done.join(enough.select("symbol"), "symbol", "left_semi")


def merge_pages(pages: DataFrame, keys: Sequence[str], *, arrival: str, keep: str = "first") -> DataFrame:
    """Union of overlapping fetches: one row per key, first or last by arrival."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in pages.columns if c not in keys]
    return (
        pages.groupBy(*keys)
        .agg(pick(F.struct(*rest), arrival).alias("_r"))
        .select(*keys, "_r.*")
    )


def bar_scan(pages: DataFrame, *, arrival: str, ms: str = "ms", keys: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """Fetched pages to bars: UTC times, one row per bar, the first arrival kept."""
    timed = pages.withColumn("ts", F.timestamp_millis(ms)).drop(ms)
    return merge_pages(timed, [*keys, "ts"], arrival=arrival, keep="first")


def numbered(bars: DataFrame, tf: str, keys: Sequence[str] = ("symbol",), **extra) -> DataFrame:
    """``seq`` per series. A chunk is a fixed span of time, so it holds at most
    ``BARS_PER_CHUNK`` bars however long the series is."""
    span = tf_minutes(tf) * 60_000_000 * BARS_PER_CHUNK
    chunk = {"_chunk": F.floor(micros(F.col("ts")) / F.lit(float(span)))}
    return with_seq(bars, list(keys), ["ts"], chunk, **extra)


def rising(flag: Column, window) -> Column:
    """True on the first row of a run of true rows."""
    return flag & ~F.coalesce(F.lag(flag).over(window), F.lit(False))
