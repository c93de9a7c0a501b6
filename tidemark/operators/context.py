"""Context series: spreads, open interest, funding and sentiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import indicators as ind
from tidemark.operators.blocks import block_window, halo_blocks, own_rows, with_seq
from tidemark.params import Portfolio


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spread_pct(bid, ask) -> Column:
    """Spread over the middle in percent; null for a one-sided or crossed book."""
    bid, ask = _c(bid), _c(ask)
    good = (bid > 0) & (ask > 0) & (ask >= bid)
    return F.when(good, (ask - bid) / ((bid + ask) / 2) * 100)


def spread_ok(pct, entry, sl, share: float = Portfolio.spread_fraction) -> Column:
    """The spread costs at most ``share`` of the planned risk; unknown passes."""
    pct, entry = _c(pct), _c(entry)
    return pct.isNull() | (pct / 100 * entry <= share * F.abs(entry - _c(sl)))


def funding_series(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    """Points with a time and a rate inside the window, one interval of lead."""
    lead = F.make_dt_interval(hours=F.lit(8))
    return raw.where(
        F.col("ts").isNotNull() & F.col("rate").isNotNull() & F.col("ts").between(start - lead, end)
    ).select("symbol", "ts", F.col("rate").cast("double").alias("value"))


def open_interest(raw: DataFrame) -> DataFrame:
    """Value else amount, zero and null dropped, the last arrival per time kept."""
    value = F.coalesce(F.nullif(F.col("oi_value"), F.lit(0.0)), F.nullif(F.col("oi_amount"), F.lit(0.0)))
    return (
        raw.select("symbol", "ts", "arrival", value.alias("oi"))
        .where(F.col("ts").isNotNull() & F.col("oi").isNotNull())
        .groupBy("symbol", "ts")
        .agg(F.max_by("oi", "arrival").alias("oi"))
    )


def open_interest_changes(points: DataFrame, col: str, order=("ts",), rows: int = 13, span: int = 86_400_000_000):
    """Change from the previous point and over the last ``rows`` points."""
    w = block_window(["symbol"])
    chunk = {"_chunk": F.floor(micros(F.col("ts")) / span)}
    df = halo_blocks(with_seq(points, ["symbol"], list(order), chunk), ["symbol"], block=4096, halo=max(64, rows))
    df = df.select("*", ind.pct_change(w, col).alias("step_pct"), ind.pct_change_rows(w, col, rows).alias("hour_pct"))
    return own_rows(df)


SENTIMENT_SCHEMA = "data ARRAY<STRUCT<timestamp: STRING, value: STRING>>"


def sentiment_series(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Index payloads to (ts, value); points with a missing part are dropped."""
    point = F.explode(F.from_json(F.col(col), SENTIMENT_SCHEMA)["data"])
    rows = payloads.select(point.alias("p"))
    seconds, value = F.expr("try_cast(p.timestamp AS BIGINT)"), F.expr("try_cast(p.value AS DOUBLE)")
    return rows.select(F.timestamp_seconds(seconds).alias("ts"), value.alias("value")).where(
        "ts is not null and value is not null"
    )


def fresh_enough(ts, context_ts, seconds: float) -> Column:
    """The looked-up value is no older than its time to live."""
    return (micros(_c(ts)) - micros(_c(context_ts))) <= F.lit(int(seconds * 1_000_000)).cast("long")
