"""Entries refused while their symbol cools down after an exit, on two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros

MINUTE = 60_000_000


def decided_entries(
    entries: DataFrame, exits: DataFrame, delay: str, *, refused: bool, minutes: float, span: int = 10, ts: str = "ts", exit_ts: str = "exit_time"
) -> DataFrame:
    """Entries that an exit of their symbol in the ``minutes`` before them refuses, or those that none does.

    An entry at the moment of an exit is refused, one exactly ``minutes`` later is not. Exits are first reduced to the first and last of every ``span``
    minutes, which decide like all of them, since a span is no longer than the cooldown: a symbol with a third of all exits
    leaves a row per span. Entries and spans meet by symbol and stretch of time, so that no symbol is one task. Rows later than
    ``delay`` are dropped. Once the watermark has passed what a span or an entry can still meet, its state goes; an admitted entry is given out then, a
    refused one with its first span. Entries without a symbol or time are not given out.
    """
    rest = int(minutes * MINUTE)
    if span * MINUTE > rest:
        raise ValueError("a span must not be longer than the cooldown")
    stretch = rest + span * MINUTE
    spans = (
        exits.withWatermark(exit_ts, delay)
        .groupBy(F.col("symbol").alias("_symbol"), F.window(exit_ts, f"{span} minutes").alias("_w"))
        .agg(F.min(exit_ts).alias("_first"), F.max(exit_ts).alias("_last"))
    )
    reach = F.sequence(_part(micros(F.col("_first")), stretch), _part(micros(F.col("_last")) + rest, stretch))
    spans = spans.select("_symbol", F.window_time("_w").alias("_at"), "_first", "_last", F.explode(reach).alias("_stretch"))
    asked = entries.where(F.col("symbol").isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    cooldown = F.expr(f"INTERVAL {rest} MICROSECONDS")
    meets = (
        (F.col("symbol") == F.col("_symbol")) & (_part(micros(F.col(ts)), stretch) == F.col("_stretch"))
        & (F.col("_first") <= F.col(ts)) & (F.col("_last") > F.col(ts) - cooldown)
        & (F.col("_at") >= F.col(ts) - cooldown) & (F.col("_at") <= F.col(ts) + F.expr(f"INTERVAL {span} MINUTES"))
    )
    if refused:
        return asked.join(spans, meets, "left_semi")
    return asked.join(spans, meets, "left_outer").where("_symbol is null").select(*entries.columns)


def _part(at: Column, stretch: int) -> Column:
    return F.floor(at / stretch).cast("long")
