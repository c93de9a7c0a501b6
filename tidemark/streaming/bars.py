"""Streaming bars, signal de-duplication, daily breaker, incremental signals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.times import micros, tf_minutes
from tidemark.operators.bars import tick_order
from tidemark.operators.context import fresh_enough
from tidemark.session import staging_root


def stream_bars(ticks: DataFrame, tf: str, delay: str, *, tie: str = "id") -> DataFrame:
    """Closed bars of a tick stream; each bar is emitted once, when it closes.

    Needs symbol, ts (TIMESTAMP), price and ``tie``. Ticks later than ``delay``
    behind the newest one are dropped by the watermark.
    """
    at = tick_order(ticks, "ts", [tie])
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{tf_minutes(tf)} minutes").alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def unique_signals(signals: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """First signal per hash within the watermark."""
    return signals.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["signal_hash"])


def stream_daily_pnl(closed: DataFrame, delay: str, ts: str = "exit_time") -> DataFrame:
    """Profit per finished UTC day, the input of the loss breaker."""
    return (
        closed.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))
        .select(F.col("w.start").alias("day"), "pnl", "trades")
    )


def fresh_context(rows: DataFrame, context: DataFrame, by: list[str], ttl_seconds: dict[str, float], ts: str = "ts") -> DataFrame:
    """Join a slowly changing context table; values past their time to live read null.

    ``context`` holds ``by`` and, per series, ``<name>`` and ``<name>_ts``.
    """
    joined = rows.join(context, by, "left")
    keep = [c for c in joined.columns if c not in ttl_seconds and c not in {f"{n}_ts" for n in ttl_seconds}]
    return joined.select(
        *keep, *[F.when(fresh_enough(ts, f"{n}_ts", s), F.col(n)).alias(n) for n, s in ttl_seconds.items()]
    )


def context_batches(
    read: Callable[[], DataFrame], by: list[str], ttl_seconds: dict[str, float], sink: Callable[[DataFrame, int], None], ts: str = "ts"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: join each micro-batch with the context as it is then.

    ``read`` opens the context, rows of ``by``, series, ts and value that are only ever appended, and is called for every
    micro-batch, so that points added between two batches count in the second. Only points that can still be fresh for a row of the
    batch are read. Per key and series the newest one counts; past its time to live it reads null, as for rows without a time or key.
    """
    longest = int(max(ttl_seconds.values()) * 1_000_000)

    def run(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            first = held.agg(F.min(micros(F.col(ts)))).first()[0]
            alive = F.col("ts") >= F.timestamp_micros(F.lit(first - longest)) if first is not None else F.lit(False)
            points = read().where(F.col("series").isin(*ttl_seconds) & alive)
            of = {n: F.when(F.col("series") == n, F.col("ts")) for n in ttl_seconds}
            newest = points.groupBy(*by).agg(*[c for n, at in of.items() for c in (F.max_by("value", at).alias(n), F.max(at).alias(f"{n}_ts"))])
            sink(fresh_context(held, newest, by, ttl_seconds, ts), epoch)
        finally:
            held.unpersist()

    return run


def drain(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Run the stream over everything available and read what it wrote."""
    return counted_drain(stream, name, mode=mode)[0]


def counted_drain(stream: DataFrame, name: str, *, mode: str = "append") -> tuple[DataFrame, dict[str, int]]:
    """What ``drain`` reads, and the rows that went in, came out, were dropped as late and as duplicates.

    Stateful operators count what reaches them: an aggregation's late rows are its partial results, one per task and group.
    """
    spark = stream.sparkSession
    base = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    q.awaitTermination()
    rows, steps = spark.read.schema(stream.schema).parquet(f"{base}/rows"), q.recentProgress
    states = [s for p in steps for s in p.stateOperators]
    counts = {
        "rows_in": sum(p.numInputRows for p in steps),
        "rows_out": rows.count(),
        "rows_late": sum(s.numRowsDroppedByWatermark for s in states),
        "rows_duplicate": sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in states),
    }
    return rows, counts


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps every batch in a folder of its own number, so that a batch that comes again replaces itself."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def drain_batches(stream: DataFrame, name: str, run: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hand everything available to ``run``, a micro-batch at a time; with the checkpoint of an earlier call, what is new since then."""
    checkpoint = checkpoint or f"{staging_root(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def signal_batches(
    spark: SparkSession, history_path: str, sink: Callable[[DataFrame, int], None], compute: Callable[[DataFrame], DataFrame],
    tf: str, rows: int = 251,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: store new bars, recompute touched symbols.

    A batch's bars are stored under its number, so a batch that comes again adds nothing. A touched symbol gets its last ``rows`` bars before the batch, however far back
    they lie. The history lies in day partitions; a batch reads those of its
    look-back span, and earlier ones only while a touched symbol has too few bars.
    Results for the new bars go to the sink.
    """
    step = timedelta(minutes=tf_minutes(tf) * rows)
    by_symbol = Window.partitionBy("symbol").orderBy(F.desc("ts"))

    def run(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            schema = batch.schema
            held.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{history_path}/batch={epoch}")
            new = held.select("symbol", "ts").distinct()
            touched = held.groupBy("symbol").agg(F.min("ts").alias("_first"))
            first = touched.agg(F.min(F.to_date("_first"))).first()[0]
            if first is None:
                return
            stored, back = spark.read.parquet(history_path), step
            while True:
                since = F.col("day") >= F.lit(first - max(back, timedelta(days=1)))
                recent = stored.where(since).join(touched, "symbol").dropDuplicates(["symbol", "ts"])
                before = recent.where(F.col("ts") < F.col("_first"))
                enough = before.groupBy("symbol").count().where(F.col("count") >= rows).count()
                if enough == touched.count() or stored.where(~since).isEmpty():
                    break
                back *= 4
            last = before.withColumn("_place", F.row_number().over(by_symbol)).where(F.col("_place") <= rows)
            slice_ = last.select(schema.names).unionByName(recent.where(F.col("ts") >= F.col("_first")).select(schema.names))
            sink(compute(slice_).join(new, ["symbol", "ts"], "left_semi"), epoch)
        finally:
            held.unpersist()

    return run
