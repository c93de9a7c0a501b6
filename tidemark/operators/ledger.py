"""Trade ledger: form, streaks, exposure, balances, reconciliation, tails.

Ledger order is global by meaning (the account takes one trade after another),
so "the last ten trades" cannot be partitioned by symbol. Rows are numbered by
chunks and windowed in padded blocks like bars, never in one global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.economics import approx_pnl, outcome, tidy
from tidemark.functions.symbols import exchange_symbol, is_major
from tidemark.functions.times import micros, session_of
from tidemark.operators.blocks import block_window, halo_blocks, own_rows, running, with_seq
from tidemark.params import Portfolio
from tidemark.session import stage

# Look-backs of the ledger context and when it starts to count.
RECENT, FORM, PNL_ROWS, DD_ROWS, MIN_HISTORY, MIN_FORM = 10, 20, 20, 50, 5, 3
ACTIVE, CLOSED = ("OPEN", "PENDING"), ("WIN", "LOSS")
LEDGER_CHUNK = 65_536


def is_active(col: str = "status") -> Column:
    return F.col(col).isin(*ACTIVE)


def is_closed(col: str = "status") -> Column:
    return F.col(col).isin(*CLOSED)


def ledger_rank(ledger: DataFrame, seq: str = "seq", keys: Sequence[str] = ()) -> DataFrame:
    """``n``: dense 0-based place in insertion order (per key when given)."""
    return with_seq(ledger, list(keys), [seq], {"_chunk": F.expr(f"{seq} div {LEDGER_CHUNK}")}, name="n")


def with_context(ledger: DataFrame, seq: str = "seq") -> DataFrame:
    """Form of the account just before each row, from earlier rows only.

    recent_win_rate, streak_count, cumulative_pnl and current_dd_abs (currency,
    also under its historic name current_dd_pct); neutral below five rows.
    """
    won = F.col("status") == "WIN"
    rows = halo_blocks(ledger_rank(ledger, seq), [], block=4096, halo=64, seq="n")
    w = block_window([], "n")
    back = lambda n: w.rowsBetween(-n, -1)
    pnl = F.coalesce(F.col("pnl"), F.lit(0.0))
    prior = F.lag(won).over(w)
    rows = own_rows(
        rows.select(
            "*",
            F.avg(won.cast("double")).over(back(RECENT)).alias("_rate"),
            F.sum(pnl).over(back(PNL_ROWS)).alias("_sum"),
            F.collect_list(pnl).over(back(DD_ROWS)).alias("_pnls"),
            prior.alias("_prior"),
            (prior.isNull() | (prior != won)).alias("_turn"),
        )
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("peak"))

    def step(s, x):
        total = s["sum"] + x
        return F.struct(total.alias("sum"), F.greatest(s["peak"], total).alias("peak"))

    fall = F.aggregate("_pnls", start, step, lambda s: F.coalesce(s["peak"] - s["sum"], F.lit(0.0)))
    rows = rows.withColumn("_fall", fall).drop("_pnls")  # folded before it is stored
    # Start of the run that ends at the previous row, carried across chunks.
    rows = running(
        stage(rows, "form"), [], {"_chunk": F.expr(f"n div {LEDGER_CHUNK}")}, ["n"],
        {"_since": (F.when(F.col("_turn"), F.col("n")), "max")}, exclusive=True,
    )
    run = (F.col("n") - F.col("_since")).cast("int")
    young = F.col("n") < MIN_HISTORY
    out = {
        "recent_win_rate": F.when(young, 0.5).otherwise(F.col("_rate")),
        "streak_count": F.when(young, 0).otherwise(F.when(F.col("_prior"), run).otherwise(-run)),
        "cumulative_pnl": F.when(young, 0.0).otherwise(F.col("_sum")),
        "current_dd_abs": F.when(young, 0.0).otherwise(F.col("_fall")),
    }
    base = [c for c in ledger.columns if c not in (*out, "current_dd_pct")]
    return rows.select(*base, "n", *[v.alias(k) for k, v in out.items()]).withColumn(
        "current_dd_pct", F.col("current_dd_abs")
    )


def with_symbol_form(closed: DataFrame, seq: str = "seq") -> DataFrame:
    """Win rate of the symbol's last 20 closed trades before the row."""
    rows = halo_blocks(ledger_rank(closed, seq, ["symbol"]), ["symbol"], block=4096, halo=32, seq="n")
    frame = block_window(["symbol"], "n").rowsBetween(-FORM, -1)
    won = (F.col("status") == "WIN").cast("double")
    rate = F.when(F.count(won).over(frame) >= MIN_FORM, F.avg(won).over(frame)).otherwise(0.5)
    return own_rows(rows.select("*", rate.alias("symbol_win_rate"))).drop("n")


def form_as_of(closed: DataFrame, seq: str = "seq") -> DataFrame:
    """Per symbol and closed trade: the win rate including that trade, for as-of use.

    ``n`` orders trades that closed at the same time.
    """
    rows = halo_blocks(ledger_rank(closed, seq, ["symbol"]), ["symbol"], block=4096, halo=32, seq="n")
    frame = block_window(["symbol"], "n").rowsBetween(1 - FORM, 0)
    won = (F.col("status") == "WIN").cast("double")
    rate = F.when(F.count(won).over(frame) >= MIN_FORM, F.avg(won).over(frame)).otherwise(0.5)
    return own_rows(rows.select("symbol", F.col("exit_time").alias("ts"), "n", "_blk", "_pos", "_own", rate.alias("symbol_win_rate")))


# ------------------------------------------------------------------ diagnostics

DIMENSIONS = ("session", "day_of_week", "market_regime", "symbol")


def diagnostics(closed: DataFrame, min_count: int = 3) -> DataFrame:
    """Win rate by session, weekday, regime and symbol, and overall, in one pass."""
    keyed = closed.select(
        session_of(F.coalesce(F.col("hour"), F.lit(12))).alias("session"),
        F.col("day_of_week").cast("string").alias("day_of_week"),
        "market_regime",
        "symbol",
        F.when(F.col("status") == "WIN", 1.0).otherwise(0.0).alias("target"),
    )
    sets = [[d] for d in DIMENSIONS] + [[]]
    cube = keyed.groupingSets(sets, *DIMENSIONS).agg(
        F.grouping_id().alias("_gid"), tidy(F.avg("target"), 3).alias("win_rate"), F.count(F.lit(1)).alias("n")
    )
    width = len(DIMENSIONS)
    whole = (1 << width) - 1
    name, value = F.lit("overall"), F.lit("all")
    for i, d in enumerate(DIMENSIONS):
        own = F.col("_gid") == whole - (1 << (width - 1 - i))
        name, value = F.when(own, d).otherwise(name), F.when(own, F.col(d)).otherwise(value)
    out = cube.select(name.alias("dimension"), value.alias("bucket"), "win_rate", "n")
    return out.where((F.col("dimension") == "overall") | ((F.col("n") >= min_count) & F.col("bucket").isNotNull()))


def best_and_worst(stats: DataFrame) -> DataFrame:
    """Best and worst bucket per dimension; ties go to the later and earlier name."""
    rank = F.struct("win_rate", "bucket")
    return (
        stats.where(F.col("dimension") != "overall")
        .groupBy("dimension")
        .agg(F.max_by("bucket", rank).alias("best"), F.min_by("bucket", rank).alias("worst"))
    )


def extremes(stats: DataFrame, by: str, name: str, top: int) -> DataFrame:
    """The ``top`` highest and lowest rows, as two ordered limits."""
    high = stats.orderBy(F.desc(by), name).limit(top).withColumn("side", F.lit("top"))
    low = stats.orderBy(F.asc(by), F.desc(name)).limit(top).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


# ------------------------------------------------------------------ exposure and balance


def trade_risk() -> Column:
    return F.coalesce(F.abs(F.col("entry") - F.col("sl")) * F.col("qty"), F.lit(0.0))


def exposure(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Heat and counts of active positions, per group."""
    one = lambda cond: F.count_if(cond)
    return (
        trades.where(is_active())
        .groupBy(*by)
        .agg(
            F.sum(trade_risk()).alias("heat"),
            one(F.col("direction") == "LONG").alias("longs"),
            one(F.col("direction") == "SHORT").alias("shorts"),
            one(~is_major(F.col("symbol"))).alias("alts"),
            F.count(F.lit(1)).alias("active"),
        )
    )


def daily_pnl(closed: DataFrame, ts: str = "exit_time") -> DataFrame:
    return closed.groupBy(F.to_date(ts).alias("day")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))


def balance(closed: DataFrame, start: float) -> DataFrame:
    return closed.agg((F.lit(start) + F.coalesce(F.sum("pnl"), F.lit(0.0))).alias("balance"))


def trading_allowed(closed: DataFrame, seq: str, ts: str, limit: float = Portfolio.daily_loss_limit) -> DataFrame:
    """Profit of the UTC day before each row, and whether the loss limit still holds."""
    spent = running(
        closed.withColumn("day", F.to_date(ts)), ["day"], {"_chunk": F.expr(f"{seq} div {LEDGER_CHUNK}")}, [seq],
        {"day_pnl": (F.col("pnl"), "sum")}, exclusive=True,
    )
    so_far = F.coalesce(F.col("day_pnl"), F.lit(0.0))
    return spent.withColumn("day_pnl", so_far).withColumn("allowed", F.col("day_pnl") > -limit)


def cooldowns(closed: DataFrame, minutes: float = Portfolio.cooldown_minutes, ts: str = "exit_time") -> DataFrame:
    until = F.timestamp_micros(F.max(micros(F.col(ts))) + F.lit(int(minutes * 60_000_000)).cast("long"))
    return closed.groupBy("symbol").agg(until.alias("until"))


def cooling_at(closed: DataFrame, now: Column, **kw) -> DataFrame:
    return cooldowns(closed, **kw).where(micros(F.col("until")) > micros(now)).select("symbol")


def new_signals(signals: DataFrame, known: DataFrame) -> DataFrame:
    """Signals whose hash is not stored yet."""
    return signals.join(known.select("signal_hash").distinct(), "signal_hash", "left_anti")


def symbols_with_open(names: DataFrame, trades: DataFrame) -> DataFrame:
    return names.join(trades.where(F.col("status") == "OPEN").select("symbol").distinct(), "symbol", "left_semi")


def trade_counts(history: DataFrame, open_trades: DataFrame) -> DataFrame:
    """Next trade number and the real / simulated mix, in one aggregate.

    Simulated rows never count towards the numbering.
    """
    simulated = F.coalesce(F.col("source"), F.lit("live")) == "backtest"
    kinds = history.select(F.when(simulated, "backtest").otherwise("real").alias("kind")).unionByName(
        open_trades.select(F.lit("open").alias("kind"))
    )
    n = lambda k: F.count_if(F.col("kind") == k)
    return kinds.agg((n("real") + n("open") + 1).alias("next_no"), n("real").alias("n_real"), n("backtest").alias("n_backtest"))


def reconcile(trades: DataFrame, positions: DataFrame, closed_records: DataFrame) -> DataFrame:
    """Close local OPEN rows that the exchange no longer holds.

    The latest closed record per symbol gives price and profit; without one the
    target (or entry) price and a computed profit stand in, marked approximate.
    """
    held = positions.where(F.col("size") > 0).select(F.col("symbol").alias("_x")).distinct()
    latest = closed_records.groupBy(F.col("symbol").alias("_x")).agg(
        F.max_by(F.struct("exit_price", "realized_pnl"), "closed_at").alias("_r")
    )
    gone = trades.where(F.col("status") == "OPEN").withColumn("_x", exchange_symbol(F.col("symbol"))).join(held, "_x", "left_anti")
    known = lambda c: F.nullif(F.col(c), F.lit(0.0))
    price = F.coalesce(F.nullif(F.col("_r.exit_price"), F.lit(0.0)), known("tp"), F.col("entry"), F.lit(0.0))
    found = gone.join(latest, "_x", "left").withColumn("exit_price", price)
    approx = F.col("_r.realized_pnl").isNull()
    profit = F.coalesce(F.col("_r.realized_pnl"), approx_pnl("direction", "entry", "exit_price", "qty"))
    base = [c for c in trades.columns if c not in ("exit_price", "pnl", "status", "exit_reason")]
    reason = F.when(approx, "closed_outside_approx").otherwise("closed_outside")
    return found.select(
        *base, "exit_price", tidy(profit, 2).alias("pnl"), outcome(profit).alias("status"), reason.alias("exit_reason"),
        approx.alias("approx"),
    )


# ------------------------------------------------------------------ tails and unions


def last_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The newest ``n`` rows: a per-task top-n, then one small merge."""
    return df.orderBy(F.desc(seq)).limit(n)


def top_signals(signals: DataFrame, scan: str, rank: str, n: int = Portfolio.top_signals) -> DataFrame:
    """Best ``n`` per scan by confidence; equal confidence keeps scan order."""
    w = Window.partitionBy(scan).orderBy(F.desc("confidence"), rank)
    return signals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def tagged_backfill(trades: DataFrame, limit: int | None, ts: str = "entry_time") -> DataFrame:
    """Simulated trades marked as such, newest ``limit`` kept."""
    marked = trades.withColumn("source", F.lit("backtest"))
    return marked if limit is None else marked.orderBy(F.desc(ts), F.desc("seq")).limit(limit)


def with_backfill(ledger: DataFrame, simulated: DataFrame, *, replace: bool = False) -> DataFrame:
    """Simulated rows in front of real ones; does nothing over an earlier backfill.

    ``place`` orders the union: backfill first, then real rows.
    """
    old = F.coalesce(F.col("source"), F.lit("live")) == "backtest"
    real = ledger.where(~old)
    if not replace and not ledger.where(old).isEmpty():
        return ledger.withColumn("place", F.when(old, 0).otherwise(1))
    return simulated.withColumn("place", F.lit(0)).unionByName(
        real.withColumn("place", F.lit(1)), allowMissingColumns=True
    )
