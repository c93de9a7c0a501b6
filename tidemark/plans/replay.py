"""Set-based replay of signals: fill, exit, label, one position at a time.

Every signal is filled, exited and labelled as if it stood alone, all in bulk;
only then does the chain decide which of them the account could have held, and
compounding runs over those. Nothing loops over bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.economics import is_long, outcome, signed_move, tidy
from tidemark.operators.blocks import BLOCK, running
from tidemark.operators.chain import BLOCK as CHAIN_BLOCK, NEVER, take_in_turn
from tidemark.operators.forward import DATA_END, first_touch, label_geometry, limit_fills, longest_series, trailing_exits
from tidemark.operators.performance import compounded, drawdowns, metrics
from tidemark.params import GRID, Execution
from tidemark.session import stage

TRADE_KEYS = ["symbol"]


def with_sid(signals: DataFrame, *parts: str) -> DataFrame:
    return signals.withColumn("sid", F.concat_ws("|", *(parts or ("symbol", "seq"))))


def slipped(direction, price: Column, pct: float, *, leaving: bool) -> Column:
    """Adverse slippage: worse by ``pct`` percent on the side being traded."""
    slip = pct / 100
    worse_up = is_long(direction) if not leaving else ~is_long(direction)
    return F.when(worse_up, price * (1 + slip)).otherwise(price * (1 - slip))


def per_unit_return(mode: Column, x: Execution) -> Column:
    """Profit after fees per unit of quantity."""
    entry_rate = F.when(mode == "limit", x.maker_fee).otherwise(x.taker_fee)
    gross = signed_move("direction", "entry", "exit_price")
    return gross - (F.col("entry") * entry_rate + F.col("exit_price") * x.taker_fee)


def resolved(rows: DataFrame, bars: DataFrame, x: Execution) -> DataFrame:
    """Exit every filled row; needs sid, direction, entry, sl, tp, start, fill."""
    exits = trailing_exits(rows, bars, longest_series(bars))
    out = rows.join(exits, "sid").where(F.abs(F.col("entry") - F.col("sl")) > 0)
    out = out.withColumn("exit_price", slipped("direction", F.col("exit_price"), x.slippage_pct, leaving=True))
    risk = F.abs(F.col("entry") - F.col("sl"))
    return (
        out.withColumn("rho", per_unit_return(F.col("entry_mode"), x) / risk * (x.risk_pct / 100.0))
        .withColumn("realized_r", tidy(signed_move("direction", "entry", "exit_price") / risk, 4))
        .withColumn("walk_bars", F.col("bars_held"))
        .withColumn("bars_held", F.col("bars_held") + F.col("fill"))
    )


def filled(signals: DataFrame, bars: DataFrame, x: Execution, mode: str) -> DataFrame:
    """Entry price, fill offset and first bar of the position, per signal."""
    ready = signals.withColumn("start", F.col("seq") + 1).withColumn("entry_mode", F.lit(mode))
    if mode == "market":
        price = slipped("direction", F.col("signal_close"), x.slippage_pct, leaving=False)
        return ready.withColumn("entry", price).withColumn("fill", F.lit(0))
    fills = limit_fills(ready, bars, x.ttl_bars, invalidate=x.invalidate)
    return (
        ready.withColumn("entry", F.col("limit_price"))
        .join(fills, "sid")
        .withColumn("start", F.col("start") + F.col("fill"))
    )


def trail_gap(x: Execution) -> Column:
    if not x.trail_by_atr:
        return F.lit(None).cast("double")
    return F.nullif(
        F.greatest(F.col("entry") * x.trail_pct / 100.0, F.coalesce(F.col("atr"), F.lit(0.0)) * x.trail_atr), F.lit(0.0)
    )


def simulate(
    signals: DataFrame, bars: DataFrame, x: Execution = Execution(), mode: str = "limit", *, label: bool = True,
    profit_atr: float | None = None, stop_atr: float | None = None, block: int = CHAIN_BLOCK,
) -> DataFrame:
    """Closed trades of all symbols with labels and compounded equity.

    ``bars`` are numbered bars (symbol, ts, seq, high, low, close); signals carry
    the same ``seq``.
    """
    done = stage(resolved(_prepared(signals, bars, x, mode), bars, x), "resolved")
    taken = take_in_turn(_occupying(done), TRADE_KEYS, block=block).drop("pos", "free")
    return _booked(taken, bars, x, label, profit_atr, stop_atr)


def simulate_counted(
    signals: DataFrame, bars: DataFrame, x: Execution = Execution(), *, label: bool = True, profit_atr: float | None = None,
    stop_atr: float | None = None, block: int = CHAIN_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Trades as from ``simulate`` with limit entries, and (symbol, unfilled_limit_orders).

    An order counts as unfilled if it was placed while the symbol was flat and price never reached it. Such orders join
    the chain of positions as candidates that free their symbol with the next bar, so they are met exactly when flat and
    change no trade.
    """
    ready = _prepared(signals, bars, x, "limit")
    fills = stage(ready, "fills")
    done = _occupying(stage(resolved(fills, bars, x), "resolved"))
    slim = [*TRADE_KEYS, "sid", F.col("seq").alias("pos"), "free"]
    missed = with_sid(signals).join(fills.select("sid"), "sid", "left_anti").withColumn("free", F.col("seq") + 1)
    both = stage(done.select(*slim, F.lit(False).alias("missed")).unionByName(missed.select(*slim, F.lit(True).alias("missed"))), "orders")
    met = stage(take_in_turn(both, TRADE_KEYS, block=block), "met")
    taken = done.drop("pos", "free").join(met.where("not missed").select("sid"), "sid", "left_semi")
    unfilled = met.where("missed").groupBy(*TRADE_KEYS).agg(F.count("*").alias("unfilled_limit_orders"))
    return _booked(taken, bars, x, label, profit_atr, stop_atr), unfilled


def _prepared(signals: DataFrame, bars: DataFrame, x: Execution, mode: str) -> DataFrame:
    """Filled rows with their trail."""
    rows = filled(with_sid(signals), bars, x, mode)
    rows = rows.withColumn("trail_pct", F.lit(x.trail_pct)).withColumn("activation", F.lit(x.activation))
    return rows.withColumn("trail_dist", trail_gap(x))


def _occupying(done: DataFrame) -> DataFrame:
    """Resolved rows with the position they take and the one that they free."""
    freed = F.when(F.col("exit_reason") == DATA_END, F.lit(NEVER)).otherwise(
        F.col("seq") + F.greatest(F.lit(1), F.col("bars_held")) + 1
    )
    return done.withColumn("pos", F.col("seq")).withColumn("free", freed)


def _booked(taken: DataFrame, bars: DataFrame, x: Execution, label: bool, profit_atr: float | None, stop_atr: float | None) -> DataFrame:
    """Taken rows with labels, compounded equity and drawdown."""
    if label:
        geometry = label_geometry(taken, profit_atr, stop_atr)
        tb = first_touch(geometry, bars, x.label_bars)
        taken = taken.join(tb, "sid", "left")
        taken = with_label_end(taken, bars)
    taken = stage(taken, "taken")
    trades = compounded(taken, TRADE_KEYS, "seq", "rho", x.start_balance)
    risk = F.abs(F.col("entry") - F.col("sl"))
    pnl = F.col("equity_before") * F.col("rho")
    trades = trades.withColumn("qty", F.col("equity_before") * (x.risk_pct / 100.0) / risk)
    trades = trades.withColumn("status", outcome(pnl)).withColumn("pnl", tidy(pnl, 4))
    trades = trades.withColumn("entry_time", F.col("ts")).withColumn("source", F.lit("backtest"))
    return drawdowns(trades, TRADE_KEYS, ["seq"], {"_chunk": F.floor(F.col("seq") / BLOCK)}, "equity", x.start_balance)


def with_label_end(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Time of the bar after the touch, clamped to the last bar of the series."""
    ends = bars.groupBy("symbol").agg(F.max("seq").alias("_last"))
    at = F.least(F.col("start") + F.col("tb_bars_to_touch"), F.col("_last"))
    clock = bars.select("symbol", F.col("seq").alias("_at"), F.col("ts").alias("tb_exit_time"))
    return trades.join(ends, "symbol").withColumn("_at", at).join(clock, ["symbol", "_at"], "left").drop("_at", "_last")


def replay_metrics(trades: DataFrame, x: Execution = Execution(), unfilled: DataFrame | None = None) -> DataFrame:
    """Metrics per symbol with trades; with the orders of ``simulate_counted`` also how many were never filled."""
    out = metrics(trades, TRADE_KEYS, ["seq"], x.start_balance)
    if unfilled is None:
        return out
    return out.join(unfilled, TRADE_KEYS, "left").withColumn("unfilled_limit_orders", F.coalesce("unfilled_limit_orders", F.lit(0).cast("long")))


# ------------------------------------------------------------------ grid


def retrace_limit(fraction: Column, clamp: float = 0.25) -> Column:
    """Resting price for a retrace fraction; gap signals keep their stored one."""
    side = F.when(is_long(), 1.0).otherwise(-1.0)
    close, sl = F.col("signal_close"), F.col("sl")
    price, floor = close - side * F.col("atr") * fraction, sl + clamp * (close - sl)
    bounded = F.when(is_long(), F.greatest(F.least(price, close), floor)).otherwise(
        F.least(F.greatest(price, close), floor)
    )
    return F.when(F.col("fvg") == 1, F.col("limit_price")).otherwise(bounded)


def exploded(df: DataFrame, name: str, values: list) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def grid_trades(signals: DataFrame, bars: DataFrame, grid: dict = GRID, modes: tuple[str, ...] = ("limit", "market"),
                x: Execution = Execution(trail_by_atr=False, unfilled_blocks_ttl=True, invalidate=False)) -> DataFrame:
    """Chain candidates of every parameter set that were taken.

    Each parameter multiplies rows only from the step that reads it: fills depend
    on the retrace alone, exits on retrace, trail and activation; confidence only
    filters, right before the chain.
    """
    base = with_sid(signals.withColumn("start", F.col("seq") + 1))
    parts = []
    for mode in modes:
        if mode == "limit":
            tried = exploded(base, "retrace", grid["retrace"])
            tried = tried.withColumn("limit_price", retrace_limit(F.col("retrace")))
            tried = tried.withColumn("fid", F.concat_ws("|", "sid", "retrace"))
            fills = limit_fills(tried, bars, x.ttl_bars, id_col="fid", invalidate=False)
            tried = tried.join(fills, "fid", "left").withColumn("entry", F.col("limit_price"))
            rr = F.col("rr_multiplier")
            tp = F.when(is_long(), F.col("entry") + (F.col("entry") - F.col("sl")) * rr).otherwise(
                F.col("entry") - (F.col("sl") - F.col("entry")) * rr
            )
            tried = tried.withColumn("tp", tp)
        else:
            price = slipped("direction", F.col("signal_close"), x.slippage_pct, leaving=False)
            tried = exploded(base.withColumn("entry", price).withColumn("fill", F.lit(0)), "retrace", grid["retrace"])
        parts.append(tried.withColumn("entry_mode", F.lit(mode)).select(
            "sid", "symbol", "seq", "direction", "confidence", "entry", "sl", "tp", "fill", "start", "entry_mode", "retrace"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    tried = stage(both, "grid-fills")
    # A market entry reads no retrace, so its exits are walked for one value only.
    live = tried.where("fill is not null").where((F.col("entry_mode") == "limit") | (F.col("retrace") == grid["retrace"][0]))
    live = exploded(exploded(live, "trail_pct", grid["trail_pct"]), "activation", grid["activation"])
    live = live.withColumn("start", F.col("start") + F.col("fill")).withColumn("trail_dist", F.lit(None).cast("double"))
    live = live.withColumn("sid", F.concat_ws("|", "sid", "entry_mode", "retrace", "trail_pct", "activation"))
    exits = stage(resolved(live, bars, x), "grid-exits")
    market = F.col("entry_mode") == "market"
    spread = F.when(market, F.array(*[F.lit(v) for v in grid["retrace"]])).otherwise(F.array("retrace"))
    exits = exits.withColumn("retrace", F.explode(spread))
    free = F.when(F.col("exit_reason") == DATA_END, F.lit(NEVER)).otherwise(
        F.col("start") + F.greatest(F.lit(1), F.col("walk_bars")) + 1
    )
    cols = ["symbol", "seq", "entry_mode", "retrace", "trail_pct", "activation", "confidence", "rho", "realized_r", "bars_held", "free"]
    cands = exits.withColumn("free", free).select(*cols)
    if x.unfilled_blocks_ttl:
        idle = exploded(exploded(tried.where("fill is null"), "trail_pct", grid["trail_pct"]), "activation", grid["activation"])
        idle = idle.withColumn("free", F.col("seq") + x.ttl_bars)
        cands = cands.unionByName(idle.select(*[c for c in cols if c in idle.columns]), allowMissingColumns=True)
    cands = exploded(cands, "min_confidence", grid["confidence"]).where("confidence >= min_confidence")
    keys = [*COMBO, "symbol"]
    taken = take_in_turn(stage(cands.withColumn("pos", F.col("seq")), "grid-cands"), keys)
    trades = taken.where("rho is not null").drop("pos", "free")
    trades = compounded(trades, keys, "seq", "rho", x.start_balance)
    return trades.withColumn("pnl", tidy(F.col("equity_before") * F.col("rho"), 6)).drop("equity", "equity_before")


COMBO = ["entry_mode", "min_confidence", "retrace", "trail_pct", "activation"]


def grid_ranking(trades: DataFrame, min_trades: int, top: int | None = None, x: Execution = Execution()) -> DataFrame:
    """Parameter sets by profit factor, then expectancy.

    The equity curve of a set adds up the profits symbol after symbol.
    """
    chunk = {"_sym": F.col("symbol"), "_chunk": F.floor(F.col("seq") / BLOCK)}
    order = ["symbol", "seq"]
    curve = running(trades, COMBO, chunk, order, {"_sum": (F.col("pnl"), "sum")})
    curve = stage(curve.withColumn("equity", F.col("_sum") + x.start_balance).drop("_sum"), "grid-curve")
    curve = drawdowns(curve, COMBO, order, chunk, "equity", x.start_balance)
    scored = metrics(curve, COMBO, order, x.start_balance).where(F.col("n_trades") >= min_trades)
    ranked = scored.orderBy(F.desc("profit_factor"), F.desc("expectancy"), *COMBO)
    return ranked if top is None else ranked.limit(top)


def bar_clock(numbered_bars: DataFrame) -> DataFrame:
    return numbered_bars.select("symbol", "ts", "seq", "high", "low", "close")
