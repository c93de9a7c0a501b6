"""Forward searches: limit fills, barrier touches and trailing exits.

A search starts at ``start`` (a row number of its own series) and looks ahead.
Bounded searches join on (symbol, row bucket), so a hot symbol spreads over its
buckets and each signal meets only the two buckets its horizon touches. The
trailing exit has no horizon; it walks bucket after bucket with growing buckets,
taking only unresolved signals to the next round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.economics import is_long, signed_move, tidy
from tidemark.operators.geometry import atr_barriers
from tidemark.session import stage

KEYS = ("symbol",)
FIRST_BUCKET, BUCKET_GROWTH, LARGEST_BUCKET = 512, 4, 16384

# Reasons an exit search reports.
STOP_HIT, TRAIL_HIT, DATA_END = "Stop Loss Hit", "Trailing Stop Hit", "Open at data end"


def forward_pairs(signals: DataFrame, bars: DataFrame, horizon: int, cols: Sequence[str], keys: Sequence[str] = KEYS):
    """Each signal with the bars start .. start + horizon - 1, as offset ``k``."""
    last = F.col("start") + horizon - 1
    buckets = F.sequence(F.expr(f"start div {horizon}"), F.expr(f"(start + {horizon - 1}) div {horizon}"))
    left = signals.withColumn("_bk", F.explode(buckets))
    right = bars.select(*keys, F.col("seq").alias("_s"), F.expr(f"seq div {horizon}").alias("_bk"), *cols)
    both = left.join(right, [*keys, "_bk"])
    return both.where(F.col("_s").between(F.col("start"), last)).withColumn("k", (F.col("_s") - F.col("start")).cast("int"))


def limit_fills(
    signals: DataFrame, bars: DataFrame, ttl: int, *, id_col: str = "sid", invalidate: bool = True
) -> DataFrame:
    """(id, fill offset) of orders whose price trades before they break or expire.

    A bar that breaks the setup level is tested before the touch, so a tie does
    not fill. Only (id, two minima) leave a task: the aggregate is partial.
    """
    need = signals.select(
        id_col, *KEYS, "start", is_long("direction").alias("_long"), "limit_price",
        (F.col("invalidation_price") if invalidate else F.lit(None).cast("double")).alias("_inv"),
    )
    pairs = forward_pairs(need, bars, ttl, ["high", "low"])
    long = F.col("_long")
    touched = F.when(long, F.col("low") <= F.col("limit_price")).otherwise(F.col("high") >= F.col("limit_price"))
    broken = F.when(long, F.col("low") < F.col("_inv")).otherwise(F.col("high") > F.col("_inv"))
    hits = pairs.groupBy(id_col).agg(
        F.min(F.when(touched, F.col("k"))).alias("fill"), F.min(F.when(broken, F.col("k"))).alias("_broken")
    )
    return hits.where("fill is not null and (_broken is null or fill < _broken)").select(id_col, "fill")


def first_touch(signals: DataFrame, bars: DataFrame, max_bars: int, *, id_col: str = "sid") -> DataFrame:
    """Triple-barrier outcome per signal, columns prefixed ``tb_``.

    Needs direction, entry, profit_price, stop_price and start. Both barriers in
    one bar count as the stop. Rows without usable geometry get nulls; rows
    without a forward bar get a 0-bar timeout at R 0.
    """
    ok = (
        F.col("direction").isin("LONG", "SHORT")
        & F.col("entry").isNotNull()
        & F.col("profit_price").isNotNull()
        & (F.abs(F.col("entry") - F.col("stop_price")) > 0)
    )
    need = signals.select(
        id_col, *KEYS, "start", "direction", "entry", "profit_price", "stop_price",
        F.coalesce(ok, F.lit(False)).alias("_ok"),
    )
    slim = need.where("_ok").select(id_col, *KEYS, "start", is_long("direction").alias("_long"), "profit_price", "stop_price")
    pairs = forward_pairs(slim, bars, max_bars, ["high", "low", "close"])
    long = F.col("_long")
    won = F.when(long, F.col("high") >= F.col("profit_price")).otherwise(F.col("low") <= F.col("profit_price"))
    lost = F.when(long, F.col("low") <= F.col("stop_price")).otherwise(F.col("high") >= F.col("stop_price"))
    seen = pairs.groupBy(id_col).agg(
        F.min(F.when(won, F.col("k"))).alias("_won"),
        F.min(F.when(lost, F.col("k"))).alias("_lost"),
        F.max("k").alias("_end"),
        F.max_by("close", "k").alias("_mark"),
    )
    j = need.join(seen, id_col, "left")
    never = F.lit(2**31 - 1)
    won_at, lost_at = F.coalesce(F.col("_won"), never), F.coalesce(F.col("_lost"), never)
    label = F.when(lost_at < never, F.when(lost_at <= won_at, -1)).otherwise(F.lit(None))
    label = F.coalesce(label, F.when(won_at < never, 1), F.lit(0))
    price = F.when(label == -1, F.col("stop_price")).when(label == 1, F.col("profit_price")).otherwise(
        F.coalesce(F.col("_mark"), F.col("entry"))
    )
    bars_to = F.when(label == -1, lost_at + 1).when(label == 1, won_at + 1).otherwise(F.coalesce(F.col("_end") + 1, F.lit(0)))
    barrier = F.when(label == -1, "stop").when(label == 1, "profit").otherwise("vertical")
    r = tidy(signed_move("direction", "entry", price) / F.abs(F.col("entry") - F.col("stop_price")), 4)
    fields = {
        "tb_label": label,
        "tb_barrier": barrier,
        "tb_bars_to_touch": bars_to.cast("int"),
        "tb_touch_price": price,
        "tb_realized_r": r,
        "tb_ambiguous": (label == -1) & (won_at == lost_at),
    }
    return j.select(id_col, *[F.when(F.col("_ok"), v).alias(n) for n, v in fields.items()])


def label_geometry(signals: DataFrame, profit_atr: float | None = None, stop_atr: float | None = None) -> DataFrame:
    """Barrier prices from the signal's own tp and sl, or from ATR multiples."""
    if profit_atr is not None and stop_atr is not None:
        profit, stop = atr_barriers("direction", F.col("entry"), F.col("atr"), profit_atr, stop_atr)
    else:
        profit, stop = F.col("tp"), F.col("sl")
    return signals.withColumn("profit_price", profit).withColumn("stop_price", stop)


# ------------------------------------------------------------------ trailing exit

STATE = "struct<done int, k bigint, armed boolean, anchor double, price double>"


def _walk(bars: Column, state: Column, long: Column, stop: Column, act: Column, pct: Column, dist: Column) -> Column:
    """Fold one ordered array of bars into the exit state of one signal.

    Per bar: the stop is tested while the trail is not armed; reaching the
    activation price arms it; an armed trail follows the best price and closes
    on the retrace, also within the bar that armed it.
    """

    def step(s, b):
        hit = ~s["armed"] & F.when(long, b["low"] <= stop).otherwise(b["high"] >= stop)
        armed = s["armed"] | F.when(long, b["high"] >= act).otherwise(b["low"] <= act)
        best = F.when(long, F.greatest(s["anchor"], b["high"])).otherwise(F.least(s["anchor"], b["low"]))
        gap = F.coalesce(dist, best * pct / 100)
        level = F.when(long, best - gap).otherwise(best + gap)
        back = armed & F.when(long, b["low"] <= level).otherwise(b["high"] >= level)
        running_ = F.struct(
            F.when(hit, 1).when(back, 2).otherwise(0).alias("done"),
            b["s"].alias("k"),
            armed.alias("armed"),
            F.when(armed, best).alias("anchor"),
            F.when(hit, stop).when(back, level).otherwise(b["close"]).alias("price"),
        ).cast(STATE)
        return F.when(s["done"] > 0, s).otherwise(running_)

    return F.aggregate(bars, state, step)


def bar_arrays(bars: DataFrame, size: int, wanted: DataFrame | None = None) -> DataFrame:
    """Bars of one (symbol, bucket of ``size`` rows) as one ordered array.

    With ``wanted`` buckets, other bars are dropped before they are shuffled; the
    semi join becomes a broadcast only if its measured size is small.
    """
    packed = F.struct(F.col("seq").cast("long").alias("s"), "high", "low", "close")
    rows = bars.select(*KEYS, F.expr(f"seq div {size}").alias("_bk"), packed.alias("b"))
    if wanted is not None:
        rows = rows.join(wanted, [*KEYS, "_bk"], "left_semi")
    return rows.groupBy(*KEYS, "_bk").agg(F.array_sort(F.collect_list("b")).alias("_bars"))


def _walk_bucket(live: DataFrame, bars: DataFrame, size: int, *, filtered: bool) -> DataFrame:
    """Walk every row of ``live`` from ``_pos`` to the end of its bucket."""
    live = live.withColumn("_bk", F.expr(f"_pos div {size}"))
    wanted = live.select(*KEYS, "_bk").distinct() if filtered else None
    ahead = F.filter(F.coalesce("_bars", F.array()), lambda b: b["s"] >= F.col("_pos"))
    walked = _walk(
        F.col("_ahead"), F.col("_state"), F.col("_long"), F.col("_sl"), F.col("_act"), F.col("_pct"), F.col("_dist")
    )
    return (
        live.join(bar_arrays(bars, size, wanted), [*KEYS, "_bk"], "left")
        .withColumn("_ahead", ahead)
        .withColumn("_state", walked)
        .withColumn("_pos", (F.col("_bk") + 1) * size)
        .drop("_bk", "_bars", "_ahead")
    )


def _zones(bars: DataFrame, size: int, longest: int) -> tuple[DataFrame, int]:
    """Lowest low and highest high per bucket, on levels of fourfold size."""
    level, parts = 0, []
    while True:
        width = size * BUCKET_GROWTH**level
        parts.append(
            bars.groupBy(*KEYS, F.lit(level).alias("_lvl"), F.expr(f"seq div {width}").alias("_bk")).agg(
                F.min("low").alias("_floor"), F.max("high").alias("_roof")
            )
        )
        if width >= longest:
            break
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stage(out, "zones"), level


def trailing_exits(
    signals: DataFrame, bars: DataFrame, longest: int, *, id_col: str = "sid", first_bucket: int = FIRST_BUCKET,
    largest_bucket: int = LARGEST_BUCKET,
) -> DataFrame:
    """(id, exit_price, exit_reason, bars_held) of every signal with a forward bar.

    Needs direction, entry, sl, tp, start, trail_pct, activation and trail_dist
    (null = percent of the anchor). ``longest`` is the longest series in rows.

    A round walks each open signal to the end of its bucket of bars. Most exits
    come soon, so the search starts with small buckets that grow fourfold up to
    ``largest_bucket`` rows, which bounds an array. Signals still open then skip
    ahead over buckets whose range touches neither stop nor activation price, on
    levels of ever wider buckets, so even an exit at the far end of a series is
    found in a number of rounds that grows with the logarithm of its distance.
    """
    long = is_long("direction")
    reach = F.when(long, F.col("entry") + (F.col("tp") - F.col("entry")) * F.col("activation")).otherwise(
        F.col("entry") - (F.col("entry") - F.col("tp")) * F.col("activation")
    )
    blank = F.expr(f"cast(named_struct('done', 0, 'k', -1L, 'armed', false, 'anchor', null, 'price', null) as {STATE})")
    ends = bars.groupBy(*KEYS).agg(F.max("seq").alias("_last"), F.max_by("close", "seq").alias("_final"))
    live = signals.select(
        id_col, *KEYS, F.col("start").cast("long").alias("_start"), F.col("start").cast("long").alias("_pos"),
        long.alias("_long"), F.col("sl").alias("_sl"), reach.alias("_act"),
        F.col("trail_pct").cast("double").alias("_pct"), F.col("trail_dist").cast("double").alias("_dist"),
        blank.alias("_state"),
    ).join(ends, list(KEYS)).where(F.col("_start") <= F.col("_last"))
    over = (F.col("_state.done") > 0) | (F.col("_pos") > F.col("_last"))
    finished, size = [], first_bucket
    while True:
        walked = _walk_bucket(live, bars, size, filtered=size > first_bucket)
        if size >= longest:
            finished.append(walked)
            return _exit_rows(finished, id_col)
        walked = stage(walked, "exits")
        finished.append(walked.where(over))
        live = walked.where(~over)
        if live.isEmpty():
            return _exit_rows(finished, id_col)
        if size >= largest_bucket:
            break
        size = min(size * BUCKET_GROWTH, largest_bucket)
    return _exit_rows(finished + _skip_ahead(live, bars, size, longest, over), id_col)


def _skip_ahead(live: DataFrame, bars: DataFrame, size: int, longest: int, over: Column) -> list[DataFrame]:
    zones, top = _zones(bars, size, longest)
    width = F.lit(size).cast("long") * F.pow(F.lit(float(BUCKET_GROWTH)), F.col("_lvl")).cast("long")
    wider = width * BUCKET_GROWTH
    near = F.when(F.col("_long"), (F.col("_floor") <= F.col("_sl")) | (F.col("_roof") >= F.col("_act"))).otherwise(
        (F.col("_roof") >= F.col("_sl")) | (F.col("_floor") <= F.col("_act"))
    )
    live, finished = live.withColumn("_lvl", F.lit(0)), []
    while True:
        seen = live.withColumn("_bk", F.floor(F.col("_pos") / width)).join(zones, [*KEYS, "_lvl", "_bk"], "left")
        seen = stage(seen.withColumn("_near", F.col("_state.armed") | F.coalesce(near, F.lit(False))), "skip")
        past = (F.col("_bk") + 1) * width
        climbs = (F.col("_lvl") < top) & (past % wider == 0)
        skipped = seen.where("not _near").withColumn("_to", past).withColumn(
            "_lvl", F.when(climbs, F.col("_lvl") + 1).otherwise(F.col("_lvl"))
        ).withColumn("_pos", F.col("_to")).drop("_to", "_bk", "_floor", "_roof", "_near")
        closer = seen.where("_near and _lvl > 0").withColumn("_lvl", F.col("_lvl") - 1).drop("_bk", "_floor", "_roof", "_near")
        here = seen.where("_near and _lvl = 0").drop("_bk", "_floor", "_roof", "_near")
        moved = skipped.unionByName(closer).unionByName(_walk_bucket(here, bars, size, filtered=True))
        moved = stage(moved, "exits")
        finished.append(moved.where(over).drop("_lvl"))
        live = moved.where(~over)
        if live.isEmpty():
            return finished


def _exit_rows(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Exits of finished signals; the rest are still open at the last bar."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    s = F.col("_state")
    closed = s["done"] > 0
    return out.select(
        id_col,
        F.when(closed, s["price"]).otherwise(F.col("_final")).alias("exit_price"),
        F.when(s["done"] == 1, STOP_HIT).when(s["done"] == 2, TRAIL_HIT).otherwise(DATA_END).alias("exit_reason"),
        (F.when(closed, s["k"]).otherwise(F.col("_last")) - F.col("_start") + 1).cast("int").alias("bars_held"),
    )


def longest_series(numbered_bars: DataFrame) -> int:
    """Rows of the longest series: one aggregate, one value to the driver."""
    top = numbered_bars.agg(F.max("seq")).first()[0]
    return 0 if top is None else int(top) + 1
