"""Ordered work on series of any length, without one task per series.

A window partitioned by symbol puts a whole series, however long, in one task.
Here every ordered operator runs on bounded pieces of a series instead:

* ``with_seq`` numbers rows by counting per chunk, adding up the chunk counts
  (one small row per chunk) and numbering inside each chunk;
* ``halo_blocks`` cuts the numbered series into blocks and repeats the last
  ``halo`` rows of a block in front of the next one, so a window that looks
  look back at most ``halo`` rows is exact inside its own block, and the caller
  derives ``halo`` from what its windows look back;
* ``running`` carries sums, extremes or last values over chunks the same way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 5120
HALO = 1024
#: Powers up to e^POWER are summed in one running sum; a double ends at e^709.
POWER = 620.0

_INSIDE = {"sum": F.sum, "max": F.max, "min": F.min}


def _last(col: Column) -> Column:
    return F.last(col, ignorenulls=True)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: dict[str, Column],
    order: Sequence[str | Column],
    carry: dict[str, tuple[Column, str]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Prefix aggregates along each key's order, in two levels.

    ``chunk`` columns must not decrease along ``order``. ``carry`` maps an output
    name to (expression, kind), kind one of sum, max, min, last, count. A chunk
    contributes one row to the second level; only that small table is windowed
    by the bare key. ``exclusive`` leaves the current row out. ``df`` is read
    twice, once pruned to what the chunk totals need: hand in a stored table.
    """
    names = list(chunk)
    tagged = df.select("*", *[c.alias(n) for n, c in chunk.items()])
    first = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    aggs = []
    for name, (expr, kind) in carry.items():
        if kind == "last":
            agg = F.max_by(expr, F.when(expr.isNotNull(), first))
        elif kind == "count":
            agg = F.count(expr)
        else:
            agg = _INSIDE[kind](expr)
        aggs.append(agg.alias(f"_c_{name}"))
    per_chunk = tagged.groupBy(*keys, *names).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys,
        *names,
        *[_combine_over(F.col(f"_c_{n}"), k, before).alias(f"_o_{n}") for n, (_, k) in carry.items()],
    )
    frame_end = -1 if exclusive else Window.currentRow
    inside = (
        Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    )
    local = tagged.select(
        "*",
        *[
            (_last(e) if k == "last" else F.count(e) if k == "count" else _INSIDE[k](e)).over(inside).alias(f"_l_{n}")
            for n, (e, k) in carry.items()
        ],
    )
    joined = local.join(offsets, [*keys, *names], "left")
    out = []
    for name, (_, kind) in carry.items():
        here, past = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        if kind in ("sum", "count"):
            value = F.when(here.isNull() & past.isNull(), None).otherwise(
                F.coalesce(past, F.lit(0)) + F.coalesce(here, F.lit(0))
            )
        elif kind == "max":
            value = F.greatest(here, past)
        elif kind == "min":
            value = F.least(here, past)
        else:
            value = F.coalesce(here, past)
        out.append(value.alias(name))
    return joined.select(*df.columns, *out)


def _combine_over(col: Column, kind: str, window) -> Column:
    if kind in ("sum", "count"):
        return F.sum(col).over(window)
    if kind == "last":
        return _last(col).over(window)
    return _INSIDE[kind](col).over(window)


def with_seq(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: dict[str, Column],
    *,
    name: str = "seq",
    carry: dict[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Dense 0-based row number per key, plus any inclusive prefix aggregates."""
    spec = {name: (F.lit(1), "count"), **(carry or {})}
    return running(df, keys, chunk, order, spec).withColumn(name, (F.col(name) - 1).cast("long"))


def halo_blocks(
    df: DataFrame, keys: Sequence[str], *, block: int = BLOCK, halo: int = HALO, seq: str = "seq"
) -> DataFrame:
    """Give each row its block, and repeat it in the lead-in of every later block within ``halo`` rows.

    Adds ``_blk`` (window partition), ``_pos`` (place inside the padded block)
    and ``_own`` (false on lead-in rows, which callers drop after the windows).
    """
    blocks = F.sequence(F.expr(f"{seq} div {block}"), F.expr(f"({seq} + {halo}) div {block}"))
    return (
        df.withColumn("_blk", F.explode(blocks))
        .withColumn("_pos", (F.col(seq) - F.col("_blk") * block + halo).cast("int"))
        .withColumn("_own", F.col("_pos") >= halo)
    )


def block_window(keys: Sequence[str], seq: str = "seq"):
    return Window.partitionBy(*keys, "_blk").orderBy(seq)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_blk", "_pos")


def decay_rows(alpha: float) -> int:
    """Rows after which a weight of (1-alpha)^n is lost in a double."""
    return 1 if alpha >= 1 else math.ceil(53 * math.log(2) / -math.log1p(-alpha)) + 1


def _fed(x: Column, alpha: float, seq: str) -> Column:
    leads = F.col(seq) == F.greatest(F.col(seq) - F.col("_pos"), F.lit(0).cast("long"))
    return F.when(leads, x).otherwise(x * alpha)


def smoothed(x: Column, alpha: float, window, *, halo: int = HALO, rows: int = BLOCK + HALO, seq: str = "seq") -> Column:
    """Exponential smoothing y = (1-alpha)*y' + alpha*x, seeded with the first x.

    Written as one running sum of x weighted by growing powers. It is exact while
    the lead-in of ``halo`` rows carries all that a double can hold and the powers
    over the ``rows`` of a padded block stay within one; other factors are refused
    here and served by ``with_smoothed``.
    """
    keep = 1.0 - alpha
    if decay_rows(alpha) > halo or rows * -math.log(keep or 1e-300) > POWER:
        raise ValueError(f"smoothing with alpha {alpha:g} does not fit blocks of {rows} rows with {halo} lead-in rows: use with_smoothed")
    grown = F.sum(_fed(x, alpha, seq) * F.pow(F.lit(keep), -F.col("_pos"))).over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return grown * F.pow(F.lit(keep), F.col("_pos"))


def with_smoothed(
    df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[Column, float]], *, block: int | None = None, seq: str = "seq"
) -> DataFrame:
    """Exponential smoothing of numbered rows with any factors, one column per name.

    The lead-in follows from the slowest factor. Inside a block the running sums
    restart before their powers leave a double, and the last value before a restart
    decays into the rows after it, so fast factors are exact as well.
    """
    halo = max(decay_rows(alpha) for _, alpha in specs.values())
    df = halo_blocks(df, keys, block=block or max(BLOCK, 2 * halo), halo=halo, seq=seq)
    earlier = block_window(keys, seq).rowsBetween(Window.unboundedPreceding, -1)
    for name, (x, alpha) in specs.items():
        if alpha >= 1:
            df = df.withColumn(name, x)
            continue
        keep = 1.0 - alpha
        piece = max(1, int(POWER / -math.log(keep)))
        df = df.withColumn("_piece", F.expr(f"_pos div {piece}")).withColumn("_at", F.col("_pos") % piece)
        inside = Window.partitionBy(*keys, "_blk", "_piece").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.sum(_fed(x, alpha, seq) * F.pow(F.lit(keep), -F.col("_at"))).over(inside) * F.pow(F.lit(keep), F.col("_at"))
        df = df.withColumn("_own_part", own)
        ends = F.when(F.col("_at") == piece - 1, F.col("_own_part"))
        carried = F.coalesce(_last(ends).over(earlier), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_at") + 1)
        df = df.withColumn(name, F.col("_own_part") + carried).drop("_piece", "_at", "_own_part")
    return own_rows(df)
