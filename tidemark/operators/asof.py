"""As-of lookups: the latest value at or before a time, at any density and key skew.

Series of a small measured size are sent whole, as sorted pages with a directory
per key, and each row of the left side finds its place by halving; the left
side is not moved. Beyond that size lookups and series are one table in the
order of key and time, cut by Spark's range partitioning into pieces of like
size, however many rows share a key, a day or a moment. A window answers inside
a piece; what a piece inherits comes from the last values of the pieces before
it, one row per key and piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import micros
from tidemark.session import stage

#: Bytes of all series of a lookup that are still sent whole.
SMALL = 8 << 20
#: Rows of a page; a row of the left side carries one page and one directory while it looks.
PAGE = 128


def _points(series: dict[str, DataFrame], by: list[str], right_ts: str, tie: str | None) -> dict[str, DataFrame]:
    """Per series: key, time, order of equal times and the struct of values. Rows without a key or time are not found."""
    out = {}
    for name, df in series.items():
        values = [c for c in df.columns if c not in by]
        out[name] = df.dropna(subset=[*by, right_ts]).select(
            *by,
            micros(F.col(right_ts)).alias("_t"),
            (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"),
            F.struct(*values).alias(name),
        )
    return out


def _size(points: DataFrame, name: str, by: list[str]) -> int | None:
    """Bytes of a stored series, None where a type gives no bound."""
    kinds = {c: points.schema[c].dataType for c in by} | {f"{name}.`{f.name}`": f.dataType for f in points.schema[name].dataType.fields}
    if any(isinstance(k, (T.ArrayType, T.MapType, T.StructType)) for k in kinds.values()):
        return None
    written = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, k in kinds.items() if isinstance(k, (T.StringType, T.BinaryType))]
    total = F.count(F.lit(1)) * (16 * len(kinds) + 32)
    for w in written:
        total = total + w
    return points.agg(total.alias("n")).first()["n"]


def _whole(points: dict[str, DataFrame], by: list[str], small: int) -> bool:
    """All series together are small enough to be sent whole. ``points`` are stored tables."""
    left = small
    for name, df in points.items():
        size = _size(df, name, by)
        if size is None or size > left:
            return False
        left -= size
    return True


def _place(times: Column, ask: Column, most: int) -> Column:
    """How many of the sorted ``times`` (``most`` at the utmost) are at or before ``ask``."""
    steps = [1 << k for k in reversed(range(max(1, most.bit_length())))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(F.get(times, p + s - 1) <= ask, p + s).otherwise(p))


def _looked_up(left: DataFrame, points: dict[str, DataFrame], by: list[str], left_ts: str, small: int) -> DataFrame:
    """``left`` with a struct per series, found in pages that are sent whole."""
    out, ask = left, micros(F.col(left_ts))
    for name, df in points.items():
        order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_t", "_tie", "_n")
        placed = df.withColumn("_n", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(order) - 1)
        pages = placed.groupBy(*by, F.expr(f"int(_k div {PAGE})").alias("_page")).agg(F.sort_array(F.collect_list(F.struct("_k", "_t", name))).alias("_points"))
        heads = F.sort_array(F.collect_list(F.struct("_page", F.get("_points", F.lit(0))["_t"].alias("_t"))))
        directory = pages.groupBy(*by).agg(heads["_t"].alias("_heads"))
        most = small // PAGE // 48 + 1  # a row counts 48 bytes or more
        found = out.join(F.broadcast(directory), by if by else F.lit(True), "left")
        found = found.withColumn("_page", _place(F.col("_heads"), ask, most) - 1).drop("_heads")
        found = found.join(F.broadcast(pages), [*by, "_page"], "left")
        hit = F.get("_points", _place(F.col("_points")["_t"], ask, PAGE) - 1)[name]
        out = found.select(*out.columns, hit.alias(name))
    return out


def asof_join(
    left: DataFrame,
    series: dict[str, DataFrame],
    by: Sequence[str],
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: str | None = None,
    pieces: int | None = None,
    small: int = SMALL,
) -> DataFrame:
    """Add one struct column per series: its last row with right_ts <= left_ts.

    Every series must hold ``by``, ``right_ts`` and its value columns. ``tie``
    names a column of the series that orders rows of equal time. Rows without a
    key or time find nothing and are not found. Series are read once and stored,
    so hand in narrow ones; if they take at most ``small`` bytes, the left side
    stays where it is, otherwise it is stored in order, too. ``pieces`` asks
    for the ordered way with that number of partitions.
    """
    by = list(by)
    points = _points(series, by, right_ts, tie)
    if not pieces:
        points = {n: stage(df, "series") for n, df in points.items()}
        if _whole(points, by, small):
            return _looked_up(left, points, by, left_ts, small)
    return _in_pieces(left, points, by, left_ts, pieces)


def _in_pieces(left: DataFrame, points: dict[str, DataFrame], by: list[str], left_ts: str, pieces: int | None) -> DataFrame:
    """The same for series of any size: both sides in one ordered, cut table."""
    names, rights = list(points), None
    for df in points.values():
        part = df.withColumn("_asks", F.lit(0))
        rights = part if rights is None else rights.unionByName(part, allowMissingColumns=True)
    lefts = left.select(
        *by, micros(F.col(left_ts)).alias("_t"), F.lit(1).alias("_asks"), F.lit(0).cast("long").alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    order = ["_t", "_asks", "_tie", "_n"]
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_n", F.monotonically_increasing_id())
    cut = [*by, *order]
    ranged = both.repartitionByRange(pieces, *cut) if pieces else both.repartitionByRange(*cut)
    rows = stage(ranged.withColumn("_piece", F.spark_partition_id()), "asof")
    tails = rows.groupBy(*by, "_piece").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(n) for n in names]
    )
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, "_piece", *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in names])
    to_here = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select(*by, "_piece", "_row", *[F.last(n, ignorenulls=True).over(to_here).alias(n) for n in names])
    out = found.where("_row is not null").join(carried, [*by, "_piece"], "left")
    return out.select("_row.*", *[F.coalesce(n, f"_c_{n}").alias(n) for n in names])


def asof_global(
    left: DataFrame, series: dict[str, DataFrame], *, left_ts: str = "ts", right_ts: str = "ts", pieces: int | None = None,
    small: int = SMALL,
) -> DataFrame:
    """Lookup in series that have no key.

    Beyond ``small`` bytes the lookup runs once, for all series, on the distinct times of the left side
    and is joined back by equality, so the left rows are never gathered by time.
    """
    return _of_times(left, series, [], left_ts, right_ts, pieces, small)


def _of_times(left: DataFrame, series: dict[str, DataFrame], by: list[str], left_ts: str, right_ts: str, pieces: int | None, small: int) -> DataFrame:
    """Small series are looked up in place; others for the distinct (key, time) of ``left``, whose wide rows only meet the results."""
    points = _points(series, by, right_ts, None)
    if not pieces:
        points = {n: stage(df, "series") for n, df in points.items()}
        if _whole(points, by, small):
            return _looked_up(left, points, by, left_ts, small)
    asked = left.select(*by, left_ts).distinct()
    return left.join(_in_pieces(asked, points, by, left_ts, pieces), [*by, left_ts], "left")


def multi_context(left: DataFrame, keyed: dict[str, DataFrame], unkeyed: dict[str, DataFrame], by: Sequence[str],
                  ts: str = "ts", *, pieces: int | None = None, small: int = SMALL) -> DataFrame:
    """Attach several series, those with keys and those without, each kind by one lookup."""
    out = left
    if keyed:
        out = _of_times(out, keyed, list(by), ts, "ts", pieces, small)
    if unkeyed:
        out = _of_times(out, unkeyed, [], ts, "ts", pieces, small)
    return out
