"""Minimax contiguous sharding: equal texts stay together, the largest shard is as small as it can be.

Groups of equal texts stand in the order of their smallest doc_id. A binary search finds the smallest
capacity at which a greedy walk along the group ends needs no more shards than there are; the cuts go
where that walk, steered to equal remainders, makes them. Groups above an even share get shards of their
own first, since no cut can make those smaller.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

SHARDS = 24
OVERHEAD = 8
#: Pieces in which the search looks at group ends at a time; it looks closer where the borders may fall until nothing is left open.
RESOLUTION = 1 << 16


def _feasible(ends: list[int], shards: int, capacity: int, start: int = 0) -> bool:
    """Whether a greedy walk from ``start`` over the atoms' cumulative sizes fits."""
    at, last = start, ends[-1]
    for _ in range(shards):
        if at >= last:
            return True
        k = bisect_right(ends, at + capacity)
        if not k or ends[k - 1] <= at:
            return False
        at = ends[k - 1]
    return at >= last


def smallest_capacity(ends: list[int], shards: int) -> int:
    sizes = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _feasible(ends, shards, middle) else (middle + 1, high)
    return low


def cuts(ends: list[int], shards: int) -> list[int]:
    """Cumulative size at the end of each shard, none above the smallest feasible capacity.

    Within it each cut is the group end nearest to an even share of what is left from which the
    rest still fits. Trailing shards may be empty if there are fewer atoms than shards.
    """
    if not ends:
        return [0] * shards
    capacity, at, out = smallest_capacity(ends, shards), 0, []
    for left in range(shards, 0, -1):
        if at >= ends[-1] or left == 1:
            out.append(ends[-1])
            at = ends[-1]
            continue
        first, stop = bisect_right(ends, at), bisect_right(ends, at + capacity)
        aim = at + (ends[-1] - at) / left
        k = bisect_right(ends, aim, first, stop)
        options = sorted({min(max(k - 1, first), stop - 1), min(k, stop - 1)}, key=lambda j: abs(ends[j] - aim))
        at = next((ends[j] for j in [*options, stop - 1] if _feasible(ends, left - 1, capacity, ends[j])), ends[stop - 1])
        out.append(at)
    return out


def border_ranges(known: list[int], shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """Ranges (after, upto) that hold every border of greedy walks with capacities from ``low`` to ``high``; known ends are some of the group ends."""
    out, first, last = [], 0, 0
    for _ in range(shards):
        k = bisect_right(known, first + low)
        first, last = known[k - 1] if k else first, min(last + high, known[-1])
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def known_ends(groups: DataFrame, shards: int, resolution: int = RESOLUTION) -> list[int]:
    """Enough of the cumulative sizes ``end`` for ``smallest_capacity`` over them to be that over all.

    ``groups`` is a stored table. First come the outermost ends of ``resolution`` pieces of all bytes. A capacity found
    with some of the ends exceeds the smallest by no more than the widest stretch with ends unknown, since borders can
    move down to known ones. That leaves narrow ranges in which borders can fall, which are cut into pieces in turn, until
    no end in them is unknown. At most two numbers a piece and round reach the driver. The ranges add up the doubt of
    all borders before them, so there are 4 x ``shards`` ** 2 pieces at least; every round then halves the doubt.
    """
    resolution = max(resolution, 4 * shards**2)
    total = groups.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    if not total:
        return []
    known, ranges, largest = {total}, [(0, total)], groups.agg(F.max("bytes")).first()[0]
    while True:
        inside = F.lit(False)
        for after, upto in ranges:  # at most one a shard
            inside = inside | ((F.col("end") > after) & (F.col("end") <= upto))
        width = max(1, sum(upto - after for after, upto in ranges) // resolution)
        pieces = groups.where(inside).groupBy(F.expr(f"end div {width}").alias("piece"))
        found = pieces.agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).collect()
        known |= {r["a"] for r in found} | {r["b"] for r in found}
        unknown = max((r["b"] - r["a"] for r in found if r["n"] > 2), default=0)
        ends = sorted(known)
        if not unknown:
            return ends
        high = smallest_capacity(ends, shards)
        ranges = border_ranges(ends, shards, max(largest, -(-total // shards), high - unknown), high)


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, resolution: int = RESOLUTION) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every document.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``; a null text counts and groups as an
    empty one. ``slot`` numbers a shard's documents from 0: group by group, inside a group in input
    order. A null doc_id stays null and its groups come first; repeated rows are rows of their own.
    Only doc_id and text are read. The largest shard is the optimum at any number of groups (those above an even share
    aside). What reaches the driver is bounded by ``resolution``, and fewer groups than ``shards`` above an even share.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = stage(rows.withColumn("part", F.shiftright("uid", 33)), "sizes")
    cells = stage(rows.groupBy("digest", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first")), "cells")
    groups = cells.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    # Groups in order, in pieces of the range partitioning; a piece's totals are carried over pieces, one row each.
    placed = groups.repartitionByRange("first", "digest").withColumn("piece", F.spark_partition_id())
    placed = stage(placed.withColumn("heavy", F.col("bytes") * shards > total), "groups")
    light = lambda c: F.when(~F.col("heavy"), F.col(c)).otherwise(0)
    sums = placed.groupBy("piece").agg(F.sum(light("bytes")).alias("b0"), F.sum(light("n")).alias("n0"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("b0", "n0")])
    inside = Window.partitionBy("piece").orderBy("first", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumns({"b1": F.sum(light("bytes")).over(inside), "n1": F.sum(light("n")).over(inside)}).join(F.broadcast(sums), "piece")  # a row per partition
    ordered = stage(ordered.select("digest", "n", "first", "bytes", "heavy", (F.col("b0") + F.col("b1")).alias("end"), (F.col("n0") + F.col("n1") - light("n")).alias("n_before")), "ordered")

    heavy = [bytes(r[0]) for r in ordered.where("heavy").select("digest", "bytes", "first").orderBy(F.col("bytes").desc(), "first").collect()]  # fewer than shards
    spare = max(1, shards - len(heavy))
    ends = known_ends(ordered.where("not heavy").select("end", "bytes"), spare, resolution)
    borders = cuts(ends, spare)

    shard = F.lit(0)
    for border in borders[:-1]:  # fewer than shards of them
        shard = shard + (F.col("end") > F.lit(border)).cast("int")
    shard = shard + len(heavy)
    for k, digest in enumerate(heavy):
        shard = F.when(F.col("digest") == F.lit(digest), k).otherwise(shard)
    homes = ordered.withColumn("shard", shard.cast("int"))
    lows = homes.where("not heavy").groupBy("shard").agg(F.min("n_before").alias("low"))
    homes = homes.join(F.broadcast(lows), "shard", "left")  # a row per shard
    homes = homes.select("digest", "shard", F.when(F.col("heavy"), 0).otherwise(F.col("n_before") - F.col("low")).alias("group_slot"))

    # Rows of one group are numbered per input partition, so a group of any size is spread.
    ahead = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("digest", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")).join(homes, "digest")
    starts = starts.select("digest", "part", "shard", (F.col("group_slot") + F.col("ahead")).alias("from"))
    within = Window.partitionBy("digest", "part").orderBy("uid")
    return rows.join(starts, ["digest", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("from") + F.row_number().over(within) - 1).cast("long").alias("slot")
    )
