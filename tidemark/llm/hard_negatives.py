"""Hard negatives by pruned exact inner-product search: length buckets, sorted coordinate lists, feasible ranges.

Vectors are whole numbers. Those of alike length form buckets, cut into blocks of bounded size; a block keeps
a sorted list of unit components per coordinate. An anchor that needs a score of t skips every block with
|q| * longest < t. Elsewhere a vector must make an angle of at most acos(t / (|q| * longest)) with the anchor, so by the triangle
inequality of angles its component on every coordinate lies in a range around the anchor's. The ranges on the
anchor's few largest (focus) coordinates are cut out of the lists and intersected; what is left is scored exactly. Scores
that an anchor has reached in one long block raise what it needs from all others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

#: Vectors and anchors of a block pair.
BLOCK = 8192
SIDE = 2048
#: Coordinates of an anchor whose lists are searched.
FOCUS = 4
#: Shortest length of a bucket relative to its longest one.
ALIKE = 0.9
#: Components are floor(SCALE * x). Longer vectors than 2 ** 28 could give scores beyond a long and take no part.
SCALE = 256
LONGEST = 1 << 28
#: Added to ranges of unit components, far above their rounding.
SLACK = 1e-9
NEED = np.iinfo(np.int64).min // 2
FREE = np.iinfo(np.int64).max // 2


def integer_rows(vectors: DataFrame, *, scale: float = SCALE) -> DataFrame:
    """(id, label, vec, dim, len2) of the usable rows of (vec_id, label, embedding), components floored to whole numbers.

    Rows with a null id, label or vector, a null or non-finite component, or an integer length above
    LONGEST take no part. ``len2`` is the squared length.
    """
    found = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("raw"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = found.where("id is not null and label is not null and raw is not null").where(~bad)
    found = found.where(~F.exists("raw", lambda x: F.abs(x) * scale > LONGEST))
    found = found.select("id", "label", F.transform("raw", lambda x: F.floor(x * scale).cast("int")).alias("vec"))
    found = found.withColumn("len2", F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long")))
    return found.where(F.col("len2") <= LONGEST**2).withColumn("dim", F.size("vec"))


def length_class(len2: Column) -> Column:
    """The bucket of a squared length: lengths of a bucket differ by a factor of ALIKE at most; -1 holds zero vectors."""
    return F.when(len2 > 0, F.floor(F.log(len2.cast("double")) / float(-2 * np.log(ALIKE)))).otherwise(-1).cast("int")


@dataclass
class CoordinateLists:
    """A block of vectors with sorted lists of unit components, built for the coordinates that are asked for."""

    ids: np.ndarray
    labels: np.ndarray
    codes: dict[str, int]
    rows: np.ndarray
    length: np.ndarray

    @functools.cached_property
    def unit(self) -> np.ndarray:
        return self.rows / np.where(self.length > 0, self.length, 1)[:, None]

    @functools.cached_property
    def exact(self) -> np.ndarray:
        """Vectors as doubles where every score below 2 ** 53 is then exact, else as integers."""
        return self.rows.astype(np.float64) if self.length.max(initial=0) < 1 << 26 else self.rows.astype(np.int64)

    @functools.cached_property
    def _lists(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {}

    def list_of(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """(components in ascending order, their rows)."""
        if coordinate not in self._lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self._lists[coordinate] = (self.unit[order, coordinate], order)
        return self._lists[coordinate]

    def scores(self, query: np.ndarray, among: np.ndarray | slice) -> np.ndarray:
        held = self.exact[among]
        wide = held.dtype == np.int64 or np.abs(query).max(initial=0) >= 1 << 26
        return (held.astype(np.int64) @ query.astype(np.int64)) if wide else (held @ query.astype(np.float64)).astype(np.int64)

    def candidates(self, query: np.ndarray, need: int, focus: int) -> np.ndarray | slice | None:
        """Rows that may score ``need`` or more with ``query``; None: no row can."""
        length, longest = float(np.sqrt((query.astype(np.float64) ** 2).sum())), float(self.length.max(initial=0))
        if need <= 0:
            return slice(None)
        if length * longest * (1 + SLACK) < need:
            return None
        angle = np.arccos(min(1.0, need / (length * longest * (1 + SLACK))))
        own = query / length
        axes = np.argsort(-np.abs(own), kind="stable")[:focus]
        turn = np.arccos(np.clip(own[axes], -1, 1))
        low = np.where(turn + angle >= np.pi, -1.0, np.cos(turn + angle)) - SLACK
        high = np.where(turn <= angle, 1.0, np.cos(turn - angle)) + SLACK
        cuts = []
        for k, axis in enumerate(axes.tolist()):
            values, order = self.list_of(axis)
            cuts.append((np.searchsorted(values, low[k]), np.searchsorted(values, high[k], "right"), order, k))
        a, b, order, first = min(cuts, key=lambda c: c[1] - c[0])
        found = order[a:b]
        for k, axis in enumerate(axes.tolist()):
            if k != first and (low[k] > -1 or high[k] < 1):
                part = self.unit[found, axis]
                found = found[(part >= low[k]) & (part <= high[k])]
        return found if 2 * len(found) < len(self.ids) else slice(None)


def best_distinct(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of different ids, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -4 * k)[-4 * k])
        if len(np.unique(ids[near])) < k:
            near = np.arange(len(scores))
    else:
        near = np.arange(len(scores))
    near = near[np.lexsort((ids[near], -scores[near]))]
    _, first = np.unique(ids[near], return_index=True)
    return near[np.sort(first)[:k]]


def block_best(block: CoordinateLists, asks: Iterator[dict], *, k: int, same: bool, focus: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, id, score): the k best of each window of each ask among the block's rows of the same label, or of others."""
    for ask in asks:
        query, low, high = np.asarray(ask["vec"], np.int64), np.asarray(ask["low"], np.int64), np.asarray(ask["high"], np.int64)
        among = block.candidates(query, int(low.min()), focus)
        if among is None:
            continue
        score = block.scores(query, among)
        ids, labels = block.ids[among], block.labels[among]
        fit = np.flatnonzero((score >= low.min()) & ((labels == block.codes.get(ask["label"], -1)) == same) & (ids != ask["id"]))
        score, ids = score[fit], ids[fit]
        for w in range(len(low)):
            held = np.flatnonzero((score >= low[w]) & (score <= high[w]))
            for x in held[best_distinct(score[held], ids[held], k)].tolist():
                yield ask["id"], w, int(ids[x]), int(score[x])


PAIR = "id long, w int, other long, score long"


def _searched(index: DataFrame, asks: DataFrame, *, k: int, same: bool, focus: int, side: int) -> DataFrame:
    """The k best per ask and window of each block pair. ``asks``: dim, pool, bucket, part and the ask; ``index``: dim, pool, bucket, part and the vector."""
    key = ["dim", "pool", "bucket", "part"]
    met = asks.groupBy(*key).agg(F.ceil(F.count("*") / side).cast("int").alias("sides"))
    left = index.join(met, key).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    left = left.select(*key, "side", "id", "label", "vec", "len2")
    right = asks.join(met, key).withColumn("side", F.pmod(F.xxhash64("id", F.lit(7)), F.col("sides")).cast("int")).select(*key, "side", "id", "label", "vec", "low", "high")

    def compare(rows: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if rows.num_rows and asking.num_rows:
            values = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            names = rows.column("label").combine_chunks().dictionary_encode()
            codes = {name: code for code, name in enumerate(names.dictionary.to_pylist())}
            block = CoordinateLists(rows.column("id").to_numpy(), names.indices.to_numpy(), codes, values, np.sqrt(rows.column("len2").to_numpy().astype(np.float64)))
            found = list(block_best(block, asking.to_pylist(), k=k, same=same, focus=focus))
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["id", "w", "other", "score"])

    tile = [*key, "side"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, PAIR)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each ask and window with their rank; several scores of one id count as its best."""
    pairs = pairs.groupBy("id", "w", "other").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id", "w").orderBy(F.col("score").desc(), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, asks: DataFrame, *, k: int, same: bool, block: int = BLOCK, side: int = SIDE, focus: int = FOCUS) -> DataFrame:
    """(id, w, other, score, rank): for window w of each ask the k best rows of its own label (``same``) or of all others.

    ``rows`` and ``asks`` are stored tables: rows as from ``integer_rows``, asks with id, label, vec, dim, len2 and arrays
    ``low`` and ``high`` of the least and greatest score of each window. Rows of the asked label are dealt into pools:
    a label of its own if it fills a block, else several labels together; without ``same`` there is one pool.
    """
    if same:
        counts = rows.groupBy("dim", "label").agg(F.count("*").alias("n"))
        few = counts.where(F.col("n") < block).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shared = F.concat(F.lit("pool "), F.pmod(F.xxhash64("label"), F.lit(max(1, -(-few // block)))))
        pools = stage(counts.select("dim", "label", F.when(F.col("n") < block, shared).otherwise(F.concat(F.lit("label "), "label")).alias("pool")), "pools")
        rows, asks = rows.join(pools, ["dim", "label"]), asks.join(pools, ["dim", "label"])
    else:
        rows, asks = rows.withColumn("pool", F.lit("")), asks.withColumn("pool", F.lit(""))
    index = rows.withColumn("bucket", length_class(F.col("len2")))
    tiles = index.groupBy("dim", "pool", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.max("len2").alias("longest"))
    tiles = stage(tiles, "tiles")  # at most 180 length classes for each vector size and pool
    index = index.join(tiles, ["dim", "pool", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    index = stage(index.select("dim", "pool", "bucket", "part", "id", "label", "vec", "len2"), "index")

    # One block of the longest vectors first: what an ask finds there it need not be shown anything worse of.
    top = Window.partitionBy("dim", "pool").orderBy(F.col("bucket").desc())
    seeds = tiles.withColumn("n", F.row_number().over(top)).where("n = 1").select("dim", "pool", "bucket", F.lit(0).alias("part"))
    seed = _top(_searched(index, asks.join(seeds, ["dim", "pool"]), k=k, same=same, focus=focus, side=side), k)
    reached = seed.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    raised = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.element_at("reached", w.cast("int")), x)))
    asks = asks.join(reached, "id", "left").withColumn("low", raised).drop("reached")

    able = F.sqrt(F.col("len2").cast("double")) * F.sqrt(F.col("longest").cast("double")) * (1 + SLACK) >= F.array_min("low")
    meeting = asks.join(tiles, ["dim", "pool"]).where(able | (F.array_min("low") <= 0))
    meeting = meeting.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meeting = stage(meeting.select("dim", "pool", "bucket", "part", "id", "label", "vec", "low", "high"), "asks")
    return _top(_searched(index, meeting, k=k, same=same, focus=focus, side=side), k)


def mined(
    vectors: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = SCALE, **sizes: int,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Every anchor's positives are its first other rows of the same label; for each, the first rows of other labels whose
    score lies between ``window`` hundredths of the positive's are its negatives. First are the highest integer
    inner products, ties to the smaller vec_id. Both tables hold vec_id, label and embedding; other columns are not read.
    Rows that ``integer_rows`` leaves out take no part; vectors of another size never meet. Rows that share a
    vec_id are one item standing at all their vectors and labels, of which the best score counts; an anchor is never its own
    positive or negative. Anchors without positives and empty tables give no rows.
    """
    rows = stage(integer_rows(vectors, scale=scale), "vectors")
    asked = stage(integer_rows(anchors, scale=scale).dropDuplicates(["id", "label", "vec"]), "anchors")
    first = asked.withColumn("low", F.array(F.lit(NEED))).withColumn("high", F.array(F.lit(FREE)))
    found = stage(search(rows, first, k=positives, same=True, **sizes), "positives")

    least = F.expr(f"-((-{window[0]} * score - pmod(-{window[0]} * score, 100)) div 100)")
    most = F.expr(f"({window[1]} * score - pmod({window[1]} * score, 100)) div 100")
    windows = found.withColumn("low", least).withColumn("high", most).where("low <= high")
    windows = windows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high", "other", "score"))).alias("windows"))  # at most ``positives``
    windows = stage(windows, "windows")
    second = asked.join(windows.select("id", F.col("windows.low").alias("low"), F.col("windows.high").alias("high")), "id")
    hard = search(rows, stage(second, "windowed"), k=negatives, same=False, **sizes)
    chosen = F.element_at("windows", F.col("w") + 1)
    return hard.join(windows, "id").select(
        F.col("id").alias("anchor_id"), chosen["other"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        chosen["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
