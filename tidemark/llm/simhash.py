"""SimHash near-duplicates: fingerprints, vantage-point trees over them, connected classes.

Fingerprints at most ``radius`` bits apart are linked. The bits are split into
``parts`` equal parts; two fingerprints that near agree within ``radius // parts`` bits in at least
one part, so there is one tree per part and its search radius r is that small. A node of a tree holds a
vantage point v and a distance m: a fingerprint x lives inside if d(x, v) <= m, else outside. By the
triangle bound a partner of x within r can only be outside if d(x, v) > m - r and only inside if
d(x, v) <= m + r. So every fingerprint has one home leaf (shard) and visits those shards that its
ball reaches across a boundary; every linked pair meets in the home shard of one of them and is
compared there over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

RADIUS = 3
SHINGLE = 3
SEED = 42
PARTS = 2
#: Fingerprints that a shard should hold, and at most this many per side of a compared tile.
SHARD = 1024
TILE = 8192
#: The tree is fitted on at most so many distinct fingerprints; all are routed through it.
SAMPLE = 65_536
HASHES = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each set if over half of the shingles' XXH64 have it. No word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = (ends[:n] - 1 - np.fromiter(map(len, words[:n]), np.int64, n)).tolist()
    stops = (ends[-n:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        cut = [joined[i:j] for i, j in zip(starts[a : a + HASHES], stops[a : a + HASHES], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), "<u8", len(cut))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the signed 64-bit fingerprint of the whole ``text`` as ``name``.

    A null or empty text, or one of white space alone, has fingerprint 0. A column called ``name``
    is replaced.
    """
    kept = docs.drop(name)
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, name])

    return kept.mapInArrow(add, schema)


@dataclass
class VantageTree:
    """A complete binary tree in heap order over the bits of ``mask``; leaves are shards."""

    mask: np.uint64
    radius: int
    points: np.ndarray
    borders: np.ndarray
    depth: int

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for every shard that a print lives in or visits."""
        row, node, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
        for _ in range(self.depth):
            far = np.bitwise_count((prints[row] ^ self.points[node]) & self.mask).astype(np.int64) - self.borders[node]
            inside, outside = 2 * node + 1, 2 * node + 2
            # A home row goes to its side; inside rows near the border also visit outside. A visitor goes wherever its ball reaches.
            own_in, own_out = home & (far <= 0), home & (far > 0)
            go_in = own_in | (~home & (far <= self.radius))
            visit_out = (home & (far <= 0) & (far > -self.radius)) | (~home & (far > -self.radius))
            row, node, home = (
                np.concatenate([row[go_in], row[own_out], row[visit_out]]),
                np.concatenate([inside[go_in], outside[own_out], outside[visit_out]]),
                np.concatenate([home[go_in], home[own_out], np.zeros(visit_out.sum(), bool)]),
            )
        return row, node - (2**self.depth - 1), home


def fit_tree(sample: np.ndarray, mask: int, radius: int, depth: int, seed: int) -> VantageTree:
    """Vantage points are drawn from the sample's prints; of some tries the cut with the least expected pairs wins."""
    rng = np.random.default_rng(seed)
    mask = np.uint64(mask)
    bits = int(np.bitwise_count(mask))
    points, borders = np.zeros(max(1, 2**depth - 1), np.uint64), np.full(max(1, 2**depth - 1), bits, np.int64)
    held = {0: sample}
    for node in range(2**depth - 1):
        own = held.pop(node)
        if not len(own):
            held[2 * node + 1] = held[2 * node + 2] = own
            continue
        best = None
        for v in own[rng.integers(0, len(own), 8)]:
            far = np.bitwise_count((own ^ v) & mask)
            upto = np.cumsum(np.bincount(far, minlength=bits + 1))
            reach = len(own) - np.concatenate([np.zeros(radius), upto])[: bits + 1]
            cost = upto.astype(float) ** 2 + np.where(upto == len(own), 0, reach) ** 2
            m = int(cost.argmin())
            if best is None or cost[m] < best[0]:
                best = (cost[m], v, m, far)
        _, points[node], borders[node], far = best
        held[2 * node + 1], held[2 * node + 2] = own[far <= borders[node]], own[far > borders[node]]
    return VantageTree(mask, radius, points, borders, depth)


def fit_trees(prints: DataFrame, *, radius: int, parts: int = PARTS, shard: int = SHARD, sample: int = SAMPLE) -> list[VantageTree]:
    n = prints.count()
    some = prints.select("fingerprint").orderBy(F.xxhash64("fingerprint", F.lit(11))).limit(sample).collect()
    drawn = np.array([r[0] for r in some], np.int64).view(np.uint64)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / shard)))), int(np.log2(max(1, len(drawn) / 8)))))
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [fit_tree(drawn, m, radius // parts, depth, k) for k, m in enumerate(masks)]


def _linked(rows: np.ndarray, prints: np.ndarray, parent: np.ndarray, among: np.ndarray, radius: int) -> None:
    """Join in ``parent`` each of ``rows`` with every one of ``among`` that is near enough."""
    itself = int(len(rows) > 0 and np.isin(rows[0], among))  # the rows are all among them, or none is

    def roots(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while (up != (next_ := parent[up])).any():
            up = next_
        return up

    step = max(1, (1 << 22) // max(1, len(among)))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        near = np.bitwise_count(prints[part, None] ^ prints[None, among]) <= radius
        for k in np.flatnonzero(near.sum(axis=1) > itself):
            tops = roots(np.append(among[near[k]], part[k]))
            parent[tops] = tops.min()
    parent[:] = roots(np.arange(len(parent)))


def links(prints: DataFrame, *, radius: int = RADIUS, parts: int = PARTS, shard: int = SHARD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(a, b), a > b: a set of links with the same classes as all pairs within ``radius`` bits.

    ``prints`` holds distinct ``fingerprint`` values and should be a stored table. A compared tile
    sends one link per fingerprint that has a smaller one in its class there, never all pairs of a class.
    """
    spark = prints.sparkSession
    trees = spark.sparkContext.broadcast(fit_trees(prints, radius=radius, parts=parts, shard=shard, sample=sample))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for k, tree in enumerate(trees.value):
                row, leaf, home = tree.route(own.view(np.uint64))
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(leaf), pa.array(own[row]), pa.array(home)], names=["tree", "leaf", "fingerprint", "home"])

    routed = stage(prints.select("fingerprint").mapInArrow(route, "tree int, leaf long, fingerprint long, home boolean"), "routed")
    tiles = routed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # a row per leaf, at most sample / 4
    dealt = routed.join(F.broadcast(tiles), ["tree", "leaf"]).withColumn("side", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("tree", "leaf", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fingerprint", "home")

    def compare(group: pa.Table) -> pa.Table:
        own = group.column("fingerprint").to_numpy()
        order = np.argsort(own.view(np.uint64), kind="stable")
        values, home, side = own[order], group.column("home").to_numpy()[order], group.column("side").to_numpy()[order]
        i, j, parent, every = group.column("i")[0].as_py(), group.column("j")[0].as_py(), np.arange(len(values)), np.arange(len(values))
        for near, far in {(i, j), (j, i)}:
            _linked(every[home & (side == near)], values.view(np.uint64), parent, every[side == far], radius)
        tied = parent != every
        a, b = values[tied], values[parent[tied]]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.groupBy("tree", "leaf", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the links with the smallest node that it reaches, by alternating stars.

    A large star ties the larger neighbours of each node to its smallest neighbour, a small star the
    smaller ones; both are a partial minimum and a join, repeated on stored tables until nothing moves.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.select("a", "b").where("a > b"), "links")
    state = mark(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stage(low.select("a", F.col("low").alias("b")).unionAll(small).distinct(), "small")
        moved = mark(after)
        now, done, state = after, moved == state, moved
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(rows: DataFrame, *, radius: int = RADIUS, **search: int) -> DataFrame:
    """(fingerprint, component_id, root) per distinct fingerprint: the smallest doc_id that its links reach.

    ``rows`` holds doc_id and fingerprint, one row per document, and should be a stored table. Equal
    fingerprints are one class, whatever the number of copies. Null doc_ids take part and count as a
    component's id only where it has no other (null then). An empty table gives none.
    """
    first = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = classes(links(first, radius=radius, **search))
    named = first.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = stage(named, "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("fingerprint", "component_id", "root")


def deduplicated(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate class, with the columns of ``docs``.

    It is the one with the smallest doc_id; of rows that share it, any one. Classes whose doc_ids
    are all null keep one row. A column named ``fingerprint`` stays as it is.
    """
    columns = docs.columns
    mark = "_simhash"
    rows = stage(with_fingerprint(docs, shingle=shingle, name=mark), "printed")
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("fingerprint"))
    found = near_duplicates(slim, radius=radius)
    return one_per_class(rows, slim, found, mark, columns)


def one_per_class(rows: DataFrame, slim: DataFrame, found: DataFrame, mark: str, columns: list[str]) -> DataFrame:
    """``columns`` of one of ``rows`` per root of ``found`` (fingerprint, component_id, root); ``slim`` holds their doc_id and ``mark`` as fingerprint."""
    per_class = slim.join(found, "fingerprint").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = per_class.groupBy("root", "component_id", "fingerprint").agg(F.count("*").alias("n"))
    best = stage(chosen.groupBy("root").agg(F.min(F.struct("fingerprint", "n", "component_id")).alias("b")).select("b.*"), "chosen")
    single, repeated = best.where("n = 1"), best.where("n > 1")
    hit = lambda side: rows[mark].eqNullSafe(side["fingerprint"]) & rows["doc_id"].eqNullSafe(side["component_id"])
    once = rows.join(single, hit(single), "left_semi").select(columns)
    again = rows.join(repeated, hit(repeated), "left_semi").dropDuplicates(["doc_id", mark]).select(columns)
    return once.unionByName(again)
