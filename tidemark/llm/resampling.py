"""Importance resampling towards a target: hashed n-gram gains summed over documents, the best Gumbel scores drawn.

Features are all runs of one to three consecutive words. Those of a batch are interned in an open-addressed
table of NumPy arrays: XXH64 keys choose the slot, the bytes decide whether two runs are equal, and a slot
holds its run's bucket and count. The counts give the bucket totals of a corpus; with the gains of the buckets
known, every occurrence gathers its gain through its slot. Only bucket totals leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm.bytewords import Layout, Ranges, layout
from tidemark.llm.words import plain_array, text_slices
from tidemark.session import stage

BUCKETS = 10_000
LONGEST = 3
SEED = 42
MIN_WORDS = 20
#: Share of the documents with enough words that is drawn, as a fraction of whole numbers.
SHARE = (5, 100)
#: Bytes of text laid out at a time, and words whose runs share a table; a longer text takes several tables.
SLICE = 2 << 20
TABLE_WORDS = 1 << 15


@dataclass
class Interned:
    """Runs of words in an open-addressed table: ``slot`` of every occurrence; ``bucket`` and ``count`` of every slot."""

    slot: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    #: How many runs start at each word.
    runs: np.ndarray

    def bucket_totals(self, buckets: int) -> np.ndarray:
        held = self.count > 0
        return np.bincount(self.bucket[held], self.count[held], buckets).astype(np.int64)

    def per_word(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of the runs that start at each word."""
        found = gains[self.bucket][self.slot]
        total = np.concatenate([[0], np.cumsum(found)])
        ends = np.cumsum(self.runs)
        return total[ends] - total[ends - self.runs]


def slots(ranges: Ranges, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every byte range, owner of every slot or -1): equal ranges share a slot, found by linear probing."""
    room = 1 << max(4, (2 * len(start)).bit_length())
    owner = np.full(room, -1, np.int64)
    at = (keys & np.uint64(room - 1)).astype(np.int64)
    left = np.arange(len(start))
    while len(left):
        here = at[left]
        free = owner[here] < 0
        owner[here[free]] = left[free]
        held = owner[here]
        same = (held == left) | ((keys[held] == keys[left]) & (size[held] == size[left]))
        check = np.flatnonzero(same & (held != left))
        same[check] = ranges.same(start[held[check]], start[left[check]], size[left[check]])
        left = left[~same]
        at[left] = (at[left] + 1) & (room - 1)
    return at, owner


def interned(words: Layout, begin: int, end: int, *, buckets: int = BUCKETS, longest: int = LONGEST) -> Interned:
    """The runs of up to ``longest`` words of one text that start at words ``begin`` to ``end`` of the layout."""
    at = np.arange(begin, end)
    runs = np.minimum(words.last[begin:end] - at, longest)
    first = np.repeat(at, runs)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = words.start[first]
    size = words.stop[first + nth] - start
    slot, owner = slots(words.ranges, start, size, words.ranges.xxh64(start, size))
    held = np.flatnonzero(owner >= 0)
    bucket = np.zeros(len(owner), np.int64)
    bucket[held] = words.ranges.crc32(start[owner[held]], size[owner[held]]) % buckets
    return Interned(slot, bucket, np.bincount(slot, minlength=len(owner)), runs)


def tables(words: Layout, **kind: int) -> Iterator[tuple[int, int, Interned]]:
    for a in range(0, len(words.start), TABLE_WORDS):
        b = min(len(words.start), a + TABLE_WORDS)
        yield a, b, interned(words, a, b, **kind)


def bucket_counts(texts: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over the column ``text`` of all rows; null texts have none.

    A task sends one row per bucket it met, which Spark adds up; ``buckets`` numbers reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(0), SLICE):
                for _, _, table in tables(layout(plain_array(batch.column(0).slice(a, b - a))), buckets=buckets, longest=longest):
                    total += table.bucket_totals(buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (share in the target / share in the source)) per bucket, one added to every count."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, *, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document: the gains of all its features added up."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1), SLICE):
                words = layout(plain_array(batch.column(1).slice(a, b - a)))
                runs, sums = np.zeros(len(words.start) + 1, np.int64), np.zeros(len(words.start) + 1, np.int64)
                for begin, end, table in tables(words, buckets=buckets, longest=longest):
                    runs[begin + 1 : end + 1], sums[begin + 1 : end + 1] = table.runs, table.per_word(gains)
                runs, sums = np.cumsum(runs), np.cumsum(sums)
                per_text = [pa.array(x[words.first[1:]] - x[words.first[:-1]]) for x in (runs, sums)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts), *per_text], names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in a total order: sorted by range, each range counted on from those before it.

    ``rows`` is a stored table. The ranges are stored with the places inside them, so that a lost
    executor cannot move a row between them; only their sizes are added up over a window.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done + 1, done + n + 1))], names=[*batch.schema.names, "_range", "_place"])
            done += n

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.mapInArrow(number, ", ".join([*fields, "_range int", "_place long"])), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))  # one row per range
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_place")).drop("_range", "_place", "_base")


def gumbel(doc_id, seed: int = SEED):
    """floor(-1000 * ln(-ln(u))), u from the first 8 hex digits of sha256 of ``seed:doc_id`` (a null id is an empty one)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(u)) * -1000.0)


def resampled(
    docs: DataFrame, target: DataFrame, *, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    A document scores its weight plus Gumbel noise of its id; of those with ``min_words`` words or more
    the given share with the highest scores is drawn and ranked from 1, ties to the smaller doc_id (null last);
    the others' rank is null. ``docs`` (doc_id, text) and ``target`` (text) lend these columns only. A null text has
    no words and weight 0; every repeated row counts and is ranked; empty tables give no rows, an
    empty target a gain from its uniform share.
    """
    slim = docs.select("doc_id", "text")
    gains = bucket_gains(*(bucket_counts(x, buckets=buckets, longest=longest) for x in (slim, target)))
    rows = stage(weighted(slim, gains, longest=longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    fit = rows.where(F.col("n_words") >= min_words)
    drawn = share[0] * fit.count() // share[1]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    found = ranked(fit, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return found.unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
