"""Exact token counts: a histogram over encoded lengths answers every context limit by suffix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import encoder, plain_array, text_slices
from tidemark.session import stage

#: Lengths per chunk of the suffix sums: a window partition holds one chunk.
CHUNK = 4096


def length_histogram(docs: DataFrame, vocabulary: str, *, extra: int = 0) -> DataFrame:
    """(n_tokens, n_docs): how many whole texts have each encoded length, plus ``extra`` end tokens each.

    A null text counts as empty, repeated rows count each, an empty table gives no rows. Only
    ``text`` is read. A task sends one row per distinct length it met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), {}
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                starts, _ = enc.encode(plain_array(batch.column(0).slice(a, b - a)))
                for length, n in zip(*np.unique(np.diff(starts) + extra, return_counts=True), strict=True):
                    seen[int(length)] = seen.get(int(length), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    part = docs.select(F.col("text").cast("string")).mapInArrow(count, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with the sums from each length on, which answer any context limit.

    Adds ``tokens`` (of this length), ``docs_longer`` and ``tokens_longer`` (strictly above it),
    ``tokens_within`` (of documents that fit) and ``tokens_truncated`` (all documents cut to this
    length). Two levels: chunks of lengths, then a window over the one row per chunk.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    h = stage(h.withColumn("_chunk", F.floor(F.col("n_tokens") / CHUNK)), "lengths")
    above = Window.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy("_chunk").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    sums = sums.select("_chunk", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_d", "_t")])
    inside = Window.partitionBy("_chunk").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.withColumns({f"{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("n_docs", "tokens")})
    out = out.join(sums, "_chunk").withColumns({"docs_longer": F.col("n_docs_in") + F.col("_d"), "tokens_longer": F.col("tokens_in") + F.col("_t")})
    total = h.agg(F.sum("tokens").alias("_all"))
    out = out.withColumn("_all", total.scalar())
    within = F.col("_all") - F.col("tokens_longer")
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer", within.alias("tokens_within"),
        (within + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_truncated"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_over, tokens_truncated, tokens_lost) for any context limits, from the suffix sums."""
    rows = [
        F.struct(
            F.lit(int(x)).cast("long").alias("limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).alias("tokens_truncated"),
            F.coalesce(F.sum(F.greatest(F.col("n_tokens") - int(x), F.lit(0)) * F.col("n_docs")), F.lit(0)).alias("tokens_lost"),
        )
        for x in limits
    ]
    return sums.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    n = F.col("_docs")
    totals = sums.agg(F.sum("n_docs").alias("_docs"))
    picked = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when((n - F.col("docs_longer")) >= s * n, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return sums.withColumn("_docs", totals.scalar()).agg(F.array(*picked).alias("_r")).select(F.inline("_r"))
