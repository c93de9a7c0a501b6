"""Cross-polytope hashing: nearest vectors by cosine from multiprobe tables, reranked exactly.

A table turns unit vectors by a pseudo-rotation, three rounds of random signs and a fast Hadamard
transform, and puts each in the bucket of the nearest signed axis. A query probes in every table the
axes that its own turned vector leans to most. Candidates are never expanded into pairs: a bucket's
vectors and the queries that probe it meet as two blocks, and a block pair sends its best few per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

TABLES = 12
PROBES = 8
SEED = 20_240
#: Vectors and queries of one block pair; a bucket of any size is cut into such blocks.
INDEX_BLOCK = 4096
QUERY_BLOCK = 1024
#: Scores this close to the last kept one are compared by their exact values.
MARGIN = 1e-9

PAIR = "query_id long, vec_id long, score double"


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the usable vectors: not null, not empty, all finite, not zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        if good.any():
            yield rows[good], values[good]


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which keeps squares in range and changes no cosine."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


def turned(matrix: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of rows padded with zeros to a power of two, up to a common factor."""
    size = 1 << max(0, matrix.shape[1] - 1).bit_length()
    rng = np.random.default_rng([seed, table, size])
    out = np.zeros((len(matrix), size))
    out[:, : matrix.shape[1]] = matrix
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        width = 1
        while width < size:
            pairs = out.reshape(len(out), -1, 2, width)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(out), size)
            width *= 2
    return out


def leanings(matrix: np.ndarray, table: int) -> np.ndarray:
    """How far each row leans to every signed axis of a table: axis k at column k, its negative at size + k."""
    out = turned(scaled(matrix), table)
    return np.concatenate([out, -out], axis=1)


def _hashed(vectors: DataFrame, tables: int, probes: int, id_name: str) -> DataFrame:
    """(dim, tbl, bucket, id, vec): each vector in its ``probes`` best buckets of every table."""
    element = vectors.schema["vec"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("tbl", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField(id_name, T.LongType()), T.StructField("vec", element)])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _vectors(batch.column(1)):
                held = batch.take(pa.array(rows))
                for table in range(tables):
                    lean = leanings(matrix, table)
                    take = min(probes, lean.shape[1])
                    if take == 1:
                        found = lean.argmax(axis=1)[:, None]
                    else:
                        found = np.argpartition(-lean, take - 1, axis=1)[:, :take]
                    again = held.take(pa.array(np.repeat(np.arange(len(rows)), take))) if take > 1 else held
                    n = len(rows) * take
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, matrix.shape[1], np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(found.ravel().astype(np.int32)), *again.columns], names=["dim", "tbl", "bucket", id_name, "vec"])

    return vectors.where("id is not null and vec is not null").select("id", "vec").mapInArrow(hash_, schema)


def _one_bucket(vectors: DataFrame, id_name: str) -> DataFrame:
    usable = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & usable).select(F.size("vec").alias("dim"), F.lit(0).alias("tbl"), F.lit(0).alias("bucket"), F.col("id").alias(id_name), "vec")


def best_of(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score): the k nearest per query in this block, itself left out.

    Scores are added up component by component in order, so equal vectors score equally.
    """
    q, x = scaled(queries), scaled(matrix)
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / qn[:, None]) @ (x / xn[:, None]).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    last = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -2.0)
    a, b = np.nonzero(rough >= np.maximum(last, -2.0)[:, None] - MARGIN)
    score = exact_cosine(q[a], x[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    kept = place < k
    return a[kept], b[kept], score[kept]


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    dot, qq, xx = (np.zeros(len(q)) for _ in range(3))
    for j in range(q.shape[1]):
        dot += q[:, j] * x[:, j]
        qq += q[:, j] * q[:, j]
        xx += x[:, j] * x[:, j]
    return dot / (np.sqrt(qq) * np.sqrt(xx))


def _meet(index: DataFrame, queries: DataFrame, k: int, index_block: int, query_block: int) -> DataFrame:
    """Best k per query and block pair, over all buckets that hold both."""
    key = ["dim", "tbl", "bucket"]
    sizes = index.groupBy(*key).agg(F.ceil(F.count("*") / index_block).cast("int").alias("rows_n"))
    probes = queries.groupBy(*key).agg(F.ceil(F.count("*") / query_block).cast("int").alias("queries_n"))
    grid = sizes.join(probes, key)  # a row per bucket
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    left = index.join(grid, key).withColumn("i", cut("vec_id", "rows_n")).withColumn("j", spread("queries_n"))
    right = queries.join(grid, key).withColumn("j", cut("query_id", "queries_n")).withColumn("i", spread("rows_n"))
    left, right = left.select(*key, "i", "j", "vec_id", "vec"), right.select(*key, "i", "j", "query_id", "vec")

    def matrix(table: pa.Table) -> np.ndarray:
        values = table.column("vec").combine_chunks()
        return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)

    def compare(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids, x, q = own.column("vec_id").to_numpy(), asking.column("query_id").to_numpy(), matrix(own), matrix(asking)
        parts = []
        for at in range(0, len(ids), index_block):  # equal ids share a block, so a block may be longer
            for to in range(0, len(query_ids), query_block):
                a, b, score = best_of(q[to : to + query_block], query_ids[to : to + query_block], x[at : at + index_block], ids[at : at + index_block], k)
                parts.append((query_ids[to + a], ids[at + b], score))
        a, b, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": score})

    tile = [*key, "i", "j"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, PAIR)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, tables: int = TABLES, probes: int = PROBES,
    index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found per query, ties to the smaller vec_id.

    Both tables hold ``vec_id`` and ``embedding``; other columns are not read. Rows with a null id
    or a vector that is null, empty, zero or holds a null or non-finite component take no part, and
    vectors of another length are no candidates. Rows that share a vec_id are one item standing at
    all their vectors; a query's own id is never its candidate. A query whose buckets held fewer
    than k candidates is compared with every vector instead. Empty tables give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    asked = queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    found = _meet(_hashed(rows, tables, 1, "vec_id"), _hashed(asked, tables, probes, "query_id"), k, index_block, query_block)
    found = stage(_ranked(found, k), "nearest")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    short = stage(short, "short")
    if short.isEmpty():
        return found
    rest = _ranked(_meet(_one_bucket(rows, "vec_id"), _one_bucket(short, "query_id"), k, index_block, query_block), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
