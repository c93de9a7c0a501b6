"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    binary_tokens, hard_negatives, licenses, mixing, neighbours, packing, quality_model, quality_rules, resampling, sharding, simhash, token_counts, toxicity,
)
from tidemark.session import stage

Query = Callable[[SparkSession, str], DataFrame]

#: Shares of sources, languages and topics in proportion to their natural ones to this power.
MIX_TARGETS = {"source": 0.9, "lang": 0.8, "topic": 0.9}


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(divisor: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor)) == remainder, F.lit(False))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length with its documents and the suffix sums that answer any context limit."""
    return token_counts.suffix_sums(token_counts.length_histogram(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_model.fit_on(docs, labels.where(~held_out(3, 1)))
    scored = quality_model.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_tokens.read_token_files(binary_tokens.write_token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality_rules.counted(_table(spark, sf_dir, "documents")), "statistics")
    rules = quality_rules.learn_from(stats, _table(spark, sf_dir, "labels"))
    return quality_rules.judged(stats, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(simhash.with_fingerprint(docs).drop("text"), "fingerprints")
    found = simhash.near_duplicates(rows)
    return rows.join(found, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_on(docs, labels.where(~held_out(5, 0)))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens, topic, raked weight, draw probability and whether it is in the sample."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows, _ = mixing.with_chances(docs, MIX_TARGETS, vocabulary=vocabulary("byte_bpe_50k.json"))
    return rows.select(
        "doc_id", "source", "lang", F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_weight").alias("weight"),
        F.col("_mix_chance").alias("probability"), (F.col("_mix_draw") < F.col("_mix_chance")).alias("sampled"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mined(vectors, vectors.where("vec_id % 100 = 0"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.with_licenses(docs).select("doc_id", *licenses.COLUMNS.names)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing, op2_token_counts, op3_neighbours, op4_quality_model, op5_binary_tokens, op6_quality_rules, op7_simhash, op8_sharding, op9_toxicity, op10_mixing,
            op11_hard_negatives, op12_resampling, op13_licenses,
        )
    }


#: Every anchor against every row, in whole numbers that doubles hold exactly.
OP11_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
    FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
    WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11_SQL}
