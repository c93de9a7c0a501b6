"""Ledger, key-value, corpus and metric tables on ordinary Spark files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Typed core of a ledger document; anything else stays readable in the text.
TRADE_SCHEMA = """symbol STRING, direction STRING, entry DOUBLE, sl DOUBLE, tp DOUBLE, qty DOUBLE, status STRING,
  entry_time STRING, exit_time STRING, exit_price DOUBLE, exit_reason STRING, pnl DOUBLE, confidence INT, source STRING,
  bars_held INT, entry_fee DOUBLE, exit_fee DOUBLE, tb_realized_r DOUBLE, tb_exit_time STRING"""

# Columns of the two CSV ledgers.
SIGNAL_CSV = "timestamp STRING, symbol STRING, confidence DOUBLE"
TRADE_CSV = "timestamp STRING, symbol STRING, direction STRING, entry DOUBLE, tp DOUBLE, sl DOUBLE, result STRING, pnl DOUBLE"
METRICS_KEPT = 200


def read_ledger(spark: SparkSession, path: str, schema: str = TRADE_SCHEMA) -> DataFrame:
    """Documents ``(seq, data)`` to rows; ``data`` stays for fields without a column."""
    raw = spark.read.schema("seq BIGINT, data STRING").parquet(path)
    return raw.select("seq", F.from_json("data", schema).alias("d"), "data").select("seq", "d.*", "data")


def to_documents(trades: DataFrame, seq: str = "seq") -> DataFrame:
    return trades.select(F.col(seq).alias("seq"), F.to_json(F.struct(*[c for c in trades.columns if c != seq])).alias("data"))


def write_ledger(documents: DataFrame, path: str, *, append: bool = False) -> None:
    documents.write.mode("append" if append else "overwrite").parquet(path)


def latest_values(log: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Current row per key of an append log; an upsert is an append."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_v")).select(*keys, "_v.*")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return latest_values(current.unionByName(changes, allowMissingColumns=True), keys, seq)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable table lies at ``path``."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def migrate_json(spark: SparkSession, source: str, target: str, schema: str = TRADE_SCHEMA) -> bool:
    """Legacy JSON array to a ledger table, only while the target is absent."""
    if exists(spark, target):
        return False
    old = spark.read.schema(schema).option("multiLine", True).json(source)
    numbered = old.withColumn("seq", F.monotonically_increasing_id())
    to_documents(numbered).write.mode("ignore").parquet(target)
    return True


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_corpus(trades: DataFrame, path: str, version: int) -> None:
    """Replace only the (symbol, version) partitions present in ``trades``."""
    (
        trades.withColumn("def_version", F.lit(version))
        .repartition("symbol", F.pmod(F.hash("seq"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("def_version", "symbol")
        .parquet(path)
    )


def read_corpus(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One version of the corpus; other versions are pruned at the file listing."""
    return spark.read.parquet(path).where(F.col("def_version") == version)


def missing_symbols(wanted: DataFrame, spark: SparkSession, path: str, version: int) -> DataFrame:
    """Symbols without a finished partition of this version."""
    if not exists(spark, path):
        return wanted.select("symbol").distinct()
    done = read_corpus(spark, path, version).select("symbol").distinct()
    return wanted.select("symbol").distinct().join(done, "symbol", "left_anti")


def recent_metrics(log: DataFrame, ts: str = "timestamp", n: int = METRICS_KEPT) -> DataFrame:
    return log.orderBy(F.desc(ts)).limit(n)


def aligned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns`` in order; absent ones are 0 and nulls read as 0."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns])


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if t in kinds and n not in set(drop)]
