"""Time-honest splits: purged folds, purged holdout, sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import running, with_seq

# Smallest training side, class share of simulated rows, recency half-life.
MIN_TRAIN_ROWS, BACKTEST_WEIGHT, HALF_LIFE = 15, 0.5, 60
DAY_MS = 86_400_000


def with_index(rows: DataFrame, order=("entry_ms", "id")) -> DataFrame:
    """``idx``: chronological 0-based place.

    A chunk is one minute. Rows without a time go by the second order column, come
    first, and are cut by that column's value.
    """
    at, tie = F.col(order[0]), F.col(order[1])
    chunk = {
        "_day": F.coalesce(F.floor(at / DAY_MS), F.lit(-1).cast("long")),
        "_part": F.coalesce(F.floor(at / 60_000), F.floor(tie / 65_536)),
    }
    return with_seq(rows, [], list(order), chunk, name="idx")


def purged_folds(rows: DataFrame, folds: int, embargo_ms: int) -> DataFrame:
    """Expanding walk-forward folds as rows (fold, split, idx, ...).

    Training rows must have resolved ``embargo_ms`` before the fold's first test
    entry. Only the fold starts (one row per fold) reach the driver; assignment is
    then a projection, since each row's place in every fold follows from its idx
    and exit. Folds without training rows are left out.
    """
    n = rows.count()
    bounds = [int(n * i / (folds + 1)) for i in range(1, folds + 2)]
    starts = {r["idx"]: r["entry_ms"] for r in rows.where(F.col("idx").isin(*bounds)).select("idx", "entry_ms").collect()}
    parts = []
    for fold, (lo, hi) in enumerate(zip(bounds, bounds[1:]), 1):
        if hi <= lo or starts.get(lo) is None:
            continue
        train = (F.col("idx") < lo) & (F.col("exit_ms") <= starts[lo] - embargo_ms)
        test = F.col("idx").between(lo, hi - 1)
        parts.append(F.when(train, F.struct(F.lit(fold).alias("fold"), F.lit("train").alias("split")))
                     .when(test, F.struct(F.lit(fold).alias("fold"), F.lit("test").alias("split"))))
    if not parts:
        return rows.select("*", F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("split")).where("false")
    placed = rows.select("*", F.explode(F.array_compact(F.array(*parts))).alias("_f")).select("*", "_f.fold", "_f.split").drop("_f")
    trained = placed.where("split = 'train'").select("fold").distinct()
    return placed.join(F.broadcast(trained), "fold", "left_semi")  # one row per fold


def holdout_sizes(rows: DataFrame, holdout: int, embargo_ms: int, min_train: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Valid holdout sizes with their split place and purge cutoff.

    A size is valid when both sides hold both classes and the training side at
    least ``min_train`` rows. Instead of counting rows per size, class counts are
    carried along one merged timeline of outcomes and cutoffs; an outcome at or
    before a cutoff always belongs to a row before the split.
    """
    n = rows.count()
    top = max(holdout, n // 2)
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    pos, neg = one(F.col("target") == 1), one(F.col("target") == 0)
    by_idx = {"_chunk": F.expr("idx div 65536")}
    seen = running(
        rows, [], by_idx, ["idx"],
        {"_pos": (pos, "sum"), "_neg": (neg, "sum"),
         "_free_pos": (one(F.col("exit_ms").isNull() & (F.col("target") == 1)), "sum"),
         "_free_neg": (one(F.col("exit_ms").isNull() & (F.col("target") == 0)), "sum")},
        exclusive=True,
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    totals = rows.agg(F.sum(pos).alias("p"), F.sum(neg).alias("n")).first()
    splits = seen.select(
        F.col("idx").alias("split_at"), (F.lit(n) - F.col("idx")).alias("size"), (F.col("entry_ms") - embargo_ms).alias("at"),
        (F.lit(totals["p"]) - zero("_pos")).alias("test_pos"), (F.lit(totals["n"]) - zero("_neg")).alias("test_neg"),
        zero("_pos").alias("all_pos"), zero("_neg").alias("all_neg"), zero("_free_pos").alias("free_pos"), zero("_free_neg").alias("free_neg"),
    ).where(F.col("size").between(holdout, top) & (F.col("split_at") >= min_train))
    outcomes = rows.where("exit_ms is not null").select(F.col("exit_ms").alias("at"), pos.alias("p"), neg.alias("q"), F.lit(0).alias("k"))
    asks = splits.where("at is not null").select("at", F.lit(1).alias("k"), "split_at")
    line = outcomes.unionByName(asks, allowMissingColumns=True)
    days = {"_day": F.floor(F.col("at") / DAY_MS), "_min": F.floor(F.col("at") / 60_000)}
    line = running(line, [], days, ["at", "k"], {"done_pos": (F.col("p"), "sum"), "done_neg": (F.col("q"), "sum")})
    counts = line.where("k = 1").select("split_at", zero("done_pos").alias("dp"), zero("done_neg").alias("dn"))
    joined = splits.join(counts, "split_at", "left")
    timed = F.col("at").isNotNull()
    train_pos = F.when(timed, zero("dp") + F.col("free_pos")).otherwise(F.col("all_pos"))
    train_neg = F.when(timed, zero("dn") + F.col("free_neg")).otherwise(F.col("all_neg"))
    ok = (F.col("test_pos") > 0) & (F.col("test_neg") > 0) & (train_pos > 0) & (train_neg > 0) & (train_pos + train_neg >= min_train)
    return joined.where(ok).select("size", "split_at", F.col("at").alias("cutoff"), (train_pos + train_neg).alias("train_rows"))


def purged_holdout(rows: DataFrame, holdout: int, embargo_ms: int, min_train: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Rows with ``split`` (train, test) at the smallest valid holdout; none if no size is valid."""
    best = holdout_sizes(rows, holdout, embargo_ms, min_train).orderBy("size").first()
    if best is None:
        return rows.withColumn("split", F.lit(None).cast("string")).where("false")
    resolved = F.col("exit_ms").isNull() | (F.col("exit_ms") <= F.lit(best["cutoff"]))
    before = F.col("idx") < best["split_at"]
    kept = resolved if best["cutoff"] is not None else F.lit(True)
    split = F.when(~before, "test").when(kept, "train")
    return rows.withColumn("split", split).where("split is not null")


def recency_weight(idx: Column, n: Column | int, half_life: float | None = HALF_LIFE) -> Column:
    """Half per ``half_life`` rows of age; uniform without one."""
    if half_life is None:
        return F.lit(1.0)
    n = F.lit(n) if isinstance(n, int) else n
    return F.pow(F.lit(0.5), (n - 1 - idx) / F.lit(float(half_life)))


def source_weight(source: str = "sample_source") -> Column:
    return F.when(F.col(source) == "backtest", BACKTEST_WEIGHT).otherwise(1.0)
