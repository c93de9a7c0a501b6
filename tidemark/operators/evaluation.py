"""Classifier metrics, top-fraction selection, promotion and feature decay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.economics import tidy
from tidemark.operators.blocks import running

# Selection share, margins and decay settings.
SELECT_FRACTION, MIN_SELECTED, EV_MARGIN, AUC_MARGIN, OVERFIT_GAP = 0.30, 5, 0.02, 0.01, 0.20
LOG_EPS = 2.220446049250313e-16
SCORE_BINS = 1_000_000  # chunks of the score axis; at most this many rows on the second level
DECAY, DECAY_FLOOR, WEAK, KEEP_ABOVE, DECAY_RUNS = 0.85, 0.3, 0.01, 0.4, 10


def _by_score(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per distinct score and, above and below it, carried in two levels.

    Rows of equal score collapse first, which is also what ranks ties right.
    """
    one = lambda v: F.sum(F.when(F.col("y") == v, 1).otherwise(0)).cast("long")
    g = pred.groupBy(*keys, "p").agg(
        F.count(F.lit(1)).alias("m"), one(1).alias("pos"), one(0).alias("neg"), F.sum("r").alias("r")
    )
    bins = {"_bin": F.floor(F.col("p") * SCORE_BINS)}
    up = running(g, keys, bins, ["p"], {"below": (F.col("m"), "sum"), "neg_below": (F.col("neg"), "sum")}, exclusive=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return up.withColumn("below", zero("below")).withColumn("neg_below", zero("neg_below"))


def _with_cut(g: DataFrame, keys: list[str], fraction: float, least: int) -> DataFrame:
    total = g.groupBy(*keys).agg(F.sum("m").alias("n"))
    joined = g.join(total, keys)
    k = F.least(F.col("n"), F.greatest(F.lit(least).cast("long"), F.ceil(F.col("n") * fraction)))
    above = F.col("n") - F.col("below") - F.col("m")
    return joined.withColumn("picked", above < k)


def top_fraction(pred: DataFrame, fraction: float = SELECT_FRACTION, least: int = MIN_SELECTED) -> DataFrame:
    """Rows at or above the k-th highest score, ties included."""
    keyed = pred.withColumn("_k", F.lit(1))
    g = keyed.groupBy("_k", "p").agg(F.count(F.lit(1)).alias("m"))
    up = running(g, ["_k"], {"_bin": F.floor(F.col("p") * SCORE_BINS)}, ["p"], {"below": (F.col("m"), "sum")}, exclusive=True)
    up = up.withColumn("below", F.coalesce(F.col("below"), F.lit(0)).cast("long"))
    cut = _with_cut(up, ["_k"], fraction, least).where("picked").select("p")
    return pred.join(cut, "p", "left_semi")


def evaluate(pred: DataFrame, keys: Sequence[str] = (), *, threshold: float | None = None,
             fraction: float = SELECT_FRACTION, least: int = MIN_SELECTED) -> DataFrame:
    """One row of metrics per key from (y, p, r); single-class keys give none.

    AUC comes from average ranks, exactly, not from binned curves.
    """
    keys = list(keys)
    made = not keys
    if made:
        pred, keys = pred.withColumn("_k", F.lit(1)), ["_k"]
    pred = pred.select(*keys, "y", "p", "r")
    clipped = F.greatest(F.lit(LOG_EPS), F.least(F.lit(1 - LOG_EPS), F.col("p")))
    loss = -F.when(F.col("y") == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    plain = pred.groupBy(*keys).agg(
        F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.count(F.lit(1)).alias("n_test"), F.avg(F.col("y").cast("double")).alias("base"),
    )
    g = _with_cut(_by_score(pred, keys), keys, fraction, least)
    if threshold is not None:
        g = g.withColumn("picked", F.col("p") >= threshold)
    pick = lambda c: F.sum(F.when(F.col("picked"), F.col(c)))
    ranked = g.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("_u"),
        F.sum("pos").alias("_n1"), F.sum("neg").alias("_n0"),
        F.coalesce(pick("m"), F.lit(0)).cast("long").alias("n_selected"), pick("pos").alias("_sp"), pick("r").alias("_sr"),
        F.min(F.when(F.col("picked"), F.col("p"))).alias("_cut"),
    ).where((F.col("_n1") > 0) & (F.col("_n0") > 0))
    n = F.nullif(F.col("n_selected"), F.lit(0))
    precision = F.col("_sp") / n
    cut = F.lit(threshold) if threshold is not None else F.col("_cut")
    out = ranked.join(plain, keys).select(
        *keys,
        (F.col("_u") / (F.col("_n1") * F.col("_n0"))).alias("auc"), "log_loss", "brier", "n_test",
        tidy(cut, 4).alias("threshold"), "n_selected", tidy(F.col("base"), 4).alias("base_rate"),
        tidy(precision, 4).alias("precision"), tidy(precision - F.col("base"), 4).alias("precision_lift"),
        tidy(F.col("_sr") / n, 4).alias("ev_r"),
    )
    return out.drop("_k") if made else out


def promotion(pairs: DataFrame) -> DataFrame:
    """Promote or keep, with a reason code, from challenger and champion metrics.

    Columns chal_ev, chal_lift, chal_auc, champ_ev, champ_lift, champ_auc; all
    challenger ones null = not evaluable, all champion ones null = no champion.
    The challenger must first make money on its own picks; then the first metric
    both models have decides.
    """
    c = F.col
    nothing = c("chal_ev").isNull() & c("chal_lift").isNull() & c("chal_auc").isNull()
    below = (
        F.when(c("chal_ev").isNotNull(), c("chal_ev") <= 0)
        .when(c("chal_lift").isNotNull(), c("chal_lift") <= 0)
        .otherwise(c("chal_auc") <= 0.5)
    )
    alone = c("champ_ev").isNull() & c("champ_lift").isNull() & c("champ_auc").isNull()
    by_ev, by_lift = c("chal_ev").isNotNull() & c("champ_ev").isNotNull(), c("chal_lift").isNotNull() & c("champ_lift").isNotNull()
    auc = lambda side: F.coalesce(c(f"{side}_auc"), F.lit(0.0))
    wins = (
        F.when(by_ev, c("chal_ev") >= c("champ_ev") + EV_MARGIN)
        .when(by_lift, c("chal_lift") >= c("champ_lift"))
        .otherwise(auc("chal") >= auc("champ") - AUC_MARGIN)
    )
    metric = F.when(by_ev, "ev").when(by_lift, "lift").otherwise("auc")
    code = (
        F.when(nothing, "not_evaluable").when(below, "below_bar").when(alone, "first")
        .otherwise(F.concat(metric, F.when(wins, "_win").otherwise("_loss")))
    )
    return pairs.withColumn("reason", code).withColumn("promote", code.isin("first", "ev_win", "lift_win", "auc_win"))


def overfit(train: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.col("train_auc") - F.col("holdout_auc")
    return (
        train.select(*keys, F.col("auc").alias("train_auc"))
        .join(holdout.select(*keys, F.col("auc").alias("holdout_auc")), list(keys))
        .select(*keys, gap.alias("gap"), (gap > OVERFIT_GAP).alias("overfit"))
    )


def mean_importance(models: DataFrame) -> DataFrame:
    """Mean importance per feature over models given as (model, MAP feature -> value)."""
    pairs = models.select("model", F.explode("importances").alias("feature", "importance"))
    return pairs.groupBy("feature").agg(F.avg("importance").alias("importance"))


def decay(importances: DataFrame) -> DataFrame:
    """Multiplier per feature after all runs (run_seq, feature, importance).

    Each run multiplies or divides by 0.85 depending on the mean of the last ten
    importances, within [0.3, 1]. The fold reads one value per retraining run.
    """
    recent = Window.partitionBy("feature").orderBy("run_seq").rowsBetween(1 - DECAY_RUNS, 0)
    runs = importances.select("feature", "run_seq", F.avg("importance").over(recent).alias("mean"))
    packed = runs.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("run_seq", "mean"))).alias("_runs"))

    def step(m, run):
        return F.when(run["mean"] < WEAK, F.greatest(F.lit(DECAY_FLOOR), m * DECAY)).otherwise(
            F.least(F.lit(1.0), m / DECAY)
        )

    out = packed.select("feature", F.aggregate("_runs", F.lit(1.0), step).alias("multiplier"))
    return out.withColumn("dropped", F.col("multiplier") < KEEP_ABOVE)
