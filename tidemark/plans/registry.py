"""Versioned model registry on ordinary tables, and the retraining flow that publishes to it.

Every run has a folder of its own for its models and one row in ``runs``; importances and diagnostics are
append tables as well. The champion is the newest row of ``pointer``: it is appended last, as one file, so readers
see the old champion until a run is complete, and a run that fails on the way leaves only an unnamed folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.features import MODEL_FEATURES
from tidemark.operators.evaluation import decay, evaluate, promotion
from tidemark.operators.ledger import best_and_worst, diagnostics, is_closed, last_rows
from tidemark.operators.splits import purged_holdout, source_weight, with_index
from tidemark.plans.training import (
    DIAGNOSE_EVERY, EMBARGO_MS, ENSEMBLE_FROM, HOLDOUT_ROWS, MIN_LABELLED, MIN_LEDGER, ROLLING_ROWS, Models, feature_frame, fit_classifier, fit_expected_r,
    load_models, save_models, weighted,
)
from tidemark.session import stage
from tidemark.sources.store import exists, numeric_columns

METRICS = "auc DOUBLE, brier DOUBLE, n_test BIGINT, n_selected BIGINT, threshold DOUBLE, base_rate DOUBLE, precision DOUBLE, precision_lift DOUBLE, ev_r DOUBLE"
RUNS = f"""run BIGINT, gate STRING, n_ledger BIGINT, n_window BIGINT, n_positive BIGINT, n_backtest BIGINT, n_train BIGINT, n_test BIGINT, ensemble BOOLEAN,
  promoted BOOLEAN, reason STRING, challenger STRUCT<{METRICS.replace(' DOUBLE', ': DOUBLE').replace(' BIGINT', ': BIGINT')}>,
  champion STRUCT<{METRICS.replace(' DOUBLE', ': DOUBLE').replace(' BIGINT', ': BIGINT')}>, train_auc DOUBLE, overfit_gap DOUBLE, features ARRAY<STRING>,
  dropped ARRAY<STRING>, folder STRING, closed BIGINT, diagnosed BOOLEAN"""
POINTER = "run BIGINT, folder STRING"
IMPORTANCES = "run_seq BIGINT, feature STRING, importance DOUBLE"
#: Columns of a feature frame that are not features.
META = ("seq", "idx", "target", "realized_r", "entry_ms", "exit_ms", "weight")
#: Features named by rank at either end of a diagnostics run.
RANKED = 10


@dataclass
class Registry:
    """Tables and model folders under ``root``, a place that every executor reaches."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")  # one file, which appears whole

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def importances(self) -> DataFrame:
        return self._read("importances", IMPORTANCES)

    def pointer(self) -> Row | None:
        """The champion's run and folder."""
        return self._read("pointer", POINTER).orderBy(F.desc("run")).first()

    def champion(self) -> Models | None:
        at = self.pointer()
        return None if at is None else load_models(self.spark, at["folder"])

    def next_run(self) -> int:
        return (self.runs().agg(F.max("run")).first()[0] or 0) + 1

    def diagnosed_at(self) -> int:
        """Closed trades when diagnostics last ran."""
        return self.runs().where("diagnosed").agg(F.max("closed")).first()[0] or 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def diagnose(self, run: int, trades: DataFrame, importances: dict[str, float]) -> None:
        """Profit by every dimension over the whole ledger, its best and worst groups, and the strongest and weakest features."""
        cube = stage(diagnostics(trades), "cube")
        tagged = lambda df: df.withColumn("run", F.lit(run).cast("long"))
        self._append("diagnostics", tagged(cube))
        self._append("extremes", tagged(best_and_worst(cube)))
        order = sorted(importances.items(), key=lambda f: (-f[1], f[0]))
        ends = [(run, "top", k, *f) for k, f in enumerate(order[:RANKED], 1)] + [(run, "bottom", k, *f) for k, f in enumerate(order[::-1][:RANKED], 1)]
        self._append("features", self.spark.createDataFrame(ends, "run BIGINT, side STRING, place INT, feature STRING, importance DOUBLE"))


def _metrics(found: Row | None) -> Row | None:
    names = [part.split()[0] for part in METRICS.split(", ")]
    return None if found is None else Row(**{n: found[n] for n in names})


def _predicted(models: Models, rows: DataFrame) -> Row | None:
    scored = models.voter.score(models.fitted_columns(rows))
    return evaluate(scored.select(F.col("target").alias("y"), "p", F.col("realized_r").alias("r"))).first()


def decision(chal: Row | None, champ: Row | None, spark: SparkSession) -> tuple[bool, str]:
    """Promote or keep, from two rows of metrics."""
    get = lambda m, k: None if m is None else m[k]
    row = [tuple(get(m, k) for m in (chal, champ) for k in ("ev_r", "precision_lift", "auc"))]
    verdict = promotion(spark.createDataFrame(row, "chal_ev double, chal_lift double, chal_auc double, champ_ev double, champ_lift double, champ_auc double")).first()
    return verdict["promote"], verdict["reason"]


def retrain_flow(ledger: DataFrame, registry: Registry, tf_minutes: int, *, force: bool = False, embargo_ms: int = EMBARGO_MS, every: int = DIAGNOSE_EVERY, **fit) -> Row:
    """One run over the newest ledger rows, published to the registry; returns its row of ``runs``.

    ``ledger`` (with ``seq``) is read by its newest ROLLING_ROWS rows; diagnostics read all of it. A run that cannot be
    honest is logged with its ``gate`` and changes nothing else: ``few_rows``, ``few_labels``, ``one_class``, ``no_split``.
    Features that decayed away in earlier runs are not trained on. The challenger is fitted on the training side of a
    purged holdout and meets the champion on the other side; with ``force`` there is no champion. What is published is
    refitted on the whole window, as the champion if promoted, else as the run's own models.
    """
    spark, run = ledger.sparkSession, registry.next_run()
    row = dict.fromkeys(part.split()[0] for part in RUNS.replace("\n", " ").split(", ") if "STRUCT" not in part and ":" not in part)
    row |= {"run": run, "challenger": None, "champion": None, "promoted": False, "diagnosed": False, "n_ledger": ledger.count(), "closed": ledger.where(is_closed()).count()}

    def logged(**more) -> Row:
        whole = row | more
        names = [f.name for f in registry.runs().schema.fields]
        line = spark.createDataFrame([tuple(whole[n] for n in names)], RUNS)
        registry._append("runs", line)
        return line.first()

    if row["n_ledger"] < MIN_LEDGER:
        return logged(gate="few_rows")
    frame = feature_frame(last_rows(ledger, ROLLING_ROWS), tf_minutes)
    window = stage(with_index(frame.withColumnRenamed("seq", "id")).withColumnRenamed("id", "seq"), "window")
    held = window.agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0)).alias("pos"), F.count_if(F.col("sample_source") == "backtest").alias("b")).first()
    row |= {"n_window": held["n"], "n_positive": held["pos"], "n_backtest": held["b"]}
    if held["n"] < MIN_LABELLED:
        return logged(gate="few_labels")
    if held["pos"] in (0, held["n"]):
        return logged(gate="one_class")
    parts = stage(purged_holdout(window, min(HOLDOUT_ROWS, max(5, held["n"] // 5)), embargo_ms), "holdout")
    sizes = dict(parts.groupBy("split").count().collect())
    if not sizes:
        return logged(gate="no_split")

    past = registry.importances()
    gone = sorted(r["feature"] for r in decay(past).where("dropped").select("feature").collect())
    columns = [c for c in numeric_columns(window, META) if c in MODEL_FEATURES and c not in gone]
    row |= {"n_train": sizes["train"], "n_test": sizes["test"], "ensemble": sizes["train"] >= ENSEMBLE_FROM, "features": columns, "dropped": gone}
    train = parts.where("split = 'train'").drop("idx").withColumnRenamed("seq", "id")
    train, test = stage(weighted(with_index(train).withColumnRenamed("id", "seq"), 60), "train"), parts.where("split = 'test'")
    fit = {"ensemble": row["ensemble"], **fit}
    challenger = Models(fit_classifier(train, columns, **fit), None, columns)
    holder = None if force else registry.champion()
    chal, own = _metrics(_predicted(challenger, test)), _metrics(_predicted(challenger, train))
    champ = None if holder is None else _metrics(_predicted(holder, test))
    promoted, reason = decision(chal, champ, spark)

    whole = stage(weighted(window, 60), "whole")
    final = Models(fit_classifier(whole, columns, **fit), fit_expected_r(whole.withColumn("weight", source_weight()), columns, rounds=fit.get("rounds", 40)), columns)
    folder = f"{registry.root}/models/run-{run}-{uuid.uuid4().hex[:8]}"
    save_models(final, spark, folder)
    load_models(spark, folder)  # what cannot be read back is not published
    found = final.voter.importances()
    registry._append("importances", spark.createDataFrame([(run, f, v) for f, v in sorted(found.items())], IMPORTANCES))
    due = row["closed"] - registry.diagnosed_at() >= every
    if due:
        registry.diagnose(run, ledger, found)
    gap = chal["auc"] is not None and own["auc"] is not None
    line = logged(gate="trained", challenger=chal, champion=champ, promoted=promoted, reason=reason, train_auc=own["auc"], overfit_gap=own["auc"] - chal["auc"] if gap else None,
                  folder=folder, diagnosed=due)
    if promoted:
        registry._append("pointer", spark.createDataFrame([(run, folder)], POINTER))
    return line
