"""Feature frames, models and the retraining flow on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.economics import label_r, realized_r, tidy
from tidemark.functions.features import MODEL_FEATURES, with_features
from tidemark.functions.times import exit_millis
from tidemark.operators.blocks import with_seq
from tidemark.operators.evaluation import evaluate
from tidemark.operators.ledger import is_closed, with_context
from tidemark.operators.splits import purged_folds, recency_weight, source_weight, with_index
from tidemark.params import Execution
from tidemark.session import stage

# Sizes that gate training and choose the model family.
ROLLING_ROWS, MIN_LEDGER, MIN_LABELLED, ENSEMBLE_FROM, HOLDOUT_ROWS = 220, 30, 20, 90, 15
DIAGNOSE_EVERY = 100
VOTES = (0.55, 0.45)
EMBARGO_MS = 24 * 3_600_000


def in_ledger_order(trades: DataFrame) -> DataFrame:
    """``seq`` by entry time, symbols breaking ties, numbered day by day."""
    day = {"_day": F.to_date("entry_time"), "_h": F.hour("entry_time")}
    return with_seq(trades.drop("seq"), [], ["entry_time", "symbol"], day)


def feature_frame(ledger: DataFrame, tf_minutes: int, win_r: float = Execution.win_label_r) -> DataFrame:
    """Model features of closed rows with walk-forward context and labels.

    Context of a row is built from earlier ledger rows only. Meta columns: target,
    realized_r, label_kind, sample_source, entry_ms, exit_ms (end of the label).
    """
    rows = with_context(ledger).where(is_closed())
    managed = realized_r("direction", "entry", "sl", "exit_price")
    r, kind = label_r("tb_realized_r", managed)
    millis = lambda c: F.expr(f"unix_millis({c})")
    recorded = millis("exit_time") if "exit_time" in ledger.columns else F.lit(None).cast("long")
    ended = exit_millis(recorded, millis("entry_time"), F.col("bars_held"), tf_minutes)
    rows = rows.select(
        "*", r.alias("_r"), kind.alias("label_kind"), F.coalesce(F.col("source"), F.lit("live")).alias("sample_source"),
        millis("entry_time").alias("entry_ms"), F.coalesce(millis("tb_exit_time"), ended).alias("exit_ms"),
    )
    meta = ["seq", "symbol", "label_kind", "sample_source", "entry_ms", "exit_ms"]
    return with_features(rows).select(
        *meta, F.col("_r").alias("realized_r"), F.when(F.col("_r") >= win_r, 1).otherwise(0).alias("target"), *MODEL_FEATURES
    )


# ------------------------------------------------------------------ models


@dataclass
class Voter:
    """Calibrated models and their votes; scoring is ``transform`` all the way."""

    members: list[tuple[str, PipelineModel, PipelineModel | None, float]]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        total = F.lit(0.0)
        for name, model, platt, vote in self.members:
            df = model.transform(df)
            if platt is not None:
                df = df.withColumn("_m", F.array(_margin()))
                df = platt.transform(df.withColumn("_margin", F.col("_m")[0]).drop(*_TEMP, "_m"))
            df = df.withColumn(f"_{name}", vector_to_array("probability")[1]).drop(*_TEMP, "_margin", "_cal")
            total = total + F.col(f"_{name}") * vote
        return df.withColumn(out, total).drop(*[f"_{n}" for n, *_ in self.members])

    def importances(self) -> dict[str, float]:
        found: dict[str, float] = {}
        for _, model, _, _ in self.members:
            last = model.stages[-1]
            weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
            columns = model.stages[0].getInputCols()
            for column, value in zip(columns, weights.toArray()):
                found[column] = found.get(column, 0.0) + abs(float(value)) / len(self.members)
        return found


_TEMP = ("_features", "rawPrediction", "probability", "prediction")


def _margin():
    return vector_to_array("rawPrediction")[1]


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep")


def _balanced(train: DataFrame) -> DataFrame:
    """Weight column that also evens out the classes."""
    total = train.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    counts = {r["target"]: r["n"] for r in total}
    n = sum(counts.values())
    share = F.when(F.col("target") == 1, n / (2.0 * counts.get(1, n))).otherwise(n / (2.0 * counts.get(0, n)))
    return train.withColumn("_w", F.col("weight") * share)


def with_fold(train: DataFrame, folds: int, order: str = "seq") -> DataFrame:
    """``fold`` 0..folds - 1 of every row: its place within its class by ``order``, dealt in turn, so that each fold holds both classes
    whenever each has as many rows as there are folds."""
    placed = with_seq(train.withColumnRenamed(order, "_order"), ["target"], ["_order"], {"_chunk": F.expr("_order div 65536")}, name="_place")
    return placed.withColumn("fold", F.pmod("_place", F.lit(folds)).cast("int")).withColumnRenamed("_order", order).drop("_place")


def _platt(margins: DataFrame) -> PipelineModel:
    return Pipeline(stages=[
        VectorAssembler(inputCols=["_margin"], outputCol="_cal"),
        LogisticRegression(featuresCol="_cal", labelCol="target", weightCol="weight"),
    ]).fit(margins)


def _calibrated(stages: list, train: DataFrame, folds: int) -> tuple[PipelineModel, PipelineModel | None, DataFrame | None]:
    """The model on all rows, Platt scaling fitted on margins of models that had not seen the row, and those rows with ``_margin``.

    Where a class has fewer rows than there are folds, the model stays uncalibrated and no row has a margin of its own.
    """
    pipeline = Pipeline(stages=stages)
    least = train.groupBy("target").count().agg(F.min("count"), F.count("*")).first()
    if least[1] < 2 or least[0] < folds:
        return pipeline.fit(train), None, None
    parts = []
    for k in range(folds):  # over folds, not rows
        fitted = pipeline.fit(train.where(F.col("fold") != k))
        parts.append(fitted.transform(train.where(F.col("fold") == k)).withColumn("_margin", _margin()).drop(*_TEMP))
    margins = parts[0]
    for part in parts[1:]:
        margins = margins.unionByName(part)
    margins = stage(margins, "margins")
    return pipeline.fit(train), _platt(margins), margins


def fit_with_scores(train: DataFrame, columns: list[str] | None = None, *, ensemble: bool = True, rounds: int = 40, seed: int = 42) -> tuple[Voter, DataFrame]:
    """Logistic regression, or a boosted and a bagged forest voting 0.55 to 0.45, and (seq, fold, p): out-of-fold probabilities of the training rows.

    Without calibration ``p`` is null, since no honest score of a training row exists then.
    """
    columns = columns or MODEL_FEATURES
    folds = 3 if train.count() >= 60 else 2
    train = stage(with_fold(_balanced(train), folds), "train")
    common = {"featuresCol": "_features", "labelCol": "target", "weightCol": "_w"}
    if not ensemble:
        kinds = [("logit", LogisticRegression(maxIter=200, regParam=0.01, **common), 1.0)]
    else:
        kinds = [
            ("boosted", GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.065, subsamplingRate=0.82, minInstancesPerNode=4, seed=seed, **common), VOTES[0]),
            ("forest", RandomForestClassifier(numTrees=rounds, maxDepth=6, subsamplingRate=0.82, minInstancesPerNode=4, seed=seed, **common), VOTES[1]),
        ]
    members, scored = [], train.select("seq", "fold").withColumn("p", F.lit(0.0))
    for name, model, vote in kinds:
        fitted, platt, margins = _calibrated([_assembler(columns), model], train, folds)
        members.append((name, fitted, platt, vote))
        if margins is None:
            scored = scored.withColumn("p", F.lit(None).cast("double"))
            continue
        own = platt.transform(margins.select("seq", "_margin")).select("seq", (vector_to_array("probability")[1] * vote).alias("_own"))
        scored = scored.join(own, "seq").withColumn("p", F.col("p") + F.col("_own")).drop("_own")
    return Voter(members), scored


def fit_classifier(train: DataFrame, columns: list[str] | None = None, **how) -> Voter:
    return fit_with_scores(train, columns, **how)[0]


def fit_expected_r(train: DataFrame, columns: list[str] | None = None, *, rounds: int = 40, seed: int = 42) -> PipelineModel:
    tree = GBTRegressor(featuresCol="_features", labelCol="realized_r", weightCol="weight", maxIter=rounds, maxDepth=4,
                        stepSize=0.07, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[_assembler(columns or MODEL_FEATURES), tree]).fit(train)


def bounded_percent(p: Column) -> Column:
    """A probability as a percentage within 5..95."""
    return tidy(F.greatest(F.lit(5.0), F.least(F.lit(95.0), p * 100)), 1)


def score(df: DataFrame, voter: Voter | None, expected: PipelineModel | None = None) -> DataFrame:
    """``ai_prob`` within 5..95 (50 without a model) and ``expected_r`` (null without)."""
    if voter is not None:
        df = voter.score(df, "_p")
        df = df.withColumn("ai_prob", bounded_percent(F.col("_p"))).drop("_p")
    else:
        df = df.withColumn("ai_prob", F.lit(50.0))
    if expected is None:
        return df.withColumn("expected_r", F.lit(None).cast("double"))
    scored = expected.transform(df)
    return scored.withColumn("expected_r", tidy(F.col("prediction"), 3)).drop("_features", "prediction")


@dataclass
class Models:
    """What a run publishes: the voting classifier, the regression of expected R, and the columns both read."""

    voter: Voter
    expected: PipelineModel | None
    columns: list[str]

    def fitted_columns(self, df: DataFrame) -> DataFrame:
        """``df`` with every column the models read; absent ones and nulls are 0."""
        have = set(df.columns)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in self.columns})

    def score(self, df: DataFrame) -> DataFrame:
        return score(self.fitted_columns(df), self.voter, self.expected)


def save_models(models: Models, spark: SparkSession, path: str) -> None:
    """Models, calibration, votes and column list under one folder; the list is written last."""
    for name, model, platt, _ in models.voter.members:
        model.write().overwrite().save(f"{path}/{name}/model")
        if platt is not None:
            platt.write().overwrite().save(f"{path}/{name}/platt")
    if models.expected is not None:
        models.expected.write().overwrite().save(f"{path}/expected_r")
    members = [(k, name, vote, platt is not None) for k, (name, _, platt, vote) in enumerate(models.voter.members)]
    spark.createDataFrame(members, "k int, name string, vote double, calibrated boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/members")
    listed = [(models.columns, models.expected is not None)]
    spark.createDataFrame(listed, "columns array<string>, expected boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_models(spark: SparkSession, path: str) -> Models:
    """What ``save_models`` wrote."""
    listed = spark.read.parquet(f"{path}/columns").first()
    members = [
        (m["name"], PipelineModel.load(f"{path}/{m['name']}/model"), PipelineModel.load(f"{path}/{m['name']}/platt") if m["calibrated"] else None, m["vote"])
        for m in spark.read.parquet(f"{path}/members").orderBy("k").collect()
    ]
    return Models(Voter(members), PipelineModel.load(f"{path}/expected_r") if listed["expected"] else None, list(listed["columns"]))


# ------------------------------------------------------------------ flows


def weighted(frame: DataFrame, half_life: float | None) -> DataFrame:
    """Recency times source weight; needs idx."""
    n = frame.count()
    return frame.withColumn("weight", recency_weight(F.col("idx"), n, half_life) * source_weight())


def cross_validate(frame: DataFrame, folds: int = 5, embargo_ms: int = EMBARGO_MS, **fit) -> DataFrame:
    """Metrics per purged walk-forward fold; single-class folds are left out.

    The loop is over folds, not rows: each turn is one distributed fit.
    """
    indexed = with_index(frame.withColumnRenamed("seq", "id")).withColumnRenamed("id", "seq")
    placed = stage(purged_folds(indexed, folds, embargo_ms), "folds")
    ready = placed.groupBy("fold", "split").agg(F.countDistinct("target").alias("k")).groupBy("fold").agg(
        F.min("k").alias("k"), F.count(F.lit(1)).alias("sides")).where("k = 2 and sides = 2")
    scored = []
    for fold in sorted(r["fold"] for r in ready.collect()):
        part = placed.where(F.col("fold") == fold)
        train = part.where("split = 'train'").withColumn("weight", F.lit(1.0))
        voter = fit_classifier(train, **fit)
        scored.append(voter.score(part.where("split = 'test'")).select("fold", F.col("target").alias("y"), "p", F.col("realized_r").alias("r")))
    if not scored:
        return frame.sparkSession.createDataFrame([], "fold int, auc double, brier double")
    pred = scored[0]
    for part in scored[1:]:
        pred = pred.unionByName(part)
    return evaluate(stage(pred, "cv"), ["fold"])
