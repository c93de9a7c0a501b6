import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.bars_util import bar_frame, walk
from tidemark.functions.features import FEATURES, MODEL_FEATURES, with_features
from tidemark.operators import patterns as pat
from tidemark.operators.bars import numbered
from tidemark.operators.blocks import block_window, halo_blocks, own_rows
from tidemark.plans import training as tr


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_feature_vocabulary(spark):
    row = spark.createDataFrame([("LONG", 100.0, 98.0, 104.0, 2.0, 0.0)], "direction string, entry double, sl double, tp double, atr double, fng double")
    out = with_features(row).first()
    assert len(FEATURES) == 60 and len(MODEL_FEATURES) == 59 and set(FEATURES) <= set(out.asDict())
    assert (out["risk_reward"], out["is_swing"], out["fng"], out["symbol_win_rate"], out["hour"]) == (2.0, 1.0, 50.0, 0.5, 12.0)
    assert with_features(row, zero_is_absent=False).first()["fng"] == 0.0


def test_breaks_equal_the_row_view(spark):
    rows = walk(200, 3, scale=0.6)
    w = block_window(["symbol"])
    up, down = pat.break_of_structure(w)
    df = halo_blocks(numbered(bar_frame(spark, rows), "5m"), ["symbol"], block=64, halo=32).select("*", up.alias("u"), down.alias("d"))
    got = own_rows(df).orderBy("seq").toPandas()
    high, low, close = (np.array([r[i] for r in rows]) for i in (4, 5, 6))
    hits = 0
    for i in range(len(rows)):
        top = i >= 13 and close[i - 1 : i + 1].min() > high[i - 11 : i - 1].max()
        bot = i >= 13 and close[i - 1 : i + 1].max() < low[i - 11 : i - 1].min()
        assert (got.u[i], got.d[i]) == (top, bot)
        hits += top + bot
    assert hits > 5


def test_training_separates_what_can_be_separated(spark):
    cols = ["a", "b"]
    rows = [(i, float(i % 10), float((i * 7) % 5), int(i % 10 > 4), 1.0 if i % 10 > 4 else -1.0, 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "seq bigint, a double, b double, target int, realized_r double, weight double")
    voter = tr.fit_classifier(df, cols, ensemble=False)
    scored = tr.score(df, voter, tr.fit_expected_r(df, cols, rounds=5))
    m = scored.groupBy("target").agg(F.avg("ai_prob").alias("p"), F.min("ai_prob").alias("lo"), F.max("ai_prob").alias("hi"), F.avg("expected_r").alias("r")).orderBy("target").collect()
    assert m[0]["p"] < 40 and m[1]["p"] > 60 and m[0]["lo"] >= 5 and m[1]["hi"] <= 95 and m[0]["r"] < 0 < m[1]["r"]
    assert voter.importances()["a"] > voter.importances()["b"]
    neutral = tr.score(df, None).first()
    assert neutral["ai_prob"] == 50.0 and neutral["expected_r"] is None


def labelled(spark, n, rare=None):
    rows = [(i, float(i % 7), float(i % 3), int(i in rare if rare else i % 7 > 3), 1.0 if i % 7 > 3 else -1.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, a double, b double, target int, realized_r double, weight double")


def test_models_are_stored_with_votes_columns_and_expected_r(spark, tmp_path):
    df = labelled(spark, 90)
    models = tr.Models(tr.fit_classifier(df, ["b", "a"], rounds=3), tr.fit_expected_r(df, ["b", "a"], rounds=3), ["b", "a"])
    tr.save_models(models, spark, str(tmp_path / "m"))
    again = tr.load_models(spark, str(tmp_path / "m"))
    assert again.columns == ["b", "a"] and [m[0] for m in again.voter.members] == ["boosted", "forest"] and [m[3] for m in again.voter.members] == [0.55, 0.45]
    keep = lambda m: [(r["ai_prob"], r["expected_r"]) for r in m.score(df.drop("b")).orderBy("seq").collect()]
    assert keep(models) == keep(again) and len({r for r, _ in keep(again)}) > 1


def test_folds_hold_both_classes_and_rows_are_scored_by_other_folds(spark):
    df = labelled(spark, 66, rare={5, 30, 61})
    scored = tr.fit_with_scores(df, ["a", "b"], ensemble=False)[1].join(df, "seq").collect()
    assert len(scored) == 66 and all(0 <= r["p"] <= 1 for r in scored)
    assert {(r["fold"], r["target"]) for r in scored} == {(f, y) for f in range(3) for y in (0, 1)}


def test_too_few_rows_of_a_class_leave_the_model_uncalibrated(spark, tmp_path):
    df = labelled(spark, 66, rare={5, 30})
    voter, scored = tr.fit_with_scores(df, ["a", "b"], ensemble=False)
    assert voter.members[0][2] is None and {r["p"] for r in scored.collect()} == {None}
    tr.save_models(tr.Models(voter, None, ["a", "b"]), spark, str(tmp_path / "m"))
    again = tr.load_models(spark, str(tmp_path / "m"))
    assert all(5 <= r["ai_prob"] <= 95 and r["expected_r"] is None for r in again.score(df).collect())


def test_a_failed_run_leaves_the_old_champion(spark, tmp_path, monkeypatch):
    from tidemark.catalog import learning
    from tidemark.plans import registry as rg
    from tidemark.session import stage

    ledger = stage(tr.in_ledger_order(learning.corpus(spark, "/root/testdata/sf0.01")))
    assert ledger.count() >= 60
    registry = rg.Registry(spark, str(tmp_path / "registry"))
    assert registry.champion() is None and rg.retrain_flow(ledger.limit(5), registry, 30)["gate"] == "few_rows"
    always = lambda *_: (True, "first")
    monkeypatch.setattr(rg, "decision", always)
    first = rg.retrain_flow(ledger, registry, 30, rounds=2, ensemble=False)
    assert (first["gate"], first["run"], first["promoted"]) == ("trained", 2, True) and registry.pointer()["run"] == 2
    before = registry.champion().score(ledger.limit(0)).columns

    def broken(models, spark, path):
        models.voter.members[0][1].write().overwrite().save(f"{path}/part")
        raise OSError("disk gone")

    monkeypatch.setattr(rg, "save_models", broken)
    with pytest.raises(OSError):
        rg.retrain_flow(ledger, registry, 30, rounds=2, ensemble=False)
    assert registry.pointer()["run"] == 2 and registry.champion().score(ledger.limit(0)).columns == before and registry.runs().count() == 2
    assert {r["run_seq"] for r in registry.importances().collect()} == {2}
