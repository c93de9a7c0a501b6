import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.bars_util import bar_frame, walk
from tidemark.operators import indicators as ind
from tidemark.operators.asof import asof_global, asof_join
from tidemark.operators.bars import numbered
from tidemark.operators.blocks import block_window, halo_blocks, own_rows, running, smoothed, with_seq
from tidemark.plans.signals import entry_features


def frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, i, float(rng.normal())) for k in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "k string, i bigint, x double")


def test_numbering_and_prefixes_match_one_window(spark):
    df = frame(spark).where("i % 7 <> 3")
    chunk = {"_c": F.expr("i div 16")}
    out = with_seq(df, ["k"], ["i"], chunk)
    late = F.when(F.col("x") > 1.2, F.col("i"))
    out = running(out, ["k"], chunk, ["i"], {"s": (F.col("x"), "sum"), "m": (F.col("x"), "max"), "l": (late, "last")}, exclusive=True)
    w = Window.partitionBy("k").orderBy("i")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    want = out.select(
        "*", (F.row_number().over(w) - 1).alias("w_seq"), F.sum("x").over(past).alias("w_s"), F.max("x").over(past).alias("w_m"),
        F.last(late, True).over(past).alias("w_l"),
    ).toPandas()
    assert (want.seq == want.w_seq).all()
    assert np.allclose(want.s.fillna(0), want.w_s.fillna(0))
    assert (want.m.fillna(-9) == want.w_m.fillna(-9)).all() and (want.l.fillna(-9) == want.w_l.fillna(-9)).all()


def test_padded_blocks_equal_plain_windows(spark):
    df = with_seq(frame(spark), ["k"], ["i"], {"_c": F.expr("i div 32")})
    blocks = halo_blocks(df, ["k"], block=16, halo=12)
    w = block_window(["k"])
    got = own_rows(blocks.select("*", F.max("x").over(w.rowsBetween(-12, -1)).alias("m"), F.lag("x", 5).over(w).alias("g")))
    plain = Window.partitionBy("k").orderBy("i")
    both = got.select("*", F.max("x").over(plain.rowsBetween(-12, -1)).alias("wm"), F.lag("x", 5).over(plain).alias("wg"))
    assert both.count() == df.count()
    assert both.where("not (m <=> wm) or not (g <=> wg)").count() == 0


def test_smoothing_across_blocks_matches_the_recurrence(spark):
    df = frame(spark, 5000, 4).where("k = 'a'").withColumn("x", F.abs("x") + 1)
    df = with_seq(df, ["k"], ["i"], {"_c": F.expr("i div 512")})
    blocks = halo_blocks(df, ["k"], block=1500, halo=1024)
    w = block_window(["k"])
    spans = {"a": 1 / 14, "b": 2 / 21, "c": 2 / 51}
    out = own_rows(blocks.select("*", *[smoothed(F.col("x"), a, w, halo=1024).alias(n) for n, a in spans.items()]))
    pdf = out.orderBy("seq").toPandas()
    for n, a in spans.items():
        assert np.abs(pdf[n] - pdf.x.ewm(alpha=a, adjust=False).mean()).max() < 1e-11


def test_means_of_any_span_equal_the_recurrence(spark):
    df = frame(spark, 20_000, 4).where("k = 'a'").withColumn("x", F.abs("x") + 1)
    df = with_seq(df, ["k"], ["i"], {"_c": F.expr("i div 512")})
    spans = {f"e{s}": s for s in (2, 9, 20, 50, 200, 500)}
    for block in (None, 900):
        pdf = ind.with_emas(df, ["k"], spans, "x", block=block).orderBy("seq").toPandas()
        for n, s in spans.items():
            assert np.abs(pdf[n] - pdf.x.ewm(span=s, adjust=False).mean()).max() < 1e-9


def test_requests_wider_than_a_block_are_refused(spark):
    w = block_window(["k"])
    for wide in (lambda: ind.ema(w, 10), lambda: ind.ema(w, 200), lambda: ind.vwap(w, 2000)):
        with pytest.raises(ValueError):
            wide()


def test_lead_in_longer_than_a_block(spark):
    df = with_seq(frame(spark, 900, 6), ["k"], ["i"], {"_c": F.expr("i div 64")})
    got = own_rows(halo_blocks(df, ["k"], block=40, halo=130).select("*", F.lag("x", 125).over(block_window(["k"])).alias("g")))
    both = got.select("*", F.lag("x", 125).over(Window.partitionBy("k").orderBy("i")).alias("wg"))
    assert both.count() == df.count() and both.where("not (g <=> wg)").count() == 0


def test_swing_look_back_is_followed(spark):
    rows = walk(300, 7)
    few, many = (entry_features(bar_frame(spark, rows), "5m", swing_rows=n).where("seq > 60").agg(F.sum("stop_low")).first()[0] for n in (5, 40))
    assert many < few


def test_true_range_and_atr_first_rows(spark):
    df = halo_blocks(numbered(bar_frame(spark, walk(40, 2)), "5m"), ["symbol"])
    w = block_window(["symbol"])
    pdf = own_rows(df.select("*", ind.true_range(w).alias("tr")).select("*", ind.wilder_atr(w).alias("atr"))).orderBy("seq").toPandas()
    assert np.isclose(pdf.tr[0], pdf.high[0] - pdf.low[0])
    assert pdf.atr[:13].isna().all() and pdf.atr[13:].notna().all()
    want = pdf.tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert np.allclose(pdf.atr[13:], want[13:])


def test_features_do_not_look_ahead(spark):
    rows = walk(160, 7) + walk(160, 8, "B")
    whole = entry_features(bar_frame(spark, rows), "5m").where("seq = 110")
    cut = [r for i, r in enumerate(rows) if i % 160 <= 110]
    part = entry_features(bar_frame(spark, cut), "5m").where("seq = 110")
    assert whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0


def test_asof_equals_merge_asof_over_buckets(spark):
    rng = np.random.default_rng(5)
    stamp = lambda s: pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(s, unit="s")
    left = pd.DataFrame({"k": rng.choice(["x", "y", "z"], 300), "s": np.sort(rng.integers(0, 90_000, 300)), "id": range(300)})
    right = pd.DataFrame({"k": rng.choice(["x", "y"], 60), "s": rng.choice(90_000, 60, replace=False), "v": rng.normal(size=60)}).sort_values("s")
    for d in (left, right):
        d["ts"] = stamp(d.s)
    a = spark.createDataFrame(left[["k", "id", "ts"]])
    b = spark.createDataFrame(right[["k", "ts", "v"]])
    got = asof_join(a, {"r": b}, ["k"], pieces=7).select("id", F.col("r.v").alias("v")).toPandas().set_index("id").v
    want = pd.merge_asof(left, right, on="s", by="k").set_index("id").v
    assert np.allclose(got.sort_index().fillna(-99), want.sort_index().fillna(-99))
    one = asof_global(a, {"r": b.drop("k")}, pieces=7).select("id", F.col("r.v").alias("v")).toPandas().set_index("id").v
    want = pd.merge_asof(left, right.drop(columns="k"), on="s").set_index("id").v
    assert np.allclose(one.sort_index().fillna(-99), want.sort_index().fillna(-99))


def test_asof_edges(spark):
    series = spark.createDataFrame([(100, 1.0), (200, 2.0), (300, 3.0)], "ms bigint, v double").select(F.timestamp_millis("ms").alias("ts"), "v")
    asks = spark.createDataFrame([(99,), (100,), (250,), (999,)], "ms bigint").select("ms", F.timestamp_millis("ms").alias("ts"))
    got = {r["ms"]: r["v"] for r in asof_global(asks, {"s": series}).select("ms", "s.v").collect()}
    assert got == {99: None, 100: 1.0, 250: 2.0, 999: 3.0}


def test_asof_pieces_hold_like_many_rows_of_one_dense_day(spark):
    """A third of a million ticks of one key in one second, and lookups among them."""
    ticks = spark.range(300_000).select(F.lit("x").alias("k"), F.timestamp_micros(F.expr("id * 3")).alias("ts"), F.col("id").alias("v"))
    asks = spark.range(0, 900_000, 9_000).select(F.lit("x").alias("k"), "id", F.timestamp_micros("id").alias("ts"))
    for pieces in (1, 40):
        got = asof_join(asks, {"r": ticks}, ["k"], pieces=pieces).select("id", "r.v").collect()
        assert sorted((r["id"], r["v"]) for r in got) == [(n, n // 3) for n in range(0, 900_000, 9_000)]


def test_asof_small_and_large_series_agree(spark):
    """Several pages per key, equal times across pages, keys and times that are null, strings and null values."""
    rng = np.random.default_rng(8)
    points = [(k, int(s), n, f"v{n}" if n % 7 else None, float(n)) for k in "xy" for n, s in enumerate(np.sort(rng.integers(0, 300, 1500)))]
    points += [(None, 5, 1, "no", 0.0), ("x", None, 1, "no", 0.0)]
    series = spark.createDataFrame(points, "k string, s long, n long, w string, v double").select("k", F.timestamp_seconds("s").alias("ts"), "n", "w", "v")
    asked = [(i, k, int(s)) for i, (k, s) in enumerate((k, s) for k in ("x", "y", "z", None) for s in range(-2, 303, 5))] + [(9999, "x", None)]
    asks = spark.createDataFrame(asked, "id long, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))
    take = lambda **how: sorted(map(tuple, asof_join(asks, {"r": series}, ["k"], tie="n", **how).select("id", "r.n", "r.w", "r.v").collect()))
    got = take()
    assert got == take(small=0) == take(pieces=9)
    times = {k: [(s, n) for kk, s, n, *_ in points if kk == k and s is not None] for k in "xy"}
    want = {i: max(((p, n) for p, n in times.get(k, []) if s is not None and p <= s), default=(0, None))[1] for i, k, s in asked}
    assert {r[0]: r[1] for r in got} == want and len(got) == len(asked)


def test_asof_moves_the_left_side_only_for_large_series(spark):
    series = spark.range(500).select(F.lit("x").alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("v"))
    asks = spark.range(50).select("id", F.lit("x").alias("k"), F.timestamp_seconds(F.col("id") * 9).alias("ts"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = asof_join(asks, {"r": series}, ["k"])
    assert "RepartitionByExpression" not in plan(found) and "Range (0, 50" in plan(found)
    assert "Range (0, 50" not in plan(asof_join(asks, {"r": series}, ["k"], small=500 * 40))  # stored in order
    empty = asof_global(asks, {"r": series.where("v < 0").drop("k")}).select("r").collect()
    assert len(empty) == 50 and all(r["r"] is None for r in empty)
