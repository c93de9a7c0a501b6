"""Names, clocks, economics, geometry and policies on fixed vectors."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import economics as eco
from tidemark.functions import symbols as sym
from tidemark.functions import times
from tidemark.operators import evaluation as ev
from tidemark.operators.context import sentiment_series, spread_ok, spread_pct
from tidemark.operators.geometry import atr_barriers, limit_zone, structure_stop, zone_stop
from tidemark.params import SWING


@pytest.fixture()
def value(spark):
    row = spark.range(1)
    return lambda *cols: tuple(row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def L(x):  # noqa: N802
    return F.lit(x)


def test_names(value):
    yes = ["CL/USDT:USDT", "CLUSDT", "XAU/USDT:USDT", "NGUSDT", "SPXUSDT"]
    no = ["BTC/USDT:USDT", "CLVUSDT", "XAIUSDT", "SOLUSDT"]
    assert all(value(*[sym.is_commodity_pair(L(s)) for s in yes]))
    assert not any(value(*[sym.is_commodity_pair(L(s)) for s in no]))
    assert value(*[sym.base_asset(L(s)) for s in ("BTC/USDT:USDT", "ETHUSDT", "SOL/USDT")]) == ("BTC", "ETH", "SOL")
    assert value(sym.is_stable_pair(L("USDCUSDT")), sym.is_stable_pair(L("FDUSD/USDT")), sym.is_stable_pair(L("BTCUSDT"))) == (True, True, False)
    assert value(sym.is_meme(L("XRPUSDT")), sym.is_meme(L("1000PEPEUSDT")), sym.is_meme(L("BTCUSDT"))) == (True, True, False)
    assert value(sym.exchange_symbol(L("BTC/USDT:USDT"))) == ("BTCUSDT",)


def test_clocks(value):
    assert [times.tf_minutes(x) for x in ("5m", "30m", "4h", "1d")] == [5, 30, 240, 1440]
    with pytest.raises(ValueError):
        times.tf_minutes("banana")
    with pytest.raises(Exception):
        value(times.tf_minutes_col(L("banana")))
    at = F.lit("2024-01-03 14:47:33").cast("timestamp")
    text = lambda m: F.date_format(times.bucket_start(at, m), "HH:mm")
    assert value(text(5), text(30)) == ("14:45", "14:30")
    hours = [6, 7, 11, 12, 16, 17, 21, 22]
    assert value(*[times.session_of(L(h)) for h in hours]) == ("asian", "london", "london", "ny", "ny", "quiet", "quiet", "asian")
    stamp = lambda s: F.lit(s).cast("timestamp")
    inside = [times.in_event_window(stamp(s)) for s in ("2024-01-02 13:30:00", "2024-01-02 13:30:01", "2024-01-05 11:30:00", "2024-01-01 13:00:00")]
    assert value(*inside) == (True, False, True, False)
    assert value(times.parsed_millis(L("2024-01-01T00:00:01+00:00")), times.parsed_millis(L("junk"))) == (1704067201000, None)
    assert value(times.exit_millis(L(None).cast("long"), L(0).cast("long"), L(0), 5)) == (300000,)


def test_blocked_sessions(spark):
    df = spark.createDataFrame([("2024-01-01 03:00:00",), ("2024-01-01 08:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    assert times.allowed_sessions(df, "ts", ["asian"]).count() == 1
    assert times.allowed_sessions(df, "ts", []).count() == 2
    with pytest.raises(ValueError):
        times.allowed_sessions(df, "ts", ["lunch"])


def test_realized_r(value):
    r = lambda d, e, s, x: eco.realized_r(L(d), L(e), L(s), L(x))
    assert value(r("LONG", 100.0, 98.0, 104.0), r("SHORT", 100.0, 102.0, 96.0), r("LONG", 100.0, 98.0, 98.0), r("LONG", 100.0, 100.0, 104.0)) == (2.0, 2.0, -1.0, 0.0)
    assert value(eco.realized_r(L("LONG"), L(100.0), L(98.0), L(None).cast("double"))) == (0.0,)
    assert value(*eco.label_r(L(1.5), L(0.2))) == (1.5, "triple_barrier")
    assert value(*eco.label_r(L(None).cast("double"), L(0.2))) == (0.2, "realized")


def test_prices_and_trails(value):
    assert value(eco.tick_price(L(0.0365567), L(0.0001)), eco.tick_price(L(123.4567), L(2.0))) == (0.0366, 123.46)
    assert value(eco.trail_distance(L(100.0), L(1.0)), eco.trail_distance(L(100.0), L(0.01)), eco.trail_distance(L(200.0), L(None).cast("double"), 0.5)) == (1.5, 0.3, 1.0)
    none = L(None).cast("double")
    bad = lambda d, p, inv: eco.invalidated(L(d), L(p), L(inv), none, none, L(100.0))
    assert value(bad("LONG", 98.9, 99.0), bad("LONG", 99.5, 99.0), bad("SHORT", 101.1, 101.0), bad("SHORT", 100.5, 101.0)) == (True, False, True, False)
    assert value(eco.invalidated(L("LONG"), L(90.0), none, none, L(101.0), L(100.0))) == (False,)
    assert value(eco.approx_pnl(L("LONG"), L(100.0), L(103.0), L(2.0)), eco.approx_pnl(L("SHORT"), L(100.0), L(97.0), L(2.0)), eco.approx_pnl(L("LONG"), L(100.0), L(98.0), L(1.5))) == (6.0, 6.0, -3.0)


def test_policies(value):
    w = value(*[eco.model_weight(L(n)) for n in (0, 30, 42, 150, 500)])
    assert w[0] == w[1] == 0 and 0 < w[2] < 0.05 and w[3] == w[4] == 0.40
    assert value(eco.ai_risk_pct(L(80), L(12.0), L("ranging")), eco.ai_risk_pct(L(80), L(12.0), L("ranging"), fix_order=True)) == (0.6, 0.4)
    assert value(eco.confidence_bar(L("ranging"), L(50.0), L(0.5)), eco.confidence_bar(L("volatile"), L(90.0), L(0.2), "market")) == (36, 73)
    assert value(eco.position_qty(L(100.0), L(100.0), L(1000.0))) == (0.0,)


def test_stops_and_zones(value):
    swing = SWING[0]
    assert value(zone_stop(L("LONG"), L(100.0), L(2.0), swing), zone_stop(L("SHORT"), L(100.0), L(2.0), swing)) == pytest.approx((98.3, 101.7))
    stop = lambda d, atr, low, high: structure_stop(L(d), L(100.0), L(atr), L(low), L(high))
    assert value(stop("LONG", 2.0, 99.4, 101.0), stop("LONG", 1.0, 97.0, 101.0), stop("SHORT", 2.0, 99.0, 100.6)) == pytest.approx((97.7, 96.75, 102.3))
    up, down = atr_barriers(L("LONG"), L(100.0), L(2.0), 2, 1), atr_barriers(L("SHORT"), L(100.0), L(2.0), 2, 1)
    assert value(*up, *down) == (104.0, 98.0, 96.0, 102.0)
    assert value(*atr_barriers(L("LONG"), L(100.0), L(0.0), 2, 1)) == (None, None)
    none = L(None).cast("double")
    zone = lambda d, e, s, a, g, b: limit_zone(L(d), L(e), L(s), L(a), g, b)
    assert tuple(value(zone("LONG", 100.0, 98.0, 1.0, L(99.2), L(99.2)))[0]) == (99.2, "fvg")
    price, name = value(zone("LONG", 100.0, 98.0, 1.0, none, L(98.1)))[0]
    assert name == "atr_pullback" and price == pytest.approx(99.55)
    price, name = value(zone("SHORT", 100.0, 102.0, 1.0, none, L(101.0)))[0]
    assert (price, name) == (101.0, "order_block")
    price, name = value(zone("LONG", 100.0, 99.9, 5.0, none, none))[0]
    assert name == "atr_pullback" and price == pytest.approx(99.93)


def test_spread(value):
    none = L(None).cast("double")
    assert value(spread_pct(L(99.0), L(101.0)), spread_pct(L(101.0), L(99.0)), spread_pct(L(0.0), L(1.0))) == (2.0, None, None)
    assert value(spread_ok(none, L(100.0), L(98.0)), spread_ok(L(0.2), L(100.0), L(98.0)), spread_ok(L(0.4), L(100.0), L(98.0))) == (True, True, False)


def test_sentiment_payload(spark):
    text = '{"data":[{"timestamp":"86400","value":"40"},{"timestamp":null,"value":"3"},{"timestamp":"172800","value":"55"}]}'
    df = sentiment_series(spark.createDataFrame([(text,)], "payload string"))
    assert sorted((r["ts"].timestamp(), r["value"]) for r in df.collect()) == [(86400.0, 40.0), (172800.0, 55.0)]


PAIR = "chal_ev double, chal_lift double, chal_auc double, champ_ev double, champ_lift double, champ_auc double"


@pytest.mark.parametrize(
    "row,want",
    [
        ((0.50, 0.1, 0.52, 0.10, 0.1, 0.71), (True, "ev_win")),
        ((0.101, 0.1, 0.6, 0.100, 0.1, 0.6), (False, "ev_loss")),
        ((None, 0.20, 0.6, None, 0.05, 0.6), (True, "lift_win")),
        ((None, None, 0.357, None, None, None), (False, "below_bar")),
        ((None, None, None, 0.1, 0.1, 0.6), (False, "not_evaluable")),
        ((0.1, 0.1, 0.6, None, None, None), (True, "first")),
        ((-0.1, 0.1, 0.6, None, None, None), (False, "below_bar")),
        ((None, None, 0.60, None, None, 0.61), (True, "auc_win")),
    ],
)
def test_promotion(spark, row, want):
    r = ev.promotion(spark.createDataFrame([row], PAIR)).first()
    assert (r["promote"], r["reason"]) == want


def test_top_fraction_and_metrics(spark):
    pred = lambda ps: spark.createDataFrame([(i, i % 2, 1.0, p) for i, p in enumerate(ps)], "id int, y int, r double, p double")
    got = ev.top_fraction(pred([0.1, 0.9, 0.5, 0.7, 0.3]), 0.4, 2)
    assert sorted(r["p"] for r in got.collect()) == [0.7, 0.9]
    assert ev.top_fraction(pred([i / 20 for i in range(20)]), 0.01, 5).count() == 5
    assert ev.top_fraction(pred([0.2, 0.4]), 0.3, 50).count() == 2
    assert ev.top_fraction(pred([0.5] * 10), 0.3, 2).count() == 10  # ties stay
    one = pred([0.1, 0.9, 0.2, 0.8])
    m = ev.evaluate(one).first()
    assert m["auc"] == 1.0 and m["n_test"] == 4 and m["base_rate"] == 0.5
    assert ev.evaluate(one.withColumn("y", F.lit(1))).count() == 0
