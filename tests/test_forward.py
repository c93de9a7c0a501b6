import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.bars_util import path_frame
from tidemark.operators.chain import NEVER, take_in_turn
from tidemark.operators.forward import first_touch, label_geometry, limit_fills, longest_series, trailing_exits

SIGNAL = "sid string, symbol string, start bigint, direction string, entry double, tp double, sl double, atr double"


def outcome(spark, direction, entry, tp, sl, bars, max_bars=50, **atr):
    sig = spark.createDataFrame([("s", "A", 0, direction, float(entry), float(tp), float(sl), 1.0)], SIGNAL)
    path = path_frame(spark, *zip(*bars)) if bars else path_frame(spark, [], [])
    return first_touch(label_geometry(sig, **atr), path, max_bars).first()


@pytest.mark.parametrize(
    "direction,tp,sl,bars,cap,want",
    [
        ("LONG", 104, 98, [(101, 100, 100), (105, 101, 104)], 50, (1, 2, 2.0, False)),
        ("LONG", 104, 98, [(101, 100, 100), (101, 97, 98)], 50, (-1, 2, -1.0, False)),
        ("LONG", 104, 98, [(101, 99.5, 101), (102, 100, 101), (103.9, 100, 103.9)], 2, (0, 2, 0.5, False)),
        ("SHORT", 96, 102, [(100, 99, 99), (99, 95, 96)], 50, (1, 2, 2.0, False)),
        ("SHORT", 96, 102, [(103, 100, 102)], 50, (-1, 1, -1.0, False)),
        ("LONG", 104, 98, [(105, 97, 100)], 50, (-1, 1, -1.0, True)),
        ("SHORT", 96, 102, [(103, 95, 100)], 50, (-1, 1, -1.0, True)),
        ("LONG", 104, 98, [(101, 100, 100)] * 4 + [(105, 100, 104)], 3, (0, 3, 0.0, False)),
        ("LONG", 104, 98, [(101, 100, 100)], 50, (0, 1, 0.0, False)),
        ("LONG", 104, 98, [], 50, (0, 0, 0.0, False)),
    ],
)
def test_first_touch(spark, direction, tp, sl, bars, cap, want):
    r = outcome(spark, direction, 100, tp, sl, bars, cap)
    assert (r["tb_label"], r["tb_bars_to_touch"], r["tb_realized_r"], r["tb_ambiguous"]) == want


def test_first_touch_geometry(spark):
    r = outcome(spark, "LONG", 100, 999, 1, [(103.5, 100, 103)], profit_atr=3.0, stop_atr=1.0)
    assert (r["tb_barrier"], r["tb_realized_r"]) == ("profit", 3.0)
    assert outcome(spark, "LONG", 100, 104, 100, [(101, 99, 100)])["tb_label"] is None
    assert outcome(spark, "UP", 100, 104, 98, [(101, 99, 100)])["tb_label"] is None


def exits(spark, rows, bars, **kw):
    schema = "sid string, symbol string, start bigint, direction string, entry double, sl double, tp double, trail_pct double, activation double, trail_dist double"
    sig = spark.createDataFrame(rows, schema)
    out = trailing_exits(sig, bars, longest_series(bars), **kw)
    return {r["sid"]: (r["exit_price"], r["exit_reason"], r["bars_held"]) for r in out.collect()}


def test_exit_vectors(spark):
    one = lambda d, sl, tp, pct, act, dist=None: [("s", "A", 0, d, 100.0, float(sl), float(tp), pct, act, dist)]
    assert exits(spark, one("LONG", 98, 110, 0.5, 0.97), path_frame(spark, [101, 102], [97, 96]))["s"] == (98.0, "Stop Loss Hit", 1)
    price, why, _ = exits(spark, one("LONG", 90, 110, 0.5, 0.97), path_frame(spark, [111, 111], [104, 100]))["s"]
    assert np.isclose(price, 111 * 0.995) and why == "Trailing Stop Hit"
    path = path_frame(spark, [110, 120, 130, 130], [109.6, 119.5, 129.5, 120])
    assert np.isclose(exits(spark, one("LONG", 90, 110, 0.5, 0.97), path)["s"][0], 130 * 0.995)
    assert exits(spark, one("SHORT", 103, 90, 0.5, 0.97), path_frame(spark, [104], [99]))["s"][0] == 103.0
    path = path_frame(spark, [110, 120, 130, 130], [109.6, 118, 128, 123])
    assert exits(spark, one("LONG", 90, 110, 0.3, 0.97, 4.0), path)["s"][0] > exits(spark, one("LONG", 90, 110, 0.3, 0.97), path)["s"][0]


def walk_exit(d, entry, sl, tp, h, l, c, pct, act, dist):
    """Row by row restatement of the exit rules."""
    s = 1 if d == "LONG" else -1
    armed, best, goal = False, None, entry + (tp - entry) * act
    for k in range(len(h)):
        good, bad = (h[k], l[k]) if s > 0 else (l[k], h[k])
        if not armed:
            if s * bad <= s * sl:
                return sl, "Stop Loss Hit", k + 1
            armed = s * good >= s * goal
        if armed:
            best = good if best is None else max(best, good) if s > 0 else min(best, good)
            stop = best - s * (dist if dist is not None else best * pct / 100)
            if s * bad <= s * stop:
                return stop, "Trailing Stop Hit", k + 1
    return c[-1], "Open at data end", len(h)


@pytest.mark.parametrize("kw", [{}, {"first_bucket": 8}, {"first_bucket": 4, "largest_bucket": 16}])
def test_exits_equal_the_walk_over_rounds(spark, kw):
    rng = np.random.default_rng(3)
    n = 600
    close = 100 + np.cumsum(rng.normal(0, 0.2, n))
    h, l = close + rng.uniform(0, 0.4, n), close - rng.uniform(0, 0.4, n)
    rows, want = [], {}
    for j in range(120):
        i = int(rng.integers(0, n))
        d = "LONG" if j % 2 else "SHORT"
        s = 1 if j % 2 else -1
        wide = [0.5, 2.0, 60.0][j % 3]
        sl, tp = float(close[i] - s * wide), float(close[i] + s * wide * [1.5, 1.5, 0.9][j % 3])
        dist = None if j % 5 else 0.7
        rows.append((f"s{j}", "A", i + 1, d, float(close[i]), sl, tp, 0.3, 0.9, dist))
        if i + 1 < n:
            want[f"s{j}"] = walk_exit(d, close[i], sl, tp, h[i + 1 :], l[i + 1 :], close[i + 1 :], 0.3, 0.9, dist)
    got = exits(spark, rows, path_frame(spark, h, l, list(close)), **kw)
    assert got.keys() == want.keys()
    for key, (price, why, held) in want.items():
        assert got[key][1:] == (why, held) and np.isclose(got[key][0], price), (key, got[key], want[key])


def test_limit_fill_vectors(spark):
    schema = "sid string, symbol string, start bigint, direction string, limit_price double, invalidation_price double"
    def fill(lows, highs=(101,) * 9, ttl=6, inv=None):
        sig = spark.createDataFrame([("s", "A", 0, "LONG", 99.0, inv)], schema)
        r = limit_fills(sig, path_frame(spark, highs[: len(lows)], lows), ttl).first()
        return None if r is None else r["fill"]

    assert fill([100, 98.5]) == 1
    assert fill([100, 100.5], ttl=2) is None
    assert fill([100, 98.5], ttl=1) is None
    assert fill([100, 97.0], inv=98.0) is None  # the break is tested first
    assert fill([98.5, 97.0], inv=98.0) == 0


@pytest.mark.parametrize("reach,smallest", [(5, 4096), (5, 16), (40, 16), (1, 4)])
def test_chain_equals_the_loop(spark, reach, smallest):
    rng = np.random.default_rng(reach)
    rows, want = [], set()
    for key in ("a", "b", "c"):
        pos = np.sort(rng.choice(4000, 900, replace=False))
        free = pos + rng.integers(1, reach + 1, len(pos))
        ends = [NEVER if key == "c" and p > 3000 else int(f) for p, f in zip(pos, free)]
        rows += [(key, int(p), f) for p, f in zip(pos, ends)]
        nxt = -1
        for p, f in zip(pos, ends):
            if p >= nxt:
                want.add((key, int(p)))
                nxt = f
    df = spark.createDataFrame(rows, "k string, pos bigint, free bigint")
    got = {(r["k"], r["pos"]) for r in take_in_turn(df, ["k"], block=smallest).collect()}
    assert got == want
    assert df.where("pos < 0").transform(lambda d: take_in_turn(d, ["k"])).count() == 0


def test_longest_series(spark):
    assert longest_series(path_frame(spark, [1, 2], [0, 0])) == 2
    assert longest_series(path_frame(spark, [], []).where(F.lit(False))) == 0


def test_a_chain_with_an_interval_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in ("a", "b", "c"):
        pos = np.sort(rng.choice(6000, 900, replace=False))
        length = rng.integers(1, 30, 900)
        length[rng.choice(900, 12, replace=False)] = rng.integers(500, 3000, 12)  # up to 190 blocks of 16
        rows += [(k, int(p), int(p + n)) for p, n in zip(pos, length)]
    want = set()
    for k in ("a", "b", "c"):
        at = 0
        for key, p, f in rows:
            if key == k and p >= at:
                want.add((k, p))
                at = f
    df = spark.createDataFrame(rows, "k string, pos bigint, free bigint")
    for block in (16, 300, 10_000):
        assert {(r["k"], r["pos"]) for r in take_in_turn(df, ["k"], block=block).collect()} == want
