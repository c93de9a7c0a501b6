import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.bars_util import START, bar_frame, walk
from tidemark.operators.bars import to_bars
from tidemark.params import SCALP
from tidemark.streaming import bars as sb
from tidemark.streaming import cooling
from tidemark.streaming import lifecycle as lc

def replay(spark, rows, tmp_path, files=1, shuffled=False, **kw):
    """Events of the rows; with several files each is a micro-batch of its own."""
    src = tmp_path / f"in{files}{shuffled}"
    order = sorted(range(len(rows)), key=lambda k: (k * 7919) % len(rows)) if shuffled else range(len(rows))
    for k in range(files):
        part = [rows[i] for i in order if i * files // len(rows) == k]
        spark.createDataFrame(part, lc.ROWS).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    stream = spark.readStream.schema(lc.ROWS).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = sb.drain(lc.lifecycle(stream, **kw), "t").orderBy("ts", "sid").collect()
    return [(r["sid"], r["event"], r["reason"]) for r in out]


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def order(sid, minute, symbol="A", d="LONG", entry=99.0, sl=97.0, tp=103.0, level=98.0, i=0):
    return (symbol, at(minute), "order", i, None, sid, d, entry, sl, tp, 0.1, level)


def price(minute, p, symbol="A", i=1):
    return (symbol, at(minute), "price", i, p) + (None,) * 7


def test_lifecycle_rules(spark, tmp_path):
    rows = [
        order("a", 0), price(1, 100.0), price(2, 98.9), price(3, 102.8), price(4, 104.0), price(5, 103.0),  # fill, arm, ratchet, close
        order("b", 10), order("c", 130), price(131, 97.5),  # cooling down; broken before the touch
        order("d", 140), price(320, 100.0), price(321, 100.0),  # expires strictly after 180 minutes
        order("q", 5, "Q"), order("s", 0, "B", "SHORT", 101.0, 103.0, 97.0, 102.0), price(1, 101.2, "B"), price(2, 103.5, "B"),  # filled, stopped
    ]
    got = replay(spark, rows, tmp_path, x=SCALP[2], cooldown=120.0)
    by = {}
    for sid, event, reason in got:
        by.setdefault(sid, []).append((event, reason))
    assert by["a"] == [("PLACED", None), ("FILLED", None), ("ARMED", None), ("CLOSED", "Trailing Stop Hit")]
    assert by["b"] == [("REFUSED", "cooldown")]
    assert by["c"] == [("PLACED", None), ("CANCELLED", "structure")]
    assert by["d"] == [("PLACED", None), ("CANCELLED", "expired")]
    assert by["s"] == [("PLACED", None), ("FILLED", None), ("CLOSED", "Stop Loss Hit")]
    assert by["q"] == [("PLACED", None), ("CANCELLED", "expired")]  # no price of its own ever comes


def walked(rows, x, cooldown, slice_minutes, upto):
    """Events of one symbol's rows by the rules, written out plainly; minutes are floats."""
    out, resting, held, cool = [], None, None, -1e9
    for now, kind, i, p, sid, d, entry, sl, tp, atr, level in sorted(rows, key=lambda r: (r[0], r[2])) + [(upto, "end", 0, None) + (None,) * 7]:
        if resting and (now // slice_minutes) * slice_minutes >= resting["at"] + x.ttl_minutes:
            out.append((resting["sid"], "CANCELLED", "expired"))
            resting = None
        if kind == "order":
            if resting or held:
                out.append((sid, "REFUSED", "busy"))
            elif now < cool:
                out.append((sid, "REFUSED", "cooldown"))
            else:
                resting = {"sid": sid, "up": d == "LONG", "entry": entry, "sl": sl, "tp": tp, "atr": atr, "level": level, "at": now}
                out.append((sid, "PLACED", None))
        elif kind == "price" and resting:
            up = resting["up"]
            if p < resting["level"] if up else p > resting["level"]:
                out.append((resting["sid"], "CANCELLED", "structure"))
                resting = None
            elif p <= resting["entry"] if up else p >= resting["entry"]:
                held, resting = resting | {"best": None}, None
                out.append((held["sid"], "FILLED", None))
            elif now - resting["at"] > x.ttl_minutes:
                out.append((resting["sid"], "CANCELLED", "expired"))
                resting = None
        elif kind == "price" and held:
            up, why = held["up"], None
            if held["best"] is not None:
                held["best"] = max(held["best"], p) if up else min(held["best"], p)
                gap = max(held["best"] * x.trail_pct / 100, held["atr"] * x.trail_atr)
                why = "Trailing Stop Hit" if (p <= held["best"] - gap if up else p >= held["best"] + gap) else None
            elif p <= held["sl"] if up else p >= held["sl"]:
                why = "Stop Loss Hit"
            elif (p - held["entry"]) / (held["tp"] - held["entry"]) >= x.activation:
                held["best"] = p
                out.append((held["sid"], "ARMED", None))
            if why:
                out.append((held["sid"], "CLOSED", why))
                held, cool = None, now + cooldown
    return out


def lifecycle_rows(n=500, symbols="ABC"):
    rng, rows = random.Random(4), []
    for k in range(n):
        for s in symbols:
            minute, p = k * 3 + rng.random(), 100 + 6 * math.sin(k / 7) + rng.uniform(-2, 2)
            rows.append((s, at(minute), "price", 2 * k + 1, p) + (None,) * 7)
            if rng.random() < 0.15:
                up = rng.random() < 0.5
                f = 1 if up else -1
                rows.append((s, at(minute), "order", 2 * k, None, f"{s}{k}", "LONG" if up else "SHORT", p - f * 1.5, p - f * 4, p + f * 3, 0.5, p - f * 3.5))
    return sorted(rows, key=lambda r: r[1])


@pytest.mark.parametrize("files, shuffled", [(1, True), (6, False)])
def test_lifecycle_equals_a_plain_walk_however_rows_arrive(spark, tmp_path, files, shuffled):
    rows = lifecycle_rows()
    last = max(r[1] for r in rows)
    upto = ((last - START).total_seconds() / 60 - 1) // 5 * 5
    want = []
    for s in "ABC":
        own = [((r[1] - START).total_seconds() / 60, *r[2:]) for r in rows if r[0] == s]
        want += walked([r for r in own if r[0] < upto], SCALP[2], 120.0, 5, upto)
    got = replay(spark, rows, tmp_path, files, shuffled, x=SCALP[2], cooldown=120.0, slice_minutes=5)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {e for _, e, _ in want} == {"PLACED", "REFUSED", "FILLED", "ARMED", "CANCELLED", "CLOSED"} and len(want) > 80


def test_late_orders_are_refused_and_late_prices_dropped(spark, tmp_path):
    first = [price(k, 100.0) for k in range(0, 60)]
    second = [order("waited", 5), price(61, 100.0)]  # its slice still waits when it comes
    late = [order("late", 6), price(7, 90.0), price(90, 100.0)]
    src = tmp_path / "late"
    for part in (first, second, late):
        spark.createDataFrame(part, lc.ROWS).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema(lc.ROWS).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = sb.drain(lc.lifecycle(stream, slice_minutes=5), "late").collect()
    got = [(r["sid"], r["event"], r["reason"]) for r in out]
    assert got == [("waited", "PLACED", None), ("late", "REFUSED", "late")] or got == [("waited", "PLACED", None)]  # Spark's own watermark may drop it first


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    ticks = [("A", at(i * 0.7), i, 100.0 + (i * 37 % 11)) for i in range(400)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, id bigint, price double")
    path = str(tmp_path / "ticks")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = sb.drain(sb.stream_bars(stream, "5m", "1 minute"), "b")
    edge = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=6)
    want = to_bars(df, "5m").where(F.col("ts") <= F.lit(edge))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 40


def test_unique_signals_and_freshness(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("h1", at(0)), ("h1", at(1)), ("h2", at(2))], "signal_hash string, ts timestamp")
    df.write.parquet(path)
    out = sb.drain(sb.unique_signals(spark.readStream.schema(df.schema).parquet(path), "10 minutes"), "u")
    assert out.count() == 2
    rows = spark.createDataFrame([("A", at(10))], "symbol string, ts timestamp")
    ctx = spark.createDataFrame([("A", 1.0, at(9), 2.0, at(1))], "symbol string, f double, f_ts timestamp, g double, g_ts timestamp")
    r = sb.fresh_context(rows, ctx, ["symbol"], {"f": 300.0, "g": 60.0}).first()
    assert (r["f"], r["g"]) == (1.0, None)


def test_incremental_batches_equal_the_whole(spark, tmp_path):
    from tidemark.plans.signals import bar_features

    rows = walk(300, 9)
    path, seen = str(tmp_path / "hist"), []
    compute = lambda b: bar_features(b, "5m").select("symbol", "ts", "volume_spike", "volume_ma")
    run = sb.signal_batches(spark, path, lambda df, e: seen.extend(df.collect()), compute, "5m")
    run(bar_frame(spark, rows[:280]), 0)
    run(bar_frame(spark, rows[280:]), 1)
    want = {r["ts"]: r["volume_ma"] for r in compute(bar_frame(spark, rows)).collect()}
    assert len(seen) == 300
    for r in seen:
        assert (r["volume_ma"] is None) == (want[r["ts"]] is None)
        assert r["volume_ma"] is None or r["volume_ma"] == pytest.approx(want[r["ts"]])


def test_batches_look_back_by_rows_on_sparse_bars(spark, tmp_path):
    """5m bars an hour apart: the look-back is a number of bars, whatever time it spans."""
    from tidemark.plans.signals import bar_features

    rows = walk(330, 9)
    bars = bar_frame(spark, rows)
    base = bars.agg(F.min(F.unix_seconds("ts"))).first()[0]
    bars = bars.withColumn("ts", F.timestamp_seconds(F.lit(base) + (F.unix_seconds("ts") - base) * 12))
    names = ["volume_ma", "atr_percentile", "market_regime", "vwap", "ema50"]
    compute = lambda b: bar_features(b, "5m").select("symbol", "ts", *names)
    cut = F.timestamp_seconds(F.lit(base + 290 * 3600))
    seen = []
    run = sb.signal_batches(spark, str(tmp_path / "hist"), lambda df, e: seen.append(df.collect()), compute, "5m", rows=320)
    run(bars.where(F.col("ts") < cut), 0)
    run(bars.where(F.col("ts") >= cut), 1)
    want = {r["ts"]: r for r in compute(bars).collect()}
    assert [len(s) for s in seen] == [290, 40]
    for r in seen[1]:
        for n in names:
            assert r[n] == want[r["ts"]][n] if n == "market_regime" else r[n] == pytest.approx(want[r["ts"]][n])


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    from tidemark.plans.signals import bar_features

    rows = walk(300, 9)
    compute = lambda b: bar_features(b, "5m").select("symbol", "ts", "volume_ma")
    run = sb.signal_batches(spark, str(tmp_path / "hist"), sb.batch_sink(str(tmp_path / "found")), compute, "5m")
    parts = [bar_frame(spark, rows[:280]), bar_frame(spark, rows[280:])]
    for epoch in (0, 1, 1, 0):
        run(parts[epoch], epoch)
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.count() == 300 == found.select("symbol", "ts").distinct().count()
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 300


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    parts = [[("a", at(0)), ("b", at(90)), ("a", at(1))], [("b", at(90))], [("c", at(2)), ("d", at(3)), ("e", at(95))]]
    src = tmp_path / "s"
    for part in parts:
        spark.createDataFrame(part, "signal_hash string, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema("signal_hash string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    rows, counts = sb.counted_drain(sb.unique_signals(stream, "30 minutes"), "u")
    assert counts == {"rows_in": 7, "rows_out": 3, "rows_late": 2, "rows_duplicate": 2} and {r.signal_hash for r in rows.collect()} == {"a", "b", "e"}


def test_context_changed_between_batches_is_seen(spark, tmp_path):
    rows, context, base = "id long, symbol string, ts timestamp", "symbol string, series string, ts timestamp, value double", str(tmp_path)
    batches = [
        ([("A", "f", at(0), 1.0), ("A", "g", at(0), 5.0)], [(1, "A", at(4)), (2, "B", at(4)), (3, "A", None)]),
        ([("A", "f", at(6), 2.0), ("B", "f", at(1), 3.0)], [(4, "A", at(8)), (5, "B", at(8)), (6, None, at(8))]),
        ([], [(7, "A", at(12)), (8, "A", at(30))]),
    ]
    run = sb.context_batches(lambda: spark.read.schema(context).parquet(f"{base}/context"), ["symbol"], {"f": 360.0, "g": 300.0}, sb.batch_sink(f"{base}/found"))
    for points, asked in batches:
        spark.createDataFrame(points, context).write.mode("append").parquet(f"{base}/context")
        spark.createDataFrame(asked, rows).write.mode("append").parquet(f"{base}/rows")
        sb.drain_batches(spark.readStream.schema(rows).parquet(f"{base}/rows"), "c", run, checkpoint=f"{base}/checkpoint")
    got = {r["id"]: (r["f"], r["g"]) for r in spark.read.parquet(f"{base}/found").collect()}
    nothing = (None, None)
    assert got == {1: (1.0, 5.0), 2: nothing, 3: nothing, 4: (2.0, None), 5: nothing, 6: nothing, 7: (2.0, None), 8: nothing}


def test_cooldown_refuses_entries_and_its_state_goes(spark, tmp_path):
    rng = random.Random(3)
    exits = [(s, at(m + rng.random())) for s in "ABC" for m in rng.sample(range(0, 3000), 14)] + [("E", at(500)), ("E", at(501)), (None, at(9))]
    entries = [(s, at(rng.random() * 3000), f"{s}{k}") for s in "ABCD" for k in range(80)] + [("E", at(620), "e"), ("E", at(621), "at the end"), ("E", at(500), "with the exit"), (None, at(9), "none")]
    base, late = str(tmp_path), at(20_000)
    for side, rows, schema in (("in", entries, "symbol string, ts timestamp, id string"), ("out", exits, "symbol string, exit_time timestamp")):
        rows = sorted(rows, key=lambda r: r[1])
        end = [("Z", late, "end")] if side == "in" else [("Z", late)]
        for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], end, end):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/{side}")
            time.sleep(0.05)
    read = lambda side, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{side}")
    got = {}
    for refused in (True, False):
        out = cooling.decided_entries(read("in", "symbol string, ts timestamp, id string"), read("out", "symbol string, exit_time timestamp"), "1 day", refused=refused, minutes=120)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/c{refused}").trigger(availableNow=True).start(f"{base}/o{refused}")
        q.awaitTermination()
        got[refused] = sorted(r["id"] for r in spark.read.schema(out.schema).parquet(f"{base}/o{refused}").collect() if r["id"] != "end")
        for op in range(2):
            left = spark.read.format("statestore").option("operatorId", op)
            left = left.option("joinSide", "left").load(f"{base}/c{refused}") if op == 0 else left.load(f"{base}/c{refused}")
            assert {r["key"][0] for r in left.select("key").collect()} <= {"Z"}
    hit = lambda s, t: any(x == s and e <= t < e + dt.timedelta(minutes=120) for x, e in exits)
    known = [r for r in entries if r[0]]
    assert got[True] == sorted(i for s, t, i in known if hit(s, t)) and got[False] == sorted(i for s, t, i in known if not hit(s, t))
    assert "with the exit" in got[True] and "e" in got[True] and "at the end" in got[False] and len(got[True]) > 20
