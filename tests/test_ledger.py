import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as led
from tidemark.operators import splits as sp
from tidemark.params import Portfolio
from tidemark.plans.admission import admit, admit_in_turn
from tidemark.sources import store

ROW = "seq bigint, symbol string, status string, pnl double"


def history(n=90, seed=1):
    rng = np.random.default_rng(seed)
    return [(i * 3, "AB"[i % 2], "WIN" if rng.random() < 0.5 else "LOSS", None if i % 17 == 0 else float(round(rng.normal(), 2))) for i in range(n)]


def test_context_equals_the_loop(spark):
    rows = history()
    got = {r["seq"]: r for r in led.with_context(spark.createDataFrame(rows, ROW)).collect()}
    for i, (seq, *_ ) in enumerate(rows):
        past, r = rows[:i], got[seq]
        if i < 5:
            assert (r["recent_win_rate"], r["streak_count"], r["cumulative_pnl"], r["current_dd_abs"]) == (0.5, 0, 0.0, 0.0)
            continue
        wins = [x[2] == "WIN" for x in past]
        run = 1
        while run < len(wins) and wins[-run - 1] == wins[-1]:
            run += 1
        curve = np.cumsum([x[3] or 0.0 for x in past[-50:]])
        assert r["recent_win_rate"] == pytest.approx(np.mean(wins[-10:]))
        assert r["streak_count"] == (run if wins[-1] else -run)
        assert r["cumulative_pnl"] == pytest.approx(sum(x[3] or 0.0 for x in past[-20:]))
        assert r["current_dd_abs"] == pytest.approx(np.maximum.accumulate(curve)[-1] - curve[-1])


def split_frame(spark, n=120, seed=0, hours=1):
    rng = np.random.default_rng(seed)
    rows = [(i, i * hours * 3_600_000, (i * hours + 1 + int(rng.integers(0, 8))) * 3_600_000, int(rng.random() < 0.4)) for i in range(n)]
    return rows, sp.with_index(spark.createDataFrame(rows, "id bigint, entry_ms bigint, exit_ms bigint, target int"))


def slow_holdout(rows, size0, embargo, least=15):
    n = len(rows)
    for size in range(size0, max(size0, n // 2) + 1):
        at = n - size
        if at < least:
            return None
        test = {r[3] for r in rows[at:]}
        train = [r for r in rows[:at] if r[2] is None or r[2] <= rows[at][1] - embargo]
        if len(test) == 2 and len({r[3] for r in train}) == 2 and len(train) >= least:
            return size, [r[0] for r in train]
    return None


@pytest.mark.parametrize("tail", [0, 12])
def test_holdout_equals_the_search(spark, tail):
    rows, _ = split_frame(spark)
    rows = [(*r[:3], 0 if i >= len(rows) - tail else r[3]) for i, r in enumerate(rows)]
    df = sp.with_index(spark.createDataFrame(rows, "id bigint, entry_ms bigint, exit_ms bigint, target int"))
    out = sp.purged_holdout(df, 8, 5 * 3_600_000).toPandas()
    size, train = slow_holdout(rows, 8, 5 * 3_600_000)
    assert (out.split == "test").sum() == size
    assert sorted(out[out.split == "train"].id) == train


def test_holdout_refuses_what_cannot_be_split(spark):
    rows, _ = split_frame(spark)
    make = lambda rs: sp.with_index(spark.createDataFrame(rs, "id bigint, entry_ms bigint, exit_ms bigint, target int"))
    assert sp.purged_holdout(make([(*r[:3], 1) for r in rows]), 8, 0).isEmpty()
    late = sp.purged_holdout(make([(r[0], r[1], r[1] + 500 * 3_600_000, r[3]) for r in rows]), 8, 0)
    assert late.isEmpty() and "split" in late.columns


def test_folds_are_purged_and_ordered(spark):
    rows = [(i, i * 3_600_000, (i + 2) * 3_600_000) for i in range(100)]
    df = sp.with_index(spark.createDataFrame(rows, "id bigint, entry_ms bigint, exit_ms bigint"))
    out = sp.purged_folds(df, 4, 5 * 3_600_000).toPandas()
    assert sorted(out.fold.unique()) == [1, 2, 3, 4]
    for _, f in out.groupby("fold"):
        train, test = f[f.split == "train"], f[f.split == "test"]
        assert train.exit_ms.max() <= test.entry_ms.min() - 5 * 3_600_000
        assert train.idx.max() < test.idx.min() and not set(train.idx) & set(test.idx)
    assert out[out.split == "test"].idx.is_unique


def test_weights(spark):
    df = spark.range(5000).select(sp.recency_weight(F.col("id"), 5000).alias("w"), sp.recency_weight(F.col("id"), 5000, None).alias("u"))
    s = df.agg(F.sum("w").alias("w"), F.sum("u").alias("u")).first()
    assert s["w"] < 100 and s["u"] == 5000


CAND = "scan int, seq bigint, rank bigint, symbol string, direction string, entry double, sl double, qty double, confidence int, status string"


def test_admission_limits(spark):
    book = spark.createDataFrame(
        [(1, 0, 0, "BTCUSDT", "LONG", 100.0, 98.0, 1.0, 0, "OPEN"), (2, 0, 0, "ETHUSDT", "LONG", 100.0, 96.0, 1.0, 0, "PENDING")], CAND
    )
    rows = [
        (1, 1, 1, "BTCUSDT", "SHORT", 100.0, 99.0, 1.0, 90, "OPEN"),  # same symbol
        (1, 2, 2, "SOLUSDT", "LONG", 100.0, 99.0, 1.0, 80, "OPEN"),
        (1, 3, 3, "SOLUSDT", "LONG", 100.0, 99.0, 1.0, 70, "OPEN"),  # taken a moment ago
        (1, 4, 4, "XRPUSDT", "LONG", 100.0, 99.0, 1.0, 60, "OPEN"),  # not in the top three
        (2, 5, 5, "BTCUSDT", "LONG", 100.0, 98.0, 1.0, 90, "OPEN"),  # 4 + 2 > 5
    ]
    out = {r["seq"]: r["verdict"] for r in admit(spark.createDataFrame(rows, CAND), book, "scan", 100.0).collect()}
    assert out == {1: "symbol", 2: "ok", 3: "symbol", 5: "heat"}


def walked_admission(rows, balance, p, max_open):
    """One walk over all scans, a list of open positions at hand."""
    out, books = {}, {}
    scans = sorted({(r["account"] or "", r["scan"]) for r in rows if r["scan"] is not None})
    for account, scan in scans:
        here = [r for r in rows if (r["account"] or "", r["scan"]) == (account, scan)]
        for r in sorted(here, key=lambda r: (-r["confidence"], r["rank"]))[:3]:
            book = books[account] = [x for x in books.get(account, []) if x["until"] is None or x["until"] > scan]
            risk, alt = abs(r["entry"] - r["sl"]) * r["qty"], not r["symbol"].startswith("BTC")
            if len(book) >= max_open:
                why = "max open"
            elif any(x["symbol"] == r["symbol"] for x in book):
                why = "symbol"
            elif sum(x["direction"] == r["direction"] for x in book) >= p.per_direction:
                why = "direction"
            elif alt and sum(x["alt"] for x in book) >= p.alts:
                why = "alts"
            elif sum(x["risk"] for x in book) + risk > balance * p.heat_pct / 100:
                why = "heat"
            else:
                why = "ok"
                book.append({**r, "alt": alt, "risk": risk})
            out[r["seq"]] = why
    return out


EVOLVING = "scan bigint, seq bigint, rank bigint, symbol string, direction string, entry double, sl double, qty double, confidence bigint, until bigint, account string"


@pytest.mark.parametrize(("hold", "span"), [(300, 1000), (2000, 400), (None, 3000)])
def test_accepted_positions_count_in_later_scans(spark, hold, span):
    rng = np.random.default_rng(5)
    names = ["BTCUSDT", "AAAUSDT", "BBBUSDT", "CCCUSDT", "DDDUSDT", "EEEUSDT", "FFFUSDT", "GGGUSDT"]
    rows = []
    for i in range(500):
        scan = None if i % 90 == 0 else int(rng.integers(0, 120)) * 100
        until = None if hold is None and i % 40 == 0 else scan and scan + int(rng.integers(0, hold or 900))
        rows.append((scan, i, i, names[int(rng.integers(0, 8))], "LONG" if rng.random() < 0.6 else "SHORT", 100.0, float(rng.integers(97, 100)),
                     float(rng.integers(1, 4)), int(rng.integers(60, 64)), until, [None, "a", "b", "a"][i % 4]))
    p = Portfolio(per_direction=3, alts=3)
    df = spark.createDataFrame(rows, EVOLVING)
    got = {r["seq"]: r["verdict"] for r in admit_in_turn(df, "scan", "until", 300.0, p, 5, by=["account"], span=span).collect()}
    assert got == walked_admission([dict(zip(df.columns, r, strict=True)) for r in rows], 300.0, p, 5)
    assert set(got.values()) >= {"ok", "symbol", "direction", "alts", "heat"}


def test_evolving_admission_of_nothing(spark):
    none = spark.createDataFrame([], EVOLVING)
    assert admit_in_turn(none, "scan", "until", 100.0).collect() == []
    one = spark.createDataFrame([(100, 1, 1, "BTCUSDT", "LONG", 100.0, 99.0, 1.0, 60, None, "a")], EVOLVING).withColumn("money", F.lit(10.0))
    assert [r["verdict"] for r in admit_in_turn(one, "scan", "until", "money").collect()] == ["heat"]


def test_reconcile_and_backfill(spark):
    trades = spark.createDataFrame(
        [(1, "BTC/USDT:USDT", "OPEN", "LONG", 100.0, 104.0, 2.0), (2, "ETH/USDT:USDT", "OPEN", "SHORT", 100.0, 97.0, 2.0), (3, "SOL/USDT:USDT", "OPEN", "LONG", 1.0, 2.0, 1.0)],
        "seq bigint, symbol string, status string, direction string, entry double, tp double, qty double",
    )
    held = spark.createDataFrame([("SOLUSDT", 1.0), ("ETHUSDT", 0.0)], "symbol string, size double")
    records = spark.createDataFrame([("BTCUSDT", 103.0, 5.5, 1), ("BTCUSDT", 90.0, -9.0, 0)], "symbol string, exit_price double, realized_pnl double, closed_at bigint")
    out = {r["seq"]: (r["exit_price"], r["pnl"], r["status"], r["approx"]) for r in led.reconcile(trades, held, records).collect()}
    assert out == {1: (103.0, 5.5, "WIN", False), 2: (97.0, 6.0, "WIN", True)}
    rows = spark.createDataFrame([(i, f"2024-01-0{i}", "live") for i in range(1, 6)], "seq bigint, entry_time string, source string")
    kept = led.tagged_backfill(rows, 2)
    assert sorted(r["seq"] for r in kept.collect()) == [4, 5]
    once = led.with_backfill(rows, kept)
    assert once.count() == 7 and led.with_backfill(once.drop("place"), kept).count() == 7
    assert led.with_backfill(once.drop("place"), kept, replace=True).count() == 7


def test_cooldown_and_breaker(spark):
    rows = spark.createDataFrame([(1, "A", "2024-01-01 10:00:00", -20.0), (2, "A", "2024-01-01 11:00:00", 1.0), (3, "B", "2024-01-02 09:00:00", 1.0)], "seq bigint, symbol string, s string, pnl double")
    rows = rows.withColumn("exit_time", F.col("s").cast("timestamp"))
    now = F.lit("2024-01-01 12:59:00").cast("timestamp")
    assert [r["symbol"] for r in led.cooling_at(rows.where("symbol = 'A'"), now).collect()] == ["A"]
    ok = {r["seq"]: r["allowed"] for r in led.trading_allowed(rows, "seq", "exit_time").collect()}
    assert ok == {1: True, 2: False, 3: True}


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"symbol":"BTCUSDT","entry":100.5,"tag":"x"}'), (2, '{"symbol":"ETHUSDT","pnl":-1}')], "seq bigint, data string")
    path = str(tmp_path / "ledger")
    store.write_ledger(docs, path)
    rows = {r["seq"]: r for r in store.read_ledger(spark, path).collect()}
    assert rows[1]["entry"] == 100.5 and rows[2]["pnl"] == -1.0 and "tag" in rows[1]["data"]
    legacy = tmp_path / "old.json"
    legacy.write_text('[{"symbol":"BTCUSDT","entry":1.0},{"symbol":"ETHUSDT","entry":2.0}]')
    target = str(tmp_path / "moved")
    assert store.migrate_json(spark, str(legacy), target) and not store.migrate_json(spark, str(legacy), target)
    assert store.read_ledger(spark, target).count() == 2
    kv = store.upsert(
        spark.createDataFrame([("balance", "1", 1), ("cool", "a", 1)], "key string, value string, seq int"),
        spark.createDataFrame([("balance", "2", 2)], "key string, value string, seq int"), ["key"], "seq",
    )
    assert {r["key"]: r["value"] for r in kv.collect()} == {"balance": "2", "cool": "a"}
    corpus = str(tmp_path / "corpus")
    trades = spark.createDataFrame([(1, "A"), (2, "B")], "seq bigint, symbol string")
    store.write_corpus(trades, corpus, 1)
    store.write_corpus(trades.where("symbol = 'A'").withColumn("seq", F.lit(9).cast("bigint")), corpus, 1)
    assert {(r["seq"], r["symbol"]) for r in store.read_corpus(spark, corpus, 1).collect()} == {(9, "A"), (2, "B")}
    wanted = spark.createDataFrame([("A",), ("C",)], "symbol string")
    assert [r["symbol"] for r in store.missing_symbols(wanted, spark, corpus, 1).collect()] == ["C"]
    assert store.missing_symbols(wanted, spark, corpus, 2).count() == 2
    table = spark.createDataFrame([("2024", "BTC", 0.5)], store.SIGNAL_CSV)
    store.write_csv(table, str(tmp_path / "csv"))
    assert store.read_csv(spark, str(tmp_path / "csv"), store.SIGNAL_CSV).first()["confidence"] == 0.5
    assert store.aligned(trades, ["seq", "gone"]).first()["gone"] == 0.0
