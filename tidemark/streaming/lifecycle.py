"""Order lifecycle per symbol as a stateful stream operator.

A symbol holds at most one order. A resting order is cancelled when price breaks
its level, filled when price touches it, or expired after its time to live, in
that order of precedence; without a further price it expires by the watermark. An open position is closed at its stop, or its trail
is armed near the target, follows the best price and closes on the retrace.
After a close the symbol cools down and refuses new orders.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.params import SCALP, Execution, Portfolio

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = """status STRING, sid STRING, direction STRING, entry DOUBLE, sl DOUBLE, tp DOUBLE, atr DOUBLE, level DOUBLE,
  placed BIGINT, armed BOOLEAN, anchor DOUBLE, cool_until BIGINT"""
FIELDS = [part.split()[0] for part in STATE.split(",")]
OUTPUT = "symbol STRING, ts TIMESTAMP, sid STRING, event STRING, price DOUBLE, reason STRING"
ROWS = """symbol STRING, ts TIMESTAMP, kind STRING, id BIGINT, price DOUBLE, sid STRING, direction STRING, entry DOUBLE, sl DOUBLE, tp DOUBLE, atr DOUBLE, level DOUBLE"""
MINUTE = 60_000_000


def orders_and_prices(orders: DataFrame, prices: DataFrame) -> DataFrame:
    """One stream of order rows and price rows in the shape of ``ROWS``."""
    names = [part.split()[0] for part in ROWS.split(",")]
    placed = orders.withColumn("kind", F.lit("order"))
    quoted = prices.withColumn("kind", F.lit("price"))
    both = placed.unionByName(quoted, allowMissingColumns=True)
    return both.select(*names)


def advance(s: dict, row: Line, x: Execution, cooldown: float) -> list[tuple]:
    """Apply one row to one symbol's state; returns (event, price, reason) items."""
    now = row.ts
    if row.kind == "order":
        if s.get("status"):
            return [("REFUSED", row.entry, "busy", row.sid)]
        if s.get("cool_until") and now < s["cool_until"]:
            return [("REFUSED", row.entry, "cooldown", row.sid)]
        s.update(status="PENDING", sid=row.sid, direction=row.direction, entry=row.entry, sl=row.sl, tp=row.tp, atr=row.atr,
                 level=row.level, placed=now, armed=False, anchor=None)
        return [("PLACED", row.entry, None, row.sid)]
    if not s.get("status"):
        return []
    price, sign = row.price, 1.0 if s["direction"] == "LONG" else -1.0
    gone = lambda event, at, why: (_clear(s), [(event, at, why, s["sid"])])[1]
    if s["status"] == "PENDING":
        if s["level"] is not None and sign * price < sign * s["level"]:
            return gone("CANCELLED", price, "structure")
        if sign * price <= sign * s["entry"]:
            s["status"] = "OPEN"
            return [("FILLED", s["entry"], None, s["sid"])]
        if now - s["placed"] > x.ttl_minutes * MINUTE:
            return gone("CANCELLED", price, "expired")
        return []
    if s["armed"]:
        best = max(s["anchor"], price) if sign > 0 else min(s["anchor"], price)
        stop = best - sign * max(best * x.trail_pct / 100, (s["atr"] or 0.0) * x.trail_atr)
        if sign * price <= sign * stop:
            s["cool_until"] = now + int(cooldown * MINUTE)
            return gone("CLOSED", stop, "Trailing Stop Hit")
        s["anchor"] = best
        return []
    if sign * price <= sign * s["sl"]:
        s["cool_until"] = now + int(cooldown * MINUTE)
        return gone("CLOSED", s["sl"], "Stop Loss Hit")
    span = sign * (s["tp"] - s["entry"])
    if span > 0 and sign * (price - s["entry"]) / span >= x.activation:
        s.update(armed=True, anchor=price)
        return [("ARMED", price, None, s["sid"])]
    return []


def _clear(s: dict) -> None:
    s["status"] = None


class Line(NamedTuple):
    """One waiting row; ``ts`` in microseconds."""

    ts: int
    id: int
    kind: str
    price: float | None
    sid: str | None
    direction: str | None
    entry: float | None
    sl: float | None
    tp: float | None
    atr: float | None
    level: float | None


class OrderBook(StatefulProcessor):
    """State of one symbol: its order or position, the end of its cooldown, and rows that wait for the watermark.

    Rows wait in slices of event time. Once the watermark has passed a slice's end its rows are applied in the order
    of time and id, one slice after the other, so the result does not depend on how rows were spread over micro-batches
    and no more than one slice is held at a time. A resting order that no price decides expires at the first slice boundary
    after its time to live. Rows of slices that are over are late: prices are dropped, orders refused.
    """

    def __init__(self, x: Execution, cooldown: float, slice_minutes: float):
        self.x, self.cooldown, self.slice = x, cooldown, int(slice_minutes * MINUTE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", STATE)
        self.waiting = handle.getMapState("waiting", "slice BIGINT", "lines STRING")
        self.done = handle.getValueState("done", "upto BIGINT, timer BIGINT")

    def _marks(self) -> tuple[int, int]:
        """(microsecond up to which slices are over, the timer set for the next one or 0)."""
        return tuple(int(v) for v in self.done.get()) if self.done.exists() else (-(1 << 62), 0)

    def _awake_at(self, boundary: int, upto: int, timer: int) -> None:
        """See that a timer fires at or before ``boundary``."""
        at = boundary // 1000
        if not timer or at < timer:
            self.handle.registerTimer(at)
            timer = at
        self.done.update((upto, timer))

    def _after(self, moment: int) -> int:
        """The first slice boundary at or after a moment."""
        return -(-moment // self.slice) * self.slice

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, timer = self._marks()
        soonest, late = None, []
        for frame in rows:  # as they arrive; a symbol's rows are never put together
            ts = frame["ts"].astype("datetime64[us]").astype("int64")
            frame = frame[list(Line._fields)].assign(ts=ts).astype(object).where(frame[list(Line._fields)].notna(), None)
            for number, part in frame.groupby(ts // self.slice):
                begin = int(number) * self.slice
                if begin < upto:
                    late += [(key[0], pd.Timestamp(r.ts, unit="us"), r.sid, "REFUSED", r.entry, "late") for r in part.itertuples(index=False) if r.kind == "order"]
                    continue
                lines = "\n".join(json.dumps(tuple(r)) for r in part.itertuples(index=False))
                at = (int(number),)
                if self.waiting.containsKey(at):
                    lines = self.waiting.getValue(at)[0] + "\n" + lines
                self.waiting.updateValue(at, (lines,))
                soonest = begin + self.slice if soonest is None else min(soonest, begin + self.slice)
        if soonest is not None:
            self._awake_at(soonest, upto, timer)
        if late:
            yield _events(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, timer = self._marks()
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.slice * self.slice
        if passed <= upto:
            return
        state = dict(zip(FIELDS, self.book.get())) if self.book.exists() else {}
        state = {k: None if isinstance(v, float) and v != v else v for k, v in state.items()}
        numbers = sorted(int(n[0]) for n in self.waiting.keys())
        for number in [n for n in numbers if (n + 1) * self.slice <= passed]:
            out = self._expired(key, state, number * self.slice)
            lines = sorted(Line(*json.loads(x)) for x in self.waiting.getValue((number,))[0].split("\n"))
            self.waiting.removeKey((number,))
            for row in lines:
                out += [(key[0], pd.Timestamp(row.ts, unit="us"), sid, event, price, reason) for event, price, reason, sid in advance(state, row, self.x, self.cooldown)]
            if out:
                yield _events(out)
        out = self._expired(key, state, passed)
        if out:
            yield _events(out)
        if not state.get("status") and (state.get("cool_until") or 0) <= passed:
            self.book.clear()  # nothing rests, nothing cools down
            state = {}
        else:
            self.book.update(tuple(state.get(name) for name in FIELDS))
        rest = [(n + 1) * self.slice for n in numbers if (n + 1) * self.slice > passed]
        if state.get("status") == "PENDING":
            rest.append(self._after(self._expiry(state)))
        elif state and not state.get("status"):
            rest.append(self._after(state["cool_until"]))
        self.done.update((passed, 0))
        if rest:
            self._awake_at(min(rest), passed, 0)

    def _expiry(self, state: dict) -> int:
        return state["placed"] + int(self.x.ttl_minutes * MINUTE)

    def _expired(self, key, state: dict, boundary: int) -> list[tuple]:
        """The event of a resting order whose time was over at a slice boundary."""
        if state.get("status") != "PENDING" or self._expiry(state) > boundary:
            return []
        _clear(state)
        return [(key[0], pd.Timestamp(self._expiry(state), unit="us"), state["sid"], "CANCELLED", None, "expired")]

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["symbol", "ts", "sid", "event", "price", "reason"]).astype({"price": "float64"})


def lifecycle(rows: DataFrame, x: Execution = SCALP[2], cooldown: float = Portfolio.cooldown_minutes, delay: str = "1 minute", slice_minutes: float = 1) -> DataFrame:
    """Lifecycle events of a stream shaped like ``ROWS``; sets the RocksDB store.

    Limit the source per trigger (``maxBytesPerTrigger``), so that what waits for the watermark stays small.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        rows.withWatermark("ts", delay)
        .groupBy("symbol")
        .transformWithStateInPandas(OrderBook(x, cooldown, slice_minutes), OUTPUT, "Append", "EventTime")
    )
