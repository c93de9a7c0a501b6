"""Portfolio admission: at most three ranked candidates per scan, one by one, against a given or an evolving book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import is_major
from tidemark.operators.ledger import ACTIVE, exposure, top_signals, trade_risk
from tidemark.params import Portfolio
from tidemark.session import stage

MAX_OPEN = 10  # fixed value: active trades at which a scan places nothing more
WEEK = 604_800
NEVER = 2**62  # leaves the book of a position that is never closed
POSITION = "struct<until bigint, symbol string, direction string, risk double, alt boolean>"


def refusal(active, named, same, alt, alts, heat, cap, p: Portfolio, max_open: int) -> Column:
    """The first limit in the way of a candidate, ``ok`` if there is none. ``heat`` includes the candidate's risk."""
    return (
        F.when(active >= max_open, "max open")
        .when(named, "symbol")
        .when(same >= p.per_direction, "direction")
        .when(alt & (alts >= p.alts), "alts")
        .when(heat > cap, "heat")
        .otherwise("ok")
    )


def admit(candidates: DataFrame, book: DataFrame, scan: str, balance: float, p: Portfolio = Portfolio(),
          max_open: int = MAX_OPEN) -> DataFrame:
    """Candidates with ``accepted`` and the first limit that refused them.

    ``book`` holds the positions active at each scan. Its sums per scan are
    partial aggregates; the sequential part folds the top three rows of a scan.
    """
    top = top_signals(candidates, scan, "rank", p.top_signals)
    held = book.where(F.col("status").isin(*ACTIVE)).select(scan, "symbol").distinct().withColumn("_held", F.lit(True))
    state = exposure(book, [scan])
    rows = top.join(held, [scan, "symbol"], "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    item = F.struct(
        "place", "seq", "symbol", "direction", trade_risk().alias("risk"), (~is_major(F.col("symbol"))).alias("alt"), "_held"
    )
    packed = rows.groupBy(scan).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    packed = packed.join(state, scan, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    start = F.struct(
        zero("longs").alias("longs"), zero("shorts").alias("shorts"), zero("alts").alias("alts"),
        zero("active").alias("active"), F.coalesce(F.col("heat"), F.lit(0.0)).alias("heat"),
        F.array().cast("array<string>").alias("names"), F.array().cast("array<struct<seq bigint, why string>>").alias("out"),
    )
    cap = balance * p.heat_pct / 100.0

    def step(s, c):
        long = c["direction"] == "LONG"
        same = F.when(long, s["longs"]).otherwise(s["shorts"])
        named = c["_held"] | F.array_contains(s["names"], c["symbol"])
        why = refusal(s["active"], named, same, c["alt"], s["alts"], s["heat"] + c["risk"], cap, p, max_open)
        yes = why == "ok"
        add = lambda cond: F.when(yes & cond, 1).otherwise(0).cast("long")
        return F.struct(
            (s["longs"] + add(long)).alias("longs"),
            (s["shorts"] + add(~long)).alias("shorts"),
            (s["alts"] + add(c["alt"])).alias("alts"),
            (s["active"] + add(F.lit(True))).alias("active"),
            (s["heat"] + F.when(yes, c["risk"]).otherwise(0.0)).alias("heat"),
            F.when(yes, F.concat(s["names"], F.array(c["symbol"]))).otherwise(s["names"]).alias("names"),
            F.concat(s["out"], F.array(F.struct(c["seq"].cast("long").alias("seq"), why.alias("why")))).alias("out"),
        )

    verdicts = packed.select(scan, F.explode(F.aggregate("_items", start, step)["out"]).alias("v")).select(
        scan, "v.seq", F.col("v.why").alias("verdict")
    )
    return top.join(verdicts, [scan, "seq"]).withColumn("accepted", F.col("verdict") == "ok")


def admit_in_turn(
    candidates: DataFrame, scan: str, until: str, balance: float | str, p: Portfolio = Portfolio(), max_open: int = MAX_OPEN,
    *, by: Sequence[str] = (), span: int = WEEK,
) -> DataFrame:
    """Candidates with ``accepted`` and the first limit that refused them, each scan seeing what earlier scans accepted.

    ``scan`` and ``until`` are seconds: an accepted candidate is in the book of the later candidates of its scan and of
    all scans before ``until``, for ever if that is null. ``balance`` is a number or a column of the candidates, ``by``
    names the accounts, whose books are separate. Rows without a scan take no part.

    The book of an account evolves scan by scan, but it is small and forgets: a position leaves it when it closes. So
    slices of ``span`` seconds are folded side by side, each from the book that the slice before it is believed to
    leave, at first none. Slices that started from a wrong book are folded again until none is left. The first slice of an account
    is right at once and every round makes at least one more right, so the end is what one walk over all scans
    gives; how many rounds it takes depends on how many slices positions outlast. A task folds one slice: at most
    ``p.top_signals`` rows per scan.
    """
    keys = list(by)
    money = F.col(balance) if isinstance(balance, str) else F.lit(float(balance))
    ready = candidates.where(F.col(scan).isNotNull()).withColumn("_scan", F.struct(*keys, scan))
    top = stage(top_signals(ready, "_scan", "rank", p.top_signals).drop("_scan"), "candidates")
    item = F.struct(
        F.col(scan).cast("long").alias("at"), "place", F.col("seq").cast("long").alias("seq"), "symbol", "direction",
        F.coalesce(F.col(until).cast("long"), F.lit(NEVER)).alias("until"), trade_risk().alias("risk"),
        (~is_major(F.col("symbol"))).alias("alt"), (money * p.heat_pct / 100.0).alias("cap"),
    )
    slices = top.groupBy(*keys, F.floor(F.col(scan) / span).alias("_slice")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    in_order = Window.partitionBy(*keys).orderBy("_slice")
    following = slices.select(*keys, "_slice", F.col("_items")[0]["at"].alias("_at"))  # one narrow row per slice
    following = following.select(*keys, "_slice", F.lead("_slice").over(in_order).alias("_next"), F.lead("_at").over(in_order).alias("_next_at"))
    same_slice = _same([*keys, "_slice"])
    slices = stage(_matched(slices, following, [*keys, "_slice"], same_slice), "slices")

    def folded(started: DataFrame) -> DataFrame:
        return started.withColumn("_end", F.aggregate("_items", _start(F.col("_book")), lambda s, c: _decide(s, c, p, max_open)))

    def left_by(started: DataFrame) -> DataFrame:
        """Slices with the book they started from and the one that the next slice's first scan finds."""
        rest = F.filter(F.col("_end")["book"], lambda x: x["until"] > F.col("_next_at"))
        return folded(started).select(*keys, "_slice", "_next", "_book", rest.alias("_left"))

    books = stage(left_by(slices.withColumn("_book", F.array().cast(f"array<{POSITION}>"))), "books")
    while True:
        handed = books.where("_next is not null").select(*keys, F.col("_next").alias("_slice"), F.col("_left").alias("_found"))
        wrong = _matched(books.select(*keys, "_slice", "_book"), handed, [*keys, "_slice"], same_slice).where("_found != _book")
        wrong = stage(wrong.select(*keys, "_slice", F.col("_found").alias("_book")), "wrong")
        if wrong.isEmpty():
            break
        again = stage(left_by(_matched(slices, wrong, [*keys, "_slice"], same_slice)), "again")
        kept = books.alias("l").join(again.select(*keys, "_slice").alias("r"), same_slice, "left_anti")
        books = stage(kept.unionByName(again), "books")
    final = folded(_matched(slices.drop("_next", "_next_at"), books.select(*keys, "_slice", "_book"), [*keys, "_slice"], same_slice))
    verdicts = final.select(*keys, F.explode(F.col("_end")["out"]).alias("v")).select(
        *keys, F.col("v.at").alias(scan), F.col("v.place").alias("place"), F.col("v.why").alias("verdict")
    )
    names = [*keys, scan, "place"]
    return _matched(top, verdicts, names, _same(names)).withColumn("accepted", F.col("verdict") == "ok")


def _same(names: Sequence[str]) -> Column:
    """Null-safe equality of the named columns of ``l`` and ``r``: rows without an account are an account."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return cond


def _matched(left: DataFrame, right: DataFrame, names: Sequence[str], cond: Column) -> DataFrame:
    extra = [F.col(f"r.{c}") for c in right.columns if c not in names]
    return left.alias("l").join(right.alias("r"), cond).select("l.*", *extra)


def _start(book: Column) -> Column:
    return F.struct(book.alias("book"), F.array().cast("array<struct<at bigint, place int, why string>>").alias("out"))


def _decide(s: Column, c: Column, p: Portfolio, max_open: int) -> Column:
    """The book and verdicts after one more candidate; what closed until its scan leaves the book first."""

    def on(held: Column) -> Column:
        count = lambda cond: F.size(F.filter(held, cond))
        heat = F.aggregate(held, F.lit(0.0), lambda a, x: a + x["risk"])
        why = refusal(
            F.size(held), F.exists(held, lambda x: x["symbol"] == c["symbol"]), count(lambda x: x["direction"] == c["direction"]),
            c["alt"], count(lambda x: x["alt"]), heat + c["risk"], c["cap"], p, max_open,
        )
        position = F.struct(*[c[n].alias(n) for n in ("until", "symbol", "direction", "risk", "alt")])

        def settled(w: Column) -> Column:
            return F.struct(
                F.when(w == "ok", F.concat(held, F.array(position))).otherwise(held).alias("book"),
                F.concat(s["out"], F.array(F.struct(c["at"].alias("at"), c["place"].alias("place"), w.alias("why")))).alias("out"),
            )

        return _let(why, settled)

    return _let(F.filter(s["book"], lambda x: x["until"] > c["at"]), on)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]
