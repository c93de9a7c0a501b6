"""Quality rules as a learned decision list, in DataFrame operations alone.

Statistics of every text are counted by built-in functions. From labelled statistics a list of
threshold conjunctions is learned by sequential covering: a rule grows by the condition with the
largest information gain on growing rows, is pruned on other rows, and the rows it covers leave before
the next one. The list comes out as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bins per figure; every border is a possible threshold.
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Labelled rows the rules are learned from: those of the smallest hashes, at most so many.
FIT_ROWS = 50_000


def counted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the base statistics of every whole text, as longs, with the counts the rules look at besides.

    Words are ``[^\\x20\\x09-\\x0D]+``. n_dup_lines counts ``\\n``-split lines with a word that equal
    an earlier line; n_repeat_words the words inside any 3-word window that occurs twice or more. A null
    text has no words and no lines; extra columns are not read; repeated rows count each for themselves.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""))
    rows = rows.withColumn("_n", F.size("_words"))
    last = F.greatest(F.col("_n") - 3, F.lit(-1))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    rows = rows.withColumn(
        "_windows",
        F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.concat_ws(" ", F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1)))).otherwise(F.array().cast("array<string>")),
    )
    # Windows next to their place, sorted: equal windows stand side by side.
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(repeated, placed))
    size = F.size("_sorted")
    twice = F.filter(
        F.transform("_sorted", lambda s, i: F.when((s["w"] == F.get("_sorted", i - 1)["w"]) | ((i + 1 < size) & (s["w"] == F.get("_sorted", i + 1)["w"])), s["i"])),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("_twice", F.when(F.col("_sorted").isNotNull(), F.array_sort(twice)))
    # Each such window adds the words up to the next one's first, three at most.
    own = F.transform("_twice", lambda p, k: F.least(F.coalesce(F.get("_twice", k + 1) - p, F.lit(3)), F.lit(3)))
    covered = F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0))
    bare = lambda letters: F.length(F.translate("_text", letters, ""))
    figures = {
        "n_words": F.col("_n"), "word_chars": bare(" \t\n\x0b\f\r"), "n_symbols": F.length("_text") - bare(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": covered,
        "n_lines": F.size("_lines"), "n_exclaims": F.length("_text") - bare("!"),
        "n_capitals": F.length("_text") - bare("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": F.length("_text") - bare("0123456789"),
        "n_kinds": F.size(F.array_distinct("_words")),
    }
    return rows.select(*keep, *[c.cast("long").alias(n) for n, c in figures.items()])


def figures() -> dict[str, Column]:
    """What the rules compare with thresholds: shares and means of the counts, 0 where there is no word."""
    share = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "same_lines": share("n_dup_lines", "n_lines"), "repeated": share("n_repeat_words", "n_words"), "exclaims": share("n_exclaims", "n_words"),
        "capitals": share("n_capitals", "word_chars"), "digits": share("n_digits", "word_chars"), "distinct": share("n_kinds", "n_words"), "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    figure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.figure)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.figure} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejecting_rule(self) -> Column:
        """Number of the first rule that a row of figures meets, from 0; null if it is kept."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            out = F.when(_all(rule), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of narrowing (p0, n0) rejected and kept rows to (p, n)."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, *, bins: int = BINS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> DecisionList:
    """Learn a list from (doc_id, label, figures), label 0 being what to reject.

    ``labelled`` is read once per condition and should be a stored table; what reaches the driver is a
    histogram of figures x bins. Two thirds of the rows grow rules, the rest prune them; a rule enters
    the list if at least nine in ten of the pruning rows it covers are rejected ones.
    """
    names = list(figures())
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    spread = lambda n, of: F.percentile_approx(F.when(of, F.col(n)), shares, F.lit(10_000))
    cut = labelled.agg(*[c for n in names for c in (spread(n, F.lit(True)).alias(n), spread(n, F.col("label") == 0).alias(f"{n}_bad"), F.min(n).alias(f"{n}_min"))]).first()
    if cut[names[0]] is None:
        return DecisionList(())
    borders = {}
    for n in names:
        low, values = cut[f"{n}_min"], {*cut[n], *(cut[f"{n}_bad"] or [])}
        higher = sorted(x for x in values if x > low)
        # Halfway to the first higher value tells "none" from "some" where most rows have none.
        borders[n] = sorted({*higher, *[(low + x) / 2 for x in higher[:1]]})
    place = lambda n: sum(((F.col(n) >= b).cast("int") for b in borders[n]), F.lit(0))
    table = labelled.withColumn("_grow", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0)
    bins_of = F.array(*[F.struct(F.lit(n).alias("figure"), place(n).alias("bin")) for n in names])
    table = stage(table.withColumn("_bins", bins_of), "rules")
    left, rules = F.lit(True), []
    for _ in range(max_rules):
        rule: tuple[Condition, ...] = ()
        while len(rule) < max_conditions:
            held = table.where(F.col("_grow") & left & _all(rule)).select("label", F.inline("_bins"))
            counts = held.groupBy("figure", "bin").agg(F.sum((F.col("label") == 0).cast("long")).alias("p"), F.sum((F.col("label") == 1).cast("long")).alias("n")).collect()
            best = _best_condition(counts, borders)
            if best is None:
                break
            rule = (*rule, best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        tests = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
        shown = table.where(~F.col("_grow") & left).agg(*[F.sum((t & (F.col("label") == v)).cast("long")).alias(f"c{k}_{v}") for k, t in enumerate(tests) for v in (0, 1)]).first()
        worth = [((shown[f"c{k}_0"] or 0) - (shown[f"c{k}_1"] or 0), k, shown[f"c{k}_0"] or 0, shown[f"c{k}_1"] or 0) for k in range(len(tests))]
        worth = [(w / max(1, p + n), -k, k, p, n) for w, k, p, n in worth]
        _, _, k, p, n = max(worth)
        rule = rule[: k + 1]
        if p == 0 or p < 9 * n:
            break
        rules.append(rule)
        left = left & ~_all(rule)
    return DecisionList(tuple(rules))


def _best_condition(counts: list, borders: dict[str, list[float]]) -> tuple[float, Condition, float] | None:
    per: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        per.setdefault(r["figure"], {})[r["bin"]] = (r["p"], r["n"])
    best = None
    for figure in sorted(per):
        held = per[figure]
        p0, n0 = (sum(v[k] for v in held.values()) for k in (0, 1))
        if not p0 or not n0:
            return None
        below_p = below_n = 0
        for k, border in enumerate(borders[figure]):
            below_p, below_n = below_p + held.get(k, (0, 0))[0], below_n + held.get(k, (0, 0))[1]
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                if p + n < p0 + n0 and (gain := _gain(p, n, p0, n0)) > (best[0] if best else 1e-9):
                    best = (gain, Condition(figure, above, border), n)
    return best


def learn_from(stats: DataFrame, labels: DataFrame, *, column: str = "quality", rows: int = FIT_ROWS, **how: int) -> DecisionList:
    """Learn from the stored statistics of at most ``rows`` labelled documents; their ids are broadcast.

    Null ids and labels are left out; of several labels the larger counts, of rows that share an id one is used.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    table = stats.join(known, "doc_id").dropDuplicates(["doc_id"])
    return learn(table.select("doc_id", "label", *[c.alias(n) for n, c in figures().items()]), **how)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, rule (the first that rejects, null if none) and kept."""
    names = figures()
    out = stats.select("*", *[c.alias(f"_f_{n}") for n, c in names.items()])
    prefixed = DecisionList(tuple(tuple(Condition(f"_f_{c.figure}", c.above, c.threshold) for c in r) for r in rules.rules))
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", prefixed.rejecting_rule())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*[f"_f_{n}" for n in names])
