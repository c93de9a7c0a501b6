"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Two models, one of toxic and one of ordinary text, give each letter of a word a probability after the
four before it. The classes share their backoff: the continuation counts (in how many different
contexts a shorter letter run occurs), taken over all documents. A word's evidence is the difference of
its two log-likelihoods; a document's is that evidence over passages, normalised by their length, and a logistic
curve fitted on labelled documents outside the counts turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import Coded, ascii_words, lean, plain_array, strings, text_slices
from tidemark.session import stage

ORDER = 5
DISCOUNT = 0.75
#: Labelled documents of either class that the models are fitted on, at most.
CLASS_ROWS = 20_000
#: Bytes of text whose distinct words are spelled out at a time.
SLICE = 3 << 20
EDGES = ".,;:!?\"'()[]{}<>«»“”„’‘…-–—*#&%$|_~`^+=/\\@"
_START, _END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _runs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, hashes by run length, length of the longest run, word) for all letters of all words.

    ``hashes[k][i]`` is of the k letters that end at i. A run does not cross the start of its word.
    """
    text = "".join(f"{_START}{w.lower().strip(EDGES)}{_END}" for w in words)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = letters == 2
    word = np.cumsum(starts) - 1
    place = np.arange(len(letters)) - np.flatnonzero(starts)[word] if len(letters) else np.zeros(0, np.int64)
    return letters, _hashes(letters), np.minimum(ORDER, place + 1), word


def _hashes(letters: np.ndarray) -> np.ndarray:
    """Row k: hash of the k letters that end at each place."""
    table = np.zeros((ORDER + 1, len(letters)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            table[k] = table[k - 1] * _MIX + np.uint64(1)
            table[k, k - 1 :] += letters[: max(0, len(letters) - k + 1)]
            table[k] = _mixed(table[k])
    return table


def _chain(table: np.ndarray, longest: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, context) hashes at every letter after ``drop`` letters are taken off the front of the longest run."""
    size = np.maximum(1, longest - drop)
    at = np.arange(len(longest))
    previous = np.maximum(at - 1, 0)
    return table[size, at], np.where(size > 1, table[size - 1, previous], np.uint64(0))


KINDS = ("toxic", "ordinary", "curve_toxic", "curve_ordinary", "other")
#: Hashes of a longest run with 0 to ORDER - 1 letters off its front, and of their contexts.
LEVELS = [f"run{d}" for d in range(ORDER)] + [f"context{d}" for d in range(ORDER)]


def run_counts(words: list[str], weights: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct longest letter runs of the words and their counts, ``weights`` being words x classes."""
    letters, hashes, longest, word = _runs(words)
    body = np.flatnonzero(longest > 1)
    run = _chain(hashes, longest, 0)[0][body]
    values, first, back = np.unique(run, return_index=True, return_inverse=True)
    sums = [np.bincount(back, weights=weights[word[body], k], minlength=len(values)).astype(np.int64) for k in range(weights.shape[1])]
    at = body[first]
    grid = np.zeros((len(at), ORDER), "<u4")
    for k in range(ORDER):
        own = k < longest[at]
        grid[own, k] = letters[at[own] - longest[at[own]] + 1 + k]
    levels = [_chain(hashes, longest, d) for d in range(ORDER)]
    levels = np.stack([levels[d][k][at] for k in range(2) for d in range(ORDER)], axis=1)
    return {"key": values, "levels": levels, "run": grid.reshape(-1).view(f"<U{ORDER}") if len(at) else np.zeros(0, f"<U{ORDER}"), "counts": np.stack(sums, axis=1)}


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float | np.ndarray) -> np.ndarray:
    """The values of ``wanted`` among the sorted keys, ``other`` where there is none."""
    if not len(keys):
        return np.broadcast_to(other, wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


@dataclass
class KneserNeyPair:
    """Log ratio of the class models by letter run, and by context for runs that neither class has; keys are sorted 64-bit hashes."""

    runs: np.ndarray
    by_run: np.ndarray
    contexts: np.ndarray
    by_context: np.ndarray

    def evidence(self, words: list[str]) -> np.ndarray:
        """Sum of log(toxic / ordinary) over the letters of each word."""
        _, hashes, longest, word = _runs(words)
        body = np.flatnonzero(longest > 1)
        run, context = _chain(hashes, longest, 0)
        first, back = np.unique(run[body], return_index=True, return_inverse=True)[1:]
        run, context = run[body][first], context[body][first]
        value = _found(self.runs, self.by_run, run, _found(self.contexts, self.by_context, context, 0.0))
        return np.bincount(word[body], weights=value[back], minlength=len(words))


def class_models(run: np.ndarray, context: np.ndarray, counts: np.ndarray, shared: np.ndarray, discount: float = DISCOUNT) -> KneserNeyPair:
    """Models from the (toxic, ordinary) counts of distinct runs, their contexts and shared probabilities. Runs of neither class change nothing."""
    seen = np.flatnonzero(counts.sum(axis=1) > 0)
    seen = seen[np.argsort(run[seen])]
    run, context, counts, shared = run[seen], context[seen], counts[seen], shared[seen]
    places, where = np.unique(context, return_inverse=True)
    logs, rests = [], []
    for k in range(2):
        n = counts[:, k].astype(float)
        total = np.bincount(where, weights=n, minlength=len(places))
        followers = np.bincount(where, weights=n > 0, minlength=len(places))
        rest = np.where(total > 0, discount * followers / np.maximum(total, 1), 1.0)
        p = np.where(total[where] > 0, np.maximum(n - discount, 0) / np.maximum(total[where], 1), 0) + rest[where] * shared
        logs.append(np.log(p))
        rests.append(np.log(rest))
    return KneserNeyPair(run, logs[0] - logs[1], places, rests[0] - rests[1])


def fit_models(runs: list[str], counts: np.ndarray, discount: float = DISCOUNT) -> KneserNeyPair:
    """Models from distinct longest runs and their (toxic, ordinary) counts; runs of other texts have 0 and 0. The same as with ``shared_model``, in memory."""
    if not len(runs):
        return KneserNeyPair(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))
    # Each run stands as a word of its own; its last letter is the one that matters.
    text = "".join(runs)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    last = np.cumsum(sizes) - 1
    table = _hashes(letters)

    def level(drop: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.maximum(1, sizes - drop)
        return table[size, last], np.where(size > 1, table[size - 1, last - 1], np.uint64(0))

    # Shared part, from single letters up: P(run) = (N - D)+ / N(context) + D T(context) / N(context) P(shorter run),
    # N counting the distinct runs one letter longer.
    shorter: dict | None = None
    lower = None
    for drop in range(ORDER - 1, 0, -1):
        run, context = level(drop)
        longer = level(drop - 1)[0]
        kinds, at = np.unique(longer, return_index=True)
        names, first, back = np.unique(run[at], return_index=True, return_inverse=True)
        n = np.bincount(back).astype(float)
        own_context = context[at][first]
        _, place = np.unique(own_context, return_inverse=True)
        total, followers = np.bincount(place, weights=n)[place], np.bincount(place)[place]
        if lower is None:
            base = np.full(len(names), 1 / (len(names) + 1))
        else:
            short = level(drop + 1)[0][at][first]
            base = lower[1][np.searchsorted(lower[0], short)]
        lower = (names, np.maximum(n - discount, 0) / total + discount * followers / total * base)
    run, context = level(0)
    shared = lower[1][np.searchsorted(lower[0], level(1)[0])]
    return class_models(run, context, counts, shared, discount)


def shared_model(runs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(run, shared): continuation probability of what remains of each longest run without its first letter.

    ``runs`` holds LEVELS, a row per distinct longest run of all documents, and is a stored table. From single letters up:
    P(run) = (N - D)+ / N(context) + D T(context) / N(context) P(shorter run), N counting the distinct runs one letter longer.
    """
    lower = None
    for drop in range(ORDER - 1, 0, -1):
        short = F.col(f"run{drop + 1}") if lower is not None else F.lit(0).cast("long")
        kinds = runs.groupBy(F.col(f"run{drop - 1}").alias("longer")).agg(F.first(f"run{drop}").alias("run"), F.first(f"context{drop}").alias("context"), F.first(short).alias("short"))
        names = kinds.groupBy("run").agg(F.count("*").alias("n"), F.first("context").alias("context"), F.first("short").alias("short"))
        names = stage(names, "runs")
        sums = names.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("followers"))
        own = names.join(sums, "context")
        if lower is None:
            own = own.withColumn("base", F.lit(1 / (names.count() + 1)))
        else:
            own = own.join(lower.select(F.col("run").alias("short"), F.col("p").alias("base")), "short")
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("followers") / F.col("total") * F.col("base")
        lower = own.select("run", p.alias("p"))
    return runs.select(F.col("run0").alias("run"), F.col("run1").alias("_rest")).join(lower.select(F.col("run").alias("_rest"), F.col("p").alias("shared")), "_rest").drop("_rest")


FIGURES = ("mean", "first", "second", "third", "passage")
#: Words of a passage.
PASSAGE = 3


def document_figures(coded: Coded, evidence: np.ndarray) -> np.ndarray:
    """Length-normalised evidence per text: over the whole text, its three strongest words and its strongest passage."""
    n, owner = coded.counts, coded.owner()
    value = evidence[coded.codes] if len(coded.codes) else np.zeros(0)
    some = np.maximum(n, 1)
    out = np.zeros((len(n), len(FIGURES)))
    out[:, 0] = np.bincount(owner, weights=value, minlength=len(n)) / some
    if len(value):
        order = np.lexsort((-value, owner))
        rank = np.arange(len(value)) - coded.starts[:-1][owner]
        for k in range(3):
            hit = order[rank == k]
            out[owner[hit], 1 + k] = value[hit]
        total = np.concatenate([[0], np.cumsum(value)])
        stop = np.minimum(np.arange(len(value)) + PASSAGE, coded.starts[1:][owner])
        best = np.full(len(n), -np.inf)
        np.maximum.at(best, owner, (total[stop] - total[: len(value)]) / PASSAGE)
        out[:, 4] = np.where(n > 0, best, 0)
    return out


@dataclass
class ToxicityModel:
    """The pair of letter models and the logistic curve over a document's figures."""

    pair: KneserNeyPair | None
    weights: np.ndarray
    base: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of toxicity per whole text."""
        if self.pair is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.base)))
        coded = ascii_words(texts)
        figures = document_figures(coded, self.pair.evidence(strings(coded.distinct)))
        return 1 / (1 + np.exp(-np.clip(figures @ self.weights + self.base, -30, 30)))


def fit_curve(figures: np.ndarray, labels: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on standardised figures, by Newton steps; weights for the raw figures."""
    mean, spread = figures.mean(axis=0), figures.std(axis=0) + 1e-9
    x = np.column_stack([(figures - mean) / spread, np.ones(len(figures))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * figures.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): a row per labelled document, of several labels the larger."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def label_sample(labels: DataFrame, column: str, class_rows: int) -> DataFrame:
    """(doc_id, label, part): at most ``class_rows`` ids of either label, those of the smallest hashes; every fourth is for the curve."""
    known = known_labels(labels, column)
    order = [F.xxhash64("doc_id", F.lit(5)), "doc_id"]
    some = known.where("label = 1").orderBy(*order).limit(class_rows).unionAll(known.where("label = 0").orderBy(*order).limit(class_rows))
    return some.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0, "curve").otherwise("counts"))


def count_runs(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """LEVELS and counts of every distinct longest letter run (by its 64-bit hash) over all documents, by class and part of the sample; documents outside it are ``other``.

    ``sample`` (doc_id, label, part) is bounded and broadcast. A task sends a row per distinct run it met.
    """
    kind = F.when(F.col("label") == 1, 0).otherwise(1) + F.when(F.col("part") == "curve", 2).otherwise(0)
    known = F.broadcast(sample.select(F.col("doc_id").alias("_id"), kind.alias("kind")))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(known, "_id", "left").select("text", "kind")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels, counts, held = [], [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            every, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            table = np.concatenate(counts)
            return every, np.concatenate(levels)[first], np.stack([np.bincount(back, weights=table[:, k]) for k in range(len(KINDS))], axis=1).astype(np.int64)

        for batch in batches:
            for a, b in text_slices(batch.column(0), SLICE):
                coded = ascii_words(plain_array(batch.column(0).slice(a, b - a)))
                words = strings(coded.distinct)
                own = pc.fill_null(batch.column(1).slice(a, b - a), len(KINDS) - 1).to_numpy(zero_copy_only=False)[coded.owner()]
                weights = np.stack([np.bincount(coded.codes[own == k], minlength=len(words)) for k in range(len(KINDS))], axis=1)
                found = run_counts(words, weights)
                keys.append(found["key"])
                levels.append(found["levels"])
                counts.append(found["counts"])
                held += len(found["key"])
                if held > 2 * len(keys[0]) + 100_000:
                    one = merged()
                    keys, levels, counts, held = [one[0]], [one[1]], [one[2]], len(one[0])
        if keys:
            _, hashes, table = merged()
            yield pa.RecordBatch.from_arrays([*[pa.array(h.view(np.int64)) for h in np.ascontiguousarray(hashes.T)], *[pa.array(c) for c in table.T]], names=[*LEVELS, *KINDS])

    found = rows.mapInArrow(count, ", ".join(f"{c} long" for c in [*LEVELS, *KINDS]))
    return found.groupBy("run0").agg(*[F.first(c).alias(c) for c in LEVELS[1:]], *[F.sum(c).alias(c) for c in KINDS])


def fit_on(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", class_rows: int = CLASS_ROWS) -> ToxicityModel:
    """Fit on at most ``class_rows`` labelled documents of either class; backoff counts are over all documents.

    The curve is fitted on a fourth of them with models of the rest, then the models count all of them. Its base is
    corrected for the rates at which the classes were drawn, so scores refer to the shares of all labelled documents.

    Null labels and ids are left out; of several labels of a document the larger counts. Without
    documents of both classes every text scores the smoothed share of label 1.
    """
    sample = label_sample(labels, column, class_rows).toArrow()  # bounded by 2 x class_rows
    label = sample.column("label").to_numpy()
    held = dict(known_labels(labels, column).groupBy("label").count().collect())
    toxic, ordinary = held.get(1, 0), held.get(0, 0)
    sure = float(np.log((toxic + 1) / (ordinary + 1))) if len(label) else -1e-9
    drawn = float(np.log(min(1.0, class_rows / max(1, ordinary)) / min(1.0, class_rows / max(1, toxic))))
    if len(np.unique(label)) < 2:
        return ToxicityModel(None, np.zeros(len(FIGURES)), sure)
    known = docs.sparkSession.createDataFrame(sample)
    every = stage(count_runs(docs, known), "letter_runs")
    # Runs of the labelled sample, which bounds them; the others only shape the shared probabilities.
    labelled = every.where(" + ".join(KINDS[:4]) + " > 0").select(F.col("run0").alias("run"), F.col("context0").alias("context"), *KINDS[:4])
    runs = labelled.join(shared_model(every), "run").toArrow()
    run, context = (runs.column(c).to_numpy().view(np.uint64) for c in ("run", "context"))
    counts, backoff = np.stack([runs.column(c).to_numpy() for c in KINDS[:4]], axis=1), runs.column("shared").to_numpy()
    pair = class_models(run, context, counts[:, :2], backoff)
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    fresh = F.broadcast(known.where("part = 'curve'").select(F.col("doc_id").alias("_id"), "label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(fresh, "_id").select("_id", "label", "text")

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2), SLICE):
                coded = ascii_words(plain_array(batch.column(2).slice(a, b - a)))
                figures = document_figures(coded, shared.value.evidence(strings(coded.distinct)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(f) for f in figures.T]], names=["id", "label", *FIGURES])

    measured = rows.mapInArrow(measure, "id long, label int, " + ", ".join(f"{f} double" for f in FIGURES)).dropDuplicates(["id"]).toArrow().sort_by("id")
    label = measured.column("label").to_numpy().astype(np.float64)
    if len(np.unique(label)) < 2:
        return ToxicityModel(None, np.zeros(len(FIGURES)), sure)
    pair = class_models(run, context, counts[:, :2] + counts[:, 2:4], backoff)
    weights, base = fit_curve(np.stack([measured.column(f).to_numpy() for f in FIGURES], axis=1), label)
    return ToxicityModel(pair, weights, base + drawn)


def with_score(docs: DataFrame, model: ToxicityModel, *, name: str = "score", keep_below: float | None = None) -> DataFrame:
    """All columns of ``docs`` and the toxicity of the whole text as ``name``, or only documents below ``keep_below``, without it.

    Only the text is scored. Null and empty texts have no evidence and score what the curve gives to none; an
    empty table gives none. A column called ``name`` is replaced.
    """
    kept = docs if keep_below is not None else docs.drop(name)
    at = kept.columns.index("text")
    fields = list(kept.schema.fields) + ([] if keep_below is not None else [T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(at), SLICE):
                own = batch.slice(a, b - a)
                score = shared.value.score(plain_array(own.column(at)))
                if keep_below is not None:
                    yield own.filter(pa.array(score < keep_below))
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score)], names=[*own.schema.names, name])

    return kept.mapInArrow(add, T.StructType(fields))
