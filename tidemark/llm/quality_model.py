"""Document quality by a generalised additive model with pairwise interactions.

Text statistics are cut into quantile bins. Boosting goes round the statistics and gives
each a tree of at most three leaves on the current residuals, added to that statistic's lookup
table; then the statistic pairs with the strongest joint residuals get tables from trees of one
cut per side. A score is the sum of table entries at a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import ascii_words, lean, plain_array, strings, text_slices

STATISTICS = (
    "log_words", "word_length", "symbols", "exclaims", "capitals", "digits", "stops", "distinct", "repeated", "same_lines", "top_word", "line_words", "log_longest",
)

#: Labelled rows that a model is fitted on: those of the smallest hashes, at most so many.
FIT_ROWS = 20_000
BINS = 32
ROUNDS = 120
RATE = 0.15
PAIRS = 6
PAIR_ROUNDS = 40


def _count(distinct: list[str], letters: str) -> np.ndarray:
    table = str.maketrans("", "", letters)
    return np.array([len(w) - len(w.translate(table)) for w in distinct], np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of figures per whole text; null is empty, a text without words has zeros."""
    texts = pc.fill_null(texts, "")
    coded = ascii_words(texts)
    n, owner, words = coded.counts.astype(np.float64), coded.owner(), strings(coded.distinct)
    some = np.maximum(n, 1)
    length = np.array([len(w) for w in words], np.float64) if words else np.zeros(0)
    chars = np.maximum(coded.per_text(length), 1)
    upper = np.array([0 if w.islower() else sum(map(str.isupper, w)) for w in words], np.float64)
    digits = np.array([0 if w.isalpha() else sum(map(str.isdigit, w)) for w in words], np.float64)
    size, texts_n = max(1, len(words)), len(texts)

    seen, times = np.unique(owner * size + coded.codes, return_counts=True)
    kinds = np.bincount(seen // size, minlength=texts_n)
    top = np.zeros(texts_n)
    np.maximum.at(top, seen // size, times)

    covered = np.zeros(len(owner), bool)
    if len(owner) > 2:
        mix = np.uint64(0x9E3779B97F4A7C15)
        code = coded.codes.astype(np.uint64)
        with np.errstate(over="ignore"):
            key = ((code[:-2] * mix + code[1:-1]) * mix + code[2:]) * mix + owner[2:].astype(np.uint64)
        whole = owner[:-2] == owner[2:]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = (times[back] > 1) & whole
        for k in range(3):
            covered[k : len(owner) - 2 + k] |= twice
    repeated = np.bincount(owner, weights=covered, minlength=texts_n)

    lines = pc.split_pattern(texts, "\n")
    ends = lines.offsets.to_numpy().astype(np.int64)
    held = lines.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    per = np.diff(ends)
    line_owner, codes = np.repeat(np.arange(texts_n), per), held.indices.to_numpy()
    worded = (pc.binary_length(pc.utf8_trim_whitespace(held.dictionary)).to_numpy() > 0)[codes]
    line_owner, codes = line_owner[worded], codes[worded]
    n_lines = np.bincount(line_owner, minlength=texts_n)
    kinds_of_line = np.bincount(np.unique(line_owner * max(1, len(held.dictionary)) + codes) // max(1, len(held.dictionary)), minlength=texts_n)

    longest = np.zeros(texts_n)
    np.maximum.at(longest, owner, length[coded.codes] if words else np.zeros(0))
    figures = [
        np.log1p(n), coded.per_text(length) / some, coded.per_text(_count(words, "#*$%&|<>")) / some, coded.per_text(_count(words, "!")) / some,
        coded.per_text(upper) / chars, coded.per_text(digits) / chars, coded.per_text(_count(words, ".,;:?")) / some, kinds / some, repeated / some,
        (n_lines - kinds_of_line) / np.maximum(n_lines, 1), top / some, n / np.maximum(n_lines, 1), np.log1p(longest),
    ]
    return np.stack(figures, axis=1)


@dataclass
class AdditiveModel:
    """Lookup tables over quantile bins: one per statistic, and one per chosen pair."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, figures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, figures[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, figures: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        at = self.bins(figures)
        total = np.full(len(at), self.base)
        for k, table in enumerate(self.tables):
            total += table[at[:, k]]
        for i, j, table in self.pairs:
            total += table[at[:, i], at[:, j]]
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _step_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of the best tree of up to two cuts on binned gradients."""

    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
        gain = _gain(left_g, left_h) + _gain(g[a:b].sum() - left_g, h[a:b].sum() - left_h)
        k = int(gain.argmax())
        return float(gain[k] - _gain(g[a:b].sum(), h[a:b].sum())), a + k + 1

    _, first = cut(0, len(g))
    borders = [0, first, len(g)]
    (left, at_left), (right, at_right) = cut(0, first), cut(first, len(g))
    borders.insert(1, at_left) if left >= right else borders.insert(2, at_right)
    out = np.zeros(len(g))
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b > a:
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values per cell) of the best tree with one cut on each side of a bin grid."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts_g = [G[:-1, :-1], G[:-1, -1:] - G[:-1, :-1], G[-1:, :-1] - G[:-1, :-1]]
    parts_h = [H[:-1, :-1], H[:-1, -1:] - H[:-1, :-1], H[-1:, :-1] - H[:-1, :-1]]
    parts_g.append(G[-1, -1] - sum(parts_g))
    parts_h.append(H[-1, -1] - sum(parts_h))
    gain = sum(_gain(a, b) for a, b in zip(parts_g, parts_h, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [_leaf(a[i, j], b[i, j]) for a, b in zip(parts_g, parts_h, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(figures: np.ndarray, labels: np.ndarray, *, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> AdditiveModel:
    """Boost the tables on labelled rows. With one class or no rows, every text scores the smoothed share of label 1."""
    edges = [np.unique(np.quantile(figures[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(figures) else np.zeros(0) for k in range(figures.shape[1])]
    edges = [np.unique(np.append(e, np.nextafter(figures[:, k].min(), np.inf))) if len(figures) else e for k, e in enumerate(edges)]
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [])
    if len(np.unique(labels)) < 2:
        return model
    at = model.bins(figures)
    logit = np.full(len(labels), model.base)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p = _sigmoid(logit)
            g, h = (np.bincount(at[:, k], weights=w, minlength=len(table)) for w in (labels - p, p * (1 - p)))
            step = rate * _step_tree(g, h)
            table += step
            logit += step[at[:, k]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = _sigmoid(logit), (len(model.tables[i]), len(model.tables[j]))
        cell = at[:, i] * shape[1] + at[:, j]
        return tuple(np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (labels - p, p * (1 - p)))

    strength = sorted(((_quadrants(*grids(i, j))[0], i, j) for i, j in combinations(range(figures.shape[1]), 2)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in strength]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*grids(i, j))[1]
            table += step
            logit += step[at[:, i], at[:, j]]
    return model


def label_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, label): at most ``rows`` labelled ids, those of the smallest hashes. Null ids and labels are left out; of several labels the larger counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_on(docs: DataFrame, labels: DataFrame, *, column: str = "quality", rows: int = FIT_ROWS, **how) -> AdditiveModel:
    """Fit on the whole texts of at most ``rows`` labelled documents; their ids are few enough to broadcast."""
    sample = F.broadcast(label_sample(labels, column, rows).select(F.col("doc_id").alias("_id"), "label"))
    joined = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(sample, "_id")

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                figures = statistics(plain_array(batch.column(2).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(f) for f in figures.T]], names=["id", "label", *STATISTICS])

    found = joined.select("_id", "label", "text").mapInArrow(measure, "id long, label int, " + ", ".join(f"{s} double" for s in STATISTICS))
    table = found.dropDuplicates(["id"]).toArrow().sort_by("id")
    figures = np.stack([table.column(s).to_numpy() for s in STATISTICS], axis=1)
    return fit(figures, table.column("label").to_numpy().astype(np.float64), **how)


def with_score(docs: DataFrame, model: AdditiveModel, *, name: str = "score", keep_from: float | None = None) -> DataFrame:
    """All columns of ``docs`` and the quality score of the whole text as ``name``, or only documents of at least ``keep_from``, without it.

    Only the text is scored. Null and empty texts get the score of a text without words; repeated rows
    score alike; an empty table gives none. A column called ``name`` is replaced.
    """
    kept = docs if keep_from is not None else docs.drop(name)
    at = kept.columns.index("text")
    fields = list(kept.schema.fields) + ([] if keep_from is not None else [T.StructField(name, T.DoubleType())])

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(at)):
                own = batch.slice(a, b - a)
                score = model.score(statistics(plain_array(own.column(at))))
                if keep_from is not None:
                    yield own.filter(pa.array(score >= keep_from))
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score)], names=[*own.schema.names, name])

    return kept.mapInArrow(add, T.StructType(fields))
