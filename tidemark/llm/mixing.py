"""Mixing to target weights: iterative proportional fitting over source, language and topic.

The token weights of the cells (source, language, topic) are raked, one margin after the other, until
every margin has its target share. A cell's factor is its raked weight over its natural one; documents are
drawn with probabilities in proportion to it, so the expected tokens of the sample meet all three
margins at once. The proportion is the largest at which at most ``SHORT`` of the raked weight lies in
cells that would need more than all their documents; those cells are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import ascii_words, encoder, plain_array, text_slices
from tidemark.session import stage

MARGINS = ("source", "lang", "topic")
TOPICS = 8
#: Passes over all distinct texts that draw starting rows, each so many times the topics, and rounds that move the centres.
SEEDINGS, DRAWN, ROUNDS = 3, 2, 4
#: Rounds end when no centre turns by more than this (1 - cosine).
STILL = 1e-4
WIDTH = 256
MISSING = "\0missing"
SEED = 17
SHORT = 0.02
#: Where margins contradict each other, no cell is raised beyond this multiple, or lowered below its inverse, of what the ratios of its own
#: categories ask for. Margins given by an exponent give way then (a topic of one language alone), share tables do not.
BOUND = 3.0
#: Largest difference of a reached from a wanted share at which margins count as met together.
MET = 1e-4


def profiles(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A unit row per text, ``codes[starts[i]:starts[i + 1]]``, of its codes' square-rooted counts, codes hashed to WIDTH places; zeros without codes."""
    n = len(starts) - 1
    place = (codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    at = np.repeat(np.arange(n) * WIDTH, np.diff(starts)) + place
    counts = np.sqrt(np.bincount(at, minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32))
    return _unit(counts)


def _packed(rows: np.ndarray) -> np.ndarray:
    """Profiles as bytes."""
    return np.rint(255 * rows).astype(np.uint8)


def _unpacked(column: pa.Array) -> np.ndarray:
    """A unit row per packed profile; zeros for a text without words."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    rows = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].reshape(-1, WIDTH).astype(np.float32)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-6)[:, None]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-12)[:, None]


def reduced(rows: np.ndarray, weights: np.ndarray, topics: int, tries: int = 16) -> np.ndarray:
    """At most ``topics`` centres of some weighted unit rows: the best of some tries of spherical k-means from starts far apart."""
    rng, best = np.random.default_rng(SEED), (np.inf, rows[:1])
    for _ in range(tries):
        centres = rows[[int(rng.choice(len(rows), p=weights / weights.sum()))]]
        while len(centres) < min(topics, len(rows)):
            far = np.maximum(1 - (rows @ centres.T).max(axis=1), 0) * weights
            if far.sum() <= 1e-9 * weights.sum():
                break
            centres = np.vstack([centres, rows[rng.choice(len(rows), p=far / far.sum())]])
        for _ in range(10):
            at = (rows @ centres.T).argmax(axis=1)
            sums = np.stack([(rows * weights[:, None])[at == k].sum(axis=0) for k in range(len(centres))])
            centres = np.where((sums != 0).any(axis=1)[:, None], _unit(sums), centres)
        loss = float(((1 - (rows @ centres.T).max(axis=1)) * weights).sum())
        best = min(best, (loss, centres), key=lambda b: b[0])
    return best[1]


def _sums(texts: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the profiles nearest to each centre, their number), added up by Spark: WIDTH + 1 numbers a centre reach the driver."""
    centres, k = centres.astype(np.float32), len(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, WIDTH + 1))
        for batch in batches:
            rows = _unpacked(batch.column(0))
            near = np.zeros((len(rows), k), np.float32)
            near[np.arange(len(rows)), (rows @ centres.T).argmax(axis=1)] = rows.any(axis=1)
            total += np.column_stack([near.T @ rows, near.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(k * (WIDTH + 1))
    for at, value in texts.select("profile").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    out = out.reshape(k, WIDTH + 1)
    return out[:, :WIDTH], out[:, WIDTH]


def _far_rows(texts: DataFrame, centres: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """So many profiles, drawn from all texts in proportion to their distance from the centres (all alike if there are none)."""
    centres = centres.astype(np.float32)

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _unpacked(batch.column(0))
            far = np.maximum(1 - (own @ centres.T).max(axis=1), 0) if len(centres) else np.ones(len(own))
            far = np.where(own.any(axis=1), far, 0)
            with np.errstate(divide="ignore"):
                lot = -np.log(batch.column(1).to_numpy()) / far  # exponential race: the smallest lots are a draw in proportion
            held = np.flatnonzero(np.isfinite(lot))
            held = held[np.argsort(lot[held], kind="stable")[:rows]]
            yield pa.RecordBatch.from_arrays([pa.array(lot[held]), batch.column(0).take(pa.array(held))], names=["lot", "profile"])

    chance = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) + 1) / float(1 << 53)
    found = texts.select("profile", chance.alias("u")).mapInArrow(race, "lot double, profile binary")
    table = found.orderBy("lot", "profile").limit(rows).toArrow()
    return _unpacked(plain_array(table.column("profile"))) if table.num_rows else np.zeros((0, WIDTH), np.float32)


def topic_centres(texts: DataFrame, topics: int = TOPICS) -> np.ndarray:
    """Centres of spherical k-means over all distinct texts, (key, profile) as a stored table, one vote each.

    Starting rows are drawn from all texts in a few passes, far ones more likely, weighed by the texts nearest to
    them and reduced to ``topics``; every round then moves the centres to the mean of all texts nearest to them.
    """
    drawn = np.zeros((0, WIDTH), np.float32)
    for k in range(SEEDINGS):
        drawn = np.vstack([drawn, _far_rows(texts, drawn, DRAWN * topics if k else 1, k)])
    if not len(drawn):
        return np.zeros((1, WIDTH))
    centres = reduced(drawn.astype(np.float64), np.maximum(_sums(texts, drawn)[1], 1e-3), topics)
    for _ in range(ROUNDS):
        sums, held = _sums(texts, centres)
        moved = np.where(held[:, None] > 0, _unit(sums), centres)
        turned = 1 - (moved * centres).sum(axis=1)
        centres = moved
        if turned.max() < STILL:
            break
    return centres


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, codes) of the texts' words, a code being a checksum of the lower-cased word without closing marks."""
    coded = ascii_words(texts)
    plain = pc.utf8_trim(pc.utf8_lower(coded.distinct), ".,;:!?").cast(pa.binary()).to_pylist()
    return coded.starts, np.fromiter(map(zlib.crc32, plain), np.int64, len(plain))[coded.codes]


def measured(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    """All columns of ``docs`` with _mix_tokens (encoded length, or words without a vocabulary), _mix_profile, _mix_key (a hash of the text) and _mix_draw."""
    rows = docs.withColumn("_mix_draw", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 11) / float(1 << 53)).withColumn("_mix_key", F.xxhash64("text"))
    at = rows.columns.index("text")
    schema = T.StructType([*rows.schema.fields, T.StructField("_mix_tokens", T.LongType()), T.StructField("_mix_profile", T.BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(at)):
                own = batch.slice(a, b - a)
                texts = pc.fill_null(plain_array(own.column(at)), "")
                starts, codes = encoder(vocabulary).encode(texts) if vocabulary else _word_codes(texts)
                tokens = np.diff(starts)
                packed = [row.tobytes() for row in _packed(profiles(starts, codes))]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(tokens.astype(np.int64)), pa.array(packed, pa.binary())], names=[*own.schema.names, "_mix_tokens", "_mix_profile"])

    return rows.mapInArrow(add, schema)


def nearest_topic(profile: Column, centres: np.ndarray) -> Column:
    """The centre nearest to each packed profile; only the profiles go to Python."""
    centres = centres.astype(np.float32)

    @F.pandas_udf(T.IntegerType())
    def near(packed: pd.Series) -> pd.Series:
        return pd.Series((_unpacked(pa.array(packed, pa.binary())) @ centres.T).argmax(axis=1).astype(np.int32))

    return near(profile)


def shares_of(at: Sequence[np.ndarray], weights: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Sums of the cells' weights per category of each margin."""
    return [np.bincount(i, weights=weights, minlength=n).astype(float) for i, n in zip(at, sizes, strict=True)]


def wanted_shares(at: Sequence[np.ndarray], weights: np.ndarray, targets: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The targets of categories that have weight, scaled to 1 a margin."""
    asked = [np.where(held > 0, t, 0) for held, t in zip(shares_of(at, weights, [len(t) for t in targets]), targets, strict=True)]
    return [a / max(1e-300, float(a.sum())) for a in asked]


def rake_cells(at: Sequence[np.ndarray], weights: np.ndarray, targets: Sequence[np.ndarray], *, bound: float = np.inf, around: np.ndarray | None = None, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Iterative proportional fitting of the cells that have weight, ``at`` being their categories, to one share vector per margin.

    Targets of categories without weight are left out and the others scaled to 1. After each round
    cells of wanted categories stand within ``bound`` times and 1/``bound`` of ``around``, by default their share of ``weights``.
    """
    natural = weights / max(weights.sum(), 1e-300)
    out, wanted = natural, wanted_shares(at, natural, targets)
    around = natural if around is None else around
    low, last = around / bound, np.zeros_like(out)
    for i, want in zip(at, wanted, strict=True):
        low = low * (want > 0)[i]
    for _ in range(rounds):
        worst = 0.0
        for i, want in zip(at, wanted, strict=True):
            now = np.bincount(i, weights=out, minlength=len(want)).astype(float)
            worst = max(worst, float(np.abs(now - want).max(initial=0.0)))
            out = out * np.divide(want, now, out=np.zeros_like(now), where=now > 0)[i]
        if worst < tolerance:
            break
        if np.isfinite(bound):
            trimmed = np.clip(out, low, bound * around)
            trimmed = trimmed / max(trimmed.sum(), 1e-300)
            settled = np.abs(trimmed - last).max(initial=0.0) < tolerance
            out = last = trimmed
            if settled:
                break
    return np.clip(out, low, bound * around) if np.isfinite(bound) else out


def residual(at: Sequence[np.ndarray], raked: np.ndarray, wanted: Sequence[np.ndarray]) -> float:
    """Largest difference of a reached from a wanted share."""
    reached = shares_of(at, raked / max(raked.sum(), 1e-300), [len(w) for w in wanted])
    return max(float(np.abs(r - w).max(initial=0.0)) for r, w in zip(reached, wanted, strict=True))


def rake_or_relax(at: Sequence[np.ndarray], weights: np.ndarray, targets: Sequence[np.ndarray], soft: Sequence[bool], short: float = SHORT) -> np.ndarray:
    """Unbounded raking where it meets all margins, else with the ``soft`` margins relaxed and the others raked to the end.

    Without soft margins it is unbounded raking whatever that reaches. Soft margins also give way where meeting them
    would blow up a few odd cells: cells of at most ``short`` of the raked weight aside, one stands beyond BOUND times
    what the ratios of its categories ask for.
    """
    natural = weights / max(weights.sum(), 1e-300)
    plain, wanted = rake_cells(at, natural, targets), wanted_shares(at, natural, targets)
    if not any(soft) or not len(natural):
        return plain
    around = natural
    for i, want, own in zip(at, wanted, shares_of(at, natural, [len(t) for t in targets]), strict=True):
        around = around * np.divide(want, own, out=np.zeros_like(own), where=own > 0)[i]
    odd = float(plain[plain > BOUND * around].sum())
    if residual(at, plain, wanted) <= MET and odd <= short:
        return plain
    out = rake_cells(at, natural, targets, bound=BOUND, around=around)
    firm = [k for k in range(len(at)) if not soft[k]]
    return rake_cells([at[k] for k in firm], out, [targets[k] for k in firm]) if firm else out / max(out.sum(), 1e-300)


def chances(factor: np.ndarray, raked: np.ndarray, short: float = SHORT) -> np.ndarray:
    """Draw probabilities in proportion to ``factor``, 1 in the cells of the largest factors that hold at most ``short`` of the raked weight."""
    if not factor.size:
        return factor
    order = np.argsort(-factor, axis=None, kind="stable")
    beyond = np.cumsum(raked.ravel()[order])
    limit = factor.ravel()[order][min(int(np.searchsorted(beyond, short, "right")), len(order) - 1)]
    return np.minimum(1.0, factor / limit) if limit > 0 else np.ones_like(factor)


@dataclass
class Mixture:
    """Categories per margin with wanted and reached shares; per cell with tokens its place in each, natural and raked token share, and draw probability.

    ``reached`` are the shares of the expected sample, so they also show what cells taken whole fall short of.
    """

    names: list[list[str]]
    at: list[np.ndarray]
    natural: np.ndarray
    raked: np.ndarray
    chance: np.ndarray
    wanted: list[np.ndarray]
    reached: list[np.ndarray]


def _key(margin: str) -> Column:
    column = "_mix_topic" if margin == "topic" else margin
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def fit_mixture(rows: DataFrame, targets: Mapping[str, Mapping[str, float] | float]) -> Mixture:
    """Rake the cells of measured rows (a stored table) to the targets.

    A target is a share per category, or an exponent t: shares in proportion to natural ones to the power t. Missing
    categories of a share table get nothing. Nulls are a category of their own. Margins of exponents give way where
    not all can be met; share tables do not.
    """
    tokens = F.sum("_mix_tokens").cast("double").alias("tokens")
    cells = rows.groupBy(*[_key(m).alias(m) for m in MARGINS]).agg(tokens).where("tokens > 0").toArrow()  # a row per source, language and topic that meet
    weights, names, at = cells.column("tokens").to_numpy(), [], []
    for m in MARGINS:
        coded = pc.dictionary_encode(plain_array(cells.column(m)))
        names.append(coded.dictionary.to_pylist())
        at.append(coded.indices.to_numpy())
    natural = weights / max(weights.sum(), 1e-300)
    shares = []
    for m, own, held in zip(MARGINS, shares_of(at, natural, [len(n) for n in names]), names, strict=True):
        want = targets[m]
        shares.append(np.array([float(want.get(n, 0.0)) for n in held]) if isinstance(want, Mapping) else own ** float(want))
    raked = rake_or_relax(at, natural, shares, [not isinstance(targets[m], Mapping) for m in MARGINS])
    factor = np.divide(raked, natural, out=np.zeros_like(natural), where=natural > 0)
    chance = chances(factor, raked)
    drawn = natural * chance
    reached = shares_of(at, drawn / max(drawn.sum(), 1e-300), [len(n) for n in names])
    return Mixture(names, at, natural, raked, chance, wanted_shares(at, natural, shares), reached)


def _chance(mixture: Mixture, rows: DataFrame) -> DataFrame:
    """``rows`` with _mix_weight (raked over natural share) and _mix_chance of their cells."""
    factor = np.divide(mixture.raked, mixture.natural, out=np.zeros_like(mixture.natural), where=mixture.natural > 0)
    keys = [pa.array(n, pa.string()).take(pa.array(i)) for n, i in zip(mixture.names, mixture.at, strict=True)]
    held = pa.table([*keys, pa.array(factor), pa.array(mixture.chance)], names=["_mix_k0", "_mix_k1", "_mix_k2", "_mix_weight", "_mix_chance"])
    table = rows.sparkSession.createDataFrame(held)
    out = rows.withColumns({f"_mix_k{k}": _key(m) for k, m in enumerate(MARGINS)})
    # Cells without tokens hold only texts without tokens: none is drawn away.
    joined = out.join(table, [f"_mix_k{k}" for k in range(3)], "left").drop(*[f"_mix_k{k}" for k in range(3)])
    return joined.withColumns({"_mix_weight": F.coalesce("_mix_weight", F.lit(1.0)), "_mix_chance": F.coalesce("_mix_chance", F.lit(1.0))})


def with_chances(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], *, vocabulary: str | None = None, topics: int = TOPICS) -> tuple[DataFrame, Mixture]:
    """``docs`` with _mix_tokens, _mix_topic, _mix_weight, _mix_chance and _mix_draw, stored once, and the mixture.

    Null texts have no tokens, null sources and languages are categories, repeated rows are drawn
    together (the draw is a hash of doc_id and text), an empty table stays empty. Columns beginning with
    ``_mix_`` are replaced. A document is in the sample if its draw is below its chance.
    """
    rows = docs.drop(*[c for c in docs.columns if c.startswith("_mix_")])
    rows = stage(measured(rows, vocabulary), "measured")
    texts = rows.groupBy(F.col("_mix_key").alias("key")).agg(F.first("_mix_profile").alias("profile"))
    centres = topic_centres(stage(texts, "profiles"), topics)
    rows = rows.withColumn("_mix_topic", nearest_topic(F.col("_mix_profile"), centres)).drop("_mix_profile", "_mix_key")
    mixture = fit_mixture(rows, targets)
    return _chance(mixture, rows), mixture


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], *, vocabulary: str | None = None, topics: int = TOPICS) -> DataFrame:
    """The sampled documents, with the columns of ``docs``.

    Nulls, repeated rows and empty tables as in ``with_chances``. Further columns may have any names: those
    that begin with ``_mix_`` stand aside under other names meanwhile.
    """
    aside = {c: f"_kept{k}_{c}" for k, c in enumerate(docs.columns) if c.lower().startswith("_mix_")}
    rows, _ = with_chances(docs.withColumnsRenamed(aside), targets, vocabulary=vocabulary, topics=topics)
    kept = rows.where("_mix_draw < _mix_chance").select([aside.get(c, c) for c in docs.columns])
    return kept.withColumnsRenamed({v: k for k, v in aside.items()})
