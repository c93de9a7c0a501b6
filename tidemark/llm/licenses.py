"""License scan: wordings with optional and replaceable regions as token automata over the words of whole texts.

A wording is compiled into a small automaton: one state before each word, steps over optional regions that
read nothing, and states that read any word for replaceable regions. A text holds a wording where the automaton,
started at some word, reaches its end, so all mandatory words stand there exactly. Places to start from come from array
comparisons of word numbers, and an automaton is only walked where the first two words fit.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytewords import Layout, Ranges, layout
from tidemark.llm.license_texts import PHRASES, WORDINGS
from tidemark.llm.words import plain_array, text_slices

#: Bytes of text laid out at a time.
SLICE = 4 << 20
#: Scores: a wording that matches as a whole, and a phrase alone.
MATCHED, NAMED = 1.0, 0.5

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_RANGE = re.compile(r"match=(\d+),(\d+)")


def words_of(text: str) -> list[str]:
    words = layout(pa.array([text]))
    return [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.stop, strict=True)]


@dataclass
class Automaton:
    """State s reads ``reads[s]`` (a word, or None for any word) and goes to s + 1; ``skips`` lead on without reading."""

    label: str
    reads: list[str | None] = field(default_factory=list)
    skips: list[tuple[int, int]] = field(default_factory=list)

    @functools.cached_property
    def closed(self) -> list[frozenset[int]]:
        """Every state that a state reaches without reading, itself included."""
        onward: dict[int, list[int]] = {}
        for a, b in self.skips:
            onward.setdefault(a, []).append(b)
        out: list[frozenset[int]] = []
        for s in range(len(self.reads), -1, -1):  # skips lead forward, so what lies behind s is known
            out.append(frozenset({s}).union(*(out[len(self.reads) - b] for b in onward.get(s, []))))
        return out[::-1]

    def heads(self) -> set[tuple[str, str | None]]:
        """The first two words of all texts it accepts; None: any word, or none at all."""
        out = set()
        for s in self.closed[0]:
            for t in self.closed[s + 1] if s < len(self.reads) else ():
                out.add((self.reads[s], self.reads[t] if t < len(self.reads) else None))
        return out


def compiled(label: str, wording: str) -> Automaton:
    """The automaton of a wording, which must begin with a mandatory or optional word."""
    out, open_ = Automaton(label), []
    at = 0
    for mark in [*_MARK.finditer(wording), None]:
        out.reads += words_of(wording[at : mark.start() if mark else len(wording)])
        if mark is None:
            break
        at, kind = mark.end(), mark[1]
        if kind == "beginOptional":
            open_.append(len(out.reads))
        elif kind == "endOptional":
            begin = open_.pop()
            out.skips += [(begin, len(out.reads))] if begin < len(out.reads) else []  # marks alone are no words
        else:
            low, high = map(int, _RANGE.search(kind).groups())
            end = len(out.reads) + high
            out.skips += [(s, end) for s in range(end - high + low, end)]
            out.reads += [None] * high
    if open_ or len(out.reads) in out.closed[0] or any(out.reads[s] is None for s in out.closed[0]):
        raise ValueError(f"the wording for {label} is not closed, or does not begin with a word")
    return out


@dataclass
class Scan:
    """What is looked for, with the words involved as numbers 0..n - 1; any other word is -1."""

    phrases: list[tuple[tuple[int, ...], str]]
    automata: list[Automaton]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, phrases: dict[str, str], wordings: Sequence[tuple[str, str]]) -> Scan:
        automata = [compiled(label, wording) for label, wording in wordings]
        cut = [(words_of(p), label) for p, label in phrases.items()]
        known = sorted({w for words, _ in cut for w in words} | {w for a in automata for w in a.reads if w is not None})
        vocabulary = {w: k for k, w in enumerate(known)}
        return cls([(tuple(vocabulary[w] for w in words), label) for words, label in cut], automata, vocabulary)

    @functools.cached_property
    def _hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        names = [w.encode() for w in self.vocabulary]
        size = np.array([len(w) for w in names], np.int64)
        data, start = np.frombuffer(b"".join(names), np.uint8), np.cumsum(size) - size
        keys = Ranges(data).xxh64(start, size)
        order = np.argsort(keys)
        return keys[order], order, data, start

    def numbers(self, words: Layout) -> np.ndarray:
        """The vocabulary's number of every word, -1 for others: equal hashes, then equal bytes."""
        keys, order, data, start = self._hashed
        size = words.stop - words.start
        own = words.ranges.xxh64(words.start, size)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == own)
        number = order[at[hit]]
        both = Ranges(np.concatenate([words.data, data]))
        ends = np.append(start[1:], len(data))
        same = ends[number] - start[number] == size[hit]
        hit, number = hit[same], number[same]
        same = both.same(words.start[hit], len(words.data) + start[number], size[hit])
        out = np.full(len(own), -1, np.int64)
        out[hit[same]] = number[same]
        return out

    def places(self, numbers: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """For each phrase the words at which it stands whole in one text."""
        out = []
        for phrase, _ in self.phrases:
            at = np.flatnonzero(numbers == phrase[0])
            at = at[at + len(phrase) <= last[at]]
            for k, word in enumerate(phrase[1:], 1):
                at = at[numbers[at + k] == word]
            out.append(at)
        return out

    @functools.cached_property
    def _programs(self) -> list[tuple[list[int], list[frozenset[int]], dict[int, set[int]]]]:
        """(number that each state reads, -2 for any; closed states; second words by first word, -2 for any) of each automaton."""
        out = []
        for a in self.automata:
            reads = [-2 if w is None else self.vocabulary[w] for w in a.reads]
            heads: dict[int, set[int]] = {}
            for x, y in a.heads():
                heads.setdefault(self.vocabulary[x], set()).add(-2 if y is None else self.vocabulary[y])
            out.append((reads, a.closed, heads))
        return out

    def spans(self, numbers: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int]]:
        """(automaton, first word, word behind the longest match) of every place where a wording matches."""
        out = []
        after = np.append(numbers[1:], -1)[: len(numbers)]
        for k, (reads, closed, heads) in enumerate(self._programs):
            starts = [np.flatnonzero((numbers == x) & (True if -2 in ys else np.isin(after, list(ys)))) for x, ys in heads.items()]
            for at in np.sort(np.concatenate(starts)).tolist():
                end = _longest(reads, closed, numbers, at, int(last[at]))
                if end:
                    out.append((k, at, end))
        return out


def _longest(reads: list[int], closed: list[frozenset[int]], numbers: np.ndarray, at: int, stop: int) -> int:
    """The word behind the longest accepted run from ``at``, 0 if there is none. A walk reads at most as many words as there are states."""
    states, found, accept = closed[0], 0, len(reads)
    for i in range(at, stop):
        word, after = int(numbers[i]), set()
        for s in states:
            if s < accept and reads[s] in (word, -2) and (reads[s] == -2 or word >= 0):
                after |= closed[s + 1]
        if not after:
            break
        states = after
        if accept in states:
            found = i + 1
    return found


#: Columns that the scan adds.
COLUMNS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def _figures(scan: Scan, texts: pa.Array) -> list[pa.Array]:
    """The columns of COLUMNS for each text."""
    words = layout(texts)
    n, numbers, last = len(texts), scan.numbers(words), words.last
    places, spans = scan.places(numbers, last), scan.spans(numbers, last)
    text_of = lambda at: np.searchsorted(words.first, at, "right") - 1
    every = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    own = text_of(every)
    n_base = np.bincount(own, minlength=n)
    first, final = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[own[::-1]], final[own] = every[::-1] - words.first[own[::-1]], every - words.first[own]
    base: dict[int, set[str]] = {}
    for at, (_, label) in zip(places, scan.phrases, strict=True):
        for i in np.unique(text_of(at)).tolist():
            base.setdefault(i, set()).add(label)
    matched: dict[int, set[str]] = {}
    for k, begin, _ in spans:
        matched.setdefault(int(text_of(begin)), set()).add(scan.automata[k].label)
    joined = lambda names: ",".join(sorted(names))
    return [
        pa.array(words.counts), pa.array(n_base), pa.array(first, mask=n_base == 0), pa.array(final, mask=n_base == 0),
        pa.array([joined(base.get(i, ())) for i in range(n)], pa.string()),
        pa.array([joined(base.get(i, set()) | matched.get(i, set())) for i in range(n)], pa.string()),
        pa.array([MATCHED if i in matched else NAMED if i in base else 0.0 for i in range(n)], pa.float64()),
    ]


def with_licenses(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, wordings: Sequence[tuple[str, str]] = WORDINGS) -> DataFrame:
    """All columns of ``docs`` and what its whole ``text`` says of licenses; columns of the same names are replaced.

    ``n_words``; ``n_base``, the places where a phrase's words stand consecutively; ``first_word`` and
    ``last_word``, the smallest and largest word at which one begins (null: none); ``base_labels`` of the phrases and
    ``labels`` of phrases and matching wordings, both distinct, sorted and joined by commas; ``score``, 1 if
    a wording matches, 0.5 if only a phrase stands there, else 0. A null or empty text has no words, empty labels and
    score 0. Every repeated row gets its own figures, an empty table none; null doc_ids stay.
    """
    kept = docs.drop(*COLUMNS.names).withColumn("text", F.col("text").cast("string"))
    at, scan = kept.columns.index("text"), Scan.of(phrases, wordings)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(at), SLICE):
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, *_figures(scan, plain_array(own.column(at)))], names=[*own.schema.names, *COLUMNS.names])

    return kept.mapInArrow(add, T.StructType([*kept.schema.fields, *COLUMNS.fields]))


def license_spans(docs: DataFrame, *, wordings: Sequence[tuple[str, str]] = WORDINGS) -> DataFrame:
    """(doc_id, label, start_word, end_word, words): every place where a wording matches, the longest match from there, with the words matched.

    Only ``doc_id`` and ``text`` are read. Null and empty texts give no rows, repeated rows each give theirs.
    """
    scan = Scan.of({}, wordings)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1), SLICE):
                words = layout(plain_array(batch.column(1).slice(a, b - a)))
                found = scan.spans(scan.numbers(words), words.last)
                k, begin, end = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                row = np.searchsorted(words.first, begin, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array([scan.automata[x].label for x in k], pa.string()),
                     pa.array(begin - words.first[row]), pa.array(end - words.first[row]),
                     pa.array([words.data[words.start[x] : words.stop[y - 1]].tobytes().decode() for x, y in zip(begin, end, strict=True)], pa.string())],
                    names=["doc_id", "label", "start_word", "end_word", "words"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(find, "doc_id long, label string, start_word long, end_word long, words string")
