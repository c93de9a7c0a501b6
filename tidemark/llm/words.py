"""Arrow batches of texts as word codes, and the encoder built on them.

Whole texts are cut with Arrow kernels and every distinct piece of a batch is
looked at once; per-text figures are then array sums over the piece codes.
"""

from __future__ import annotations

import ctypes
import functools
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer text is handled alone and whole.
SLICE_BYTES = 6 << 20
#: Distinct pieces a worker remembers (twice this at most).
CACHE_PIECES = 300_000


#: Bytes of an Arrow batch on its way to a task's Python worker and back.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """Let the session hand texts to Python in batches of BATCH_BYTES, if its own are larger.

    A batch is held several times over, by the JVM, the worker and the results, for every task that runs.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def plain_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


@dataclass
class Coded:
    """Pieces of some texts: text i holds ``codes[starts[i]:starts[i + 1]]``, indices into ``distinct``."""

    starts: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a figure of the pieces over each text (0 for a text without pieces)."""
        total = np.concatenate([[0], np.cumsum(values[self.codes])])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def ascii_words(texts: pa.Array) -> Coded:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, null as empty."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    codes = coded.indices.to_numpy()
    full = pc.binary_length(coded.dictionary).to_numpy() > 0
    if not full.all():  # the edges of texts that begin or end with white space
        held = full[codes]
        offsets = np.concatenate([[0], np.cumsum(held)])[offsets]
        codes = codes[held]
    return Coded(offsets, codes, coded.dictionary)


#: Byte-level alphabets print these bytes as themselves and the rest from U+0100 on (fixed rule of the format).
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


@functools.cache
def _alphabet() -> dict[int, int]:
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    return {b: 256 + i for i, b in enumerate(hidden)}


def byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_alphabet())


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Whole-text encoding by the tokenizers library, each distinct piece encoded once per worker.

    A text is cut where every pre-tokenizer of its kind cuts anyway: byte-level
    vocabularies before a space, vocabularies that drop white space at white
    space. A piece of Latin letters with closing marks is two pre-tokens, and
    its letters go to the vocabulary's model directly. Texts whose white-space
    runs hold a space that is not their last character, and vocabularies of
    any other kind, are encoded whole.
    """

    MARKS = ".,;:!?"
    LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    ODD_SPACE = r"[\t-\r\x{85}\p{Z}] (?:[\t-\r\x{85}\p{Z}]|$)|^ (?:[\t-\r\x{85}\p{Z}]|$)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, self.size = spec["pre_tokenizer"] or {}, self.tokenizer.get_vocab_size()
        steps = [s["type"] for s in cutter.get("pretokenizers", [])]
        drops = cutter.get("type") == "Sequence" and steps == ["Split", "ByteLevel"]
        drops = drops and cutter["pretokenizers"][0].get("invert") and "\\s" in cutter["pretokenizers"][0]["pattern"].get("Regex", "")
        lowers = "Lowercase" in [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        levels = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        self.kind = "dropped" if drops and lowers else "spaced" if levels and spec["normalizer"] is None else "whole"
        self.lead = " " if self.kind == "spaced" else ""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self._whole([text])[0]
        return self.marks[text]

    def _pieces(self, distinct: pa.Array) -> list[bytes]:
        """Ids of every distinct piece that follows a space."""
        keys = pc.ascii_lower(distinct) if self.kind == "dropped" else distinct
        stems = pc.utf8_rtrim(keys, self.MARKS)
        plain = pc.match_substring_regex(stems, self.LETTERS).to_numpy(zero_copy_only=False)
        names, stems = strings(keys), strings(stems)
        for i in np.flatnonzero(~plain).tolist():
            stems[i] = "\0" + names[i]
        known = self.young
        out = list(map(known.get, stems))
        wanted = [i for i, ids in enumerate(out) if ids is None]
        if wanted:
            lower, get, model, lead = self.kind == "dropped", self.old.get, self.tokenizer.model, byte_letters(self.lead)
            late = []
            for i in wanted:
                stem = stems[i]
                ids = known.get(stem) or get(stem)
                if ids is None:
                    if stem[:1] == "\0":
                        late.append(i)
                        continue
                    letters = stem if stem.isascii() else byte_letters(stem.lower() if lower else stem)
                    ids = array("I", [t.id for t in model.tokenize(lead + letters)]).tobytes()
                known[stem] = out[i] = ids
            for i, ids in zip(late, self._whole([self.lead + names[i] for i in late]), strict=True):
                known[stems[i]] = out[i] = ids
        marks = np.flatnonzero(plain & (pc.binary_length(keys).to_numpy() > [len(s) if s.isascii() else len(s.encode()) for s in stems]))
        for i in marks.tolist():
            out[i] += self._mark(names[i][len(stems[i]) :])
        if len(known) > CACHE_PIECES:
            self.old, self.young = known, {}
        return out

    def encode(self, texts: pa.Array, words: Coded | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): text i holds ``ids[starts[i]:starts[i + 1]]`` as unsigned 32-bit ids; null is empty. ``words`` are its ``ascii_words`` if known."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, "<u4")
        if self.kind == "whole":
            return _joined(self._whole(texts.to_pylist()))
        if self.kind == "dropped":
            coded = words or ascii_words(texts)
            starts, codes, parts = coded.starts, coded.codes, self._pieces(coded.distinct)
        else:
            cut = pc.split_pattern(texts, " ")
            starts = cut.offsets.to_numpy().astype(np.int64)
            values = cut.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
            starts -= starts[0]
            codes, parts = values.indices.to_numpy().copy(), self._pieces(values.dictionary)
            heads, where = np.unique(codes[starts[:-1]], return_inverse=True)
            codes[starts[:-1]] = len(parts) + where
            parts = parts + self._whole(values.dictionary.take(pa.array(heads)).to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        begins = np.cumsum(sizes) - sizes
        run = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(run)])
        small = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
        places = np.repeat((begins[codes] - ends[:-1]).astype(small), run)
        places += np.arange(ends[-1], dtype=small)
        ids = flat[places]
        starts = ends[starts]
        if self.kind == "spaced":
            odd = pc.match_substring_regex(texts, self.ODD_SPACE).to_numpy(zero_copy_only=False)
            if odd.any():
                rows = [ids[starts[i] : starts[i + 1]].tobytes() for i in range(len(texts))]
                at = np.flatnonzero(odd)
                for i, whole in zip(at, self._whole(texts.take(pa.array(at)).to_pylist()), strict=True):
                    rows[i] = whole
                return _joined(rows)
        return starts, ids


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(rows), "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def let_go() -> None:
    """Give back what a reused worker holds of earlier steps: encoders with their pieces, and memory that Arrow and the C library keep."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow step that encodes nothing and starts with the memory of earlier steps given back."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from step(batches)

    return run
