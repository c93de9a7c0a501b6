"""Words of whole texts as byte ranges, their runs hashed by vectorised XXH64 and CRC-32.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are lower-cased: ASCII digits and
letters and everything beyond ASCII. The words of a text are laid out one after another with one space
between them, so a run of words is one byte range of that layout.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Hashes work on ranges up to so many bytes at a time; longer ones go through the library one by one.
LONG_RUN = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

#: The five primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass
class Layout:
    """Words of some texts: text i holds words ``first[i]:first[i + 1]``, word w the bytes ``start[w]:stop[w]`` of ``data``."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @functools.cached_property
    def ranges(self) -> Ranges:
        return Ranges(self.data)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @functools.cached_property
    def last(self) -> np.ndarray:
        """For every word the number of the word behind its text's last one."""
        return np.repeat(self.first[1:], self.counts)


def layout(texts: pa.Array) -> Layout:
    """The lower-cased words of each text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    held = _LOWER[raw]
    inside = _IN_WORD[held]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges[:-1][edges[:-1] < len(raw)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    begins, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sizes = ends - begins
    stop = np.cumsum(sizes + 1) - 1
    data = np.full(stop[-1] + 1 if len(stop) else 0, 32, np.uint8)
    taken = np.ones(len(data), bool)
    taken[stop] = False
    data[taken] = held[inside]
    return Layout(data, stop - sizes, stop, np.searchsorted(begins, edges))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _longest_first(size: np.ndarray) -> np.ndarray:
    """Stable order of sizes up to LONG_RUN, which a radix sort of short integers gives."""
    return np.argsort(-size.astype(np.int16), kind="stable")


def _crc_steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables that move a CRC-32 (polynomial 0xEDB88320) on by one byte, and by the low and the high half of four bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (one & np.uint32(1)))
    on = [one]
    for _ in range(3):
        on.append(one[on[-1] & np.uint32(255)] ^ (on[-1] >> np.uint32(8)))
    low, high = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    return one, on[3][low] ^ on[2][high], on[1][low] ^ on[0][high]


_CRC_BYTE, _CRC_LOW, _CRC_HIGH = _crc_steps()


class Ranges:
    """Hashes and comparisons of byte ranges of one array, for many ranges at a time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        # Every position's next bytes as one little-endian number.
        self.eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
        self.four = np.ndarray(len(data) + 1, "<u4", padded, 0, (1,))

    def xxh64(self, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
        """XXH64 of every byte range ``start:start + size``, as unsigned 64-bit integers."""
        out = np.empty(len(start), np.uint64)
        long_ = size > LONG_RUN
        if long_.any():
            view = self.data.tobytes()
            out[long_] = [xxhash.xxh64_intdigest(view[a : a + n], seed) for a, n in zip(start[long_].tolist(), size[long_].tolist(), strict=True)]
        data, eight, four, seed = self.data, self.eight, self.four, np.uint64(seed)
        with np.errstate(over="ignore"):
            for wide in (False, True):
                rows = np.flatnonzero(~long_ & ((size >= 32) == wide))
                if not len(rows):
                    continue
                rows = rows[_longest_first(size[rows])]  # so that those still at work are the first ones
                at, left = start[rows].copy(), size[rows].copy()
                if wide:
                    parts = [np.full(len(rows), s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
                    for _ in range(int(left.max()) // 32):
                        n = np.searchsorted(-left, -31, "left")
                        for k in range(4):
                            parts[k][:n] = _turn(parts[k][:n] + eight[at[:n] + 8 * k] * P2, 31) * P1
                        at[:n] += 32
                        left[:n] -= 32
                    h = _turn(parts[0], 1) + _turn(parts[1], 7) + _turn(parts[2], 12) + _turn(parts[3], 18)
                    for v in parts:
                        h = (h ^ (_turn(v * P2, 31) * P1)) * P1 + P4
                    order = _longest_first(left)
                    rows, at, left, h = rows[order], at[order], left[order], h[order]
                else:
                    h = np.full(len(rows), seed + P5)
                h += size[rows].astype(np.uint64)
                for _ in range(int(left[0]) // 8):
                    n = np.searchsorted(-left, -7, "left")
                    h[:n] = _turn(h[:n] ^ (_turn(eight[at[:n]] * P2, 31) * P1), 27) * P1 + P4
                    at[:n] += 8
                    left[:n] -= 8
                some = np.flatnonzero(left >= 4)
                h[some] = _turn(h[some] ^ (four[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
                at[some] += 4
                left[some] -= 4
                for k in range(3):
                    some = np.flatnonzero(left > k)
                    h[some] = _turn(h[some] ^ (data[at[some] + k].astype(np.uint64) * P5), 11) * P1
                h = (h ^ (h >> np.uint64(33))) * P2
                h = (h ^ (h >> np.uint64(29))) * P3
                out[rows] = h ^ (h >> np.uint64(32))
        return out

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ranges of ``size`` bytes at ``a`` and at ``b`` are equal, compared byte for byte, eight at a time."""
        eight = self.eight
        same = np.ones(len(a), bool)
        rows = np.arange(len(a))
        done = 0
        while len(rows):
            rest = np.minimum(size[rows] - done, 8)
            apart = eight[a[rows] + done] ^ eight[b[rows] + done]
            same[rows] &= (apart << (np.uint64(8) * (8 - rest).astype(np.uint64))) == 0
            done += 8
            rows = rows[(size[rows] > done) & same[rows]]
        return same

    def crc32(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC-32 of every byte range ``start:start + size``, as unsigned 32-bit integers."""
        out = np.empty(len(start), np.uint32)
        if not len(start):
            return out
        long_ = size > LONG_RUN
        if long_.any():
            view = self.data.tobytes()
            out[long_] = [zlib.crc32(view[a : a + n]) for a, n in zip(start[long_].tolist(), size[long_].tolist(), strict=True)]
        rows = np.flatnonzero(~long_)
        rows = rows[_longest_first(size[rows])]  # so that those still at work are the first ones
        data, four, at, left = self.data, self.four, start[rows].copy(), size[rows].copy()
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for _ in range(int(left[0]) // 4 if len(rows) else 0):
            n = np.searchsorted(-left, -3, "left")
            now = crc[:n] ^ four[at[:n]]
            crc[:n] = _CRC_LOW[now & np.uint32(0xFFFF)] ^ _CRC_HIGH[now >> np.uint32(16)]
            at[:n] += 4
            left[:n] -= 4
        for k in range(3):
            some = np.flatnonzero(left > k)
            crc[some] = _CRC_BYTE[(crc[some] ^ data[at[some] + k]) & np.uint32(255)] ^ (crc[some] >> np.uint32(8))
        out[rows] = ~crc
        return out
