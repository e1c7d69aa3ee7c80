"""Content-chosen anchors: which places of a text can lie in a repeated string of a given length.

Of the k-grams of every window of `length` bytes the one of least hash (the first, if tied) is the
window's anchor. Equal windows have equal anchors at equal places, so two windows can be equal only if
their anchors are. Windows that follow one another mostly share an anchor: one place stands for dozens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestone.llm.bytekit import byte_codes, mix, prefix_hash, span_hash

#: Bytes of an anchor's k-gram.
GRAM = 32
CODES = byte_codes(101)
CODES_AGAIN = byte_codes(102)
PLACE_BITS = 23


@dataclass
class Anchors:
    """Anchors of the rows of a batch: row, first and last window start (in the row), k-gram hash, hash of all bytes its windows cover."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    whole: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    def take(self, at: np.ndarray) -> "Anchors":
        return Anchors(self.row[at], self.first[at], self.last[at], self.gram[at], self.whole[at])


def find(data: np.ndarray, offsets: np.ndarray, length: int) -> Anchors:
    """Anchors of all windows of `length` bytes that lie within a row; at most 2**PLACE_BITS bytes at a time."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length or not (np.diff(offsets) >= length).any():
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    if n >= 1 << PLACE_BITS:
        return _find_long(data, offsets, length)
    prefix = prefix_hash(data, CODES)
    grams = mix(span_hash(prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & low).astype(np.int64)  # the anchor of the window that starts at each place
    start, stop = offsets[:-1], offsets[1:] - length + 1
    inside = np.zeros(n + 2, np.int32)
    ok = stop > start
    np.add.at(inside, start[ok], 1)
    np.add.at(inside, stop[ok], -1)
    valid = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    own = at[valid]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    row = np.searchsorted(offsets, valid[new], "right") - 1
    first, last = valid[new], np.concatenate([valid[new[1:] - 1], valid[-1:]])
    place = own[new]
    gram = grams[place]
    second = prefix_hash(data, CODES_AGAIN)
    whole = mix(span_hash(second, first, last + length) + np.uint64(0x9E3779B97F4A7C15) * (place - first).astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F) * (last - first).astype(np.uint64))
    return Anchors(row, first - offsets[row], last - offsets[row], gram, whole)


def _find_long(data: np.ndarray, offsets: np.ndarray, length: int) -> Anchors:
    """The same for more bytes: row by row, a long row in stretches that overlap by a window less one byte.

    Runs of windows are cut at the ends of stretches of a fixed size counted from the row's start, which
    may cut equal runs differently in different rows; a cut run only makes its anchor count as several.
    """
    parts = []
    most = (1 << PLACE_BITS) // 2
    for r in range(len(offsets) - 1):
        a, b = offsets[r], offsets[r + 1]
        for s in range(a, max(a + 1, b - length + 1), most):
            e = min(b, s + most + length - 1)
            got = find(data[s:e], np.array([0, e - s]), length)
            got.row = np.full(len(got), r)
            got.first, got.last = got.first + (s - a), got.last + (s - a)
            parts.append(got)
    return Anchors(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "first", "last", "gram", "whole")))
