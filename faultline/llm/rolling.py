"""Hashes of byte and word windows of a whole Arrow batch at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 21
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


class Prefix:
    """Hash of any window ``[a, b)`` of a sequence from one pass of running sums.

    The value is a polynomial in an odd base modulo 2^64, taken back to the
    window's start by the base's inverse, so equal windows hash alike anywhere.
    """

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def window(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])


BASES = (0x2545F4914F6CDD1D | 1, 0x9E3779B97F4A7C15 | 1)
BYTE_VALUES = [mix(np.arange(1, 257, dtype=U) * U(k)) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True


def byte_prefix(data: np.ndarray, which: int) -> Prefix:
    return Prefix(BYTE_VALUES[which][data], BASES[which])


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of whole texts of about ``SLICE_BYTES``."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


class Words:
    """Words of a run of texts: byte spans, text, place in the text, and their hashes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        solid = ~IS_SPACE[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets] = True
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(data):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | begins[:-1]))
        self.end = np.flatnonzero(solid & (~after | begins[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.place = np.arange(len(self.start)) - self.first[self.doc]
        self.data = data

    def prefix(self, which: int) -> Prefix:
        return Prefix(byte_prefix(self.data, which).window(self.start, self.end), BASES[1 - which])
