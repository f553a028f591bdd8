"""Hashes of words and windows of texts, on whole slices of bytes at once.

The hash of a byte string is a polynomial modulo 2**64 over random values of its bytes, mixed at the end. With running sums
the hash of any stretch of a slice is one subtraction and one product, wherever the stretch lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weirflow.llm.common import AFTER_TASK

U = np.uint64
#: Seeded, so that every machine and run has the same: values of bytes, and an odd factor with its inverse.
VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Values for a second hash, which doesn't fail where the first does.
OTHER = np.random.default_rng(20240602).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
FACTOR = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Emptied after each task, with what else a worker needn't keep.
_powers: dict[int, np.ndarray] = {}
AFTER_TASK.append(_powers.clear)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1); kept and grown by doubling."""
    got = _powers.get(int(base), np.ones(1, U))
    while len(got) < n:
        got = np.concatenate([got, got * (got[-1:] * base)])
    _powers[int(base)] = got
    return got[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit depends on all."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none), and where each starts and the last ends."""
    data = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Sums:
    """Running sums over ``raw``: hashes of stretches in a few operations each."""

    def __init__(self, raw: np.ndarray, values: np.ndarray = VALUES) -> None:
        self.sums = np.empty(len(raw) + 1, U)
        self.sums[0] = 0
        np.cumsum(values[raw] * powers(FACTOR, len(raw)), out=self.sums[1:])
        self.back = powers(INVERSE, len(raw) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes of raw[start:end]."""
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]

    def windows(self, n: int) -> np.ndarray:
        """Unmixed hashes of all windows of ``n`` bytes, by start."""
        h = self.sums[n:] - self.sums[:-n]
        h *= self.back[: len(h)]
        return h


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word: maximal runs of bytes that aren't ASCII white space, within one text."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
