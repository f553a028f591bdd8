"""Maximal repeats of a set of byte strings, by the common-prefix interval tree of their suffix array.

The suffixes that are at least ``least`` bytes long are sorted, neighbours' common prefixes are measured, and a stack scan of
these lengths visits the intervals of the tree from the leaves up: an interval of common prefix l is all suffixes that begin
with the same l bytes. Where the bytes before these suffixes differ (or one begins its string), the repeat can't be extended
to the left, nor, being an interval, to the right: it is maximal, and all its occurrences are put out, not just neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def enhanced_suffix_array(data: np.ndarray, offsets: np.ndarray, least: int, suffixes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, position, common prefix with the suffix before) of the sorted suffixes of data[offsets[i] : offsets[i + 1]].

    Of all suffixes of at least ``least`` bytes, or of those given as (string, position).
    """
    size = np.diff(offsets)
    if suffixes is None:
        count = np.maximum(size - least + 1, 0)
        string = np.repeat(np.arange(len(size)), count)
        position = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    else:
        string, position = suffixes
    width = int(size.max(initial=0))
    if not len(string):
        return string, position, np.zeros(0, np.int64)
    # Shorter suffixes first: of two that differ in zero bytes at the end only, the sort below, being stable, keeps this order.
    short = np.argsort(size[string] - position, kind="stable")
    string, position = string[short], position[short]
    length = size[string] - position
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[offsets[string] + position]
    rows[np.arange(width)[None, :] >= length[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    rows, string, position, length = rows[order], string[order], position[order], length[order]
    differ = rows[1:] != rows[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), width)
    return string, position, np.append(0, np.minimum(prefix, np.minimum(length[1:], length[:-1])))


def intervals(prefix: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals with a common prefix of at least ``least``, children before parents."""
    marks = np.flatnonzero(prefix >= least)
    if not len(marks):
        return
    values = prefix.tolist()
    breaks = np.flatnonzero(np.diff(marks) > 1)
    for a, b in zip(marks[np.append(0, breaks + 1)].tolist(), marks[np.append(breaks, len(marks) - 1)].tolist(), strict=True):
        stack = [(values[a], a - 1)]
        for i in range(a + 1, b + 2):
            now = values[i] if i <= b else 0
            left = i - 1
            while stack and stack[-1][0] > now:
                length, left = stack.pop()
                yield length, left, i - 1
            if now >= least and (not stack or stack[-1][0] < now):
                stack.append((now, left))


def maximal_repeats(data: np.ndarray, offsets: np.ndarray, least: int, suffixes: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, strings, positions) of each maximal repeat of at least ``least`` bytes, with all its occurrences (among ``suffixes``, if given)."""
    string, position, prefix = enhanced_suffix_array(data, offsets, least, suffixes)
    # The byte before each suffix; a string's beginning is like nothing else.
    before = np.where(position > 0, data[np.maximum(offsets[string] + position - 1, 0)].astype(np.int64), -1 - np.arange(len(string)))
    changes = np.cumsum(np.append(False, before[1:] != before[:-1])) if len(string) else np.zeros(0, np.int64)
    for length, first, last in intervals(prefix, least):
        if changes[last] > changes[first]:
            yield length, string[first : last + 1], position[first : last + 1]
