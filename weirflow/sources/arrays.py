"""Elements of huge JSON arrays, read by many tasks: ``elements(spark, path)``.

A file is cut into ranges of bytes. Whether a range begins within a string, and how deep, depends on all before it; so each range
first says what it does to either state (a pass over the bytes alone), the driver chains these (a few numbers a range), and then
each range gives the elements that begin in it, as texts for ``from_json``.

Reading goes by ``pyarrow.fs``: local and mounted paths, and the stores it knows (S3, GCS, HDFS).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and those looked at at once.
SPLIT, STEP = 64 << 20, 4 << 20
#: Tasks from which one takes several ranges, and the bytes of these.
TASKS, TASK_BYTES = 256, 16 << 20
#: Bytes looked at first behind a range for the end of its last element; twice as many each time.
BEYOND = 4 << 10
_QUOTE, _BACK, _COMMA = b'"\\,'
_OPEN, _CLOSE = b"[{", b"]}"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the package


class NotAnArray(ValueError):
    """A file that isn't one JSON array."""


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _edge(f, at: int, size: int) -> int:
    """The first place from ``at`` on that no backslash comes before, so that no escape is cut."""
    while 0 < at < size and f.read_at(1, at - 1) == b"\\":
        at += 1
    return min(at, size)


class State:
    """Where a scan stands: within a string or not, how deep, and whether the next byte is escaped."""

    def __init__(self, inside: int = 0, depth: int = 0) -> None:
        self.inside, self.depth, self.escaped = inside, depth, False

    def scan(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, whether each is outside strings, depth after each); moves the state on."""
        b = np.frombuffer(raw, np.uint8)
        quote = b == _QUOTE
        if self.escaped or _BACK in raw:
            back = b == _BACK
            # length of the run of backslashes that ends before each quote, and before the end
            places = np.append(np.flatnonzero(quote), len(b))
            last = np.maximum.accumulate(np.where(~back, np.arange(len(b)), -1)) if len(b) else np.zeros(0, int)
            before = np.where(places > 0, last[np.maximum(places - 1, 0)] if len(b) else -1, -1)
            run = places - 1 - before + ((before < 0) & self.escaped)
            quote[places[:-1][run[:-1] % 2 == 1]] = False
            self.escaped = bool(run[-1] % 2)
        parity = (np.cumsum(quote, dtype=np.int64) + self.inside) & 1
        outside = np.where(quote, False, parity == 0)
        change = np.isin(b, list(_OPEN)).astype(np.int64) - np.isin(b, list(_CLOSE))
        depth = self.depth + np.cumsum(change * outside)
        if len(b):
            self.inside, self.depth = int(parity[-1]), int(depth[-1])
        return b, outside, depth


def _summary(path: str, start: int, end: int) -> tuple[int, int, int, int, int]:
    """(start, end, whether the quotes flip the state, change of depth from outside a string, the same from inside one)."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        size = f.size()
        start, end = _edge(f, start, size), _edge(f, end, size)
        plain, quoted = State(0), State(1)
        for pos in range(start, end, STEP):
            raw = f.read_at(min(STEP, end - pos), pos)
            plain.scan(raw)
            quoted.scan(raw)
    return start, end, plain.inside, plain.depth, quoted.depth


def _elements(path: str, start: int, end: int, inside: int, depth: int) -> Iterator[bytes]:
    """The elements whose opening bracket or comma lies in [start, end)."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        size, state = f.size(), State(inside, depth)
        held: list[bytes] | None = None  # the element under way
        pos, beyond = start, BEYOND
        while pos < size and (pos < end or held is not None):
            if pos < end:
                raw = f.read_at(min(STEP, end - pos), pos)
            else:  # the rest of the last element: a little at first, as most elements are short
                raw = f.read_at(min(beyond, size - pos), pos)
                beyond = min(2 * beyond, STEP)
            b, outside, deep = state.scan(raw)
            cuts = np.flatnonzero(outside & ((b == _COMMA) & (deep == 1) | (b == ord("[")) & (deep == 1) | (b == ord("]")) & (deep == 0)))
            last = 0
            for c in cuts.tolist():
                if held is not None:
                    yield b"".join([*held, raw[last:c]])
                    held = None
                if pos + c >= end:
                    return
                if b[c] != ord("]"):
                    held = []
                last = c + 1
            if held is not None:
                held.append(raw[last:])
            pos += len(raw)
        if held is not None:
            yield b"".join(held)


def elements(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(value) of a file's elements, as their texts. A file that isn't one array, from its first to its last bracket, is ``NotAnArray``."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        size = f.size()
        head, tail = f.read_at(min(size, 1 << 16), 0).lstrip(), f.read_at(min(size, 1 << 16), max(0, size - (1 << 16))).rstrip()
    if not head.startswith(b"[") or not tail.endswith(b"]"):
        raise NotAnArray(f"{path}: not an array")
    empty = size <= 1 << 16 and not head.rstrip()[1:-1].strip()
    ranges = [(path, a, min(a + split, size)) for a in range(0, size, split)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_summary(*r.values()) for r in b.to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["start", "end", "flips", "plain", "quoted"])

    # A task takes a range, or, where there are more than ``TASKS`` and they are small, as many neighbours as ``TASK_BYTES`` hold.
    many = max(1, min(TASK_BYTES // split, len(ranges) // TASKS))

    def spread(rows: list[tuple], kind: str) -> DataFrame:
        numbered = [(i // many, *r) for i, r in enumerate(rows)]
        tasks = spark.createDataFrame(numbered, f"task int, {kind}").repartition(max(1, -(-len(rows) // many)), F.col("task"))
        return tasks.drop("task")

    known = spread(ranges, "path string, start long, end long").mapInArrow(summed, "start long, end long, flips long, plain long, quoted long").collect()
    inside, depth, placed = 0, 0, []
    for r in sorted(known, key=lambda r: (r.start, r.end)):  # a few numbers a range
        placed.append((path, r.start, r.end, inside, depth))
        depth += r.quoted if inside else r.plain
        inside ^= r.flips
    if inside or depth:
        raise NotAnArray(f"{path}: ends {'within a string' if inside else f'at depth {depth}'}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                held, n = [], 0
                for x in _elements(*r.values()):
                    if empty:
                        continue
                    held.append(x.decode("utf-8", "replace"))
                    n += len(x)
                    if n > STEP:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return spread(placed, "path string, start long, end long, inside long, depth long").mapInArrow(read, "value string")
