"""Repeated passages: every byte covered by a string of ``least`` bytes that also starts earlier is cut out.

Earlier is: in a row with a smaller doc_id (null last; of equal ones, in the order in which they were read), or in the same
row. Strings never cross rows, and are judged on the input. What a suffix array over the whole corpus would find is found by
many small ones:

1. Texts are packed into compressed blocks, written once to the shared folder. A window (string of ``least`` bytes) is filed
   under its anchor, the smallest hash of its ``GRAM``-byte strings. Consecutive windows with the same place of the anchor make a
   fragment, in which no window repeats. Equal windows have equal anchors, so they are always filed together.
2. Fragments are counted by (anchor, content), over all blocks. A fragment whose anchor no other has repeats nothing. Of equal
   fragments (by 136 bits of three hashes), which would be equal entries of a suffix array, all but the first are covered
   whole; the first stands for all.
3. Where an anchor has several fragments, their bytes meet in one task: an enhanced suffix array over them, its common-prefix
   intervals, and of these the maximal repeats with all occurrences. All but each repeat's first occurrence are covered.
4. Suffixes that share ``least`` bytes share the hash of their first ``least`` bytes, so a suffix array falls into parts by
   this hash, and no interval crosses them. An anchor with more suffixes than are sorted at once is taken in such parts; one
   with more than ``HOT`` distinct fragments is dealt over 2, 4, 8, ... tasks by it, each getting the fragments that have a
   suffix there. So every repeat is found by the same comparison of bytes, however common.

Tasks hold a block, or the fragments of one bucket of anchors, both of bounded size; a task that gets several buckets takes
one after the other.

Defined cases: a null text is empty, an empty or short text loses nothing; equal rows lose all but the first (from ``least``
bytes on); an empty table gives an empty result; other columns pass through ``strip`` unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.bytehash import OTHER, U, Sums, flat, mixed
from weirflow.llm.common import any_names, materialize, quoted, released, scratch
from weirflow.llm.packing import slices
from weirflow.llm.suffixes import maximal_repeats

#: Bytes of the strings of which the one with the smallest hash is an anchor.
GRAM = 32
#: Bytes of text in a block, about; fragments in a bucket, about; fragments of an anchor that one task takes; tasks at most.
BLOCK_BYTES, TASK_FRAGMENTS, HOT, MOST_TASKS = 1 << 19, 1_000_000, 20_000, 1 << 15
#: Suffixes sorted at once.
SUFFIXES = 60_000

LAST = (1 << 63) - 1
#: A covered stretch of a block's text: row in the block, start, length.
RANGE = np.dtype([("row", "<u4"), ("start", "<u4"), ("length", "<u4")])


# Blocks ---------------------------------------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, data, ids): a block's rows in the order of doc_id, as a compressed Arrow stream, and their places in it."""
    block, squeeze = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for part in slices(batch, batch.schema.get_field_index("text"), BLOCK_BYTES):
            rows = pa.Table.from_batches([part])
            rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")])).combine_chunks()
            ids = pc.fill_null(rows.column("doc_id"), LAST).to_numpy()
            # Doc_ids of a block lie within 32 bits of its first, so that four bytes tell them apart.
            at = 0
            while at < len(ids):
                end = int(np.searchsorted(ids, min(int(ids[at]) + (1 << 32), LAST + 0), side="left")) if ids[at] < LAST else len(ids)
                end = max(end, at + 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_table(rows.slice(at, end - at))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeeze.compress(sink.getvalue().to_pybytes())], pa.binary())], ["block", "data"])
                block, at = block + 1, end


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()


class Block:
    """The fragments of a block's texts, in order."""

    def __init__(self, rows: pa.Table, least: int) -> None:
        text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        self.raw, self.offsets = flat(text)
        self.ids = pc.fill_null(rows.column("doc_id"), LAST).to_numpy()
        self.sums = Sums(self.raw)
        n = len(self.raw) - least + 1
        if n <= 0:
            self.starts = self.windows = self.row = np.zeros(0, np.int64)
            self.anchor = self.content = self.second = np.zeros(0, U)
            return
        grams = mixed(self.sums.windows(GRAM))
        # Of equal hashes (by their upper bits) the leftmost: the lower bits give way to the place.
        near = U((1 << 24) - 1)
        low = _sliding_min((grams & ~near) | (np.arange(len(grams)).astype(U) & near), least - GRAM + 1)
        place = np.arange(n) + ((low - np.arange(n).astype(U)) & near).astype(np.int64)
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[:n]
        inside = np.arange(n) + least <= self.offsets[row + 1]
        new = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))
        first = np.flatnonzero(new & inside)
        # The last window of each fragment: the one before the next beginning, or the last inside its text.
        ends = np.append(np.flatnonzero(new), n)
        stop = ends[np.searchsorted(ends, first, side="right")]
        stop = np.minimum(stop, self.offsets[row[first] + 1] - least + 1)
        self.starts, self.windows, self.row = first, stop - first, row[first]
        self.anchor = grams[place[first]]
        end = stop + least - 1
        self.content = mixed(self.sums.of(first, end) + U(0xD6E8FEB86659FD93) * self.windows.astype(U))
        self.second = mixed(Sums(self.raw, OTHER).of(first, end))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of each set of equal fragments, and the later ones."""
        order = np.lexsort((self.starts, self.second, self.content, self.anchor))
        a, c, d = self.anchor[order], self.content[order], self.second[order]
        later = np.append(False, (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])) if len(order) else np.zeros(0, bool)
        return np.sort(order[~later]), np.sort(order[later])

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, fragments) of the distinct fragments by anchor, in an order that is the same each time."""
        first, _ = self.distinct()
        bucket = (mixed(self.anchor[first]) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[order[a]]), first[order[a:b]]


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, ~U(0))
    padded[: len(h)] = h
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, 1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def _merged(ranges: np.ndarray) -> np.ndarray:
    """The same bytes in as few ranges as possible, sorted."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges["start"], ranges["row"]))]
    row, start = ranges["row"].astype(np.int64), ranges["start"].astype(np.int64)
    # Rows laid far apart on one line.
    far = int((start + ranges["length"]).max()) + 1
    a = row * far + start
    end = np.maximum.accumulate(a + ranges["length"])
    new = np.append(True, a[1:] > end[:-1])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), RANGE)
    out["row"], out["start"] = row[first], start[first]
    out["length"] = end[np.append(first[1:], len(a)) - 1] - a[first]
    return out


def _covered(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), RANGE)
    out["row"], out["start"], out["length"] = row, start, length
    return _merged(out)


# Counting fragments ---------------------------------------------------------------------------------------------------

#: Bytes of a counted fragment: 5 of its anchor, 8 and 4 of its content, 4 of its doc_id's distance from the block's first.
WIDTH = 21
#: What is told of a fragment: it is there once; it is the first of equal ones, under an anchor without others; a later one;
#: or it is to be sorted, with those of its anchor dealt over 2 ** (told - SORTED) tasks.
ALONE, FIRST, LATER, SORTED = range(4)


def _short(values: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _long(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), 8), np.uint8)
    out[:, : data.shape[1]] = data
    return out.view("<u8").ravel()


def _requests(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(_unpack(data.as_py()), least)
                base = int(block.ids[0])
                rows = []
                for bucket, own in block.dealt(buckets):
                    away = (block.ids[block.row[own]] - base).astype(U)
                    rows.append((bucket, number, base, np.hstack([_short(block.anchor[own], 5), _short(block.content[own], 8), _short(block.second[own], 4), _short(away, 4)]).tobytes()))
                kinds = [("bucket", pa.int32()), ("block", pa.int64()), ("base", pa.int64()), ("data", pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def by_bucket(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[tuple]]:
    """The rows of each run of equal buckets, one bucket at a time; tasks that get several have them sorted by bucket."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def by_task(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` by bucket: a task a bucket up to ``MOST_TASKS`` tasks, more buckets to a task, one after the other, beyond."""
    tasks = min(buckets, MOST_TASKS)
    dealt = rows.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks)).cast("int"))
    return dealt if tasks == buckets else dealt.sortWithinPartitions("bucket")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to be done with each fragment of each request, in the order of the request: a byte each, compressed."""
    for own in by_bucket(batches):
        data = np.frombuffer(b"".join(r[3] for r in own), np.uint8).reshape(-1, WIDTH)
        size = [len(r[3]) // WIDTH for r in own]
        anchor, content, second = _long(data[:, :5]), _long(data[:, 5:13]), _long(data[:, 13:17])
        place = np.repeat(np.array([r[2] for r in own], np.int64), size) + _long(data[:, 17:]).astype(np.int64)
        block = np.repeat(np.array([r[1] for r in own], np.int64), size)
        # Only fragments whose anchor is there again are worth more than a look.
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        new = np.append(True, a[1:] != a[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        order, group = order[many], group[many]
        inner = np.lexsort((block[order], place[order], second[order], content[order], group))
        order, group = order[inner], group[inner]
        c, d = content[order], second[order]
        lead = np.append(True, (group[1:] != group[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])) if len(order) else np.zeros(0, bool)
        kinds = np.bincount(group[lead], minlength=int(group[-1]) + 1 if len(group) else 0)[group]
        spread = np.ceil(np.log2(np.maximum(1, -(-kinds // HOT)))).astype(np.int64)
        told = np.zeros(len(anchor), np.uint8)
        told[order] = np.where(~lead, LATER, np.where(kinds == 1, FIRST, SORTED + spread))
        cuts = np.append(0, np.cumsum(size))
        out = [(own[0][0], r[1], zstandard.compress(told[a:b].tobytes(), 3)) for r, a, b in zip(own, cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "block", "told"])


# Repeats --------------------------------------------------------------------------------------------------------------

#: A fragment on its way to the suffix array (its bytes follow all of these). Only its windows whose hash is ``part`` modulo
#: 2 ** ``spread`` count there.
FRAGMENT = np.dtype([("anchor", "<u8"), ("place", "<i8"), ("block", "<i8"), ("row", "<u4"), ("start", "<u4"), ("length", "<u4"), ("part", "<u4"), ("spread", "u1")])
RANGES, TEXTS = range(2)
SENT = "kind int, bucket int, block long, data binary"


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _decisions(least: int, buckets: int):
    """From (block, data, told) rows of ``SENT``: ranges that are covered for sure, and fragments to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                block = Block(_unpack(data.as_py()), least)
                answers = {r["bucket"]: r["told"] for r in told or []}
                what = np.zeros(len(block.starts), np.uint8)
                what[block.distinct()[1]] = LATER
                for bucket, own in block.dealt(buckets):
                    what[own] = np.frombuffer(zstandard.decompress(answers[bucket]), np.uint8)
                at = block.starts - block.offsets[block.row]
                later = np.flatnonzero(what == LATER)
                ranges = [_covered(block.row[later], at[later], block.windows[later] + least - 1)]
                rows = []
                own, part = _parts(block, np.flatnonzero(what >= SORTED), what, least)
                if len(own):
                    head = np.zeros(len(own), FRAGMENT)
                    head["anchor"], head["place"], head["block"] = block.anchor[own], block.ids[block.row[own]], number
                    head["row"], head["start"], head["length"] = block.row[own], at[own], block.windows[own] + least - 1
                    head["part"], head["spread"] = part, what[own] - SORTED
                    bucket = (mixed(head["anchor"] + U(0x9E3779B97F4A7C15) * part.astype(U)) % U(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        some = order[a:b]
                        bytes_ = [block.raw[block.starts[own[i]] : block.starts[own[i]] + int(head["length"][i])] for i in some]
                        rows.append((TEXTS, int(bucket[some[0]]), 0, len(some).to_bytes(4, "little") + head[some].tobytes() + np.concatenate(bytes_).tobytes()))
                sure = _merged(np.concatenate(ranges))
                if len(sure):
                    rows.append((RANGES, 0, number, sure.tobytes()))
                if rows:
                    yield _sent(rows)

    return run


def _by_block(block: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield RANGES, 0, int(block[order[a]]), _merged(ranges[order[a:b]]).tobytes()


def _parts(block: Block, own: np.ndarray, what: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, part) of the fragments ``own`` with each part in which they have a window; part 0 of those that aren't spread."""
    spread = what[own].astype(np.int64) - SORTED
    one, more = own[spread == 0], own[spread > 0]
    if not len(more):
        return one, np.zeros(len(one), np.int64)
    n = block.windows[more]
    start = np.repeat(block.starts[more] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    of = np.repeat(np.arange(len(more)), n)
    part = (mixed(block.sums.of(start, start + least)) & ((U(1) << spread[spread > 0].astype(U)) - U(1))[of]).astype(np.int64)
    pairs = np.unique(of * (1 << 32) + part)
    return np.concatenate([one, more[pairs >> 32]]), np.concatenate([np.zeros(len(one), np.int64), pairs & ((1 << 32) - 1)])


def fragment_repeats(head: np.ndarray, data: np.ndarray, least: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, RANGE) of all occurrences but the first of the maximal repeats of some fragments (FRAGMENT and their bytes), about ``most`` suffixes at a time."""
    most = SUFFIXES if most is None else most
    size = head["length"].astype(np.int64)
    offsets = np.append(0, np.cumsum(size))
    rank = np.empty(len(head), np.int64)
    rank[np.lexsort((head["start"], head["row"], head["block"], head["place"]))] = np.arange(len(head))
    n = size - least + 1
    string = np.repeat(np.arange(len(head)), n)
    position = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    parts = max(1, -(-len(string) // most))
    chunk = np.zeros(len(string), np.int64)
    if parts > 1 or head["spread"].any():
        h = mixed(Sums(data).of(offsets[string] + position, offsets[string] + position + least))
        here = (h & ((U(1) << head["spread"].astype(U)) - U(1))[string]) == head["part"][string]
        chunk = np.where(here, ((h >> U(32)) % U(parts)).astype(np.int64), -1)
    for x in range(parts):
        own = np.flatnonzero(chunk == x) if parts > 1 or head["spread"].any() else slice(None)
        which, at, length = [], [], []
        for m, strings, positions in maximal_repeats(data, offsets, least, (string[own], position[own])):
            rest = np.arange(len(strings)) != np.argmin(rank[strings] * (1 << 20) + positions)
            which.append(strings[rest])
            at.append(positions[rest])
            length.append(np.full(len(strings) - 1, m))
        if which:
            found = np.concatenate(which)
            out = np.zeros(len(found), RANGE)
            out["row"], out["start"], out["length"] = head["row"][found], head["start"][found] + np.concatenate(at), np.concatenate(length)
            yield head["block"][found], out


def _compared(least: int):
    """From the fragments of a bucket, the ranges they cover, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches, 1):
            heads, texts = [], []
            for row in rows:
                n = int.from_bytes(row[3][:4], "little")
                heads.append(np.frombuffer(row[3], FRAGMENT, n, 4))
                texts.append(np.frombuffer(row[3], np.uint8, offset=4 + n * FRAGMENT.itemsize))
            del rows
            head, text = np.concatenate(heads), np.concatenate(texts)
            del heads, texts
            offsets = np.append(0, np.cumsum(head["length"].astype(np.int64)))
            order = np.lexsort((head["part"], head["anchor"]))
            a, part = head["anchor"][order], head["part"][order]
            work = np.cumsum(head["length"][order].astype(np.int64) - least + 1)
            # Whole anchors (or their parts) at a time, as many as make a suffix array of bounded size; a larger one by itself.
            ends = np.append(np.flatnonzero((a[1:] != a[:-1]) | (part[1:] != part[:-1])) + 1, len(a))
            own_work = np.diff(np.append(0, work[ends - 1]))
            chunk = work[ends - 1] // SUFFIXES + np.cumsum(own_work > SUFFIXES) + np.append(0, np.cumsum(own_work > SUFFIXES)[:-1])
            cuts = np.append(0, ends[np.append(np.flatnonzero(np.diff(chunk)), len(ends) - 1)])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[x:y]
                size = head["length"][own].astype(np.int64)
                data = text[np.repeat(offsets[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                for found in fragment_repeats(head[own], data, least):
                    yield _sent(list(_by_block(*found)))

    return run


# The operator ---------------------------------------------------------------------------------------------------------


def _listed(ranges: np.ndarray, rows: int) -> pa.Array:
    """The ranges of each row as a list of (start, length)."""
    values = pa.StructArray.from_arrays([pa.array(ranges[c].astype(np.int64)) for c in ("start", "length")], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ranges["row"], np.arange(rows + 1)).astype(np.int32)), values)


def _cut(extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows = _unpack(data.as_py())
                raw, offsets = flat(rows.column("text").combine_chunks())
                ranges = _merged(np.concatenate([np.frombuffer(x, RANGE) for x in found])) if found else np.zeros(0, RANGE)
                size = np.diff(offsets)
                start = offsets[ranges["row"]] + ranges["start"]
                gone = np.cumsum(np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + ranges["length"], minlength=len(raw) + 1))[:-1] > 0
                removed = np.bincount(ranges["row"], ranges["length"], len(size)).astype(np.int64)
                spans = np.bincount(ranges["row"], minlength=len(size))
                whole, kept = raw[~gone].tobytes(), np.cumsum(np.append(0, size - removed))
                pieces = [whole[a:b] for a, b in zip(kept[:-1], kept[1:], strict=True)]
                out = [pa.array(size), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                left = [rows.column("doc_id").combine_chunks()]
                keep = ["doc_id"]
                if extra:
                    keep = rows.schema.names
                    out.append(_listed(ranges, len(size)))
                    left = [rows.column(c).combine_chunks() if c != "text" else pa.array([x.decode("utf-8", "ignore") for x in pieces]) for c in keep]
                yield pa.RecordBatch.from_arrays([*left, *out], [*keep, *names, *(["removed"] if extra else [])])

    return run


@any_names
def strip(docs: DataFrame, least: int = 100, texts: bool = True) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans and kept_sha256 (of the bytes left), and, with ``texts``, its columns, the
    text being what is left (bytes of a character that was cut apart are dropped), and ``removed``, the stretches cut out."""
    spark = docs.sparkSession
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    rows = docs.select(*[F.col(quoted(c)) for c in docs.columns if c not in names]) if texts else docs.select("doc_id", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks = materialize(rows.mapInArrow(released(_pack), "block long, data binary"), "blocks")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 30 / TASK_FRAGMENTS))
    with scratch(spark) as keep:
        asked = blocks.mapInArrow(released(_requests(least, buckets)), "bucket int, block long, base long, data binary")
        told = materialize(by_task(asked, buckets).mapInArrow(released(_answers), "bucket int, block long, told binary"), "answers")
        answers = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "told")).alias("told"))
        decided = materialize(blocks.join(answers, "block", "left").select("block", "data", "told").mapInArrow(released(_decisions(least, buckets)), SENT), "decisions")
        compared = by_task(decided.where(F.col("kind") != RANGES), buckets).mapInArrow(released(_compared(least)), SENT)
        ranges = keep(decided.where(F.col("kind") == RANGES).unionByName(compared).select("block", "data"), "ranges")
    found = ranges.groupBy("block").agg(F.collect_list("data").alias("found"))
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields if texts or f.name == "doc_id")
    cut = blocks.join(found, "block", "left").select("block", "data", "found")
    return cut.mapInArrow(released(_cut(texts)), f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<struct<start: long, length: long>>" * texts)
