"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a run of words that ends at a sentence's end (. ! ?) or at a word whose hash says so, so an edit changes the
paragraphs that it touches and no others. The n-th occurrence of a digest counts as a digest of its own. Each digest is added
to one cell of each of three parts of a sketch; a cell holds a count, the sum of digests and the sum of their check hashes.

The sketches of two versions subtract cell by cell; what is left is peeled: a cell with one digest gives it away, and taking
it out of its other cells uncovers more, until the digests that only one version has are recovered. If cells remain, both
versions are sketched again, four times larger; after ``RETRIES`` of these (equal digests by chance), by their plain sets.
The likeness is the Jaccard index of the two sets, from what was peeled and the sketches' totals.

A fingerprint is a sketch as text. It has as many cells as it takes to peel itself, so whoever has two fingerprints can tell
what differs without the texts: ``differences`` subtracts them at the larger size of the two, the smaller peeled and sketched
again, and retries larger with the peeled digests.

For the order of a table see ``with_next``.

Defined cases: a null text is empty; an empty text has no paragraph, an empty sketch, and likeness 1 to itself and 0 to any
other; equal texts have equal fingerprints; the next of rows that share a doc_id is that whose text's hash comes next, and of
equal rows another of them, the last excepted; rows with a null doc_id come last; the only row of a table is its own next; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.bytehash import Sums, U, flat, mixed, words
from weirflow.llm.common import hash_below, released
from weirflow.llm.packing import slices

#: Cells in each of the three parts of a fingerprint, at least; how much larger each retry is, and how many; one word in so many ends a paragraph.
PART_CELLS, RETRY, RETRIES, EVERY = 16, 4, 3, 8
#: Bytes of text in a partition of the order, about, and partitions at most; sampled keys for each; bytes of text taken at once.
PARTITION_BYTES, MOST_PARTS, SAMPLED, SLICE_BYTES = 32 << 20, 1 << 15, 40, 2 << 20
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
CELL = np.dtype([("cell", "<u4"), ("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The paragraph digests of all texts, one text after the other, and how many each has."""
    raw, offsets = flat(texts)
    starts, ends, doc = words(raw, offsets)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    h = mixed(Sums(raw).of(starts, ends))
    last = STOP[raw[ends - 1]] | (h % U(EVERY) == 0) | np.append(doc[1:] != doc[:-1], True)
    first = np.flatnonzero(np.append(True, last[:-1]))
    # Order within the paragraph matters: each word's hash is turned by its place.
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    d = mixed(np.add.reduceat(mixed(h + U(0xA24BAED4963EE407) * (place.astype(U) + U(1))), first))
    doc = doc[first]
    # The n-th occurrence of a digest in a text.
    order = np.lexsort((d, doc))
    same = np.append(False, (d[order][1:] == d[order][:-1]) & (doc[order][1:] == doc[order][:-1]))
    run = np.arange(len(d)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))
    nth = np.empty(len(d), U)
    nth[order] = run.astype(U)
    return np.where(nth > 0, mixed(d + nth * U(0x8CB92BA72F3D8DD7)), d), np.bincount(doc, minlength=len(texts))


def part_cells(sizes: np.ndarray) -> np.ndarray:
    """Cells of each part for so many digests: a power of two, at least two thirds of their number."""
    need = np.maximum(2 * np.asarray(sizes, np.int64) // 3, PART_CELLS)
    return np.int64(1) << np.ceil(np.log2(need)).astype(np.int64)


def _places(keys: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """The cell of each key in each of the three parts; ``cells``: of a part, for each key."""
    return [(mixed(keys + U(p * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & (cells.astype(U) - U(1))).astype(np.int64) + p * cells for p in range(3)]


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ U(0x5851F42D4C957F2D)) >> U(32)


class Sketches:
    """Sketches laid end to end, sketch s with ``3 * cells[s]`` cells from ``first[s]`` on."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells.astype(np.int64)
        self.first = np.cumsum(3 * self.cells) - 3 * self.cells
        n = int(3 * self.cells.sum())
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)

    def add(self, sketch: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        turned = sign.astype(np.int64).view(U)
        own, check = keys * turned, _check(keys) * turned
        for at in _places(keys, self.cells[sketch]):
            at = at + self.first[sketch]
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, own)
            np.add.at(self.checks, at, check)

    @classmethod
    def of(cls, keys: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> Sketches:
        out = cls(cells)
        out.add(np.repeat(np.arange(len(sizes)), sizes), keys, np.ones(len(keys), np.int64))
        return out

    def _cells_of(self, rows: np.ndarray) -> np.ndarray:
        n = 3 * self.cells[rows]
        before = np.cumsum(n) - n
        return np.repeat(self.first[rows] - before, n) + np.arange(n.sum())

    def minus(self, rows: np.ndarray, other: Sketches, others: np.ndarray) -> Sketches:
        """The differences of own sketches ``rows`` and as large ones ``others`` of ``other``, cell by cell."""
        out = Sketches(self.cells[rows])
        a, b = self._cells_of(rows), other._cells_of(others)
        out.count, out.keys, out.checks = self.count[a] - other.count[b], self.keys[a] - other.keys[b], self.checks[a] - other.checks[b]
        return out

    def copy(self) -> Sketches:
        none = Sketches(np.zeros(0, np.int64))
        none.cells, none.first = self.cells, self.first
        none.count, none.keys, none.checks = self.count.copy(), self.keys.copy(), self.checks.copy()
        return none

    def text(self, s: int) -> str:
        """The sketch as text, in base64: how many cells a part has, and the cells that aren't empty. '' for an empty one."""
        at = slice(self.first[s], self.first[s] + 3 * self.cells[s])
        used = np.flatnonzero((self.count[at] != 0) | (self.keys[at] != 0))
        if not len(used):
            return ""
        row = np.zeros(len(used), CELL)
        row["cell"], row["count"], row["key"], row["check"] = used, self.count[at][used], self.keys[at][used], self.checks[at][used] & U(0xFFFFFFFF)
        return base64.b64encode(int(self.cells[s]).to_bytes(4, "little") + row.tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Sketches:
        """One sketch from its text."""
        data = base64.b64decode(text)
        out = cls(np.array([int.from_bytes(data[:4], "little") if data else PART_CELLS]))
        row = np.frombuffer(data[4:], CELL)
        out.count[row["cell"]], out.keys[row["cell"]], out.checks[row["cell"]] = row["count"], row["key"], row["check"]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest, sign) of the digests of one version only (+1: the first), and of each sketch whether nothing was left."""
        n = len(self.cells)
        owner = np.repeat(np.arange(n), 3 * self.cells)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.count)
        while len(look):
            one = look[np.abs(self.count[look]) == 1]
            sign = self.count[one]
            key = self.keys[one] * sign.view(U)
            # Sums of check hashes are held to their low 32 bits, as a fingerprint has them.
            pure = (self.checks[one] * sign.view(U)) & U(0xFFFFFFFF) == _check(key) & U(0xFFFFFFFF)
            one, sign, key = one[pure], sign[pure], key[pure]
            if not len(one):
                break
            # A digest may lie alone in more than one cell: it is taken out once.
            order = np.lexsort((key, owner[one]))
            once = order[np.append(True, (key[order][1:] != key[order][:-1]) | (owner[one][order][1:] != owner[one][order][:-1]))]
            one, sign, key = one[once], sign[once], key[once]
            sketch = owner[one]
            found.append((sketch, key, sign))
            self.add(sketch, key, -sign)
            look = np.unique(np.concatenate([at + self.first[sketch] for at in _places(key, self.cells[sketch])]))
        left = np.bincount(owner, (self.count != 0) | (self.keys != 0) | (self.checks & U(0xFFFFFFFF) != 0), n) > 0
        none = (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
        sketch, key, sign = (np.concatenate(x) for x in zip(none, *found, strict=True))
        return sketch, key, sign, ~left


def _of(keys: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the texts ``rows``, and how many each has."""
    n = sizes[rows]
    start = (np.cumsum(sizes) - sizes)[rows]
    before = np.cumsum(n) - n
    return keys[np.repeat(start - before, n) + np.arange(n.sum())], n


class Version:
    """Digests of some texts, and their sketches in the sizes of fingerprints."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, sketches: Sketches | None = None) -> None:
        self.keys, self.sizes = keys, sizes
        self.sketches = peelable(keys, sizes) if sketches is None else sketches

    def take(self, rows: np.ndarray) -> Version:
        cells = Sketches(self.sketches.cells[rows])
        at = self.sketches._cells_of(rows)
        cells.count, cells.keys, cells.checks = self.sketches.count[at], self.sketches.keys[at], self.sketches.checks[at]
        return Version(*_of(self.keys, self.sizes, rows), cells)

    def texts(self) -> list[str]:
        return [self.sketches.text(s) for s in range(len(self.sizes))]


def peelable(keys: np.ndarray, sizes: np.ndarray) -> Sketches:
    """Sketches of the texts, each as large as it takes to peel it: four times larger where ``part_cells`` doesn't do."""
    cells = part_cells(sizes)
    out = Sketches.of(keys, sizes, cells)
    for _ in range(RETRIES):
        *_, done = out.copy().peel()
        if done.all():
            break
        cells = np.where(done, cells, cells * RETRY)
        out = Sketches.of(keys, sizes, cells)
    return out


def compare_versions(a: Version, b: Version) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of text i of ``a`` and text i of ``b``: likeness, the digests that only the first has, and those that only the second has."""
    n = len(a.sizes)
    likeness = np.ones(n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle(rows: np.ndarray, sketch: np.ndarray, key: np.ndarray, sign: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Note what was peeled of the ``rows`` that are done; the others are given back."""
        good = done[sketch]
        sketch, key, sign = sketch[good], key[good], sign[good]
        found.append((rows[sketch], key, sign))
        first = np.bincount(sketch[sign > 0], minlength=len(rows))
        second = np.bincount(sketch[sign < 0], minlength=len(rows))
        both, union = a.sizes[rows] - first, a.sizes[rows] + second
        likeness[rows[done]] = np.where(union[done] > 0, both[done] / np.maximum(union[done], 1), 1.0)
        return rows[~done]

    cells = np.maximum(a.sketches.cells, b.sketches.cells)
    same = np.flatnonzero(a.sketches.cells == b.sketches.cells)
    todo = np.flatnonzero(a.sketches.cells != b.sketches.cells)
    left = settle(same, *a.sketches.minus(same, b.sketches, same).peel()) if len(same) else same
    cells[left] *= RETRY
    todo = np.concatenate([todo, left])
    for _ in range(RETRIES):
        if not len(todo):
            break
        both = [Sketches.of(*_of(v.keys, v.sizes, todo), cells[todo]) for v in (a, b)]
        every = np.arange(len(todo))
        todo = settle(todo, *both[0].minus(every, both[1], every).peel())
        cells[todo] *= RETRY
    for row in todo:
        x, y = (np.unique(_of(v.keys, v.sizes, np.array([row]))[0]) for v in (a, b))
        gone, come = np.setdiff1d(x, y), np.setdiff1d(y, x)
        found.append((np.full(len(gone) + len(come), row), np.concatenate([gone, come]), np.append(np.ones(len(gone), np.int64), -np.ones(len(come), np.int64))))
        likeness[row] = 1 - (len(gone) + len(come)) / max(1, len(np.union1d(x, y)))
    row, key, sign = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)), *found, strict=True))
    order = np.lexsort((key, row))
    row, key, sign = row[order], key[order], sign[order]
    sides = []
    for s in (1, -1):
        own = sign == s
        sides.append(np.split(key[own], np.searchsorted(row[own], np.arange(1, n))))
    return likeness, sides[0], sides[1]


def differences(first: str, second: str) -> tuple[float, list[int], list[int]] | None:
    """From two fingerprints alone: likeness, and the digests that only the first and only the second has. None if one is damaged."""
    versions = []
    for text in (first, second):
        try:
            sketch = Sketches.read(text)
        except (ValueError, IndexError):
            return None
        _, key, sign, done = sketch.copy().peel()
        if not done.all() or (sign < 0).any():
            return None
        versions.append(Version(key, np.array([len(key)]), sketch))
    likeness, gone, come = compare_versions(*versions)
    return float(likeness[0]), gone[0].tolist(), come[0].tolist()


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third (code points, rounded down) replaced by as many of the first of ``following``, or all."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


# The order of a table -------------------------------------------------------------------------------------------------


def _keys(doc_id: pa.Array, h: pa.Array) -> np.ndarray:
    """Keys that sort as bytes: doc_id descending, nulls last, then the text's hash."""
    out = np.zeros((len(doc_id), 17), np.uint8)
    out[:, 0] = pc.is_null(doc_id).to_numpy(zero_copy_only=False)
    top = U(1 << 63)
    out[:, 1:9] = (~pc.fill_null(doc_id, 0).to_numpy().view(U) ^ top).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = (h.to_numpy().view(U) ^ top).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel() if len(out) else np.zeros(0, "S17")


class Parts:
    """Which part of the order a key falls into. A bound that stands more than once is a key of many rows: it has that many parts."""

    def __init__(self, bounds: np.ndarray) -> None:
        self.bounds, self.times = np.unique(bounds, return_counts=True)
        # Group g: the keys above bound g - 1, up to bound g. Its rows go to part start[g]; those equal to bound g, to any of its parts.
        self.parts = np.append(self.times, 1)
        self.start = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def group(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, side="left")

    def place(self, keys: np.ndarray, seen: dict[int, int], salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(group, part) of each key. ``seen`` counts a task's rows of each key of many rows: the first goes to the last of its parts, so that this is never empty."""
        group = self.group(keys)
        part = self.start[group]
        many = np.flatnonzero(self.parts[group] > 1)
        many = many[keys[many] == self.bounds[group[many]]] if len(many) else many
        for i in many:
            g = int(group[i])
            n = seen.get(g, 0)
            seen[g] = n + 1
            part[i] += self.parts[g] - 1 if n == 0 else (n + salt) % self.parts[g]
        return group, part


def _bounds(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Bounds that cut the sampled keys into ``parts`` of about equal weight."""
    order = np.argsort(keys, kind="stable")
    total = np.cumsum(weights[order])
    if not len(total) or parts < 2:
        return np.zeros(0, "S17")
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return keys[order][np.minimum(at, len(total) - 1)]


def with_next(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(_part, _last, doc_id, _hash, text), in partitions that follow each other in descending doc_id, each sorted, and ended by the
    row that comes next (marked ``_last``), so that every row's next is in its partition. Texts are shuffled once.

    Bounds come from a sample of keys (doc_id and the text's hash), weighted by bytes, so a partition holds about
    ``PARTITION_BYTES`` of text, or more where ``MOST_PARTS`` don't suffice; the sample and the bounds are at most
    ``SAMPLED * MOST_PARTS`` keys of 17 bytes. What ends a partition is the first key of the next one that has rows; every task
    that has a row of that key sends one copy of it along. Rows with the same doc_id and text may spread over partitions: there
    the next of the last row is a row with the same text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()
    parts = int(min(MOST_PARTS, max(1, math.ceil(size / PARTITION_BYTES))))
    bounds = np.zeros(0, "S17")
    if parts > 1:
        # By doc_id and text, and by place too, so that rows that repeat are sampled as others are.
        drawn = rows.select("doc_id", "_hash", (F.octet_length("text") + 16).alias("w")).where(hash_below(min(1.0, SAMPLED * parts / n), F.col("doc_id"), F.col("_hash"), F.monotonically_increasing_id()))
        sample = drawn.limit(2 * SAMPLED * MOST_PARTS).toArrow().combine_chunks()
        bounds = _bounds(_keys(sample.column("doc_id").combine_chunks(), sample.column("_hash").combine_chunks()), sample.column("w").to_numpy(), parts)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Parts(bounds))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest key of each group that the task has."""
        least: dict[int, bytes] = {}
        for batch in batches:
            keys = _keys(batch.column(0), batch.column(1))
            group = sent.value.group(keys)
            order = np.lexsort((keys, group))
            first = order[np.append(True, group[order][1:] != group[order][:-1])] if len(order) else order
            for g, k in zip(group[first].tolist(), keys[first].tolist(), strict=True):
                k = k.ljust(17, b"\0")
                least[g] = min(least.get(g, k), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.binary())], ["g", "k"])

    found = rows.select("doc_id", "_hash").mapInArrow(released(heads), "g int, k binary").groupBy("g").agg(F.min("k").alias("k")).toArrow()
    there = sorted(zip(found.column("g").to_pylist(), found.column("k").to_pylist(), strict=True))
    # The head of a group ends the last part of the group before it; that of the first, the last group.
    final = {g: int(sent.value.start[g] + sent.value.parts[g] - 1) for g, _ in there}
    ends = spark.sparkContext.broadcast({g: (k, final[there[i - 1][0]]) for i, (g, k) in enumerate(there)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its part, and, once, a copy of each row that ends another part."""
        seen: dict[int, int] = {}
        told: set[int] = set()
        salt = TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, 2, SLICE_BYTES):
                keys = _keys(piece.column(0), piece.column(1))
                group, part = sent.value.place(keys, seen, salt)
                copies = [(i, ends.value[g][1]) for i, (g, k) in enumerate(zip(group.tolist(), keys.tolist(), strict=True)) if g not in told and k.ljust(17, b"\0") == ends.value[g][0] and not told.add(g)]
                rows = piece.take(pa.array([i for i, _ in copies], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), bool)), *piece.columns], ["_part", "_last", "doc_id", "_hash", "text"])
                if copies:
                    yield pa.RecordBatch.from_arrays([pa.array([p for _, p in copies], pa.int32()), pa.array([True] * len(copies)), *rows.columns], ["_part", "_last", "doc_id", "_hash", "text"])

    dealt = rows.select("doc_id", "_hash", "text").mapInArrow(released(deal), "_part int, _last boolean, doc_id long, _hash long, text string")
    return dealt.repartitionById(sent.value.count, F.col("_part")).sortWithinPartitions("_part", "_last", F.col("doc_id").desc_nulls_last(), "_hash"), sent


class NoNext(RuntimeError):
    """A partition without the row that ends it: the table's rows were not the same each time they were read."""


def compare(docs: DataFrame) -> DataFrame:
    """A row a document: its fingerprint, that of its edited text, the likeness to the edited and to the next text, and the
    digests that the edit took away and brought."""

    def rows_of(texts: list[str], following: list[str], doc_id: pa.Array, version: Version, own: np.ndarray, next_: Version) -> pa.RecordBatch:
        new = [edited_text(t, f) for t, f in zip(texts, following, strict=True)]
        edited = Version(*digests(pa.array(new, pa.large_string())))
        this = version.take(own)
        near, gone, come = compare_versions(this, edited)
        near_next, _, _ = compare_versions(this, next_)
        lists = [pa.array([x.view(np.int64) for x in side], pa.list_(pa.int64())) for side in (gone, come)]
        return pa.RecordBatch.from_arrays(
            [
                doc_id,
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                pa.array(this.texts()),
                pa.array(edited.texts()),
                pa.array(near),
                pa.array(near_next),
                *lists,
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "gone", "come"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for part in slices(batch, 4, SLICE_BYTES):
                # The last row waits for its next.
                rows = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks().to_batches()[0]
                held = pa.RecordBatch.from_pylist(rows.slice(rows.num_rows - 1).to_pylist(), rows.schema)
                texts, last = rows.column(4).to_pylist(), rows.column(1).to_numpy(zero_copy_only=False)
                own = np.flatnonzero(~last[:-1])
                if not len(own):
                    continue
                version = Version(*digests(rows.column(4)))
                yield rows_of([texts[i] for i in own], [texts[i + 1] for i in own], rows.column(2).take(pa.array(own)), version, own, version.take(own + 1))
        if held is not None and not held.column(1)[0].as_py():
            # The last of rows that are equal, in a part of theirs before the last.
            group = parts.value.group(_keys(held.column(2), held.column(3)))[0]
            if held.column(0)[0].as_py() >= parts.value.start[group] + parts.value.parts[group] - 1:
                raise NoNext("no row ends this partition")
            text, version = held.column(4).to_pylist(), Version(*digests(held.column(4)))
            yield rows_of(text, text, held.column(2), version, np.zeros(1, np.int64), version)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, gone array<long>, come array<long>"
    ordered, parts = with_next(docs)
    return ordered.mapInArrow(released(run), schema)
