"""Phrases of words that stand together more often than their parts would by chance, per language.

1. A count-min sketch of all phrases of 1 to ``longest`` words: tasks send the cells that they counted, sums stop at ``least``,
   and of a cell only one bit stays: whether its sum reaches ``least``. It never does so too seldom, so phrases of which a cell,
   or a part, is below can't be frequent.
2. Texts are scanned chunk by chunk. What the sketch lets through of a chunk's phrases compiles into one automaton, which then
   counts all their occurrences in it, overlapping ones too. Words are spelled as ``DIGITS`` characters, each place with an
   alphabet of its own and a delimiter of another at the end of every piece, so no match starts or ends within a word or crosses
   pieces; alphabets are small, as a node of the automaton looks its children up one by one. Chunks are of one language, cut
   between pieces, and bounded in bytes whatever the length of a text.
3. Counts are summed by phrase; thresholds, parts and scores are exact, whatever the sketch let through.

The sketch has a cell for every fourth byte of text, so it grows with the corpus, up to ``MOST_CELLS`` a row (32 MB of bits,
the only thing that is broadcast); beyond that it lets more phrases through, which costs rows in the sum but changes no result.

Null texts are empty; a null lang is ``und``. Repeated rows count each. Words and phrases are compared by bytes. An empty table
gives no rows. Columns beyond lang and text are ignored, whatever their names. A single piece, not a text, must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.bytehash import FACTOR, Sums, U, mixed
from weirflow.llm.common import bounded, materialize, released, trim

#: Bytes of a chunk, rows of the sketch, cells of a segment (bits), most cells of a row, cells that are counted at once.
CHUNK, ROWS, SEGMENT, MOST_CELLS, HELD = 3 << 20, 2, 20, 1 << 27, 6_000_000
UNKNOWN = "und"
#: Characters that spell a word in the automaton, where the alphabet of each begins, the character of a piece's end.
DIGITS, ALPHABETS, GUARD = 3, (0x100, 0x1100, 0x2100), 1

#: A-Z become small, what ends a piece a line feed, a tab a space; nothing else stands between words.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, bytes]]:
    """(language, pieces parted by line feeds): about ``size`` bytes at a time, of one language each."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    for b in batches:
        for lang, text in zip(*(b.column(i).cast(pa.large_binary()).to_pylist() for i in (0, 1)), strict=True):
            at = 0
            raw = text.translate(TABLE) if text else b""
            while at < len(raw):  # a long text is cut between pieces
                end = len(raw) if len(raw) - at <= size else raw.rfind(b"\n", at, at + size)
                end = end if end >= 0 else raw.find(b"\n", at + size)
                part = raw[at : end if end >= 0 else len(raw)]
                at += len(part) + 1
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sum(sizes.values()) >= size:
                    largest = max(sizes, key=sizes.__getitem__)
                    sizes.pop(largest)
                    yield largest, b"\n".join(held.pop(largest))
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


class Chunk:
    """The words of a chunk as numbers: ``ids`` with 0 at each piece's end, ``words`` by number, and hashes of all phrases."""

    def __init__(self, lang: bytes, raw: bytes) -> None:
        numbers: dict[bytes, int] = {}
        new = count(1).__next__
        self.ids: list[int] = []
        for piece in raw.split(b"\n"):
            if ws := piece.split():
                self.ids += [numbers.get(w) or numbers.setdefault(w, new()) for w in ws]
                self.ids.append(0)
        self.words = [b"", *numbers]
        self.at = np.array(self.ids, np.int64)
        self.n_words = int(np.count_nonzero(self.at))
        ends = np.cumsum([len(w) for w in self.words])
        sums = Sums(np.frombuffer(b"".join(self.words), np.uint8))
        hashes = mixed(sums.of(np.concatenate([[0], ends[:-1]]), ends) + U(int.from_bytes(hashlib.blake2b(lang, digest_size=8).digest(), "little")))
        self.hashes = hashes[self.at]

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of ``n`` words start, and their hashes."""
        if len(self.at) < n:
            return np.zeros(0, np.int64), np.zeros(0, U)
        inside = np.ones(len(self.at) - n + 1, bool)
        h = np.full(len(inside), n, U)
        for j in range(n):
            inside &= self.at[j : len(inside) + j] != 0
            h = (h ^ self.hashes[j : len(inside) + j]) * FACTOR
            h ^= h >> U(29)
        starts = np.flatnonzero(inside)
        return starts, mixed(h[starts])

    def spelled(self) -> str:
        """The chunk with ``DIGITS`` characters a word."""
        base = 2
        while base**DIGITS < len(self.words):
            base += 1
        letters = np.empty((len(self.at), DIGITS), np.uint32)
        for j, first in enumerate(ALPHABETS):
            letters[:, j] = first + self.at // base ** (DIGITS - 1 - j) % base
        letters[self.at == 0] = GUARD
        return letters.tobytes().decode("utf-32-le")


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(h + U(row) * FACTOR) >> U(64 - bits)).astype(np.int64)


def _packed(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, those of the lowest place first: most of the others are zero, and pack to nothing."""
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, n, asbytes=True)


def _sketch(texts: DataFrame, longest: int, least: int, bits: int, chunk: int) -> np.ndarray:
    """One bit a cell and row: the sum of the cell reaches ``least``. Packed, a row of the array a row of the sketch."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segment = min(SEGMENT, bits)
    segments = ROWS << (bits - segment)
    salts = max(1, parts // segments)

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts

        def counted(row: int, found: list[np.ndarray]) -> pa.RecordBatch:
            cells, times = np.unique(np.concatenate(found), return_counts=True)
            times = np.minimum(times, least).astype(np.uint8)
            cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << segment))
            rows = [((row << (bits - segment)) + s, cells[a:b], times[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            packed = [_planes(np.diff(c - (c[0] >> segment << segment), prepend=np.uint32(0))) + t.tobytes() for _, c, t in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([len(p) for p in packed], pa.int32()), pa.array([_packed(p) for p in packed], pa.binary())], names=["segment", "salt", "n", "cells"])

        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for lang, raw in _chunks(batches, chunk):
            words = Chunk(lang, raw)
            hashes = np.concatenate([words.phrases(n)[1] for n in range(1, longest + 1)])
            for row in range(ROWS):
                held[row].append(_cells(hashes, row, bits).astype(np.uint32))
            del words, hashes
            if sum(map(len, held[0])) >= HELD:
                for row in range(ROWS):
                    yield counted(row, held[row])
                    held[row] = []
        if any(map(len, held[0])):
            for row in range(ROWS):
                yield counted(row, held[row])

    def add_up(dense: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sums = None, np.zeros(1 << segment, np.uint8)

            def out() -> pa.RecordBatch:
                raw = np.packbits(sums >= least).tobytes() if not dense else sums.tobytes()
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([len(raw)], pa.int32()), pa.array([_packed(raw)], pa.binary())], names=["segment", "salt", "n", "cells"])

            for b in batches:
                for seg, salt, n, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (seg, salt) != now:
                        if now is not None:
                            yield out()
                        now, sums = (seg, salt), np.zeros(1 << segment, np.uint8)
                    raw = np.frombuffer(_unpacked(cells, n), np.uint8)
                    if dense or salts == 1:
                        at = np.cumsum(raw[: n // 5 * 4].reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.int64)
                        sums[at] = np.minimum(sums[at] + raw[n // 5 * 4 :], least)
                    else:
                        sums = np.minimum(sums + raw, least)
            if now is not None:
                yield out()

        return released(run)

    kind = "segment int, salt int, n int, cells binary"
    cells = texts.mapInArrow(released(count_cells), kind)
    for dense in [True, False] if salts > 1 else [False]:
        cells = cells.repartition("segment", "salt").sortWithinPartitions("segment", "salt").mapInArrow(add_up(dense), kind)
    found = np.zeros((segments, max(1, (1 << segment) // 8)), np.uint8)
    for r in cells.collect():  # bounded: a bit a cell
        found[r.segment] = np.frombuffer(_unpacked(bytes(r.cells), r.n), np.uint8)
    return found.reshape(ROWS, -1)


def counts(docs: DataFrame, longest: int = 3, least: int = 10, cells: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, size, f): all phrases of 1 to ``longest`` words, parted by spaces, with f >= ``least`` occurrences; size 0
    and the empty phrase have the number of words. ``cells`` overrides the size of a row of the sketch (a power of two)."""
    if not 1 <= least <= 127:
        raise ValueError("least must be 1 to 127")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    if cells is None:
        volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = 1 << min(max(volume // 4, 1 << 16) - 1, MOST_CELLS - 1).bit_length()
    bits = cells.bit_length() - 1
    hot = spark.sparkContext.broadcast(_sketch(texts, longest, least, bits, chunk))

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        frequent = lambda h: np.logical_and.reduce([(hot.value[r][(c := _cells(h, r, bits)) >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1 for r in range(ROWS)])
        for lang, raw in _chunks(batches, chunk):
            words = Chunk(lang, raw)
            text, n_ids = words.spelled(), len(words.words)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            phrases, sizes, times = [b""], [0], [words.n_words]
            compiled: list[bytes] = []
            part = np.ones(len(words.at) + 1, bool)
            for n in range(1, longest + 1):
                starts, h = words.phrases(n)
                if n > 1:  # both its parts of n - 1 words may be frequent
                    good = part[starts] & part[starts + 1]
                    starts, h = starts[good], h[good]
                starts = starts[frequent(h)]
                part = np.zeros(len(words.at) + 1, bool)
                part[starts] = True
                each = np.stack([words.at[starts + j] for j in range(n)], 1)
                if n == 1:
                    own, found = np.unique(each, return_counts=True)
                    phrases += [words.words[i] for i in own.tolist()]
                    sizes += [1] * len(own)
                    times += found.tolist()
                    continue
                keys = reduce(lambda a, b: a * n_ids + b, each.T) if n_ids**n < 1 << 62 else np.unique(each, axis=0, return_inverse=True)[1].ravel()
                first = np.sort(np.unique(keys, return_index=True)[1])  # words that come early are frequent, and found first
                for s, key in zip(starts[first].tolist(), each[first].tolist(), strict=True):
                    automaton.add_word(text[DIGITS * s : DIGITS * (s + n)], len(compiled))
                    compiled.append(b" ".join([words.words[i] for i in key]))
                sizes += [n] * len(first)
            if compiled:
                automaton.make_automaton()
                found = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(compiled))
                phrases += compiled
                times += found.tolist()
            del automaton, compiled, words, text
            trim()
            names = pa.array([lang] * len(phrases), pa.binary()).cast(pa.string())
            for a in range(0, len(phrases), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([names[z], pa.array(phrases[z], pa.binary()).cast(pa.string()), pa.array(sizes[z], pa.int32()), pa.array(times[z], pa.int64())], names=["lang", "phrase", "size", "f"])

    found = texts.mapInArrow(released(count_phrases), "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50, cells: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words with a >= ``least``.

    Of the cuts in two, l and r are the counts of the parts at the one of lowest score = floor(10**6 * a * a / (l * r)), ties
    to the earliest. A phrase goes if a longer frequent one that holds it has ``share`` percent of its occurrences. Order: score
    and a descending, phrase ascending by bytes.
    """
    known = materialize(counts(docs, longest, least, cells, chunk), "phrases")
    parts = known.where((F.col("size") > 0) & (F.col("size") < longest)).select("lang", F.col("phrase").alias("part"), "f")
    n_parts, width = parts.agg(F.count("*"), F.coalesce(F.max(F.octet_length("part")), F.lit(0))).first()
    held = lambda name, f: bounded(parts.select("lang", F.col("part").alias(name), F.col("f").alias(f)), n_parts, width + 32)
    candidates = known.where("size > 1").withColumnRenamed("f", "a")
    ws, size = F.split("phrase", " "), F.col("size")
    joined = lambda start, n: F.array_join(F.slice("ws", start, n), " ")
    cut = candidates.withColumn("ws", ws).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "size", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, size - F.col("k")).alias("right"))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    both = cut.join(held("left", "l"), ["lang", "left"]).join(held("right", "r"), ["lang", "right"])
    both = both.withColumns({"top": exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": exact("l") * exact("r")})
    scored = both.withColumn("score", F.expr("top div under")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # sub-phrases of two words or more, of every longer candidate
    inner = candidates.where("size > 2").withColumn("ws", ws).withColumn("n", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)))
    longer = inner.select("lang", joined(F.col("i"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(exact("longer") * 100 < exact("a") * share, F.lit(True)))
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = kept.withColumn("in_salt", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("in_salt") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
