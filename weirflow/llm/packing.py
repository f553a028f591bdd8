"""Packing by sums of squares, online.

Every task packs the documents of its own partition, in their order. A document is turned into ids; whole windows are cut
off it at once, and the rest goes into the open window whose fill level makes the sum of squared counts of partially filled
windows, over the levels, smallest (a new window is level 0; of equal levels the fullest). The counts are kept in one array
indexed by level. A document that fits a window is placed whole. At most ``OPEN`` windows are open: where a new one would be
too many, the fullest is closed as it is, if its gap is at most ``GAP`` of the window; only where none is that full (documents
that leave gaps which none fills) is the document cut to fill the fullest that it can.

When the partition ends, the documents in open windows are placed once more, the longest first, each where it fits tightest.
Windows with a gap of at most ``GAP`` are closed as they are. What the others hold is laid end to end, cut at the window size;
the last, unfilled window is cut into lengths that are powers of two, which need no padding.

Memory is that of a slice of texts and of the open windows. Nothing is shuffled; a lost task is simply run again, and its
sequence ids are its own (partition number in the high bits).

Defined cases: a null text is empty, and an empty text is the end id alone; repeated rows are packed each; texts of any
length are cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weirflow.llm.common import released, trim

#: Windows open at once, share of a window that may be padding, bytes of text taken at once, stems a task remembers.
OPEN, GAP, SLICE_BYTES, REMEMBERED = 1024, 1 / 16, 6 << 20, 100_000
SPLIT, TAIL = "<|endoftext|>", ".,!?;:|"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _gather(store: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs store[start : start + length], one after the other."""
    before = np.cumsum(lengths) - lengths
    return store[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


class Words:
    """Ids of texts for a tokenizer that never joins what white space parts, and parts a letter from the punctuation behind it.

    Whether the tokenizer does so is tried on loading; one that doesn't is asked for each text as a whole.

    A text is its words; a word is a stem and the punctuation behind it. Distinct stems are encoded once a slice, frequent
    ones once a task. Stems of lower-case letters in normal form, on which the tokenizer's rules do nothing, are encoded
    without the rules.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = not self._as_expected()
        self.rules = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.no_rules = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.index: dict[str, int] = {}
        if self.plain:
            return
        self.split_id = self.tokenizer.token_to_id(SPLIT)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    #: A text in whose ids each rule shows that the splitting here rests on.
    PROBE = "It's  THE <|endoftext|> Día—99 naïve,words...\tstr.aße ﬁne (x)|y; x\u0301 don't! '' 1,000.5 ɐ <| e:t |> İ\n\n ß. "

    def _as_expected(self) -> bool:
        """Whether this tokenizer's ids are those of its words, on a text that has what could join or part them otherwise."""
        if self.tokenizer.token_to_id(SPLIT) is None or not any(w.endswith("</w>") for w in self.tokenizer.get_vocab()):
            return False
        words = self.PROBE.split()
        apart = [i for w in words for i in self._ids(w)]
        tails = [i for w in words for part in self._parted(w) for i in self._ids(part)]
        upper = [i for w in words for i in self._ids(w.lower() if w.isascii() and "<" not in w else w)]
        return self._ids(self.PROBE) == apart == tails == upper

    @staticmethod
    def _parted(word: str) -> list[str]:
        stem = word.rstrip(TAIL)
        return [stem, word[len(stem) :]] if stem and stem != word and (stem[-1].isascii() and stem[-1].isalpha()) else [word]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text as it is, for a tokenizer whose words can't be told apart here."""
        for t in texts.fill_null("").to_pylist():
            ids = np.array(self._ids(t), np.uint32)
            yield ids, np.array([len(ids)])

    @staticmethod
    def _bare(stem: str) -> bool:
        return stem.isalpha() and max(stem) < "\u0250" and unicodedata.is_normalized("NFC", stem) and stem == stem.lower()

    def _fresh(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stems, one after the other, and how many each has."""
        stems = names.to_pylist()
        bare = pc.match_substring_regex(names, "^[a-z]+$").to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(~pc.string_is_ascii(names).to_numpy(zero_copy_only=False))
        bare[wide] = [self._bare(stems[i]) for i in wide.tolist()]
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        order = np.concatenate([np.flatnonzero(bare), np.flatnonzero(~bare)])
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.no_rules
        for at in range(0, int(bare.sum()), 2000):
            run = [stems[i] for i in order[at : min(at + 2000, int(bare.sum()))]]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(got)
            lengths.append(np.diff(np.flatnonzero(self.ends[got]), prepend=-1))
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.rules
        odd = [stems[i] for i in order[int(bare.sum()) :]]
        marked = [SPLIT[:2] in w for w in odd]
        # Stems without the mark of a special token are encoded together, with one between them.
        for run in [odd[at : at + 2000] for at in range(0, len(odd), 2000)] if not any(marked) else [[w] for w in odd]:
            got = np.array(self.tokenizer.encode_batch_fast([SPLIT.join(run)], add_special_tokens=False)[0].ids, np.uint32)
            if len(run) == 1:
                ids.append(got)
                lengths.append(np.array([len(got)]))
            else:
                lengths.append(np.diff(np.append(np.flatnonzero(got == self.split_id), len(got)), prepend=-1) - 1)
                ids.append(got[got != self.split_id])
        every, sizes = np.concatenate(ids), np.concatenate(lengths)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gather(every, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def _units(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Stem and tail of each word. ASCII words without a "<" may be lower-cased here; a tail is cut off a letter that stays one."""
        lower = pc.if_else(pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<"))), pc.ascii_lower(words), words)
        stem = pc.utf8_rtrim(lower, TAIL)
        cut = pc.match_substring_regex(stem, "[A-Za-zß-öø-ÿ]$")
        # Few words have a tail that is cut off.
        n, whole = (pc.binary_length(x).to_numpy() for x in (stem, lower))
        with_tail = np.flatnonzero(cut.to_numpy(zero_copy_only=False) & (n < whole))
        some = pa.array(with_tail)
        tails = [w[k:] for w, k in zip(lower.take(some).cast(pa.binary()).to_pylist(), n[with_tail].tolist(), strict=True)]
        at = np.full(len(n), len(tails))
        at[with_tail] = np.arange(len(tails))
        tail = pa.array([*tails, b""], pa.binary()).cast(pa.string()).take(pa.array(at))
        return pc.if_else(cut, stem, lower), tail

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts, one after the other, and how many each has, some texts at a time."""
        if self.plain:
            yield from self._encoded(texts)
            return
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
        keep = pc.not_equal(flat, "")
        coded, owner = flat.filter(keep).dictionary_encode(), owner.filter(keep).to_numpy()
        del parts, flat, keep
        codes = coded.indices.to_numpy()
        stem, tail = self._units(coded.dictionary)
        units = pa.concat_arrays([stem, tail]).dictionary_encode()
        names, unit = units.dictionary.to_pylist(), units.indices.to_numpy()
        at = np.fromiter(map(self.index.get, names, [-1] * len(names)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        # The remembered stems are first in the store, the fresh ones behind them.
        ids, lengths = self._fresh(units.dictionary.take(pa.array(new)))
        store, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        at[new] = len(self.lengths) + np.arange(len(new))
        starts = np.cumsum(sizes) - sizes
        # Stem and tail of each word in turn, then the words' own store.
        pairs = at[unit].reshape(2, -1).T.ravel()
        words, long = _gather(store, starts[pairs], sizes[pairs]), sizes[pairs].reshape(-1, 2).sum(1)
        again = np.bincount(unit[: len(stem)], weights=np.bincount(codes, minlength=len(stem)), minlength=len(names))[new] > 1
        self._remember([names[i] for i in new[again]], ids[np.repeat(again, lengths)], lengths[again])
        first = np.cumsum(long) - long
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for a in range(0, len(texts), 500):
            b = min(a + 500, len(texts))
            own = codes[cuts[a] : cuts[b]]
            n = long[own]
            yield _gather(words, first[own], n), np.bincount(owner[cuts[a] : cuts[b]] - a, weights=n, minlength=b - a).astype(np.int64)

    def _remember(self, stems: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(self.index) + len(stems) > REMEMBERED:
            self.index, self.ids, self.lengths = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64)
            stems, lengths = stems[:REMEMBERED], lengths[:REMEMBERED]
            ids = ids[: lengths.sum()]
        self.index.update(zip(stems, range(len(self.index), len(self.index) + len(stems)), strict=True))
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])


class SquaresPacker:
    """Online packing of pieces into windows of ``size`` ids; ``done`` collects (sequence, pieces) of closed windows."""

    def __init__(self, size: int, first_sequence: int, open_windows: int = OPEN, gap: float = GAP) -> None:
        self.size, self.next, self.most = size, first_sequence, open_windows
        self.full = size - int(size * gap)  # a window filled so far may be closed
        self.counts = np.zeros(size + 1, np.int64)  # counts[h]: open windows filled up to h
        self.levels: dict[int, list[list]] = {}
        self.open = 0
        self.done: list[tuple[int, list]] = []

    def _close(self, pieces: list) -> None:
        self.done.append((self.next, pieces))
        self.next += 1

    def _take(self, level: int) -> list:
        if level == 0:
            self.open += 1
            return []
        self.counts[level] -= 1
        return self.levels[level].pop()

    def _put(self, level: int, pieces: list) -> None:
        if level == self.size:
            self.open -= 1
            self._close(pieces)
        else:
            self.counts[level] += 1
            self.levels.setdefault(level, []).append(pieces)

    def _fullest(self) -> int:
        return int(self.size - np.argmax(self.counts[self.size :: -1] > 0))

    def best_level(self, n: int) -> int:
        """The fill level that a piece of ``n`` ids goes to."""
        there = np.flatnonzero(self.counts[: self.size - n + 1])
        levels = np.append(there, 0)
        after = np.where(levels + n < self.size, 2 * self.counts[levels + n] + 1, 0)
        change = after - np.where(levels > 0, 2 * self.counts[levels] - 1, 0)
        best = change.min()
        return int(levels[change == best].max())

    def place(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        """Pieces are (doc, start, ids)."""
        while len(ids) >= self.size:
            self._close([(doc, start, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            level, n = self.best_level(len(ids)), len(ids)
            if level == 0 and self.open >= self.most:
                fullest = self._fullest()
                if fullest >= self.full:
                    self.open -= 1
                    self._close(self._take(fullest))
                else:
                    level, n = fullest, min(n, self.size - fullest)
            pieces = self._take(level)
            pieces.append((doc, start, ids[:n]))
            self._put(level + n, pieces)
            start, ids = start + n, ids[n:]

    def finish(self) -> None:
        """Close all windows: see the module."""
        pieces = [p for level in sorted(self.levels, reverse=True) for window in self.levels[level] for p in window]
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        rest: list = []
        for level, window in sorted(tightest(pieces, self.size), key=lambda w: -w[0]):
            if level >= self.full:
                self._close(window)
            else:
                rest += window
        left = sum(len(p[2]) for p in rest)
        window, room = [], 0
        for doc, start, ids in rest:
            while len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                window.append((doc, start, ids[:n]))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self._close(window)
                    window = []

    def drain(self) -> list[tuple]:
        """The rows of ``PIECES`` of the windows closed since the last call."""
        rows = []
        for sequence, pieces in self.done:
            offset = 0
            for (doc_id, tokens), start, ids in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset))
                offset += len(ids)
        self.done = []
        return rows


def tightest(pieces: list, size: int) -> list[tuple[int, list]]:
    """(filled, pieces) of windows: each piece, the longest first, goes where it leaves the least room, whole."""
    windows: list[tuple[int, list]] = []
    room: list[tuple[int, int]] = []  # (room, window), ascending
    for p in sorted(pieces, key=lambda p: -len(p[2])):
        n = len(p[2])
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, w = room.pop(at)
        else:
            free, w = size, len(windows)
            windows.append((0, []))
        windows[w][1].append(p)
        windows[w] = windows[w][0] + n, windows[w][1]
        if free > n:
            bisect.insort(room, (free - n, w))
    return windows


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` of about ``size`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows) if batch.num_rows else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in batches of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, slice_bytes: int = SLICE_BYTES, spare: bool = False) -> DataFrame:
    """A row for each piece of each document: see ``PIECES``. ``tokenizer``: path of its file on every machine.

    ``slice_bytes`` of text are taken at once: fewer need less memory and more time, as a slice's stems are encoded once.
    With ``spare``, free memory is given back after each slice, not only at the end of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer)
        packer = SquaresPacker(size, TaskContext.get().partitionId() << 33)
        for batch in gathered(batches, slice_bytes):
            for part in slices(batch, 1, slice_bytes):
                names = iter(part.column(0).to_pylist())
                for ids, lengths in words.encode(part.column(1)):
                    at = 0
                    for n in lengths.tolist():
                        packer.place((next(names), n + 1), 0, np.append(ids[at : at + n], np.uint32(end_id)))
                        at += n
                    yield _rows(packer.drain())
                if spare:
                    trim()
        packer.finish()
        yield _rows(packer.drain())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(released(run), PIECES)
