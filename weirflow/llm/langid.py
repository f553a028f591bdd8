"""Language identification of texts and of the spans of mixed ones.

Words are maximal runs of letters (ASCII letters and all bytes of other characters). Script ranges narrow the languages a
word can have: those that were seen in its script while learning (all, where none was). Of these, each gets a per-word score,
the sum of smoothed log-probabilities of the word's byte trigrams. Viterbi's algorithm, with a penalty for each switch of
language, labels the words; the language that labels most bytes is the text's.

If no stretch of words favours other languages by more than one penalty over the best single language, that language labels
every word: no path with a switch can score more. Only texts that fail this test are decoded word by word.

Memory is that of a slice of texts and of a bounded number of scores, whatever the number of languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no span; so is every text if nothing could
be learned; repeated rows are equal; texts of any length are labelled whole; an empty table gives an empty result; other
columns pass through unchanged (``lang_pred``, ``score``, ``spans`` replace columns of those names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import any_names, bounded, quoted, released
from weirflow.llm.packing import slices

#: Hash buckets of byte trigrams (bits, at most and at least), cells of a model, score of a language that a script rules out.
BITS, FEWEST_BITS, CELLS, RULED_OUT = 16, 8, 8 << 20, -1e4
#: Bytes of text taken at once; scores (words times languages) held at once.
SLICE_BYTES, SCORES = 3 << 19, 2 << 20

#: Script of a character by the lead byte of its UTF-8 form, as half-open ranges of lead bytes.
SCRIPT_RANGES = [
    ("latin", 0x41, 0x5B),
    ("latin", 0x61, 0x7B),
    ("latin", 0xC3, 0xCA),
    ("greek", 0xCD, 0xD0),
    ("cyrillic", 0xD0, 0xD5),
    ("hebrew", 0xD6, 0xD8),
    ("arabic", 0xD8, 0xDC),
    ("south and southeast asian", 0xE0, 0xE1),
    ("kana and cjk marks", 0xE3, 0xE4),
    ("han", 0xE4, 0xEA),
    ("hangul", 0xEA, 0xEE),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: what stands for it in a trigram (a space for what is no letter), and its script's number."""
    letter = np.full(256, 0x20, np.uint8)
    for b in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
        letter[b] = b
    letter[0x41:0x5B] += 0x20
    script = np.zeros(256, np.uint8)
    for name, a, b in SCRIPT_RANGES:
        script[a:b] = SCRIPTS.index(name)
    return letter, script


LETTER, SCRIPT = _tables()


class Text:
    """The words of some texts: trigram buckets of their bytes, where words start, which text and script they are of."""

    def __init__(self, texts: pa.Array, bits: int = BITS) -> None:
        # A space before each text and behind the last keeps words and trigrams within a text.
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        n, lengths = len(raw), np.diff(offsets)
        doc = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(n) + doc + 1
        data = np.full(n + len(texts) + 2, 0x20, np.uint8)
        data[at] = raw
        seen = SCRIPT[data]
        data = LETTER[data]
        inside = data != 0x20
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        code = data.astype(np.uint32)
        code = ((code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]) * np.uint32(2654435761)
        self.tri = (code >> np.uint32(32 - bits))[inside[1:-1]]  # of the letters only
        self.sizes = ends - starts
        self.first = np.cumsum(self.sizes) - self.sizes
        gaps = np.cumsum(lengths + 1)
        self.doc = np.searchsorted(gaps, starts, side="right") if len(starts) else np.zeros(0, np.int64)
        # A word's script: that of its characters beyond ASCII if any, else Latin. Lead bytes of other scripts number higher.
        self.script = np.maximum.reduceat(seen, starts) if len(starts) else np.zeros(0, np.uint8)
        self.texts = len(texts)


def _learned(languages: int, bits: int):
    width = len(SCRIPTS) + (1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(languages * width, np.int32)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                text = Text(part.column(1), bits)
                lang = part.column(0).to_numpy()[text.doc].astype(np.int64)
                for cells in (np.repeat(lang, text.sizes) * width + len(SCRIPTS) + text.tri, lang * width + text.script):
                    own, n = np.unique(cells, return_counts=True)
                    counts[own] += n.astype(np.int32)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32)), pa.array(counts[cell].astype(np.int64))], ["lang", "cell", "n"])

    return run


class TooManyLanguages(ValueError):
    """There are more languages than rows to learn from, so some can't be learned."""


def learn(docs: DataFrame, usable: Column, sample: int = 20_000, smoothing: float = 0.5) -> dict:
    """A model from the text and lang of the ``usable`` rows with a lang.

    ``sample`` bounds the rows, dealt out evenly over the languages: of a language with more distinct texts than its part, those
    with the smallest hashes are taken, as many as that on average, and one at least; a text that is repeated counts once. So
    a rare language is learned as well as a frequent one, and one whose rows repeat as well as one whose don't, at any size.
    Distinct texts are estimated (2 % off, in general) from sketches of their hashes, so no row is shuffled for it. The counts are summed by the executors; the driver gets one number for each language and
    trigram bucket. The buckets become fewer where there are so many languages that the model would have more than ``CELLS``.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    draw = F.xxhash64("lang", "text", F.lit("langid"))
    by = rows.groupBy("lang").agg(F.approx_count_distinct(draw, 0.02).alias("n"), F.min(draw).alias("least")).orderBy("lang").limit(sample + 1).collect()
    if len(by) > sample:
        raise TooManyLanguages(f"more than {sample} languages, and no more rows to learn from")
    languages = [r["lang"] for r in by]
    if not languages:
        return {"languages": []}
    part = max(1, sample // len(languages))
    below = [(i, r["lang"], max(r["least"], min((1 << 63) - 1, int(min(1.0, part / max(r["n"], 1)) * float(1 << 63)) * 2 - (1 << 63)))) for i, r in enumerate(by)]
    wanted = docs.sparkSession.createDataFrame(below, "_lang int, lang string, _below long")
    drawn = rows.join(bounded(wanted, len(below), 64 + 4 * max(len(x) for x in languages)), "lang").withColumn("_draw", draw).where("_draw <= _below")
    taken = drawn.groupBy("_draw").agg(F.first("_lang").alias("_lang"), F.first("text").alias("text")).select("_lang", "text")
    bits = min(BITS, max(FEWEST_BITS, (CELLS // len(languages)).bit_length() - 1))
    counted = taken.mapInArrow(released(_learned(len(languages), bits)), "lang int, cell int, n long")
    cells = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), len(SCRIPTS) + (1 << bits)), np.float32)
    counts[cells.column("lang").to_numpy(), cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    scripts, tri = counts[:, : len(SCRIPTS)], counts[:, len(SCRIPTS) :]
    shares = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    allowed = shares > 0.001
    allowed[:, ~allowed.any(0)] = True
    p = np.log((tri + np.float32(smoothing)) / (tri.sum(1, keepdims=True, dtype=np.float64) + smoothing * tri.shape[1]).astype(np.float32))
    return {"languages": languages, "bits": bits, "scores": np.ascontiguousarray((p - p.mean(0)).T.astype(np.float32)), "allowed": allowed.T}


def word_scores(text: Text, model: dict, a: int = 0, b: int | None = None) -> np.ndarray:
    """Score of each word (row) from ``a`` to ``b`` in each language (column)."""
    b = len(text.sizes) if b is None else b
    if b <= a:
        return np.zeros((0, len(model["languages"])))
    first = text.first[a:b] - text.first[a]
    tri = text.tri[text.first[a] : text.first[b - 1] + text.sizes[b - 1]]
    per = np.stack([np.add.reduceat(column[tri], first) for column in model["scores"].T], 1).astype(np.float64)
    return np.where(model["allowed"][text.script[a:b]], per, RULED_OUT)


class Scores:
    """The scores of a text's words, a bounded stretch at a time; those of all words are kept if they are within the bound."""

    def __init__(self, text: Text, model: dict) -> None:
        self.text, self.model, self.k = text, model, len(model["languages"])
        self.step = max(1, SCORES // self.k)
        self.whole = word_scores(text, model) if len(text.sizes) <= self.step else None

    def parts(self, a: int = 0, b: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        b = len(self.text.sizes) if b is None else b
        for at in range(a, b, self.step):
            end = min(at + self.step, b)
            yield at, end, word_scores(self.text, self.model, at, end) if self.whole is None else self.whole[at:end]


def viterbi(parts: Iterator[tuple[int, int, np.ndarray]], penalty: float) -> np.ndarray:
    """The labels of the best path over stretches of scores: their sum less ``penalty`` for each switch; of equal choices to
    stay, then the lower label. A bit for each word and language, and a number for each word, lead back."""
    stays, tops = [], []
    best = np.zeros(0)
    for _, _, scores in parts:
        stay, top = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
        for t, s in enumerate(scores):
            if not len(best):
                best = s.copy()
                continue
            top[t] = best.argmax()
            least = best[top[t]] - penalty
            stay[t] = best >= least
            best = np.maximum(best, least) + s
        stays.append((np.packbits(stay, axis=1), scores.shape[1]))
        tops.append(top)
    out: list[np.ndarray] = []
    label = int(best.argmax()) if len(best) else 0
    for (packed, k), top in zip(reversed(stays), reversed(tops), strict=True):
        stay, path = np.unpackbits(packed, axis=1, count=k), np.zeros(len(top), np.int32)
        for t in range(len(top) - 1, -1, -1):
            path[t] = label
            if not stay[t, label]:
                label = int(top[t])
        out.append(path)
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int32)


def label(text: Text, scores: Scores, penalty: float) -> np.ndarray:
    """The language of each word by the best path of its text."""
    k = scores.k
    sums = np.zeros((text.texts, k))
    for a, b, own in scores.parts():
        for j in range(k):
            sums[:, j] += np.bincount(text.doc[a:b], own[:, j], text.texts)
    single = sums.argmax(1)
    path = single[text.doc].astype(np.int32)
    if not len(path) or k == 1:
        return path
    gain = np.zeros(len(path))
    for a, b, own in scores.parts():
        rows, at = np.arange(b - a), path[a:b]
        others = own.copy()
        others[rows, at] = -np.inf
        gain[a:b] = others.max(1) - own[rows, at]
    # The largest sum of gains over a stretch of a text's words: running sum less its smallest value before, text by text.
    step = np.abs(gain).sum() + 1
    run = np.cumsum(gain) - step * text.doc
    before = np.concatenate([[0.0], run[:-1]])
    edge = np.flatnonzero(np.diff(text.doc, prepend=-1))
    before[edge] = run[edge] - gain[edge]
    most = np.full(text.texts, -np.inf)
    most[text.doc[edge]] = np.maximum.reduceat(run - np.minimum.accumulate(before), edge)
    for d in np.flatnonzero(most >= penalty):
        a, b = np.searchsorted(text.doc, [d, d + 1])
        path[a:b] = viterbi(scores.parts(int(a), int(b)), penalty)
    return path


def _spans(text: Text, path: np.ndarray, languages: list[str]) -> pa.Array:
    edge = np.flatnonzero((np.diff(text.doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
    size = np.diff(np.append(edge, len(path)))
    starts = np.searchsorted(text.doc, np.arange(text.texts))
    offsets = np.searchsorted(text.doc[edge], np.arange(text.texts + 1)) if len(edge) else np.zeros(text.texts + 1, np.int64)
    kind = [("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]
    names = pa.array(languages, pa.string()).take(pa.array(path[edge], pa.int64()))
    values = pa.StructArray.from_arrays([names, pa.array((edge - starts[text.doc[edge]]).astype(np.int32)), pa.array(size.astype(np.int32))], [k for k, _ in kind])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


@any_names
def identify(docs: DataFrame, model: dict, penalty: float = 12.0) -> DataFrame:
    """``docs`` with lang_pred, score (share of the text's letters with that language, times how sure it is) and spans."""
    languages = model["languages"]
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    spans = "array<struct<lang: string, first_word: int, words: int>>"
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not languages:
        return docs.select(*[F.col(quoted(c)) for c in names], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast(spans).alias("spans"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    mark = "_letters"
    while mark in names:
        mark += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(languages)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at, SLICE_BYTES):
                text = Text(part.column(at), model["bits"])
                scores = Scores(text, model)
                path = label(text, scores, penalty)
                cell = text.doc * k + path
                letters = np.bincount(cell, text.sizes, text.texts * k).reshape(text.texts, k)
                pred = letters.argmax(1)
                margin = np.zeros((text.texts, k))
                for a, b, own in scores.parts():
                    mine = np.where(path[a:b] == pred[text.doc[a:b]], 1.0, 0.0)
                    for j in range(k):
                        margin[:, j] += np.bincount(text.doc[a:b], mine * np.maximum(own[:, j], -50), text.texts)
                best = margin[np.arange(text.texts), pred]
                margin[np.arange(text.texts), pred] = -np.inf
                sure = 1 / (1 + np.exp(-np.clip(best - margin.max(1), -30, 30))) if k > 1 else np.ones(text.texts)
                total = letters.sum(1)
                score = np.where(total > 0, letters.max(1) / np.maximum(total, 1) * sure, 0.0)
                some = part.column(batch.schema.get_field_index(mark)).to_numpy(zero_copy_only=False) & (total > 0)
                lang = pc.if_else(pa.array(some), pa.array(languages, pa.string()).take(pa.array(pred)), "und")
                found = pc.if_else(pa.array(some), _spans(text, path, languages), None)
                keep = [part.column(i) for i, c in enumerate(batch.schema.names) if c != mark]
                yield pa.RecordBatch.from_arrays([*keep, lang, pa.array(np.where(some, score, 0.0)), found], [*(c for c in batch.schema.names if c != mark), "lang_pred", "score", "spans"])

    rows = docs.select(*[F.col(quoted(c)) for c in names], has_letter.alias(mark))
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != mark)
    return rows.mapInArrow(released(run), f"{schema}, lang_pred string, score double, spans {spans}")
