"""Quality scores by pairwise ranking (Bradley-Terry).

Each pair of a preferred and another document says that the first has the higher score; the chance of it is the logistic
function of the difference of their scores. Scores are linear in features of the text, so the weights are those of a logistic
regression on feature differences. A quantile of the learned rows' scores, at the share of rows that are not preferred, is
the threshold; the score given out is the logistic function of the distance to it, shifted so that the threshold is ``at``.

Features are of the whole text and nothing else: shares of kinds of bytes, lengths, repetition of words and lines.

Defined cases: a null or empty text has the features of no words and the score they give; with no row of either class
learned, every text has the score ``at``; repeated rows are equal; an empty table gives an empty result; other columns pass
through unchanged (``score`` replaces a column of that name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import any_names, bounded, hash_below, quoted, released
from weirflow.llm.packing import slices

SLICE_BYTES = 2 << 20
KINDS = ("upper", "letter", "digit", "space", "line end", "stop", "mark")
FEATURES = ("log words", "bytes a word", *KINDS, "same word again", "distinct words", "log distinct words", "distinct lines", "log lines", "marks a word", "log upper", "log marks", "log again")


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("mark"), np.int64)
    for name, bytes_ in (("upper", range(0x41, 0x5B)), ("letter", (*range(0x61, 0x7B), *range(0x80, 0x100))), ("digit", range(0x30, 0x3A)), ("space", (0x20, 9, 11, 12, 13)), ("line end", (10,)), ("stop", b".,;:?'\"-()")):
        kind[list(bytes_)] = KINDS.index(name)
    return kind


KIND = _kinds()


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    n, k = len(texts), len(KINDS)
    texts = pc.fill_null(texts, "")
    data = texts.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * k, lengths) + KIND[raw], minlength=n * k).reshape(n, k)
    parts = pc.ascii_split_whitespace(texts)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    keep = pc.not_equal(flat, "")
    coded, owner = flat.filter(keep).dictionary_encode(), owner.filter(keep).to_numpy()
    codes = coded.indices.to_numpy().astype(np.int64)
    words = np.bincount(owner, minlength=n)
    again = np.bincount(owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    distinct = np.bincount(np.unique(owner * np.int64(len(coded.dictionary) + 1) + codes) // (len(coded.dictionary) + 1), minlength=n)
    rows = pc.split_pattern(texts, "\n")
    lines = np.bincount(pc.list_parent_indices(rows).to_numpy(), minlength=n)
    lined = pc.list_flatten(rows).dictionary_encode()
    own = np.unique(pc.list_parent_indices(rows).to_numpy() * np.int64(len(lined.dictionary) + 1) + lined.indices.to_numpy()) // (len(lined.dictionary) + 1)
    apart = np.bincount(own.astype(np.int64), minlength=n)
    w, size = np.maximum(words, 1), np.maximum(lengths, 1)
    share = counts / size[:, None]
    mark, upper = share[:, KINDS.index("mark")], share[:, KINDS.index("upper")]
    return np.column_stack(
        [np.log1p(words), lengths / w, share, again / w, distinct / w, np.log1p(distinct), apart / np.maximum(lines, 1), np.log1p(lines), counts[:, KINDS.index("mark")] / w]
        + [np.log(0.01 + x) for x in (upper, mark, again / w)]
    )


def fit(x: np.ndarray, preferred: np.ndarray, at: float, pairs: int = 200_000, ridge: float = 1.0, seed: int = 5) -> dict:
    """Weights from pairs of rows of ``x``, one preferred and one not; the threshold and how features are scaled."""
    good, bad = np.flatnonzero(preferred == 1), np.flatnonzero(preferred == 0)
    if not len(good) or not len(bad):
        return {"weights": np.zeros(len(FEATURES)), "mean": np.zeros(len(FEATURES)), "deviation": np.ones(len(FEATURES)), "threshold": 0.0, "at": at}
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / deviation, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    weights = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
        slope = d.T @ (p - 1) + ridge * pairs / 1000 * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d + ridge * pairs / 1000 * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights -= move
        if np.abs(move).max() < 1e-8:
            break
    threshold = float(np.quantile(z @ weights, len(bad) / (len(good) + len(bad))))
    return {"weights": weights, "mean": mean, "deviation": deviation, "threshold": threshold, "at": at}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    s = np.clip((x - model["mean"]) / model["deviation"], -6, 6) @ model["weights"]
    return 1 / (1 + np.exp(-np.clip(s - model["threshold"] + np.log(model["at"] / (1 - model["at"])), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", at: float = 0.3, sample: int = 20_000) -> dict:
    """A model from the ``usable`` rows of ``labels`` (doc_id and ``label``, 0 or 1) and the texts of ``docs``.

    ``sample`` bounds the labelled texts: with more, those with the smallest hashes are taken, as many as that on average.
    Labels and texts are counted, and count, once however often they are repeated (texts by an estimate from sketches of their
    hashes). Labels are broadcast while their count shows
    that they fit, and joined by shuffle else; the driver gets the features of the sample, not its texts.
    """
    draw = F.lit("quality")
    rows = labels.where(usable & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label")).distinct()
    once = rows.where(hash_below(min(1.0, sample / max(rows.count(), 1)), F.col("doc_id"), F.col("_label"), draw))
    taken = bounded(once, once.count(), 32)
    # A doc_id may stand for many texts.
    texts = docs.select("doc_id", "text").join(taken, "doc_id").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02)).first()[0]
    drawn = docs.select("doc_id", "text").join(taken, "doc_id").where(hash_below(min(1.0, sample / max(texts, 1)), F.col("doc_id"), F.col("text"), draw))
    joined = drawn.groupBy("doc_id", "_label", F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text")).select("_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])

    found = joined.mapInArrow(released(run), "label int, x array<double>").toArrow().combine_chunks()
    order = np.lexsort([*np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES)).T, found.column("label").to_numpy()]) if found.num_rows else np.zeros(0, int)
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit(x, found.column("label").to_numpy()[order], at)


@any_names
def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with its score, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]
    rows = docs.select(*[F.col(quoted(c)) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at, SLICE_BYTES):
                s = scores(features(part.column(at)), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, "score"])

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(released(run), f"{schema}, score double")
