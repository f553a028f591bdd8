"""Exact top-k by inner product: term-at-a-time accumulation over all candidates.

Vectors are turned into integers, a component being a term and its integer the weight. A task turns a block of candidates
into posting lists (term -> candidates with a weight that is not 0), and each query's terms scatter query weight times
posting weights into a dense array of scores, a row a query. A partition selection keeps the k best of the block, merged
with those of the task's earlier blocks; a ranking per query merges the tasks.

Queries are a stated set, searched in blocks: the queries fall into blocks of about ``QUERY_BYTES``, the candidates into
blocks of about ``BLOCK_BYTES`` (smaller ones where that would leave tasks without work), and each pair of blocks is a task's
unit of work. Nothing comes to the driver but counts.

Defined cases: vectors that are null, or hold null or a non-finite component, take no part; a missing component (shorter
vector) counts as 0; a query is never its own candidate (same vec_id), nor are rows with a null vec_id anything; ties go to
the smaller vec_id; repeated candidate rows are ranked each, repeated query rows are one query (of rows that share a vec_id,
the first by content); scores are exact: where 64-bit sums could overflow, Python integers are used, and a score beyond
64 bits is held at the nearest long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of queries and of candidates, as 8-byte numbers; what a block is not divided below to employ more tasks; scores held at once in a task.
QUERY_BYTES, BLOCK_BYTES, LEAST_BYTES, SCORES = 16 << 20, 16 << 20, 1 << 20, 2 << 20
LIMIT = (1 << 63) - 1


def usable(embedding: Column) -> Column:
    """Not null, and every component a finite number."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def _matrix(values: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) by row, shorter rows filled with 0; Python integers if they don't fit."""
    lengths = np.diff(values.offsets.to_numpy(zero_copy_only=False))
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    big = bool(len(flat)) and np.abs(flat).max() >= 2.0**62
    out = np.zeros((len(values), int(lengths.max(initial=0))), object if big else np.int64)
    at = np.arange(out.shape[1])[None, :] < lengths[:, None]
    out[at] = [int(x) for x in flat] if big else flat.astype(np.int64)
    return out


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Dense scores (queries x candidates), a term at a time."""
    terms = min(queries.shape[1], block.shape[1])
    most = [int(np.abs(x[:, :terms]).max(initial=0)) if x.dtype != object else max((abs(v) for v in x[:, :terms].ravel()), default=0) for x in (queries, block)]
    kind = np.int64 if most[0] * most[1] * max(terms, 1) < LIMIT else object
    out = np.zeros((len(queries), len(block)), kind)
    for t in range(terms):
        weights, asked = block[:, t].astype(kind), queries[:, t].astype(kind)
        posting, rows = np.flatnonzero(weights), np.flatnonzero(asked)
        if not len(posting) or not len(rows):
            continue
        if len(posting) == len(block) and len(rows) == len(queries):
            out += asked[:, None] * weights[None, :]
        else:
            out[np.ix_(rows, posting)] += asked[rows, None] * weights[None, posting]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of one query: a partition selection with all ties of the last place, then a sort."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return scores[order], ids[order]


def _pair(k: int, scale: int):
    """The k best of a block of candidates for each query of a block of queries."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        asks = rows.column("asks").to_numpy()
        sides = [rows.filter(pa.array(m)).combine_chunks() for m in (asks, ~asks)]
        (query_ids, ids), (asked, vectors) = [t.column("vec_id").to_numpy() for t in sides], [t.column("embedding").combine_chunks() for t in sides]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(query_ids):
            block = _matrix(vectors, scale)
            among = np.isin(query_ids, ids)
            step = max(1, SCORES // len(ids))
            for at in range(0, len(query_ids), step):
                scores = _scores(_matrix(asked.slice(at, step), scale), block)
                for own, here, row in zip(query_ids[at : at + step], among[at : at + step], scores, strict=True):
                    other = ids != own if here else slice(None)
                    best, names = _best(row[other], ids[other], k)
                    out[0].append(np.full(len(best), own))
                    out[1].append(names)
                    out[2].append(np.array([max(-LIMIT - 1, min(LIMIT, int(x))) for x in best], np.int64))
        none = np.zeros(0, np.int64)
        return pa.table({c: np.concatenate([none, *v]) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for every query row."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_asks"))
    queries = rows.where("_asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = F.coalesce(F.sum(8 * (F.size("embedding") + 2)), F.lit(0))
    asked = max(1, math.ceil(queries.agg(size).first()[0] / QUERY_BYTES))
    whole, tasks = rows.agg(size).first()[0], int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = max(1, math.ceil(whole / BLOCK_BYTES), min(tasks, math.ceil(whole / LEAST_BYTES)))
    # Candidates are dealt by their place in the input, so that repeated rows spread as all others do.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(held)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "embedding", F.lit(False).alias("asks"), place.alias("_c")).withColumn("_q", every(asked))
    sent = queries.select("vec_id", "embedding", F.lit(True).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(asked)).cast("int").alias("_q")).withColumn("_c", every(held))
    found = candidates.unionByName(sent).groupBy("_q", "_c").applyInArrow(_pair(k, scale), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
