"""Running numbers and sums over ordered rows of a key, however many rows a key has.

Rows are cut by ranges of (key, order), so that the rows of a hot key lie in many tasks; each task scans its rows with numpy,
and what earlier tasks hold of a key is added afterwards. Only keys that cross a cut are carried, at most one per cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.bytehash import FACTOR, INVERSE, U, mixed, powers
from weirflow.llm.common import bounded, materialize, released

#: Columns that a scan works with; rows must not have them.
OWN = ["scan_part", "scan_at", "scan_poly"]


def _terms(digests: pa.Array, seed: int, salt: np.ndarray | None, on: np.ndarray | None) -> np.ndarray:
    """A 64-bit value of each digest (at least 16 bytes), another for each seed; 0 where not ``on``."""
    raw = b"".join(digests.to_pylist())
    halves = np.frombuffer(raw, U).reshape(len(digests), -1)
    h = mixed(halves[:, seed % halves.shape[1]] ^ mixed(np.full(1, seed + 1, U)))
    if salt is not None:
        h = mixed(h ^ mixed(salt))
    return h if on is None else np.where(on, h, U(0))


def scan(rows: DataFrame, key: str, order: list[str | Column], add: tuple[str, ...] = (), poly: str | None = None, seed: int = 0, salt: str | None = None, on: str | None = None) -> DataFrame:
    """``rows`` with ``at`` (number within the key, from 0), inclusive sums ``sum_<c>`` of the long columns ``add``, and, with
    ``poly`` (a column of digests), ``fp``: the polynomial sum(term_i * FACTOR**i) modulo 2**64 up to and with the row, and
    ``before``, the same without it. ``salt`` (long) goes into the terms, ``on`` (boolean) says which rows have one.

    The key is a long that isn't null. Rows equal in key and order are numbered in any order. Written to the shared folder, as
    what the tasks found of a key must not change before it is added up.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    names = [f"sum_{c}" for c in add]
    schema = T.StructType([*cut.schema.fields, T.StructField("scan_part", T.IntegerType()), T.StructField("scan_at", T.LongType()), *[T.StructField(n, T.LongType()) for n in names], *([T.StructField("scan_poly", T.LongType()), T.StructField("scan_before", T.LongType())] if poly else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n_before, sums, total = None, 0, np.zeros(len(add), np.int64), U(0)
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            keys = b.column(b.schema.names.index(key)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            goes_on = last is not None and keys[0] == last
            at = np.arange(n) - starts[group]
            first = group == 0
            if goes_on:
                at[first] += n_before
            else:
                sums, total, n_before = np.zeros(len(add), np.int64), U(0), 0
            out = []
            for j, c in enumerate(add):
                x = np.cumsum(b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False))
                x = x - np.concatenate([[0], x])[starts][group]
                x[first] += sums[j]
                out.append(x)
            if poly:
                of = lambda c: None if c is None else b.column(b.schema.names.index(c))
                t = _terms(of(poly), seed, None if salt is None else of(salt).to_numpy(zero_copy_only=False).view(U), None if on is None else of(on).to_numpy(zero_copy_only=False))
                ran = np.concatenate([np.zeros(1, U), np.cumsum(t * powers(FACTOR, n))])
                back = powers(INVERSE, n + 1)[starts][group]
                upto, less = (ran[1:] - ran[starts][group]) * back, (ran[:-1] - ran[starts][group]) * back
                if goes_on:
                    ahead = U(pow(int(FACTOR), int(n_before), 1 << 64))
                    upto[first], less[first] = total + ahead * upto[first], total + ahead * less[first]
                total = upto[-1]
                out += [upto.view(np.int64), less.view(np.int64)]
            last, n_before = keys[-1], int(at[-1]) + 1
            sums = np.array([x[-1] for x in out[: len(add)]], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(at), *map(pa.array, out)], names=[f.name for f in schema])

    done = materialize(cut.mapInArrow(released(run), schema), "scan")
    ends = done.groupBy(key, "scan_part").agg(F.count("*").alias("n"), *[F.max_by(c, "scan_at").alias(c) for c in [*names, *(["scan_poly"] if poly else [])]])
    crossing = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("scan_part", "n", *names, *(["scan_poly"] if poly else [])))).alias("parts")).where(F.size("parts") > 1)
    kept = ["off", *[f"off_{n}" for n in names], *(["off_poly"] if poly else [])]

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, parts in zip(frame[key], frame["parts"], strict=True):
                off, sums, total = 0, [0] * len(names), 0
                for p in parts:
                    signed = total - (1 << 64) if total >> 63 else total
                    rows.append((k, p["scan_part"], off, *sums, *([signed] if poly else [])))
                    if poly:
                        total = (total + pow(int(FACTOR), off, 1 << 64) * p["scan_poly"]) % (1 << 64)
                    off += p["n"]
                    sums = [s + p[n] for s, n in zip(sums, names, strict=True)]
            yield pd.DataFrame(rows, columns=[key, "scan_part", *kept])

    carries = materialize(crossing.mapInPandas(carry, ", ".join([f"`{key}` long", "scan_part int", *[f"{c} long" for c in kept]])), "carries")
    joined = done.join(bounded(carries, carries.count(), 16 + 8 * len(kept)), [key, "scan_part"], "left")
    plain = joined.withColumn("at", F.col("scan_at") + F.coalesce("off", F.lit(0))).withColumns({n: F.col(n) + F.coalesce(f"off_{n}", F.lit(0)) for n in names})
    columns = [*rows.columns, "at", *names]
    if not poly:
        return plain.select(columns)

    @F.pandas_udf("long")
    def moved(value: pd.Series, off: pd.Series, start: pd.Series) -> pd.Series:
        offs, where = np.unique(off.to_numpy(np.int64), return_inverse=True)
        ahead = np.array([pow(int(FACTOR), int(o), 1 << 64) for o in offs], U)[where]
        return pd.Series((start.to_numpy(np.int64).view(U) + ahead * value.to_numpy(np.int64).view(U)).view(np.int64))

    zero = F.lit(0).cast("long")
    whole = lambda c: F.when(F.col("off").isNull(), F.col(c)).otherwise(moved(c, F.coalesce("off", zero), F.coalesce("off_poly", zero)))
    return plain.select(*columns, whole("scan_poly").alias("fp"), whole("scan_before").alias("before"))
