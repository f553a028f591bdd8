"""URL filter: a blocked Bloom filter of the listed canonical URLs, and an exact hash join for what passes it.

A listed URL is a rule (host, path, verdict). It fits a URL if the URL's host is the rule's or ends in "." + the rule's, and
the URL's path starts with the rule's. A URL is expanded to the keys a fitting rule can have: the ends of its host with as
many labels as some listed host, each with the beginnings of its path as long as some listed path. So their number depends on
the list, not on how long a URL is. They are made and hashed in the JVM; the filter drops the keys that are surely not listed,
the join with the list drops its false positives, and the longest rule decides; of two as long, that with the longer host. A
URL that no rule fits gets ``otherwise``.

Defined cases: a null URL, or one without "://", has host and path "" and no rule; repeated rows are each judged; a URL of any
length is judged; a rule without a host fits nothing; an empty table gives an empty result, an empty list fits nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import BROADCAST_BYTES, bounded, released

#: Bits of a block (a cache line), and bits set in it for a key.
BLOCK_BITS, PROBES = 512, 8
WORDS = BLOCK_BITS // 64


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (after the first ``://``, up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end)."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumns({"host": F.coalesce(F.translate(host, upper, lower), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def labels_of(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys (h, p, x) that a rule fitting this URL can have, by label counts and path lengths of the list; x is their hash."""
    ends = F.array(*[F.when(labels_of(host) >= n, F.substring_index(host, ".", -n)) for n in labels]).cast("array<string>")
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>")
    pairs = F.flatten(F.transform(F.array_compact(ends), lambda h: F.transform(F.array_compact(heads), lambda p: F.struct(h.alias("h"), p.alias("p"), F.xxhash64(h, p).alias("x")))))
    return F.filter(pairs, lambda k: k["h"] != "")


def _probes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash: its block, and the words and masks of its bits there."""
    h = h.astype(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    step = (h & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.stack([(step >> np.uint64(9 * i % 54)) % np.uint64(BLOCK_BITS) for i in range(PROBES)], 1)
    return block, bits >> np.uint64(6), np.uint64(1) << (bits & np.uint64(63))


def build_filter(hashes: np.ndarray, bits_per_key: int = 16) -> np.ndarray:
    """A blocked Bloom filter: every key sets its bits in one block. At most ``BROADCAST_BYTES`` long; a longer list only raises false positives, which the join removes."""
    blocks = int(min(max(1, -(-len(hashes) * bits_per_key // BLOCK_BITS)), BROADCAST_BYTES * 8 // BLOCK_BITS))
    table = np.zeros((blocks, WORDS), np.uint64)
    block, word, mask = _probes(hashes, blocks)
    for i in range(PROBES):
        np.bitwise_or.at(table, (block, word[:, i]), mask[:, i])
    return table


def maybe_listed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, word, mask = _probes(hashes, len(table))
    return ((table[block[:, None], word] & mask) == mask).all(1)


def _list_filter(rules: DataFrame, n: int) -> np.ndarray:
    """The filter of the list's ``n`` rules. Tasks send one partial filter each, never keys."""
    blocks = int(min(max(1, -(-n * 16 // BLOCK_BITS)), BROADCAST_BYTES * 8 // BLOCK_BITS))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((blocks, WORDS), np.uint64)
        for batch in batches:
            block, word, mask = _probes(batch.column(0).to_numpy().view(np.uint64), blocks)
            for i in range(PROBES):
                np.bitwise_or.at(table, (block, word[:, i]), mask[:, i])
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, i].view(np.int64)) for i in range(WORDS)]], ["block", *[f"w{i}" for i in range(WORDS)]])

    filled = rules.select(F.xxhash64("host", "path")).mapInArrow(released(part), "block long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
    rows = filled.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toArrow()
    table = np.zeros((blocks, WORDS), np.uint64)
    if rows.num_rows:
        table[rows.column("block").to_numpy()] = np.stack([rows.column(f"w{i}").to_numpy() for i in range(WORDS)], 1).view(np.uint64)
    return table


def _passing(keys: pa.ListArray, table: np.ndarray) -> pa.ListArray:
    """Of each row's keys, those that may be listed, without their hashes."""
    values, at = keys.values, keys.offsets.to_numpy()
    listed = maybe_listed(table, values.field("x").to_numpy(zero_copy_only=False).view(np.uint64)) if len(values) else np.zeros(0, bool)
    before = np.append(0, np.cumsum(listed))
    kept = pa.StructArray.from_arrays([values.field(c).filter(pa.array(listed)) for c in ("h", "p")], ["h", "p"])
    return pa.ListArray.from_arrays(pa.array((before[at] - before[at[0]]).astype(np.int32)), kept.slice(int(before[at[0]])))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page; ``rules`` has host, path, verdict and no row twice."""
    spark: SparkSession = pages.sparkSession
    rules = rules.select("host", "path", "verdict").where("host != '' and path is not null")
    shape = rules.agg(F.count("*"), F.coalesce(F.max(F.length("host") + F.length("path")), F.lit(0)), F.array_sort(F.collect_set(labels_of(F.col("host")))), F.array_sort(F.collect_set(F.length("path")))).first()
    n, width, labels, lengths = shape
    sent = spark.sparkContext.broadcast(_list_filter(rules, n))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _passing(batch.columns[-1], sent.value)], [*batch.schema.names[:-1], "hits"])

    # Equal rows are judged once and counted, so that a page that makes up much of the table is one row from here on.
    once = parts(pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("times")))
    expanded = once.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels, lengths))
    schema = "page_id {}, url string, times long, host string, path string, hits array<struct<h: string, p: string>>"
    passed = expanded.mapInArrow(released(hits), schema.format(pages.schema["page_id"].dataType.simpleString()))
    listed = bounded(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("hn"), F.concat("host", "path").alias("rule"), "verdict").alias("found")), n, width * 8 + 64)
    best = (
        passed.select("page_id", "url", "times", "host", "path", F.explode_outer("hits").alias("key"))
        .select("page_id", "url", "times", "host", "path", "key.h", "key.p")
        .join(listed, ["h", "p"], "left")
        .groupBy("page_id", "url", "times", "host", "path")
        .agg(F.max("found").alias("found"))
    )
    return best.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        "page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict")
    )
