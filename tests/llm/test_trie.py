"""Prefix tries and scans against brute-force versions, with keys cut over tasks and fingerprints that collide."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm import queries, scans, trie
from weirflow.llm.bytehash import FACTOR

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = own + sum(saved[x] for x in children[p])
    found = []
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(p))))
        found.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, found))


def got(spark, rows, bits=64):
    conv = F.col("conv_id")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns, convs = trie.rebuild(trie.turns_of(docs), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return sorted(repr(tuple(r)) for r in trie.prefix_trie(turns, ["phase", "turn"], convs, bits).drop("fp").collect())


def made(n, turns, seed=1, texts=3):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice([*(f"text {i} of some" for i in range(texts)), None, ""])) for c in range(-n // 4, n) for t in range(rng.randint(0, turns))]


def test_equals_brute_force(spark):
    rows = made(150, 6)
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_one_long_conversation_and_copies(spark):
    rows = made(60, 4, seed=2)
    rows += rows[:20]
    rows += [(7, t // 2, "user", f"turn {t % 5}") for t in range(700)]
    rows += [(1000 + 20 * c, t, "user", f"the same turn {t}") for c in range(300) for t in range(3)]
    rows += [(None, 1, "user", "nobody")]
    assert got(spark, rows) == brute(rows)


def test_colliding_fingerprints_are_split(spark):
    rows = made(120, 7, seed=3)
    for bits in (2, 5):
        assert got(spark, rows, bits) == brute(rows)


def test_odd_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "a", "b")]) == []
    rows = [(3, None, None, None), (40, 1, "user", ""), (41, 5, "", "x " * 50_000), (43, 5, "", "x " * 50_000), (-1, 2, "a:b", "c"), (-20, 2, "a", "bc")]
    assert got(spark, rows) == brute(rows)


def test_clashing_columns(spark, tmp_path):
    rows = made(40, 5, seed=9)
    plain = spark.createDataFrame(rows, SCHEMA)
    plain.withColumns({c: F.lit(1) for c in ("digest", "words", "at", "fp", "before", "scan_part", "base", "i", "phase", "depth", "a`b")}).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(repr(tuple(r)) for r in queries.queries()["op13_trie"](spark, str(tmp_path)).collect()) == brute(rows)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_scan_over_cut_keys(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = random.Random(4)
        rows = [(rng.choice([1, 1, 1, 2, 3]) if i % 3 else 5, i, rng.randint(-5, 5)) for i in range(500)]
        df = spark.createDataFrame(rows, "k long, o long, v long").withColumn("digest", F.unhex(F.sha2(F.col("v").cast("string"), 256)))
        out = scans.scan(df, "k", ["o"], add=("v",), poly="digest").collect()
        parts = spark.createDataFrame(rows, "k long, o long, v long").repartitionByRange(4, "k", "o").select("k", F.spark_partition_id().alias("p")).distinct().groupBy("k").count().agg(F.max("count")).first()[0]
        assert parts > 1 and len(out) == 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    terms = {}
    for k in {r.k for r in out}:
        total = fp = 0
        for i, r in enumerate(sorted((r for r in out if r.k == k), key=lambda r: r.o)):
            total += r.v
            assert (r.at, r.sum_v) == (i, total)
            assert r.before % (1 << 64) == fp
            term = (r.fp - r.before) * pow(int(FACTOR), -i, 1 << 64) % (1 << 64)
            assert terms.setdefault(r.v, term) == term
            fp = r.fp % (1 << 64)
    assert len(set(terms.values())) == len(terms) > 5
