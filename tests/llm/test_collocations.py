"""Collocations against a brute-force version, with sketches and chunks of any size."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm import collocations

SCHEMA = "doc_id long, text string, lang string"
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest=3, least=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        rows_ = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations.mine(docs, **how).collect())


def made(n, seed=1, vocabulary=14):
    rng = random.Random(seed)
    words = [rng.choice(["Ab", "c", "É", "x y", "der", "x\x1cz", "日本"]) + str(i % 7) for i in range(vocabulary)]
    ends = [". ", ", ", "; ", "\n", "! ", "\t", "  ", " ", " ", " ", " ", " ", "\r\n"]
    return [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None])) for i in range(n)]


def test_equals_brute_force(spark):
    rows = made(900)
    want = brute(rows)
    assert len(want) > 100
    assert got(spark, rows) == want


@pytest.mark.parametrize(("cells", "chunk"), [(1 << 3, 1 << 20), (1 << 10, 300), (1 << 22, 2000)])
def test_sketch_and_chunks_change_nothing(spark, cells, chunk):
    rows = made(60, seed=2)
    assert got(spark, rows, least=4, cells=cells, chunk=chunk) == brute(rows, least=4)


def test_salted_sketch(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = made(60, seed=5)
        assert got(spark, rows, least=5, cells=1 << 12, chunk=1000) == brute(rows, least=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_overlaps_longer_phrases_and_top(spark):
    rows = [(1, "na " * 40, "en"), (2, "a b c d " * 30, "en"), (3, "a b. c d " * 12, "en"), (4, "q r s t u " * 11, "en")]
    for how in ({"longest": 4}, {"longest": 2}, {"top": 3}, {"share": 20}, {"share": 101}):
        assert got(spark, rows, **how) == brute(rows, **how)


def test_odd_rows(spark):
    long = "one two three four. " * 30_000
    rows = [(1, None, "en"), (1, "", "en"), (None, " \t. , ", None), (2, long, "en"), (3, "one two " * 50, "und"), (4, "one two " * 50, None), (5, "x y z " * 40_000, ""), *[(6, "the same text again", "fr")] * 25]
    assert got(spark, rows, chunk=10_000) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame(made(40, seed=3), SCHEMA)
    assert collocations.mine(docs.limit(0)).collect() == []
    more = docs.withColumns({c: F.lit("x") for c in ("phrase", "size", "f", "a", "n", "segment", "a`b")})
    assert sorted(map(tuple, collocations.mine(more).collect())) == sorted(map(tuple, collocations.mine(docs).collect()))


def test_least_is_bounded(spark):
    with pytest.raises(ValueError):
        collocations.mine(spark.createDataFrame([(1, "a", "en")], SCHEMA), least=200)
