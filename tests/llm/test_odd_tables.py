"""What every operator and stage makes of nulls, empty tables, repeated rows, long texts and columns with clashing names."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weirflow.llm import fingerprints, langid, mixing, neardup, packing, passages, quality, sharding, topk, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text():
    rng = random.Random(3)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60_000))


ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", None, "b", 4),
    (5, "123 !!", "de", None, 6),
    (None, "no id at all", "en", "a", 12),
    (6, "é" * 300, "fr", "c", 300),
    (7, long_text(), "en", "a", 0),
    (8, "one two three four five six seven", "en", "c", 33),
    (-9, "x\x00y z", "en", "c", 5),
]
EXTRA = ["_key", "_cell", "_row", "score", "spans", "rank", "node", "bucket", "_part", "n_bytes", "_letters", "task", "a`b", "c.d"]


@pytest.fixture(params=["odd", "empty", "clashing"])
def docs(request, spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    if request.param == "empty":
        return rows.limit(0)
    return rows.withColumns({c: F.lit(7) for c in EXTRA}) if request.param == "clashing" else rows


def count(docs):
    return docs.count()


def test_mixing(docs):
    plan = mixing.plan_mixture(docs)
    assert plan.count() == count(docs)
    rows = plan.collect()
    assert all(r.size == 0 or r.copies in (0, 1, 2) for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_sharding(docs):
    rows = sharding.interleave(docs, 3).collect()
    assert len(rows) == count(docs)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert not rows or max(len([r for r in rows if r.shard == s]) for s in range(3)) - min(len([r for r in rows if r.shard == s]) for s in range(3)) <= 1


def test_fingerprints(docs):
    rows = fingerprints.compare(docs).collect()
    assert len(rows) == count(docs)
    by = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert not rows or len(by[33]) == 1 and by[0] == {""}


def test_neardup(docs):
    rows = neardup.components(docs).collect()
    assert len(rows) == count(docs)
    if rows:
        found = {}
        for r in rows:
            found.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
        assert found[1] == [(3, 1)] * 2 and found[8] == [(3, 1)]
        assert found[2] == [(0, 2)] and found[3] == [(0, 3)] and found[4] == [(0, 4)] and found[5] == [(1, 5)] and found[None] == [(1, None)]


def test_neardup_of_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (9, " ".join(["y", *words[1:]])), (None, "alone here")]
    got = sorted((r.n_shingles, r.component_id is None) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, True), (56, False), (56, False), (56, False)]


def test_quality(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.learn(docs, labels, F.col("doc_id").isNotNull())
    rows = quality.score(docs, model).collect()
    assert len(rows) == count(docs) and all(0 <= r.score <= 1 for r in rows)
    none = quality.score(docs, quality.learn(docs, labels.limit(0), F.lit(True))).collect()
    assert all(abs(r.score - 0.3) < 1e-9 for r in none)


def test_packing(docs):
    pieces = packing.pack(docs, TOKENIZER, 512).collect()
    assert sum(p.start == 0 for p in pieces) == count(docs)
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert all(p.length == p.doc_tokens == 1 for p in pieces if p.doc_id in (2, 3, 4))


def test_passages(docs):
    cut = passages.strip(docs, 100)
    assert cut.columns == [*(c for c in docs.columns if c != "n_bytes"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    rows = {r.doc_id: r for r in cut.collect()}
    if rows:
        assert (rows[2].n_bytes, rows[2].n_removed, rows[2].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
        assert (rows[6].n_bytes, rows[6].n_removed, rows[6].n_spans) == (600, 598, 1) and rows[6].removed == [(2, 598)]
        assert rows[1].n_removed == 0


def test_langid(docs):
    model = langid.learn(docs, F.lit(True))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == count(docs)
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
    nothing = langid.identify(docs, langid.learn(docs.limit(0), F.lit(True))).collect()
    assert {r.lang_pred for r in nothing} <= {"und"}


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://B.A.com/xyz?q"), (4, "http://B.A.com/xyz?q"), (None, "http://a.com"), (5, "http://ba.com/x"), (6, "x" * 100_000 + "://a.com/x#f"), (7, "http://a.com?://b/"), (8, "http://" + "a." * 500_000 + "com/" + "x" * 500_000)], "page_id long, url string")
    for table in (pages, pages.withColumns({"h": F.lit(1), "found": F.lit(2), "times": F.lit(3)}), pages.limit(0)):
        rows = urls.judge(table, rules).collect()
        assert len(rows) == table.count()
        if rows:
            assert [(len(r.host), len(r.path), r.rule) for r in rows if r.page_id == 8] == [(1_000_003, 500_001, "a.com/x")]
            got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id != 8)
            assert got == [
                (0, "a.com", "", None, "allow"),
                (1, "", "", None, "allow"),
                (2, "", "", None, "allow"),
                (3, "", "", None, "allow"),
                (4, "b.a.com", "/xyz", "a.com/x", "block"),
                (4, "b.a.com", "/xyz", "a.com/x", "block"),
                (5, "ba.com", "/x", "com/", "allow"),
                (6, "a.com", "/x", "a.com/x", "block"),
                (7, "a.com", "", None, "allow"),
            ]
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf]), (5, [None, 1.0]), (6, []), (7, [3.0]), (7, [3.0]), (None, [9.0, 9.0]), (8, [1e300]), (9, [0.0, -1.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for table in (vectors, vectors.withColumns({"rank": F.lit(1), "score": F.lit(1)}), vectors.limit(0)):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") == 0, 4, 2).orderBy("rank").collect()]
        if table.count():
            assert got == [(0, 1, 8, (1 << 63) - 1), (0, 2, 7, 12), (0, 3, 7, 12), (0, 4, 1, 20)] or got == [(0, 1, 8, (1 << 63) - 1), (0, 2, 1, 20), (0, 3, 7, 12), (0, 4, 7, 12)]
        else:
            assert got == []
