"""The stages of the pipeline: odd tables, and each against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_odd_tables import ROWS, SCHEMA
from tests.llm.test_operators import brute_components, brute_strip
from weirflow.llm import mixing

DATA = Path("/root/testdata/sf0.001")
pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("kind", ["odd", "empty", "wide"])
@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_odd_tables(spark, stage, kind):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    if kind == "empty":
        docs = docs.limit(0)
    wide = ("score", "Lang_Pred", "component_id", "_rate", "_key", "_hash", "_copy", "n_bytes", "removed", "block", "data", "label", "a.b`c")
    if kind == "wide":
        docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("~"))) for c in wide})
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "")
    rows = out.collect()
    if stage < 4:
        assert out.schema.simpleString() == docs.schema.simpleString()
    if stage < 4 and kind == "wide":
        before = {(r.doc_id, r["score"]) for r in docs.collect()}
        assert all((r.doc_id, r["score"]) in before and all(r[c] == c + r["score"].removeprefix("score") for c in wide) for r in rows)
    if kind == "empty":
        assert rows == []
    elif stage == 0:
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [-9, 1, 1, 6, 7, 8]
    elif stage == 1:
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [-9, 1, 2, 3, 4, 5, 6, 7]
    elif stage == 2:
        assert len(rows) == docs.count()
    elif stage == 4:
        assert sum(r.start == 0 for r in rows) == docs.count()


def test_near_duplicates_go_by_row(spark):
    """Rows that share a doc_id are told apart by their texts; of rows equal in both one stays."""
    words = [f"w{i}" for i in range(60)]
    near, u, v = " ".join([*words[:-1], "x"]), "a text that no other is like at all", "another such text of some words more"
    rows = [(5, " ".join(words)), (3, near), (5, u), (7, v), (7, v), (8, v), (None, near), (None, "no id and alone here with words"), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(4)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(3, near), (5, u), (7, v), (None, "no id and alone here with words"), (None, None), (4, ""), (4, "")]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_queries_side_by_side(spark):
    """Two threads that each write and drop tables of their own."""
    from concurrent.futures import ThreadPoolExecutor

    from weirflow.llm import neardup, passages

    docs = spark.createDataFrame(ROWS, SCHEMA)
    with ThreadPoolExecutor(2) as pool:
        found = [pool.submit(lambda f=f: f(docs).count()) for f in (neardup.components, passages.strip) * 2]
        assert [f.result() for f in found] == [len(ROWS)] * 4


def test_tables_go_when_they_are_read(spark, tmp_path):
    from weirflow.llm import common, neardup
    from weirflow.sources.store import Files, shared_dir

    there = lambda: set(Files(spark).names(f"{shared_dir(spark)}/weirflow"))
    before = there()
    with common.scratch(spark):
        neardup.components(spark.createDataFrame(ROWS, SCHEMA)).write.parquet(str(tmp_path / "out"))
        assert there() > before
    assert there() == before


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda f: {r.doc_id: r for r in f.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = spark.createDataFrame(stages["language"](spark, docs, str(DATA)).collect(), docs.schema)
    # Clean documents stay: all that have a letter do here.
    assert set(rows(kept)) == {i for i, r in rows(docs).items() if any(c.isalpha() for c in r.text or "")}

    single = spark.createDataFrame(stages["near_duplicates"](spark, kept, str(DATA)).collect(), docs.schema)
    text = {i: r.text for i, r in rows(kept).items()}
    assert set(rows(single)) == {top for _, top in brute_components(text).values()}

    cut = spark.createDataFrame(stages["repeated_passages"](spark, single, str(DATA)).collect(), docs.schema)
    want = brute_strip([(i, r.text) for i, r in rows(single).items()], 100)
    left = rows(cut)
    assert set(left) == {i for i, (n, gone, _, _) in want.items() if gone < n or not n}
    assert all(len(left[i].text.encode()) <= want[i][0] - want[i][1] and left[i].n_chars == len(left[i].text) for i in left)

    mixed = stages["mixture"](spark, cut, str(DATA)).collect()
    copies = {r.doc_id: r.copies for r in mixing.plan_mixture(cut).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: c for i, c in copies.items() if c})

    pieces = stages["sequences"](spark, cut, str(DATA)).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(dict.fromkeys(left, 1))
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_run(spark):
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
