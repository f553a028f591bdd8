"""The statements data source: splits, filters that reach the reader, bad lines."""

from __future__ import annotations

import json

import pytest
from pyspark.sql.datasource import EqualNullSafe, GreaterThanOrEqual, LessThan

from weirflow.sources.connector import PUSH_DOWN, Range, Statements, StatementSource, _day, _lines
from weirflow.sources.registry import registry


def row(i, day=1, **more):
    return {"seq": i, "provider_account_id": "a", "transaction_ts_raw": f"{day:02d}/05/26 10:30", "amount_raw": f"${i}"} | more


@pytest.fixture
def folder(tmp_path):
    lines = [json.dumps(row(i, 1 + i % 28, business_name="é" * (i % 50))) for i in range(500)]
    (tmp_path / "a.json").write_text("\n".join(lines[:300]) + "\n")
    (tmp_path / "b.json").write_text("\n\n".join([*lines[300:], "{broken", '{"no": "seq"}', "[1]"]))  # no line feed at the end
    (tmp_path / "_SUCCESS").write_text("x")
    return str(tmp_path)


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_every_line_is_in_one_range(tmp_path, split):
    text = "".join(f"{'x' * (i % 90)}é{i}\n" for i in range(60)) + "last"
    path = tmp_path / "t"
    path.write_text(text)
    size = path.stat().st_size
    got = [line for a in range(0, size, split) for line in _lines(str(path), a, min(a + split, size))]
    assert got == text.encode().split(b"\n")


def test_reads_all_rows_in_any_splits(spark, folder):
    spark.dataSource.register(Statements)
    for split in (500, 1 << 20):
        df = spark.read.format("statements").option("split", str(split)).load(folder)
        rows = df.collect()
        assert sorted(r.seq for r in rows if r.seq is not None) == list(range(500))
        assert sorted(r.bad_line for r in rows if r.bad_line) == ["[1]", '{"no": "seq"}', "{broken"]
        assert {r.seq: r.day for r in rows if r.seq is not None}[30] == "2026-05-03"
    assert df.rdd.getNumPartitions() == 2 and spark.read.format("statements").option("split", "500").load("file://" + folder).rdd.getNumPartitions() > 50


def test_filters_are_taken_by_the_reader(folder):
    source = Statements({"path": folder, "pushdown": "true"})
    reader = source.reader(source.schema())
    left = list(reader.pushFilters([GreaterThanOrEqual(("seq",), 100), LessThan(("day",), "2026-05-03"), EqualNullSafe(("seq",), 1), GreaterThanOrEqual(("amount_raw",), "$")]))
    assert [type(f) for f in left] == [EqualNullSafe, GreaterThanOrEqual] and left[1].attribute == ("amount_raw",)
    got = [x for part in reader.partitions() for b in reader.read(part) for x in b.to_pylist() if x["seq"] is not None]
    assert got and all(x["seq"] >= 100 and x["day"] < "2026-05-03" for x in got)
    assert len(got) == sum(i >= 100 and i % 28 < 2 for i in range(500))
    assert [b for b in reader.read(Range(f"{folder}/a.json", 0, 60)) if b.num_rows] == []


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_look_back_and_resume_index(spark, folder, pushed):
    before = spark.conf.get(PUSH_DOWN)
    spark.conf.set(PUSH_DOWN, pushed)
    try:
        got = registry.create("statements", folder).fetch(spark, "2026-05-20", 5, 250)
        want = [i for i in range(250, 500) if 1 + i % 28 >= 15]
        assert sorted(r.seq for r in got.rows.collect()) == want
        assert got.warnings.count() == 3
        plan = got.rows._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter " in line]
        assert not any(">= 2026-05-15" in f for f in filters) if pushed == "true" else any(">= 2026-05-15" in f for f in filters)
    finally:
        spark.conf.set(PUSH_DOWN, before)


def test_days():
    assert [_day(x) for x in ("31/12/25 x", "on 01/02/26", "none", "", None, 7)] == ["2025-12-31", "2026-02-01", "", "", None, None]


def test_empty_folder(spark, tmp_path):
    assert StatementSource(str(tmp_path)).read(spark, "2026-01-01", 4).count() == 0
