"""State in buckets: what a merge reads, writes and shuffles, and what it survives."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weirflow.operators import cdc, ledger
from weirflow.schema import LEDGER, SEEN
from weirflow.sources.buckets import Bucketed
from weirflow.sources.store import Files, Lost, Moved, Versioned



def now():
    return F.lit("2026-05-06 07:08:09").cast("timestamp")


def keys(spark, first, end, value="h"):
    """State rows, or a delta, of one row a key; every tenth key is a second occurrence."""
    n = F.col("id")
    print_ = F.substring(F.md5(n.cast("string")), 1, 16)
    return spark.range(first, end).select(
        F.lit("cal").alias("provider"), (n % 3).cast("string").alias("provider_account_id"), F.when(n % 10 == 0, F.concat(print_, F.lit("|#2"))).otherwise(print_).alias("dedup_key"),
        F.lit(value).alias("content_hash"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("last_seen_at"), F.lit(None).cast("timestamp").alias("updated_at"), n.alias("seq"),
    )


def upsert(old, new):
    return cdc.upsert_seen(old, new, now())


def content(rows):
    return sorted(((r.provider_account_id, r.dedup_key), r.content_hash, r.last_seen_at.month, r.updated_at and r.updated_at.month) for r in rows.collect())


def files_of(spark, state):
    return {b: (f, tuple(Files(spark).names(f"{state.root}/{f}"))) for b, f in state.current()["folders"].items()}


def test_a_small_delta_rewrites_its_buckets_alone(spark, tmp_path):
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    others = tables()
    state = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=64)
    state.write(keys(spark, 0, 2000))
    before = files_of(spark, state)
    assert len(before) == 64
    delta = keys(spark, 1990, 2010, "new")  # one percent: ten keys that are there, ten that aren't
    touched = state.merge(delta, upsert)
    after = files_of(spark, state)
    assert 1 < len(touched) <= 20 and {int(b) for b in before if before[b] != after[b]} == set(touched)
    assert touched == state.touched(delta)
    plain = cdc.upsert_seen(keys(spark, 0, 2000), delta, now())
    assert content(state.read()) == content(plain) == content(Versioned(spark, state.root, SEEN).read())
    some = content(state.read(touched))
    assert set(some) <= set(content(plain)) and 20 <= len(some) < 1000
    state.close()
    assert tables() == others


def test_state_rows_are_not_shuffled(spark, tmp_path):
    state, book = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=8), Bucketed(spark, str(tmp_path / "b"), LEDGER, buckets=8)
    state.write(keys(spark, 0, 500))
    entry = {f.name: F.lit(None).cast(f.dataType) for f in LEDGER.fields if f.name not in cdc.KEY}
    book.write(keys(spark, 0, 100).select(*cdc.KEY).withColumns(entry | {"finance_status": F.lit("sent"), "sent_at": now()}))
    keys(spark, 400, 600, "new").withColumns({"fingerprint": F.substring_index("dedup_key", "|#", 1)}).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    exchanges = lambda text: [line.strip(" :+-") for line in text.splitlines() if "Exchange" in line]
    for found in (
        cdc.upsert_seen(state.read(), state.aligned(rows), now()),
        cdc.keyed_against(rows.drop("dedup_key"), state.read(), book.read(), buckets=8),
        ledger.merge(book.read(), book.aligned(rows.withColumns({"finance_status": F.lit("failed"), "reason": F.lit("x"), "api_status": F.lit(500), "finance_transaction_id": F.lit("i")})), now()),
    ):
        only = exchanges(plan(found))
        print(plan(found))
        assert len(only) == 1 and "REPARTITION_BY_NUM" in only[0] and "Bucketed: true" in plan(found)
    some = state.touched(rows.limit(3))
    assert f"SelectedBucketsCount: {len(some)}" in plan(state.read(some)) or plan(state.read(some)).count("bucket=") <= len(some)


def test_an_empty_delta_writes_nothing(spark, tmp_path):
    state = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=4)
    assert state.merge(keys(spark, 0, 0), upsert) == [] and not Files(spark).names(state.root)
    assert state.read().count() == 0 and state.merge(keys(spark, 0, 30), upsert)
    files = Files(spark)
    names = files.names(state.root)
    assert state.merge(keys(spark, 0, 0), upsert) == [] and state.current()["number"] == 1
    assert state.merge(keys(spark, 0, 0), upsert, {"batch": 7}) == [] and state.notes() == {"batch": 7} and files.names(state.root) == names
    assert state.read().count() == 30


def test_old_state_is_put_into_buckets(spark, tmp_path):
    old = Versioned(spark, str(tmp_path / "s"), SEEN)
    old.write(keys(spark, 0, 50), {"kept": 1})
    state = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=4)
    assert content(state.read()) == content(old.read())
    state.merge(keys(spark, 40, 60, "new"), upsert)
    assert len(state.current()["folders"]) == 4 and state.notes() == {"kept": 1}
    assert content(state.read()) == content(cdc.upsert_seen(keys(spark, 0, 50), keys(spark, 40, 60, "new"), now()))


def test_versions_are_kept_and_tidied(spark, tmp_path):
    state, files = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=16, keep=2), Files(spark)
    state.write(keys(spark, 0, 200))
    for i in range(4):
        state.merge(keys(spark, i, i + 1, f"v{i}"), upsert)
    assert content(state.read()) == content(cdc.upsert_seen(keys(spark, 0, 200), keys(spark, 0, 4, "x").withColumn("content_hash", F.concat(F.lit("v"), "seq")), now()))
    held = {f for n in state._numbers()[:2] for f in state._pointer(n)["folders"].values()}
    there = {f"{v}/{b}" for v in files.names(state.root) if v.startswith("v-") for b in files.names(f"{state.root}/{v}") if b.startswith("bucket=")}
    assert there == held
    # What a run that was cut off left behind doesn't count, and goes.
    files.create(f"{state.root}/v-0000000001-gone/bucket=3/x.parquet", "cut off")
    files.create(f"{state.root}/pointers/9", '{"folder": "v-')
    assert state.read().count() == 200
    state.merge(keys(spark, 300, 301), upsert)
    assert state.current()["number"] == 10 and state.read().count() == 201 and "v-0000000001-gone" not in files.names(state.root)
    for n in state._numbers():
        files.delete(f"{state.root}/pointers/{n}")
    with pytest.raises(Lost):
        state.read()


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, other = (Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=4) for _ in range(2))
    assert one.read().isEmpty() and other.read().isEmpty()
    one.merge(keys(spark, 0, 5), upsert)
    with pytest.raises(Moved):
        other.merge(keys(spark, 5, 9), upsert)
    assert one.read().count() == 5
    with pytest.raises(ValueError, match="aren't replaced"):
        one.replace(keys(spark, 0, 50), [0])
    assert one.read().count() == 5


def test_another_number_of_buckets(spark, tmp_path):
    state = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=2)
    state.write(keys(spark, 0, 100), {"n": 1})
    before = content(state.read())
    state.rebucket(32)
    again = Bucketed(spark, state.root, SEEN, buckets=5)
    assert again.buckets == 32 and len(again.current()["folders"]) > 20 and content(again.read()) == before and again.notes() == {"n": 1}
    again.merge(keys(spark, 100, 120), upsert)
    assert again.read().count() == 120


def test_a_manifest_is_plain_json(spark, tmp_path):
    state = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=2)
    state.write(keys(spark, 0, 10))
    told = json.loads((tmp_path / "s/pointers/1").read_text())
    assert told["buckets"] == 2 and set(told["folders"]) == {"0", "1"}
