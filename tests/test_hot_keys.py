"""Fingerprints that very many rows share: numbered by ranges, with the same keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_engine import X1, X2, seen, txns
from weirflow.operators import cdc

KEYS = ["provider_account_id", "seq", "dedup_key"]


def many(spark, n, segments=1):
    """n rows of one fingerprint in one account, some of others."""
    one = txns(spark, [X1]).drop("seq")
    hot = one.crossJoin(spark.range(n).select((F.col("id") * 7 % 1_000_003).alias("seq"), (F.col("id") % segments).alias("segment")))
    rest = txns(spark, [X1, X2], "b").unionByName(txns(spark, [X2, X2])).withColumns({"seq": F.monotonically_increasing_id(), "segment": F.lit(0).cast("long")})
    return hot.unionByName(rest, allowMissingColumns=True)


def picked(df, *more):
    return sorted(tuple(r) for r in df.select(*KEYS, *more).collect())


@pytest.mark.parametrize(("segments", "order"), [(1, ("seq",)), (3, ("segment", "seq"))])
def test_ranges_give_the_same_keys(spark, segments, order):
    rows = many(spark, 4000, segments)
    plain = cdc.occurrence_keys(rows, order, hot=10**12)
    cut = cdc.occurrence_keys(rows, order, hot=500)
    assert picked(cut) == picked(plain) and sorted(cut.columns) == sorted(plain.columns)
    bounds = cdc.hot_bounds(cdc.hashed(rows), order, 500).collect()
    assert len(bounds) == 1 and len(bounds[0].bounds) > 20
    assert cdc.hot_bounds(cdc.hashed(rows), order, 50_000) is None


def test_equal_order_values_stay_in_one_range(spark):
    rows = many(spark, 2000).withColumn("seq", F.when(F.col("seq") % 2 == 0, F.lit(5).cast("long")).otherwise(F.col("seq")))
    got = cdc.occurrence_keys(rows, hot=300)
    assert got.select("provider_account_id", "dedup_key").distinct().count() == rows.count()


def test_hot_rows_meet_state_and_ledger(spark):
    rows = many(spark, 3000)
    keys = [r.dedup_key for r in cdc.occurrence_keys(rows.where("provider_account_id <> 'b'")).select("dedup_key").collect()]
    hashes = cdc.hashed(rows.limit(1)).first().content_hash
    state = seen(spark, [(k, (hashes, "stale", None)[i % 3]) for i, k in enumerate(sorted(keys)[:1500])])
    book = state.select(*cdc.KEY, F.lit("sent").alias("finance_status"), F.lit("x").alias("reason"), "content_hash", F.lit("2026-01-01").cast("timestamp").alias("sent_at"))
    more = ("kind", "local_dedup_status", "ledger_entry")
    plain, cut = (cdc.keyed_against(rows, state, book, hot=h) for h in (10**12, 400))
    assert picked(cut, *more) == picked(plain, *more) and len({r.kind for r in cut.collect()}) == 3
    assert picked(cdc.keyed_against(rows, state, full_fetch=True, hot=400), "kind") == picked(cdc.keyed_against(rows, state, full_fetch=True), "kind")


def test_a_hot_fingerprint_spreads_over_tasks(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so few rows would go to one task for their size
    try:
        cut = cdc.occurrence_keys(many(spark, 20_000), hot=2000)
        sizes = [r[1] for r in cut.where("provider_account_id <> 'b'").select(F.spark_partition_id().alias("p"), "dedup_key").groupBy("p").agg(F.count_distinct("dedup_key")).collect()]
    finally:
        spark.conf.unset(coalesce)
    assert max(sizes) < 12_000
