"""Change capture: which rows of a run are new, changed or known, against the state that earlier runs left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.identity import classify, content_hash, fingerprint, local_tag
from weirflow.sources.store import written

#: State never crosses accounts, so every join and window has the account in its key.
ACCOUNT = ["provider", "provider_account_id"]
KEY = [*ACCOUNT, "dedup_key"]


def hashed(txn: DataFrame) -> DataFrame:
    """``fingerprint`` and ``content_hash`` of every row; what is stamped on rows later doesn't change them."""
    return txn.withColumns({"fingerprint": fingerprint(), "content_hash": content_hash()})


def _with_hashes(txn: DataFrame) -> DataFrame:
    return txn if "fingerprint" in txn.columns else hashed(txn)


def _nth_key(n: Column) -> Column:
    return F.when(n == 1, F.col("fingerprint")).otherwise(F.concat(F.col("fingerprint"), F.lit("|#"), n.cast("string")))


PRINT = [*ACCOUNT, "fingerprint"]
#: Rows that share a fingerprint from which they are numbered by ranges; of how many rows one is looked at to find such
#: fingerprints; most ranges of one; bytes of keys and bounds that may be broadcast; bytes that a row has at least.
HOT_ROWS, LOOKED_AT, RANGES, BROADCAST, ROW_BYTES = 1_000_000, 1_000, 256, 8 << 20, 16


def occurrence_keys(txn: DataFrame, order: tuple[str, ...] = ("seq",), hot: int = HOT_ROWS) -> DataFrame:
    """dedup_key: the fingerprint for its first row in the account, fingerprint|#n for the n-th; with fingerprint and content_hash.

    Both hashes are computed once, before the shuffle; it is by (account, fingerprint), so a busy account spreads over all
    tasks. Rows that share a fingerprint are numbered by ``order``, which must be a real key of the input, its last column a number. Where
    about ``hot`` rows or more share one, they are cut into ranges of ``order``, numbered within each, and moved on by what the
    ranges before hold, so that they spread over tasks too.
    """
    rows = _with_hashes(txn)
    n = F.row_number().over(Window.partitionBy(*PRINT).orderBy(*order))
    bounds = hot_bounds(rows, order, hot)
    if bounds is None:
        return rows.withColumn("dedup_key", _nth_key(n))
    cold = rows.join(_small(bounds).select(*PRINT), PRINT, "left_anti").withColumn("dedup_key", _nth_key(n))
    return cold.unionByName(_numbered_by_ranges(rows, bounds, order))


def hot_bounds(rows: DataFrame, order: tuple[str, ...], hot: int) -> DataFrame | None:
    """(account, fingerprint, bounds) of the fingerprints that about ``hot`` rows or more share, where to cut ``order``'s last
    column; None where there is none.

    A sample by hash finds them; it decides how rows are numbered, not which numbers they get. Input that is too small to
    hold so many rows isn't looked at.
    """
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < hot * ROW_BYTES:
        return None
    share = min(LOOKED_AT, max(1, hot // 100))
    seen = rows.where(F.pmod(F.xxhash64(*order), F.lit(share)) == 0) if share > 1 else rows
    fractions = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    found = seen.groupBy(*PRINT).agg(F.count("*").alias("n"), F.percentile_approx(F.col(order[-1]).cast("double"), fractions, F.lit(10_000)).alias("bounds")).where(F.col("n") >= hot / share / 2)
    # As many ranges as there are times a tenth of ``hot``.
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES * hot / 10 / share) / F.col("n"))).cast("int")
    found = found.select(*PRINT, F.array_distinct(F.filter("bounds", lambda b, i: (i + 1) % step == 0)).alias("bounds"))
    found = written(found, "hot")
    return None if found.isEmpty() else found


def _small(bounds: DataFrame) -> DataFrame:
    return F.broadcast(bounds) if bounds.count() * RANGES * 8 <= BROADCAST else bounds


def _numbered_by_ranges(rows: DataFrame, bounds: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows of hot fingerprints with their dedup_key."""
    last = F.col(order[-1]).cast("double")
    cut = rows.join(_small(bounds), PRINT).withColumn("_range", F.size(F.filter("bounds", lambda b: b < last))).drop("bounds")
    cell = [*PRINT, *order[:-1], "_range"]
    counts = cut.groupBy(*cell).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*PRINT).orderBy(*order[:-1], "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cell]
    # A row a range: as small as the bounds.
    starts = F.broadcast(starts) if bounds.count() * RANGES * 64 <= BROADCAST else starts
    joined = cut.withColumn("_n", n).alias("r").join(starts.alias("s"), same, "left")
    numbered = joined.withColumn("_number", F.col("_n") + F.col("_start")).select("r.*", "_number").drop("_n", "_range")
    return numbered.withColumn("dedup_key", _nth_key(F.col("_number"))).drop("_number")


def stored_fingerprint(stored: DataFrame) -> Column:
    """The fingerprint of stored rows: a column of theirs, or the key without its number."""
    return F.col("fingerprint") if "fingerprint" in stored.columns else F.substring_index("dedup_key", "|#", 1).alias("fingerprint")


def keyed_against(txn: DataFrame, seen: DataFrame | None, ledger: DataFrame | None = None, order: tuple[str, ...] = ("seq",), full_fetch: bool = False, buckets: int | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """``occurrence_keys`` and ``against_seen`` in one shuffle of the rows; with ``ledger``, its entry in ``ledger_entry`` too.

    State and ledger rows go through the rows' own shuffle, by (account, fingerprint), and meet them in a window over the
    whole key, which that partitioning serves. A join would need one by all its keys, so a second shuffle. Work stays in
    proportion to the rows, however many share a fingerprint. Numbered keys can't repeat, so there is no search for repeats.

    Where state and ledger lie in ``buckets`` of (account, fingerprint) (``sources.buckets``), only the run's rows are
    shuffled, into as many parts; state rows stay where they are. Rows of hot fingerprints (``occurrence_keys``) are numbered by ranges and
    joined by their whole keys.
    """
    hashed_rows = _with_hashes(txn)
    bounds = hot_bounds(hashed_rows, order, hot)
    if bounds is None:
        return _keyed_against(hashed_rows, seen, ledger, order, full_fetch, buckets)
    few = _small(bounds).select(*PRINT)
    part = lambda df, how: None if df is None else df.select("*", *([] if "fingerprint" in df.columns else [stored_fingerprint(df)])).join(few, PRINT, how)
    cold = _keyed_against(part(hashed_rows, "left_anti"), part(seen, "left_anti"), part(ledger, "left_anti"), order, full_fetch, buckets)
    warm = _numbered_by_ranges(hashed_rows, bounds, order)
    known = seen is not None and not full_fetch
    if known:
        warm = warm.join(part(seen, "left_semi").select(*KEY, F.struct("content_hash").alias("_seen")), KEY, "left")
    if ledger is not None:
        warm = warm.join(part(ledger, "left_semi").select(*KEY, ledger_entry().alias("ledger_entry")), KEY, "left")
    kind = classify(F.col("_seen").isNotNull(), F.col("_seen.content_hash"), F.col("content_hash")) if known else F.lit("created")
    warm = warm.withColumn("kind", kind).withColumn("local_dedup_status", local_tag(F.col("kind"), F.lit(False)))
    return cold.unionByName(warm.select(cold.columns))


def _keyed_against(hashed_rows: DataFrame, seen: DataFrame | None, ledger: DataFrame | None, order: tuple[str, ...], full_fetch: bool, buckets: int | None) -> DataFrame:
    rows = hashed_rows.withColumn("_side", F.lit(0))
    if buckets:
        rows = rows.repartition(buckets, *ACCOUNT, "fingerprint")
    names = rows.columns
    wants_seen = seen is not None and not full_fetch
    if wants_seen:
        rows = rows.unionByName(seen.select(*ACCOUNT, stored_fingerprint(seen), F.col("dedup_key").alias("_stored_key"), F.struct("content_hash").alias("_seen"), F.lit(1).alias("_side")), allowMissingColumns=True)
    if ledger is not None:
        rows = rows.unionByName(ledger.select(*ACCOUNT, stored_fingerprint(ledger), F.col("dedup_key").alias("_stored_key"), ledger_entry().alias("_entry"), F.lit(1).alias("_side")), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*ACCOUNT, "fingerprint").orderBy("_side", *order))
    key = _nth_key(n)
    if "_stored_key" in rows.columns:
        key = F.when(F.col("_side") == 0, key).otherwise(F.col("_stored_key"))
    rows = rows.withColumn("dedup_key", key)
    whole = Window.partitionBy(*ACCOUNT, "fingerprint", "dedup_key")
    if wants_seen:
        rows = rows.withColumn("_seen", F.max("_seen").over(whole))
    if ledger is not None:
        rows = rows.withColumn("ledger_entry", F.max("_entry").over(whole))
    kind = classify(F.col("_seen").isNotNull(), F.col("_seen.content_hash"), F.col("content_hash")) if wants_seen else F.lit("created")
    found = rows.where("_side = 0").withColumn("kind", kind).withColumn("local_dedup_status", local_tag(F.col("kind"), F.lit(False)))
    kept = [c for c in names if c not in ("_side", "dedup_key", "kind", "local_dedup_status", "ledger_entry")]
    return found.select(*kept, "dedup_key", "kind", "local_dedup_status", *(["ledger_entry"] if ledger is not None else []))


def ledger_entry() -> Column:
    """What a decision needs of a ledger row: whether it was sent, with which content, and whether a send of it is in doubt."""
    sent = F.coalesce(F.col("finance_status") == "sent", F.lit(False)) & F.col("sent_at").isNotNull()
    in_doubt = ~sent & F.coalesce(F.col("reason") == "outcome_unknown", F.lit(False))
    return F.struct(sent.alias("sent"), F.col("content_hash").alias("content_hash"), in_doubt.alias("in_doubt"))


def repeats_in_run(keyed: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``repeated``: a row with the same dedup_key comes earlier in the run."""
    return keyed.withColumn("repeated", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) > 1)


def against_seen(keyed: DataFrame, seen: DataFrame, full_fetch: bool = False) -> DataFrame:
    """``kind`` (created, updated, unchanged) and ``local_dedup_status`` (new, updated, unchanged, duplicate) of every row.

    For rows that have their keys already, from wherever: one shuffle by the key serves the search for repeats and the join
    (Spark broadcasts the state while it is small). ``keyed_against`` makes keys and classes together.
    """
    rows = repeats_in_run(keyed)
    if full_fetch:
        rows = rows.withColumn("kind", F.lit("created"))
    else:
        stored = seen.select(*KEY, F.col("content_hash").alias("_stored"), F.lit(True).alias("_seen"))
        rows = rows.join(stored, KEY, "left").withColumn("kind", classify(F.col("_seen"), F.col("_stored"), F.col("content_hash"))).drop("_stored", "_seen")
    return rows.withColumn("local_dedup_status", local_tag(F.col("kind"), F.col("repeated"))).drop("repeated")


def exported(classified: DataFrame) -> DataFrame:
    """The delta: rows that are new or updated."""
    return classified.where(F.col("local_dedup_status").isin("new", "updated"))


def never_seen(keyed: DataFrame, seen: DataFrame) -> DataFrame:
    return keyed.join(seen.select(*KEY), KEY, "left_anti")


def seen_before(keyed: DataFrame, seen: DataFrame) -> DataFrame:
    return keyed.join(seen.select(*KEY), KEY, "left_semi")


def counted() -> dict[str, Column]:
    """created, updated, unchanged, duplicates, exported, considered: what is counted of classified rows, for an aggregation or
    an observation."""
    count = lambda *tags: F.count_if(F.col("local_dedup_status").isin(*tags))
    return {
        "created": count("new"),
        "updated": count("updated"),
        "unchanged": count("unchanged"),
        "duplicates": count("duplicate"),
        "exported": count("new", "updated"),
        "considered": F.count("*"),
    }


def counters(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The counters of each account: one conditional aggregation."""
    return classified.groupBy(*(ACCOUNT if by is None else by)).agg(*[c.alias(n) for n, c in counted().items()])


def run_status(error: Column, warnings: Column) -> Column:
    """failed with an error, partial with a warning of this run, else success."""
    return F.when(error.isNotNull(), "failed").when(F.coalesce(F.size(warnings), F.lit(0)) > 0, "partial").otherwise("success")


def upsert_seen(seen: DataFrame, delta: DataFrame, now: Column) -> DataFrame:
    """The state after a run that exported ``delta``, with its fingerprints: old and new rows of a key meet in one aggregation.

    A new key has no updated_at; a changed hash sets it; the same hash, or none stored before, keeps it. Keys that the run
    didn't export stay as they are. Grouped by fingerprint and key, so state in buckets isn't shuffled.
    """
    old = seen.select(*KEY, stored_fingerprint(seen), F.struct("content_hash", "last_seen_at", "updated_at").alias("_old"), F.lit(None).cast("struct<seq: bigint, hash: string>").alias("_new"))
    new = delta.select(*KEY, stored_fingerprint(delta), F.lit(None).cast(old.schema["_old"].dataType).alias("_old"), F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("content_hash").alias("hash")).alias("_new"))
    # One row a key: a later row of the run wins. The shuffled rows come first: the union takes its partitioning from there.
    met = new.unionByName(old).groupBy(*KEY, "fingerprint").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    fresh = F.col("_new").isNotNull()
    changed = fresh & F.col("_old.content_hash").isNotNull() & (F.col("_old.content_hash") != F.col("_new.hash"))
    return met.select(
        *KEY,
        F.when(fresh, F.col("_new.hash")).otherwise(F.col("_old.content_hash")).alias("content_hash"),
        F.when(fresh, now).otherwise(F.col("_old.last_seen_at")).alias("last_seen_at"),
        F.when(changed, now).otherwise(F.col("_old.updated_at")).alias("updated_at"),
        "fingerprint",
    )


def seen_from_files(files: DataFrame) -> DataFrame:
    """State rows from (provider, provider_account_id, data) rows of state files' JSON.

    Version 2 has ``entries`` (key -> hash and times), version 1 ``fingerprints`` (keys without a hash); anything else is
    an empty state.
    """
    kind = "struct<entries: map<string, struct<contentHash: string, lastSeenAt: string, updatedAt: string>>, fingerprints: array<string>>"
    parsed = files.select(*ACCOUNT, F.from_json("data", kind).alias("s"))
    v2 = parsed.where("s.entries is not null").select(*ACCOUNT, F.explode("s.entries").alias("dedup_key", "e"))
    v2 = v2.select(*KEY, F.col("e.contentHash").alias("content_hash"), F.try_to_timestamp("e.lastSeenAt").alias("last_seen_at"), F.try_to_timestamp("e.updatedAt").alias("updated_at"))
    v1 = parsed.where("s.entries is null and s.fingerprints is not null").select(*ACCOUNT, F.explode("s.fingerprints").alias("dedup_key")).distinct()
    none = F.lit(None)
    return v2.unionByName(v1.select(*KEY, none.cast("string").alias("content_hash"), none.cast("timestamp").alias("last_seen_at"), none.cast("timestamp").alias("updated_at")))
