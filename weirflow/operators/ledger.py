"""The ledger of what was sent: deciding, recording and auditing a sync run.

Decided once, where nothing observable settles it: gates are asked in the order of ``GATES``; row rules in the order not
completed, no positive charge, duplicate, sent with other content, sent, send; a sent entry without a hash counts as not
changed; all rules see the ledger as it was at the run's start. A row of which a run was cut off while sending it is held back
until the system was asked for it by its external id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.identity import content_hash
from weirflow.operators.cdc import KEY, ledger_entry, stored_fingerprint
from weirflow.operators.outbound import positive

#: Reasons for which a whole run sends nothing, in the order in which they are asked.
GATES = ["finance_disabled", "missing_api_url", "missing_api_key", "fetch_failed"]
FETCH_ONLY = "run_mode_fetch_only"
SENT = "already_sent_successfully"
#: Why a row is held back whose earlier send may or may not have been made.
DOUBTED = "earlier_send_in_doubt"


def run_gate(enabled: bool, api_url: str | None, api_key: str | None, fetch_succeeded: bool) -> str | None:
    """Why this run may not send, or None."""
    for reason, closed in zip(GATES, (not enabled, not api_url, not api_key, not fetch_succeeded), strict=True):
        if closed:
            return reason
    return None


def gate_column(enabled: Column, api_url: Column, api_key: Column, fetch_succeeded: Column) -> Column:
    """The same for a table of runs."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    closed = (~F.coalesce(enabled, F.lit(False)), blank(api_url), blank(api_key), ~F.coalesce(fetch_succeeded, F.lit(False)))
    found = F.lit(None).cast("string")
    for reason, c in reversed(list(zip(GATES, closed, strict=True))):
        found = F.when(c, reason).otherwise(found)
    return found


def decide(considered: DataFrame, ledger: DataFrame, gate: str | None = None) -> DataFrame:
    """``decision`` (send, already_sent, skipped, not_attempted) and ``reason`` of every considered row.

    Rows of ``cdc.keyed_against`` with a ledger bring their entry along, and keys that can't repeat: nothing is shuffled
    again. Any others are joined with the ledger by account and key.
    """
    rows = considered if "content_hash" in considered.columns else considered.withColumn("content_hash", content_hash())
    if gate is not None:
        return rows.withColumns({"decision": F.lit("not_attempted"), "reason": F.lit(gate)}).drop("ledger_entry")
    again = F.coalesce(F.col("local_dedup_status") == "duplicate", F.lit(False))
    if "ledger_entry" in rows.columns:
        joined = rows.withColumns({"_again": again, "_entry": F.col("ledger_entry")}).drop("ledger_entry")
    else:
        stored = ledger.select(*KEY, ledger_entry().alias("_entry"))
        repeated = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")) > 1
        joined = rows.withColumn("_again", repeated | again).join(stored, KEY, "left")
    sent, stored_hash = F.coalesce(F.col("_entry.sent"), F.lit(False)), F.col("_entry.content_hash")
    reason = (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "completed", "transaction_not_completed")
        .when(~positive(F.col("charge_amount")), "charge_amount_zero_or_negative")
        .when(F.col("_again"), "duplicate_in_current_batch")
        .when(sent & stored_hash.isNotNull() & (stored_hash != F.col("content_hash")), "already_sent_content_changed")
        .when(sent, SENT)
        .when(F.coalesce(F.col("_entry.in_doubt"), F.lit(False)), DOUBTED)
    )
    decision = F.when(F.col("reason").isNull(), "send").when(F.col("reason") == SENT, "already_sent").otherwise("skipped")
    return joined.withColumn("reason", reason).withColumn("decision", decision).drop("_again", "_entry")


def with_results(decided: DataFrame, results: DataFrame) -> DataFrame:
    """``finance_status`` and reason of every row after the sends of ``results``."""
    got = results.select(*KEY, "seq", "ok", "classification", "api_status", F.col("finance_transaction_id").alias("_id"))
    joined = decided.join(got, [*KEY, "seq"], "left")
    status = F.when(F.col("decision") != "send", F.col("decision")).when(F.col("ok"), "sent").otherwise("failed")
    reason = F.when(F.col("decision") != "send", F.col("reason")).when(F.col("ok"), "sent").otherwise(F.coalesce("classification", F.lit("api_error")))
    return joined.withColumns({"finance_status": status, "reason": reason, "finance_transaction_id": F.col("_id")}).drop("ok", "classification", "_id")


def merge(ledger: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """The ledger after a run, with its fingerprints: entries and attempts of a key meet in one aggregation, by which a ledger
    in buckets isn't shuffled.

    A success stores hash, status and id; a failure stores its reason and keeps what was known; a failure after a success
    only moves the time and number of attempts. Entries without an attempt stay. Of several attempts at a key a success counts.
    """
    known = ["finance_status", "reason", "content_hash", "api_status", "finance_transaction_id", "sent_at", "last_attempt_at", "attempts"]
    attempt_type = "struct<ok: boolean, reason: string, hash: string, status: int, id: string>"
    old = ledger.select(*KEY, stored_fingerprint(ledger), F.struct(*known).alias("_was"), F.lit(None).cast(attempt_type).alias("_tried"))
    tried = F.struct((F.col("finance_status") == "sent").alias("ok"), "reason", F.col("content_hash").alias("hash"), F.col("api_status").cast("int").alias("status"), F.col("finance_transaction_id").alias("id"))
    new = finished.where(F.col("finance_status").isin("sent", "failed")).select(*KEY, stored_fingerprint(finished), F.lit(None).cast(old.schema["_was"].dataType).alias("_was"), tried.alias("_tried"))
    j = new.unionByName(old).groupBy(*KEY, "fingerprint").agg(F.max("_was").alias("_was"), F.max("_tried").alias("_tried"))
    was, got = (lambda c: F.col(f"_was.{c}")), (lambda c: F.col(f"_tried.{c}"))
    won = F.coalesce((was("finance_status") == "sent") & was("sent_at").isNotNull(), F.lit(False))
    attempt, ok = F.col("_tried").isNotNull(), F.coalesce(got("ok"), F.lit(False))
    fresh_failure = attempt & ~ok & ~won
    pick = lambda old, success, failure: F.when(ok, success).when(fresh_failure, failure).otherwise(old)
    return j.select(
        *KEY,
        pick(was("finance_status"), F.lit("sent"), F.lit("failed")).alias("finance_status"),
        pick(was("reason"), F.lit(SENT), got("reason")).alias("reason"),
        pick(was("content_hash"), got("hash"), was("content_hash")).alias("content_hash"),
        pick(was("api_status"), got("status"), got("status")).alias("api_status"),
        pick(was("finance_transaction_id"), got("id"), was("finance_transaction_id")).alias("finance_transaction_id"),
        F.when(ok, now).otherwise(was("sent_at")).alias("sent_at"),
        F.when(attempt, now).otherwise(was("last_attempt_at")).alias("last_attempt_at"),
        F.when(attempt, F.coalesce(was("attempts"), F.lit(0)) + 1).otherwise(was("attempts")).alias("attempts"),
        "fingerprint",
    )


def in_doubt() -> Column:
    """Entries whose last send may or may not have been made."""
    return ledger_entry()["in_doubt"]


def attempts_of(results: DataFrame) -> DataFrame:
    """Results of sends (``schema.RESULT``) in the form ``merge`` takes."""
    status = F.when(F.col("ok"), "sent").otherwise("failed")
    reason = F.when(F.col("ok"), "sent").otherwise(F.coalesce("classification", F.lit("api_error")))
    return results.select(*KEY, status.alias("finance_status"), reason.alias("reason"), "content_hash", "api_status", "finance_transaction_id")


def fetch_succeeded(accounts: DataFrame) -> DataFrame:
    """Whether any account of a run (status) was read, wholly or in part; false for no account."""
    return accounts.agg(F.coalesce(F.bool_or(F.col("status").isin("success", "partial")), F.lit(False)).alias("fetch_succeeded"))


def sync_ok(gate: Column, failed: Column) -> Column:
    """A sync is well if it was made and nothing failed."""
    return gate.isNull() & (F.coalesce(failed, F.lit(0)) == 0)


def sync_counts(finished: DataFrame) -> DataFrame:
    """considered, sent, already_sent, skipped, failed, not_attempted."""
    names = ["sent", "already_sent", "skipped", "failed", "not_attempted"]
    return finished.agg(F.count("*").alias("considered"), *[F.count_if(F.col("finance_status") == n).alias(n) for n in names])


def audit(finished: DataFrame, run_id: str, timestamp: str) -> DataFrame:
    """A row for each considered row, in the columns and order of the report."""
    column = lambda c: F.col(c) if c in finished.columns else F.lit(None)
    return finished.select(
        F.lit(run_id).alias("runId"),
        F.lit(timestamp).alias("timestamp"),
        "provider",
        F.col("provider_account_id").alias("accountId"),
        F.col("provider_display_name").alias("accountLabel"),
        F.col("transaction_date").alias("transactionDate"),
        F.col("merchant_name").alias("merchant"),
        "amount",
        F.col("charge_amount").alias("chargeAmount"),
        "currency",
        "status",
        F.col("local_dedup_status").alias("localDedupStatus"),
        F.col("finance_status").alias("financeStatus"),
        "reason",
        column("api_status").cast("int").alias("apiStatus"),
        column("finance_transaction_id").cast("string").alias("financeTransactionId"),
        F.col("dedup_key").alias("dedupKey"),
    )


def ledger_from_files(files: DataFrame) -> DataFrame:
    """Ledger rows from (provider, provider_account_id, data) rows of ledger files' JSON; anything unreadable is empty."""
    entry = "financeStatus: string, reason: string, contentHash: string, apiStatus: int, financeTransactionId: string, sentAt: string, lastAttemptAt: string, attempts: int"
    parsed = files.select("provider", "provider_account_id", F.from_json("data", f"struct<entries: map<string, struct<{entry}>>>").alias("s"))
    rows = parsed.where("s.entries is not null").select("provider", "provider_account_id", F.explode("s.entries").alias("dedup_key", "e"))
    return rows.select(
        *KEY,
        F.col("e.financeStatus").alias("finance_status"),
        F.col("e.reason").alias("reason"),
        F.col("e.contentHash").alias("content_hash"),
        F.col("e.apiStatus").alias("api_status"),
        F.col("e.financeTransactionId").alias("finance_transaction_id"),
        F.try_to_timestamp("e.sentAt").alias("sent_at"),
        F.try_to_timestamp("e.lastAttemptAt").alias("last_attempt_at"),
        F.col("e.attempts").alias("attempts"),
    )
